"""Queries of the corpus operators on the test tables, with their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.llm import grid_clusters, leak, mixing, neighbours, runs, sentences, vectors
from motionlake.session import read_table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    r = runs.collapse_runs(read_table(spark, d, "features"), ["handle", "take"], "frame", ["flag", "mask"])
    return r.filter("n >= 2").select("handle", "take", F.col("first").alias("first_frame"), F.col("last").alias("last_frame"))


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(read_table(spark, d, "features"), ["handle", "take"], "frame", ["flag", "mask"])


DIM = 48


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.usable_vectors(read_table(spark, d, "features"), ["handle", "take", "frame"], "row_id", "data", DIM)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, d), 0.99, DIM).select("row_id_a", "row_id_b")


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_classes(_vectors(spark, d), 0.99, DIM)


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20, against all rows."""
    v = _vectors(spark, d)
    return neighbours.nearest(v, v.filter("row_id % 20 = 0"), 5, DIM).select("query_id", "rank", "row_id", F.round("cosine", 4).alias("cosine"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return grid_clusters.cluster(_vectors(spark, d), DIM).select("cluster_row_id", "row_id")


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return grid_clusters.describe(grid_clusters.cluster(_vectors(spark, d), DIM))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).filter("exact").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = read_table(spark, d, "mix_targets")
    return mixing.report(mixing.mixture(read_table(spark, d, "documents"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(read_table(spark, d, "documents"), plain_only=True).select("doc_id", "sent_start")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(read_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_runs, p6_found, p6_classes, p6_nearest, p7_found, p7_groups, p8_found, p8_leaks, p9_mixture, p9_shares, p10_found, p10_sentences)}
_ONE = "SELECT *, row_number() OVER (PARTITION BY handle, take, frame ORDER BY row_id) AS k FROM features"

_UNIT = f"""u AS (
  SELECT row_id, [CAST(x AS DOUBLE) FOR x IN data] AS v FROM ({_ONE}) q
  WHERE k = 1 AND len(data) = 48 AND len([1 FOR x IN data IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([1 FOR x IN data IF x <> 0]) > 0
)"""

_RUNS = f"""WITH RECURSIVE d AS (
  SELECT handle, take, frame, flag, mask, row_number() OVER (PARTITION BY handle, take ORDER BY frame) AS rn FROM ({_ONE}) q WHERE k = 1 AND frame IS NOT NULL
), r AS (
  SELECT handle, take, rn, frame, flag, mask, frame AS first_frame FROM d WHERE rn = 1
  UNION ALL
  SELECT handle, take, rn, frame, CASE WHEN goes_on THEN coalesce(known_flag, flag) ELSE flag END, CASE WHEN goes_on THEN coalesce(known_mask, mask) ELSE mask END, CASE WHEN goes_on THEN first_frame ELSE frame END
  FROM (SELECT d.*, r.flag AS known_flag, r.mask AS known_mask, r.first_frame,
      d.frame - r.frame <= 5 AND NOT coalesce(d.flag <> r.flag, FALSE) AND NOT coalesce(d.mask <> r.mask, FALSE) AS goes_on
    FROM r JOIN d ON d.handle IS NOT DISTINCT FROM r.handle AND d.take IS NOT DISTINCT FROM r.take AND d.rn = r.rn + 1) s
)
"""

SQL: dict[str, str] = {
    "p4_found": _RUNS + "SELECT handle, take, first_frame, max(frame) AS last_frame FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2",
    "p4_runs": _RUNS + "SELECT handle, take, first_frame AS first, max(frame) AS last, arg_max(flag, rn) AS flag, arg_max(mask, rn) AS mask, count(*) AS n, max(frame) - first_frame AS duration FROM r GROUP BY 1, 2, 3",
    "p6_classes": f"""WITH {_UNIT}, c AS (SELECT row_id, v, min(row_id) OVER (PARTITION BY v) AS class_id, count(*) OVER (PARTITION BY v) AS copies FROM u),
l AS (SELECT a.row_id AS class_id, count(*) AS links FROM c a JOIN c b ON a.row_id <> b.row_id WHERE a.row_id = a.class_id AND b.row_id = b.class_id AND list_cosine_similarity(a.v, b.v) >= 0.99 GROUP BY 1)
SELECT row_id, c.class_id, copies, coalesce(links, 0) AS links FROM c LEFT JOIN l ON c.class_id = l.class_id""",
    "p6_nearest": f"""WITH {_UNIT}, s AS (SELECT a.row_id AS query_id, b.row_id, list_cosine_similarity(a.v, b.v) AS cosine FROM u a JOIN u b ON a.row_id <> b.row_id WHERE a.row_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, row_id, round(cosine, 4) AS cosine FROM r WHERE rank <= 5""",
    "p6_found": f"WITH {_UNIT} SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM u a JOIN u b ON a.row_id < b.row_id WHERE list_cosine_similarity(a.v, b.v) >= 0.99",
    # a group is closed and complete exactly if all its rows have one and the same list of near rows
    "p7_found": f"""WITH {_UNIT}, near AS (
  SELECT a.row_id, list_sort(list(b.row_id)) AS rows FROM u a JOIN u b ON list_cosine_similarity(a.v, b.v) >= 0.87 GROUP BY 1
), groups AS (SELECT rows FROM near GROUP BY rows HAVING count(*) = len(rows) AND len(rows) >= 8)
SELECT rows[1] AS cluster_row_id, unnest(rows) AS row_id FROM groups""",
}
