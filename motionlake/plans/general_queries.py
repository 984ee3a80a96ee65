"""Queries of the general data-quality operators on the test tables, with their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.operators import drift, implausible, regular_grid, rejects
from motionlake.session import read_table


def _raw(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return drift.raw_tables(*(read_table(spark, d, n) for n in ("yolo3r_raw", "dlc_single", "dlcma_multi")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.report(drift.detect(_raw(spark, d), read_table(spark, d, "raw_files"))[1])


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    return drift.field_kinds(drift.detect(_raw(spark, d), read_table(spark, d, "raw_files"))[0])


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    tables = _raw(spark, d)
    return drift.unify(tables, *drift.detect(tables, read_table(spark, d, "raw_files")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(read_table(spark, d, "dlc_single"), read_table(spark, d, "dlcma_multi")).select("source_table", "line_id", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    dlc = rejects.loaded(read_table(spark, d, "dlc_single"), "dlc", "dlc_single")
    return dlc.unionByName(rejects.loaded(read_table(spark, d, "dlcma_multi"), "dlcma", "dlcma_multi"))


def _pose(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, d, "yolo3r"), read_table(spark, d, "recordings")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The slots that the model filled."""
    return regular_grid.regular_grid(*_pose(spark, d)).filter("filled AND x IS NOT NULL AND y IS NOT NULL").select("handle", "take", "slot")


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    g = regular_grid.regular_grid(*_pose(spark, d))
    return g.select("handle", "take", "slot", "n", "filled", *[F.when(~F.col("filled"), F.round(c, 6)).alias(f"{c}_observed") for c in "xy"])


def p2_filled(spark: SparkSession, d: str) -> DataFrame:
    g = regular_grid.regular_grid(*_pose(spark, d))
    return g.select("handle", "take", "slot", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "n", "filled")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible.flag_implausible(*_pose(spark, d)).select("handle", "take", "frame_index")


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    return implausible.flag_implausible(*_pose(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_kinds, p1_unified, p2_found, p2_grid, p2_filled, p3_found, p3_loaded, p5_found, p5_flags)}

_USABLE = """
usable AS (
  SELECT row_id, handle, take, frame_index, p1.x AS x, p1.y AS y, CASE WHEN isnan(p1.conf) THEN NULL ELSE p1.conf END AS conf
  FROM (SELECT *, row_number() OVER (PARTITION BY handle, take, frame_index ORDER BY row_id) AS k FROM yolo3r) q
  WHERE k = 1 AND frame_index IS NOT NULL AND p1.x IS NOT NULL AND p1.y IS NOT NULL AND NOT isnan(p1.x) AND NOT isnan(p1.y)
)"""

_SLOTS = _USABLE + """, slots AS (
  SELECT u.handle, u.take, CAST(floor(frame_index / CAST(grid_step AS DOUBLE)) AS BIGINT) AS slot, avg(x) AS x, avg(y) AS y, count(*) AS n
  FROM usable u JOIN recordings r ON u.handle IS NOT DISTINCT FROM r.handle AND u.take = r.take GROUP BY 1, 2, 3
), gaps AS (
  SELECT handle, take, slot, lead(slot) OVER (PARTITION BY handle, take ORDER BY slot) AS nxt FROM slots
), holes AS (
  SELECT handle, take, CAST(unnest(generate_series(slot + 1, nxt - 1)) AS BIGINT) AS slot FROM gaps WHERE nxt - slot > 1
)"""

_BASIS = "[1.0, slot / period, " + ", ".join(f"{f}(2 * pi() * {k} * slot / period)" for k in (1, 2) for f in ("sin", "cos")) + "]"
_AT = " + ".join(f"b[{i}] * beta_{{0}}[{i}]" for i in range(1, 7))
# normal equations with a ridge, solved by Gauss-Jordan steps, one pivot a round
_FILLED = "WITH RECURSIVE " + _SLOTS + f""", b AS (
  SELECT s.*, greatest(4.0, 60.0 * coalesce(fps, 30.0) / grid_step) AS period FROM slots s JOIN recordings r ON s.handle IS NOT DISTINCT FROM r.handle AND s.take = r.take
), m AS (SELECT *, {_BASIS} AS b FROM b
), sums AS (
  SELECT handle, take, {", ".join(f"sum(b[{i}] * b[{j}]) AS a{i}{j}" for i in range(1, 7) for j in range(i, 7))}, {", ".join(f"sum(b[{i}] * {v}) AS {v}{i}" for i in range(1, 7) for v in "xy")} FROM m GROUP BY 1, 2
), g AS (
  SELECT handle, take, 1 AS k, [{", ".join("[" + ", ".join((f"a{min(i, j)}{max(i, j)}" + (f" + 1e-6 * greatest(a{i}{i}, 1e-12)" if i == j else "")) for j in range(1, 7)) + f", x{i}, y{i}]" for i in range(1, 7))}] AS m FROM sums
  UNION ALL
  SELECT handle, take, k + 1, [CASE WHEN i = k THEN [v / m[k][k] FOR v IN m[k]] ELSE [v - m[i][k] * m[k][j] / m[k][k] FOR v, j IN m[i]] END FOR i IN range(1, 7)] FROM g WHERE k <= 6
), beta AS (SELECT handle, take, [r[7] FOR r IN m] AS beta_x, [r[8] FOR r IN m] AS beta_y FROM g WHERE k = 7
), ends AS (
  SELECT m.handle, m.take, slot, period, x, y, beta_x, beta_y, lead(slot) OVER w AS nslot, lead(x) OVER w AS nx, lead(y) OVER w AS ny,
    x - ({_AT.format("x")}) AS rx, y - ({_AT.format("y")}) AS ry FROM m JOIN beta ON m.handle IS NOT DISTINCT FROM beta.handle AND m.take = beta.take WINDOW w AS (PARTITION BY m.handle, m.take ORDER BY slot)
), nxt AS (
  SELECT *, lead(rx) OVER w AS nrx, lead(ry) OVER w AS nry FROM ends WINDOW w AS (PARTITION BY handle, take ORDER BY slot)
), f AS (
  SELECT handle, take, period, beta_x, beta_y, slot AS s0, nslot, rx, ry, nrx, nry, CAST(unnest(generate_series(slot + 1, nslot - 1)) AS BIGINT) AS slot FROM nxt WHERE nslot - slot > 1
), p AS (SELECT *, {_BASIS} AS b, (slot - s0) / CAST(nslot - s0 AS DOUBLE) AS share FROM f)
SELECT handle, take, slot, round(x, 3) AS x, round(y, 3) AS y, n, FALSE AS filled FROM slots
UNION ALL SELECT handle, take, slot, round({_AT.format("x")} + rx + (nrx - rx) * share, 3), round({_AT.format("y")} + ry + (nry - ry) * share, 3), 0, TRUE FROM p"""

_REASONS = """
WITH lines AS (
  SELECT 'dlc_single' AS source_table, line_id, file_id, line_no, replace(replace(line, chr(13), ' '), chr(10), ' ') AS line, 3 AS n_head FROM dlc_single
  UNION ALL SELECT 'dlcma_multi', line_id, file_id, line_no, replace(replace(line, chr(13), ' '), chr(10), ' '), 4 FROM dlcma_multi
), heads AS (
  SELECT source_table, file_id, string_split(line, ',') AS coords FROM lines WHERE line_no = n_head - 1
), parsed AS (
  SELECT l.source_table, l.line_id, h.coords,
    regexp_full_match(line, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS quoted_ok,
    [trim(CASE WHEN c LIKE '"%' THEN substr(c, 2, length(c) - 2) ELSE c END) FOR c IN regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1)] AS cells
  FROM lines l JOIN heads h USING (source_table, file_id) WHERE l.line_no >= l.n_head AND trim(l.line) <> ''
), judged AS (
  SELECT source_table, line_id, CASE
    WHEN NOT quoted_ok THEN 'quoting'
    WHEN len(cells) <> len(coords) THEN 'column_count'
    WHEN source_table = 'dlcma_multi' AND NOT regexp_full_match(cells[1], '[0-9]+') THEN 'value'
    WHEN len([1 FOR c, i IN cells IF i > 1 AND NOT (c = '' OR lower(c) = 'nan' OR (
      regexp_full_match(c, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND (coords[i] <> 'likelihood' OR TRY_CAST(c AS DOUBLE) BETWEEN 0 AND 1)))]) > 0 THEN 'value' END AS reason
  FROM parsed
)
SELECT source_table, line_id, reason FROM judged WHERE reason IS NOT NULL"""

_KINDS = """
WITH lines AS (
  SELECT 'yolo3r' AS t, file_id, line_no, replace(replace(line, chr(13), ' '), chr(10), ' ') AS line, 1 AS n_head FROM yolo3r_raw
  UNION ALL SELECT 'dlc', file_id, line_no, replace(replace(line, chr(13), ' '), chr(10), ' '), 3 FROM dlc_single
  UNION ALL SELECT 'dlcma', file_id, line_no, replace(replace(line, chr(13), ' '), chr(10), ' '), 4 FROM dlcma_multi
), cut AS (
  SELECT *, regexp_full_match(line, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS quoted_ok,
    [trim(CASE WHEN c LIKE '"%' THEN substr(c, 2, length(c) - 2) ELSE c END) FOR c IN regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1)] AS cells FROM lines
), heads AS (
  SELECT t, file_id, max(cells) FILTER (line_no = 0) AS h0, max(cells) FILTER (line_no = 1) AS h1, max(cells) FILTER (line_no = 2) AS h2, max(cells) FILTER (line_no = 3) AS h3 FROM cut WHERE line_no < n_head GROUP BY 1, 2
), named AS (
  SELECT t, file_id, CASE t WHEN 'dlc' THEN h2 WHEN 'dlcma' THEN h3 ELSE h0 END AS coords, CASE t WHEN 'dlc' THEN ['c0'] || [h1[i] || '.' || h2[i] FOR i IN range(2, len(h2) + 1)]
    WHEN 'dlcma' THEN ['c0'] || [h1[i] || '.' || h2[i] || '.' || h3[i] FOR i IN range(2, len(h3) + 1)] ELSE h0 END AS names FROM heads
), good AS (
  SELECT c.file_id, names, cells FROM cut c JOIN named n ON c.t = n.t AND c.file_id = n.file_id
  WHERE line_no >= n_head AND trim(line) <> '' AND quoted_ok AND len(cells) = len(names) AND (c.t = 'yolo3r' OR (c.t = 'dlc' OR regexp_full_match(cells[1], '[0-9]+'))
    AND len([1 FOR v, i IN cells IF i > 1 AND NOT (v = '' OR lower(v) = 'nan' OR (regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND (coords[i] <> 'likelihood' OR TRY_CAST(v AS DOUBLE) BETWEEN 0 AND 1)))]) = 0)
), v AS (SELECT file_id, unnest(names) AS field_name, unnest(cells) AS v FROM good
), k AS (
  SELECT file_id, field_name, bool_and(regexp_full_match(v, '[+-]?[0-9]+')) AS whole, bool_and(regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')) AS number FROM v WHERE lower(v) NOT IN ('', 'na', 'nan') GROUP BY 1, 2
), f AS (SELECT DISTINCT n.file_id, unnest(names) AS field_name FROM named n JOIN raw_files r ON n.file_id = r.file_id AND n.t = r.layout)
SELECT f.file_id, f.field_name, CASE WHEN coalesce(whole, TRUE) THEN 'long' WHEN number THEN 'double' ELSE 'string' END AS kind FROM f LEFT JOIN k ON f.file_id = k.file_id AND f.field_name = k.field_name"""

_LOADED = """
WITH lines AS (
  SELECT 'dlc_single' AS source_table, line_id, file_id, line_no, replace(replace(line, chr(13), ' '), chr(10), ' ') AS line, 3 AS n_head FROM dlc_single
  UNION ALL SELECT 'dlcma_multi', line_id, file_id, line_no, replace(replace(line, chr(13), ' '), chr(10), ' '), 4 FROM dlcma_multi
), bad AS (""" + _REASONS + """
), cut AS (
  SELECT source_table, file_id, line_id, line_no, [trim(CASE WHEN c LIKE '"%' THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END) FOR c IN regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1)] AS cells
  FROM lines WHERE line_no >= n_head AND trim(line) <> ''
)
SELECT c.source_table, c.file_id, c.line_id, c.line_no, cells[1] AS c0, [CASE WHEN lower(v) NOT IN ('', 'nan') THEN CAST(v AS DOUBLE) END FOR v IN cells[2:]] AS values
FROM cut c LEFT JOIN bad b ON c.source_table = b.source_table AND c.line_id = b.line_id WHERE b.line_id IS NULL"""

_DEVIATES = " OR ".join(
    "(" + " AND ".join(f"abs(lag({c}, {b}) OVER w - lead({c}, {g + 1 - b}) OVER w) <= 20 * m{c}" for _ in (0,)) + "".join(
        f" AND abs({'lag(' + c + f', {b - k}) OVER w' if k < b else 'lead(' + c + f', {k - b}) OVER w' if k > b else c} - lag({c}, {b}) OVER w) > 20 * m{c}"
        f" AND abs({'lag(' + c + f', {b - k}) OVER w' if k < b else 'lead(' + c + f', {k - b}) OVER w' if k > b else c} - lead({c}, {g + 1 - b}) OVER w) > 20 * m{c}"
        for k in range(1, g + 1)) + ")"
    for c in ("x", "y", "conf") for g in (1, 2, 3) for b in range(1, g + 1))

_IMPLAUSIBLE = "WITH " + _USABLE + f""", steps AS (
  SELECT *, {", ".join(f"round(abs({c} - lag({c}) OVER v), 9) AS d{c}" for c in ("x", "y", "conf"))},
    {", ".join(f"CASE WHEN {c} = lag({c}) OVER v THEN 0 ELSE 1 END AS n{c}" for c in "xy")}
  FROM usable WINDOW v AS (PARTITION BY handle, take ORDER BY frame_index)
), runs AS (
  SELECT *, {", ".join(f"sum(n{c}) OVER (PARTITION BY handle, take ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS r{c}" for c in "xy")} FROM steps
), med AS (
  SELECT *, {", ".join(f"median(d{c}) OVER (PARTITION BY handle, take) AS m{c}" for c in ("x", "y", "conf"))},
    {", ".join(f"count(*) OVER (PARTITION BY handle, take, r{c}) AS l{c}" for c in "xy")} FROM runs
), flags AS (
  SELECT *, coalesce({_DEVIATES}, FALSE) AS spike FROM med WINDOW w AS (PARTITION BY handle, take ORDER BY frame_index)
)
SELECT {{}} FROM flags f LEFT JOIN recordings r ON f.handle IS NOT DISTINCT FROM r.handle AND f.take = r.take
WHERE spike OR lx >= 20 OR ly >= 20 OR x < 0 OR x > width_px OR y < 0 OR y > height_px OR conf < 0 OR conf > 1"""

SQL: dict[str, str] = {
    "p2_found": "WITH " + _SLOTS + " SELECT handle, take, slot FROM holes",
    "p2_grid": "WITH " + _SLOTS + " SELECT handle, take, slot, n, FALSE AS filled, round(x, 6) AS x_observed, round(y, 6) AS y_observed FROM slots UNION ALL SELECT handle, take, slot, 0, TRUE, NULL, NULL FROM holes",
    "p1_kinds": _KINDS,
    "p2_filled": _FILLED,
    "p3_found": _REASONS,
    "p3_loaded": _LOADED,
    "p5_found": _IMPLAUSIBLE.format("f.handle, f.take, f.frame_index"),
    "p5_flags": _IMPLAUSIBLE.format("f.handle, f.take, f.frame_index, f.row_id, coalesce(x < 0 OR x > width_px, FALSE) OR coalesce(y < 0 OR y > height_px, FALSE) OR coalesce(conf < 0 OR conf > 1, FALSE) AS outside, lx >= 20 OR ly >= 20 AS frozen, spike"),
}
