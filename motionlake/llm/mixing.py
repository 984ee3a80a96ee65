"""Mixing sources to target weights with capped repetition.

Sizes are tokens of a public tokenizer. Capped water-filling gives every source its share of the wanted
total; sources that would need more than ``max_repeats`` passes are clamped there and their excess goes to
the others in proportion to their weights, until nothing changes. A source then contributes whole passes
and a seeded sample for the fraction.

Defined results: documents without a source or with a source that has no target take no part; null and
empty texts have no tokens and are left out; a source without documents gets nothing and its weight is
redistributed; equal rows are separate documents; a null cap counts as one pass; if every source is clamped
the mixture is smaller than wanted.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.session import materialise

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pre-token pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096


def token_counts(texts: Iterator[pa.RecordBatch], vocabulary: bytes) -> Iterator[pa.RecordBatch]:
    """Append the number of tokens of column ``text``, which is dropped."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encoder = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for batch in texts:
        i = batch.schema.get_field_index("text")
        n = pa.array([len(encoder.encode_ordinary(t)) for t in batch.column(i).to_pylist()], pa.int64())
        keep = [k for k in range(batch.num_columns) if k != i]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), n], [*(batch.schema.names[k] for k in keep), "n_tokens"])


def sized(documents: DataFrame, targets: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents whose source has a target."""
    docs = documents.select("doc_id", "source", "text").filter((F.length("text") > 0) & F.col("source").isNotNull())
    docs = docs.join(targets.select("source"), "source", "left_semi").select("doc_id", "source", "text")
    with open(ranks_path, "rb") as f:  # on the driver: a vocabulary of fixed size, sent to the workers once
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    return docs.mapInArrow(lambda it: token_counts(it, shared.value), "doc_id long, source string, n_tokens long")


def water_fill(sizes: dict[str, int], weights: dict[str, float], caps: dict[str, int], total: float) -> dict[str, float]:
    """Size given to each source: weight shares of ``total``, none above size times cap."""
    limit = {s: sizes.get(s, 0) * max(0, caps[s]) for s in weights}
    given: dict[str, float] = {}
    free = {s for s in weights if weights[s] > 0}
    left = float(total)
    while free:
        norm = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / norm > limit[s]}
        if not over:
            given |= {s: left * weights[s] / norm for s in free}
            break
        for s in over:
            given[s] = float(limit[s])
        left -= sum(limit[s] for s in over)
        free -= over
    return {s: given.get(s, 0.0) for s in weights}


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> list[dict]:
    """Per source: available tokens, repetitions and given tokens. One row per source comes to the driver."""
    have = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    rows = targets.select("source", "target_share", "max_repeats").collect()
    weights = {r["source"]: r["target_share"] or 0.0 for r in rows}
    caps = {r["source"]: 1 if r["max_repeats"] is None else r["max_repeats"] for r in rows}
    given = water_fill(have, weights, caps, sum(have.values()) if total is None else total)
    return [{"source": s, "target_share": weights[s], "max_repeats": caps[s], "available": have.get(s, 0), "given": given[s], "passes": given[s] / have[s] if have.get(s) else 0.0} for s in weights]


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of all documents in the mixture.

    ``total`` defaults to the tokens of all targeted documents. The fractional pass takes documents in the
    order of a seeded hash up to the wanted size: the cut is found by two histograms of the hash, so
    no source is ever sorted or gathered.
    """
    docs = materialise(sized(documents, targets, ranks_path))
    planned = plan(docs, targets, total)
    spark = documents.sparkSession
    wanted = spark.createDataFrame([(p["source"], int(p["passes"]), (p["passes"] - int(p["passes"])) * p["available"]) for p in planned], "source string, whole int, part double")
    h = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BUCKETS * BUCKETS))
    docs = docs.withColumns({"_coarse": F.floor(h / BUCKETS), "_fine": h % BUCKETS})
    cuts = {p["source"]: [(p["passes"] - int(p["passes"])) * p["available"], -1, -1] for p in planned}

    def cut(counts: list, slot: int) -> None:
        done: set[str] = set()
        for r in sorted(counts, key=lambda r: (r["source"], r["b"])):
            state = cuts[r["source"]]
            if r["source"] not in done:
                if state[0] >= r["n"]:
                    state[0] -= r["n"]
                    state[slot] = r["b"]
                else:
                    done.add(r["source"])

    # at most BUCKETS rows per source
    cut(docs.groupBy("source", F.col("_coarse").alias("b")).agg(F.sum("n_tokens").alias("n")).collect(), 1)
    coarse = spark.createDataFrame([(s, v[1]) for s, v in cuts.items()], "source string, _upto long")
    edge = docs.join(F.broadcast(coarse), "source").filter(F.col("_coarse") > F.col("_upto"))
    first = edge.groupBy("source").agg(F.min("_coarse").alias("_edge"))
    inside = edge.join(first, "source").filter(F.col("_coarse") == F.col("_edge"))
    cut(inside.groupBy("source", F.col("_fine").alias("b")).agg(F.sum("n_tokens").alias("n")).collect(), 2)
    edges = {r["source"]: r["_edge"] for r in first.collect()}
    limits = spark.createDataFrame([(s, v[1], edges.get(s, -1), v[2]) for s, v in cuts.items()], "source string, _upto long, _edge long, _fine_upto long")
    picked = (F.col("_coarse") <= F.col("_upto")) | ((F.col("_coarse") == F.col("_edge")) & (F.col("_fine") <= F.col("_fine_upto")))
    out = docs.join(F.broadcast(limits), "source").join(F.broadcast(wanted), "source")
    return out.select("doc_id", "source", "n_tokens", (F.col("whole") + picked.cast("int")).alias("copies")).filter("copies > 0")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, actual_share), sources without share included."""
    per = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    total = per.agg(F.sum("tokens").alias("all_tokens"))
    full = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").join(total)
    return full.select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.try_divide(F.coalesce("tokens", F.lit(0)), "all_tokens").alias("actual_share"))
