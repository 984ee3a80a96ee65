"""Permutation test on mean transition matrices between groups of recordings.

Permutations rank recordings by ``md5(handle:take:permutation:seed)``, so they can be replayed anywhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.model import ENTITY

#: Permutations of one pair of groups that one row carries.
PER_TASK = 64


def distances(transitions: DataFrame, groups: DataFrame, shuffles: int = 1000, seed: int = 0) -> DataFrame:
    """(pair, permutation, distance): Manhattan distance of the group means; permutation -1 is observed.

    ``groups`` is (handle, take, grp) with one row per recording; all pairs of groups are compared.
    Recordings without any transition take part with a zero matrix. Each recording's transitions are one
    short list, so a permutation of a pair is one task-sized unit: its recordings are ranked by their hash and the
    weighted lists are summed in one aggregate; neither pairs nor cells are ever joined per permutation.
    """
    g = groups.select(F.struct(*ENTITY).alias("_e"), *ENTITY, "grp").filter("grp IS NOT NULL")
    names = sorted(r["grp"] for r in g.select("grp").distinct().collect())  # a tag's values
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return g.select(F.col("grp").alias("pair"), F.lit(0).alias("permutation"), F.lit(0.0).alias("distance")).limit(0)
    of = {n: [(f"{a}_vs_{b}", n == a) for a, b in pairs if n in (a, b)] for n in names}
    lookup = F.create_map(*[x for n in names for x in (F.lit(n), F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(own).alias("own")) for p, own in of[n]]))])
    cells = transitions.groupBy(F.struct(*ENTITY).alias("_e")).agg(F.sort_array(F.collect_list(F.struct("prev", "curr", "n"))).alias("cells"))
    both = g.select("_e", *ENTITY, F.explode(lookup[F.col("grp")]).alias("p")).select("_e", *ENTITY, "p.pair", "p.own").join(cells, "_e", "left")
    sizes = both.groupBy("pair").agg(F.count_if("own").alias("_n1"), F.count_if(~F.col("own")).alias("_n2"))
    key = F.concat_ws(":", F.coalesce("handle", F.lit("")), "take")
    runs = both.join(sizes, "pair").select("pair", "own", "_n1", "_n2", "cells", key.alias("_k"), *ENTITY)
    # the recordings of a pair (of one experiment: a bounded number), in one row, meet all its permutations
    listed = runs.groupBy("pair", "_n1", "_n2").agg(F.sort_array(F.collect_list(F.struct(*ENTITY, "_k", "own", F.coalesce("cells", F.array().cast("array<struct<prev: string, curr: string, n: bigint>>")).alias("cells")))).alias("rows"))
    some = F.explode(F.sequence(F.lit(-1), F.lit(shuffles - 1), F.lit(PER_TASK)))
    tasks = listed.withColumn("first", some).repartition("pair", "first")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for pair, n1, n2, rows, first in zip(pdf["pair"], pdf["_n1"], pdf["_n2"], pdf["rows"], pdf["first"]):
                index: dict[tuple, int] = {}
                at = [(i, index.setdefault((c["prev"], c["curr"]), len(index)), c["n"]) for i, r in enumerate(rows) for c in r["cells"]]
                m = np.zeros((len(rows), max(1, len(index))))
                for i, j, n in at:
                    m[i, j] += n
                own = np.array([bool(r["own"]) for r in rows])
                out = []
                for permutation in range(first, min(first + PER_TASK, shuffles)):
                    if permutation < 0:
                        one = own
                    else:
                        keys = [(hashlib.md5(f"{r['_k']}:{permutation}:{seed}".encode()).hexdigest(), i) for i, r in enumerate(rows)]
                        one = np.zeros(len(rows), bool)
                        one[[i for _, i in sorted(keys)[:n1]]] = True
                    w = np.where(one, 1 / n1 if n1 else 0.0, -1 / n2 if n2 else 0.0)
                    out.append((pair, permutation, float(np.abs(w @ m).sum())))
                yield pd.DataFrame(out, columns=["pair", "permutation", "distance"])

    return tasks.select("pair", "_n1", "_n2", "rows", "first").mapInPandas(run, "pair string, permutation int, distance double")


def stats(d: DataFrame, digits: int | None = None) -> DataFrame:
    """(pair, observed, percentile, zscore): share of surrogates below, over n + 1, and population z-score.

    ``digits`` rounds distances first, so that equal ones compare equal.
    """
    v = F.col("distance") if digits is None else F.round("distance", digits)
    d = d.select("pair", "permutation", v.alias("distance"))
    seen = d.filter("permutation < 0").select("pair", F.col("distance").alias("observed"))
    s = d.filter("permutation >= 0").join(F.broadcast(seen), "pair")
    s = s.groupBy("pair", "observed").agg(F.count_if(F.col("observed") > F.col("distance")).alias("below"), F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"))
    return s.select("pair", "observed", F.try_divide(F.col("below").cast("double"), F.col("n") + 1).alias("percentile"), F.try_divide(F.col("observed") - F.col("mean"), F.col("std")).alias("zscore"))


def right_tail(s: DataFrame) -> DataFrame:
    """Add ``right_tail_p`` of the z-score."""

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return z.map(lambda v: 0.5 * (1 - math.erf(v / math.sqrt(2))), na_action="ignore")

    return s.withColumn("right_tail_p", p("zscore"))
