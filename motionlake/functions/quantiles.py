"""Exact medians per entity without gathering an entity's values in one task.

Radix selection: counts over logarithmic bins (plain sums, combined before the shuffle) tell in which bin the middle
ranks lie; counts over equal steps inside that bin narrow it again; only the values of the step found, a vanishing share
of the entity's value range, are sorted. Equal values are counted, not listed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.chunked import null_safe_join

#: Width of a first-level bin in natural logarithms, and steps a bin is divided into.
WIDTH, STEPS, TINY, MOST = 0.02, 4096, 1e-300, 1e300
#: Bin of values beyond MOST.
INFINITE = 1_000_000


def _bin(v: Column) -> Column:
    """Bin that grows with the value; 0 for 0."""
    finite = F.least(F.greatest(F.abs(v), F.lit(TINY)), F.lit(MOST))
    size = F.when(F.abs(v) > MOST, INFINITE).otherwise(F.floor((F.log(finite) - math.log(TINY)) / WIDTH).cast("long") + 1)
    return F.when(v == 0, 0).when(v < 0, -size).otherwise(size)


def _hit(counts: DataFrame, key: list[str], bins: str) -> DataFrame:
    """(key, rank, bins, left): the bin that holds each wanted rank, and the rank inside it."""
    w = Window.partitionBy(*key).orderBy(bins).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = counts.withColumn("_upto", F.sum("_n").over(w))
    return c.filter((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_n") <= F.col("rank"))).select(*key, bins, (F.col("rank") - F.col("_upto") + F.col("_n")).alias("left"))


def medians(df: DataFrame, entity: list[str], values: dict[str, Column]) -> DataFrame:
    """(entity, names): the exact median of each expression, null where an entity has no value; NaN counts as no value."""
    names = list(values)
    each = df.select(F.struct(*entity).alias("_e"), F.explode(F.array(*[F.struct(F.lit(i).alias("c"), values[n].cast("double").alias("v")) for i, n in enumerate(names)])).alias("_s"))
    each = each.select("_e", "_s.c", "_s.v").filter(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("b", _bin(F.col("v")))
    key = ["_e", "c"]
    n = each.groupBy(*key, "b").agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_all", F.sum("_n").over(Window.partitionBy(*key)))
    n = n.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)))))
    first = _hit(n, [*key, "rank"], "b")
    plain = (F.col("b") == 0) | (F.abs("b") == INFINITE)  # sorted as they are
    step = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * STEPS).cast("long")
    inside = each.join(first, [*key, "b"])
    lo = F.exp((F.least(F.abs("b"), F.lit(100_000)) - 1) * WIDTH + math.log(TINY))
    inside = inside.withColumns({"lo": F.when(F.col("b") < 0, -lo * F.lit(1.03)).otherwise(lo * F.lit(0.999)), "hi": F.when(F.col("b") < 0, -lo * F.lit(0.999)).otherwise(lo * F.lit(1.03))})
    inside = inside.select(*key, "rank", "left", "v", F.when(plain, 0).otherwise(step).alias("s"))
    m = inside.groupBy(*key, "rank", "left", "s").agg(F.count(F.lit(1)).alias("_n"))
    second = _hit(m.withColumnRenamed("rank", "place").withColumnRenamed("left", "rank"), [*key, "place", "rank"], "s").select(*key, F.col("place").alias("rank"), "s", F.col("left").alias("last"))
    kept = inside.join(second, [*key, "rank", "s"]).groupBy(*key, "rank", "last", "v").agg(F.count(F.lit(1)).alias("_n"))
    found = _hit(kept.withColumnRenamed("rank", "place").withColumnRenamed("last", "rank"), [*key, "place", "rank"], "v")
    per = found.groupBy("_e").agg(*[F.avg(F.when(F.col("c") == i, F.col("v"))).alias(f"_m{i}") for i in range(len(names))])
    out = df.select(*entity).distinct()
    return null_safe_join(out, per.select(*[F.col(f"_e.{k}").alias(k) for k in entity], *[F.col(f"_m{i}").alias(n) for i, n in enumerate(names)]), entity, "left")
