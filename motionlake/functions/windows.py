"""Window recipes over an entity in frame order, none of which gathers an entity in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from motionlake.functions.chunked import null_safe_join, with_position

CHUNK = 4096


def bounded(df: DataFrame, entity: list[str], order: str, before: int, after: int, add: Callable[[WindowSpec], dict[str, Column]], chunk: int = CHUNK) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    Rows are cut into chunks of ``chunk`` positions; edge rows are copied to the neighbouring chunk, so
    every chunk is windowed on its own.
    """
    if max(before, after) > chunk:
        raise ValueError("the window is wider than a chunk")
    d = with_position(df, entity, order, "_pos")
    own, at = F.floor(F.col("_pos") / chunk).cast("long"), F.col("_pos") % chunk
    copies = F.array(own, F.when(at >= chunk - before, own + 1) if before else F.lit(None).cast("long"), F.when((at < after) & (own > 0), own - 1) if after else F.lit(None).cast("long"))
    d = d.withColumn("_chunk", F.explode(F.filter(copies, lambda c: c.isNotNull()))).withColumn("_own", F.col("_chunk") == own)
    w = Window.partitionBy(*entity, "_chunk").orderBy("_pos")  # nulls are one key to a window
    return d.withColumns(add(w)).filter("_own").drop("_pos", "_chunk", "_own")


def frame_of(k: int, centred: bool, mode: bool = False) -> tuple[int, int]:
    """Rows back and ahead of a window of k rows; an even centred window leans back (mode: ahead)."""
    if not centred:
        return k - 1, 0
    ahead = k // 2 if mode else (k - 1) // 2
    return k - 1 - ahead, ahead


def rolling(c: Column, w: WindowSpec, k: int, method: str, centred: bool = False) -> Column:
    """Rolling mean, median or mode of k rows; null unless all k values are there.

    Ties of the mode go to the smallest value.
    """
    back, ahead = frame_of(k, centred, method == "mode")
    f = w.rowsBetween(-back, ahead)
    full = F.count(c).over(f) == k
    if method == "mean":
        return F.when(full, F.avg(c).over(f))
    values = F.array_sort(F.collect_list(c).over(f))
    if method == "median":
        return F.when(full, (F.get(values, F.lit((k - 1) // 2)) + F.get(values, F.lit(k // 2))) / 2)
    if method == "mode":
        ranked = F.array_sort(F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda u: u == v))).alias("n"), v.alias("v"))))
        return F.when(full, F.get(ranked, F.lit(0))["v"])
    raise ValueError(f"unknown method {method}")


def per_entity(df: DataFrame, entity: list[str], aggs: list[Column]) -> DataFrame:
    """Join per-entity aggregates back to the rows (one small row per entity)."""
    return null_safe_join(df, df.groupBy(*entity).agg(*aggs), entity, "inner")
