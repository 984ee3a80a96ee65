"""Irregular readings onto a regular grid, with missing slots filled by a seasonal model.

Per source and coordinate a trend plus harmonics of one season is fitted by normal equations: the
cross products are plain sums, so they combine before the shuffle and any source size costs one
row. Missing slots get the model's value plus the residual interpolated between the observed slots
on either side, so a filled stretch joins its neighbours without a step.

Defined results: readings without frame, x or y (null or NaN) and readings of sources without a
recording or with a grid step below 1 are left out; of re-delivered readings the smallest row_id counts;
a source with one slot has no gaps; with too few slots for all terms a small ridge keeps the solution
unique. Null handles form a source of their own. Extra columns are ignored; empty input gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions.chunked import null_safe_join, with_next

SOURCE = ["handle", "take"]
#: Slots of a gap that come from one row at most.
GAP_BLOCK = 4096


def usable_readings(readings: DataFrame) -> DataFrame:
    """(row_id, handle, take, frame_index, x, y, conf) with NaN as null and unusable rows dropped."""
    def clean(c: Column, n: str) -> Column:
        return F.nanvl(c, F.lit(None).cast("double")).alias(n)

    r = readings.select("row_id", "handle", "take", "frame_index", clean(F.col("p1.x"), "x"), clean(F.col("p1.y"), "y"), clean(F.col("p1.conf"), "conf"))
    return r.filter(F.col("frame_index").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())


def slot_means(readings: DataFrame, recordings: DataFrame, season_seconds: float = 60.0) -> DataFrame:
    """(handle, take, slot, x, y, n, period): one row per source and observed slot.

    Readings are hashed by (source, slot) once; removing re-deliveries and averaging both reuse that.
    """
    rec = recordings.filter(F.col("grid_step") >= 1).select(*SOURCE, "grid_step", F.greatest(F.lit(4.0), season_seconds * F.coalesce("fps", F.lit(30.0)) / F.col("grid_step")).alias("period"))
    r = null_safe_join(usable_readings(readings), rec, SOURCE, "inner")
    r = r.select(*SOURCE, F.floor(F.col("frame_index") / F.col("grid_step")).cast("long").alias("slot"), "frame_index", "row_id", "x", "y", "period")
    r = r.repartition(*SOURCE, "slot")
    one = r.groupBy(*SOURCE, "slot", "frame_index").agg(F.min_by(F.struct("x", "y", "period"), "row_id").alias("r"))
    return one.groupBy(*SOURCE, "slot").agg(F.avg("r.x").alias("x"), F.avg("r.y").alias("y"), F.count(F.lit(1)).alias("n"), F.first("r.period").alias("period"))


def basis(slot: Column, period: Column, harmonics: int) -> list[Column]:
    t = slot / period
    waves = [f(2 * math.pi * k * t) for k in range(1, harmonics + 1) for f in (F.sin, F.cos)]
    return [F.lit(1.0), t, *waves]


def fit(slots: DataFrame, harmonics: int = 2, ridge: float = 1e-6) -> DataFrame:
    """(handle, take, beta_x, beta_y): least squares by normal equations, one row per source."""
    b = basis(F.col("slot"), F.col("period"), harmonics)
    p = len(b)
    s = slots.select(*SOURCE, "x", "y", *[c.alias(f"b{i}") for i, c in enumerate(b)])
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    sums = s.groupBy(*SOURCE).agg(
        F.array(*[F.sum(F.col(f"b{i}") * F.col(f"b{j}")) for i, j in upper]).alias("xtx"),
        F.array(*[F.sum(F.col(f"b{i}") * F.col("x")) for i in range(p)]).alias("xty"),
        F.array(*[F.sum(F.col(f"b{i}") * F.col("y")) for i in range(p)]).alias("yty"),
    )

    @F.pandas_udf("struct<beta_x: array<double>, beta_y: array<double>>")
    def solve(xtx: pd.Series, xty: pd.Series, yty: pd.Series) -> pd.DataFrame:
        a = np.zeros((len(xtx), p, p))
        flat = np.stack(xtx.to_list())
        for k, (i, j) in enumerate(upper):
            a[:, i, j] = a[:, j, i] = flat[:, k]
        scale = np.maximum(np.einsum("kii->ki", a), 1e-12)
        a[:, range(p), range(p)] += ridge * scale
        rhs = np.stack([np.stack(xty.to_list()), np.stack(yty.to_list())], axis=2)
        beta = np.linalg.solve(a, rhs)
        return pd.DataFrame({"beta_x": list(beta[:, :, 0]), "beta_y": list(beta[:, :, 1])})

    return sums.select(*SOURCE, solve("xtx", "xty", "yty").alias("m")).select(*SOURCE, "m.beta_x", "m.beta_y")


def _model(slot: Column, beta: Column, period: Column, harmonics: int) -> Column:
    terms = [c * F.get(beta, F.lit(i)) for i, c in enumerate(basis(slot, period, harmonics))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def missing_slots(slots: DataFrame, harmonics: int = 2) -> DataFrame:
    """(handle, take, slot, x, y): the slots without reading between observed ones, predicted and bridged."""
    gaps = with_next(slots, SOURCE, "slot", ["x", "y"]).filter(F.col("nxt.slot") - F.col("slot") > 1)
    gaps = null_safe_join(gaps, fit(slots, harmonics), SOURCE, "inner")
    for v in ("x", "y"):
        beta = F.col(f"beta_{v}")
        gaps = gaps.withColumns({
            f"r0{v}": F.col(v) - _model(F.col("slot"), beta, F.col("period"), harmonics),
            f"r1{v}": F.col(f"nxt.{v}") - _model(F.col("nxt.slot"), beta, F.col("period"), harmonics),
        })
    # wide gaps are spread over rows in blocks before they are filled
    each = gaps.withColumn("_block", F.explode(F.sequence(F.col("slot") + 1, F.col("nxt.slot") - 1, F.lit(GAP_BLOCK))))
    each = each.withColumn("s", F.explode(F.sequence(F.col("_block"), F.least(F.col("_block") + GAP_BLOCK - 1, F.col("nxt.slot") - 1))))
    share = (F.col("s") - F.col("slot")) / (F.col("nxt.slot") - F.col("slot"))

    def value(v: str) -> Column:
        return (_model(F.col("s"), F.col(f"beta_{v}"), F.col("period"), harmonics) + F.col(f"r0{v}") + (F.col(f"r1{v}") - F.col(f"r0{v}")) * share).alias(v)

    return each.select(*SOURCE, F.col("s").alias("slot"), value("x"), value("y"))


def regular_grid(readings: DataFrame, recordings: DataFrame, harmonics: int = 2, season_seconds: float = 60.0) -> DataFrame:
    """(handle, take, slot, x, y, n, filled): one row per source and slot from first to last observed slot.

    The season's length is a parameter; harmonics of a season the data lack get small coefficients.
    """
    slots = slot_means(readings, recordings, season_seconds)
    filled = missing_slots(slots, harmonics).select("*", F.lit(0).cast("long").alias("n"), F.lit(True).alias("filled"))
    return slots.select(*SOURCE, "slot", "x", "y", "n", F.lit(False).alias("filled")).unionByName(filled)
