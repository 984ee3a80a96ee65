"""Smoothing of feature columns and clean-up of label runs, keyed by frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions.chunked import null_safe_join, with_neighbours, with_run_start
from motionlake.functions.windows import bounded, frame_of, rolling
from motionlake.model import ENTITY, FRAME
from motionlake.session import materialise


def smooth(df: DataFrame, column: str, method: str, window: int, name: str | None = None, centred: bool = True) -> DataFrame:
    """Rolling mean, median or mode (``block`` see below) of a column; null unless the window is full."""
    name = name or f"{column}_{method}"
    if method == "block":
        return smooth_block(df, column, window, name)
    back, ahead = frame_of(window, centred, method == "mode")
    return bounded(df, ENTITY, FRAME, back, ahead, lambda w: {name: rolling(F.col(column), w, window, method, centred)})


def _runs(df: DataFrame, column: str, value: Column | None = None, *aggs: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_run``, the first frame of their run, and one row per run: (entity, _run, _v, _n non-null values, aggs)."""
    d = materialise(with_run_start(df, ENTITY, FRAME, F.col(column) if value is None else value, "_run"))
    return d, d.groupBy(*ENTITY, "_run").agg(F.first(column).alias("_v"), F.count(column).alias("_n"), *aggs)


def smooth_block(df: DataFrame, column: str, window: int, name: str) -> DataFrame:
    """Runs of at most ``window`` rows (and nulls) take the label before them, at the start the one after.

    Where no run is long enough every label is null. Labels are settled on the table of runs.
    """
    d, runs = _runs(df, column)
    runs = materialise(with_neighbours(runs, ENTITY, "_run", {"_k": F.when(F.col("_n") > window, F.col("_v"))}))
    label = F.coalesce(F.when(F.col("_n") > window, F.col("_v")), "_k_prev.v", "_k_next.v")
    return null_safe_join(d, runs.select(*ENTITY, "_run", label.alias(name)), [*ENTITY, "_run"], "inner").drop("_run")


def get_block(df: DataFrame, column: str, window: int, name: str) -> DataFrame:
    """Whether the row lies in a run of at least ``window`` non-null values."""
    d, runs = _runs(df, column)
    return null_safe_join(d, runs.select(*ENTITY, "_run", (F.col("_n") >= window).alias(name)), [*ENTITY, "_run"], "inner").drop("_run")


def remove_block(df: DataFrame, column: str, other: str, name: str) -> DataFrame:
    """True-runs of ``column`` in which ``other`` is ever true become false; nulls are false."""
    known = F.coalesce(F.col(column), F.lit(False))
    d, runs = _runs(df, column, known, F.bool_or(F.coalesce(F.col(other), F.lit(False))).alias("_hit"))
    d = null_safe_join(d, runs.select(*ENTITY, "_run", "_hit"), [*ENTITY, "_run"], "inner")
    return d.withColumn(name, known & ~F.col("_hit")).drop("_run", "_hit")
