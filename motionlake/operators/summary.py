"""Per-recording summaries: aggregates by entity, lags by two-level windows, and named results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions.chunked import null_safe_join
from motionlake.functions.quantiles import medians
from motionlake.functions.windows import bounded
from motionlake.model import ENTITY, FRAME, PoseFrame
from motionlake.operators.features import with_motion


def _with_previous(df: DataFrame, column: str) -> DataFrame:
    return bounded(df, ENTITY, FRAME, 1, 0, lambda w: {"_prev": F.lag(column).over(w)})


def count_onset(df: DataFrame, column: str) -> DataFrame:
    """(entity, onsets): number of runs of true; nulls are dropped first. Recordings of nulls only are absent."""
    d = _with_previous(df.select(*ENTITY, FRAME, column).filter(F.col(column).isNotNull()), column)
    return d.groupBy(*ENTITY).agg(F.count_if(F.col(column) & ~F.coalesce("_prev", F.lit(False))).alias("onsets"))


def time_true_false(df: DataFrame, column: str, recordings: DataFrame) -> DataFrame:
    """(entity, time_true, time_false) in seconds; nulls are neither."""
    n = df.groupBy(*ENTITY).agg(F.count_if(F.col(column)).alias("t"), F.count_if(~F.col(column)).alias("f"))
    n = null_safe_join(n, recordings.select(*ENTITY, "fps"), ENTITY, "inner")
    return n.select(*ENTITY, F.try_divide("t", "fps").alias("time_true"), F.try_divide("f", "fps").alias("time_false"))


def total_distance(pose: PoseFrame, point: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(entity, total_distance): changes are taken before slicing; a recording without any has 0."""
    d = with_motion(pose, [point]).frames
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(FRAME) >= start)
    if end is not None:
        inside = inside & (F.col(FRAME) <= end)
    return d.groupBy(*ENTITY).agg(F.coalesce(F.sum(F.when(inside, F.col(f"change_{point}"))), F.lit(0.0)).alias("total_distance"))


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """(entity, sum_, mean_, median_, max_, min_ of the column); nulls are skipped, an empty sum is 0."""
    c = F.col(column)
    s = df.groupBy(*ENTITY).agg(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"sum_{column}"), F.avg(c).alias(f"mean_{column}"), F.max(c).alias(f"max_{column}"), F.min(c).alias(f"min_{column}"))
    return null_safe_join(s, medians(df, ENTITY, {f"median_{column}": c}), ENTITY, "inner")


def transition_matrix(df: DataFrame, column: str, states: Sequence[str] | None = None) -> DataFrame:
    """(entity, prev, curr, n): counts of changes of state; pairs touching a null are dropped.

    With ``states`` the matrix is dense over them: missing pairs count 0, other states are left out.
    """
    d = _with_previous(df.select(*ENTITY, FRAME, column), column)
    n = d.filter(F.col("_prev") != F.col(column)).groupBy(*ENTITY, F.col("_prev").alias("prev"), F.col(column).alias("curr")).agg(F.count(F.lit(1)).alias("n"))
    if states is None:
        return n
    pairs = F.array(*[F.struct(F.lit(a).alias("prev"), F.lit(b).alias("curr")) for a in states for b in states])
    grid = df.select(*ENTITY).distinct().withColumn("p", F.explode(pairs)).select(*ENTITY, "p.prev", "p.curr")
    return null_safe_join(grid, n, [*ENTITY, "prev", "curr"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def count_state_onsets(df: DataFrame, column: str) -> DataFrame:
    """(entity, state, onsets): entries into each state; a state after a null counts as entered."""
    d = _with_previous(df.select(*ENTITY, FRAME, column), column).filter(F.col(column).isNotNull())
    return d.groupBy(*ENTITY, F.col(column).alias("state")).agg(F.count_if(~F.col(column).eqNullSafe(F.col("_prev"))).alias("onsets"))


def time_in_state(df: DataFrame, column: str, recordings: DataFrame) -> DataFrame:
    """(entity, state, seconds); nulls are dropped."""
    n = df.filter(F.col(column).isNotNull()).groupBy(*ENTITY, F.col(column).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return null_safe_join(n, recordings.select(*ENTITY, "fps"), ENTITY, "inner").select(*ENTITY, "state", F.try_divide("n", "fps").alias("seconds"))


def make_bins(df: DataFrame, n: int) -> DataFrame:
    """Rows with ``bin`` 0..n-1 between integer edges of equal spacing; interior edge frames lie in both bins."""
    ends = df.groupBy(*ENTITY).agg(F.min(FRAME).alias("_lo"), F.max(FRAME).alias("_hi"))
    d = null_safe_join(df, ends, ENTITY, "inner")

    def edge(i: Column) -> Column:
        return F.floor(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / F.lit(n))

    bins = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.col(FRAME) >= edge(i)) & (F.col(FRAME) <= edge(i + 1)))
    return d.withColumn("bin", F.explode(bins)).drop("_lo", "_hi")


def make_bin(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.filter(F.col(FRAME).between(start, end))


def to_table(entities: DataFrame, results: Sequence[DataFrame], tags: DataFrame | None = None, prefix: str = "tag_") -> DataFrame:
    """One row per recording with all scalar results as columns, and the tags with a prefix."""
    out = entities
    for r in results:
        clash = (set(r.columns) & set(out.columns)) - set(ENTITY)
        if clash:
            raise ValueError(f"results exist: {sorted(clash)}")
        out = null_safe_join(out, r, ENTITY, "left")
    if tags is not None:
        t = tags.select("handle", *[F.col(c).alias(f"{prefix}{c}") for c in tags.columns if c != "handle"])
        out = null_safe_join(out, t, ["handle"], "left")
    return out


def store(table: DataFrame, result: DataFrame, name: str, overwrite: bool = False, meta: dict | None = None) -> DataFrame:
    """Add a named result (entity, value) to a summary table; ``meta`` travels with the column."""
    if name in table.columns and not overwrite:
        raise ValueError(f"{name} exists")
    value = next(c for c in result.columns if c not in ENTITY)
    return null_safe_join(table.drop(name), result.select(*ENTITY, F.col(value).alias(name, metadata=meta or {})), ENTITY, "left")
