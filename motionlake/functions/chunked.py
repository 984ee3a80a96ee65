"""Ordered operations within an entity that do not put a whole entity into one task.

An entity (a recording) may hold a third of all rows, so a plain
``Window.partitionBy(entity)`` would sort that third in one task. Every helper here works on
two levels: rows are windowed by (entity, span of the order column), and only one summary row
per span is windowed by entity and joined back. The entity travels as one struct, which equals another
with nulls in the same fields, so rows, summaries and join share one partitioning: every helper moves the rows once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SPAN = 4096


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match null keys; key columns of ``left`` are kept."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def span_of(order: str | Column, span: int = SPAN) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(span)).cast("long")


def keyed(df: DataFrame, entity: list[str], order: str, span: int = SPAN) -> DataFrame:
    """Add ``_e``, the entity as one never-null key, and ``_span``: everything below is partitioned by these two."""
    return df.withColumns({"_e": F.struct(*entity), "_span": span_of(order, span)})


def _before(name: str = "_span") -> WindowSpec:
    return Window.partitionBy("_e").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)


def _after(name: str = "_span") -> WindowSpec:
    return Window.partitionBy("_e").orderBy(name).rowsBetween(1, Window.unboundedFollowing)


def in_span(order: str) -> WindowSpec:
    return Window.partitionBy("_e", "_span").orderBy(order)


def with_position(df: DataFrame, entity: list[str], order: str, name: str = "pos", span: int = SPAN) -> DataFrame:
    """Add the 0-based position of a row in its entity (``order`` is unique and non-null there)."""
    d = keyed(df, entity, order, span)
    sizes = d.groupBy("_e", "_span").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_e", "_span", F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_before"))
    d = d.withColumn("_local", F.row_number().over(in_span(order)) - 1).join(sizes, ["_e", "_span"])
    return d.withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_e", "_span", "_before", "_local")


def with_next(df: DataFrame, entity: list[str], order: str, payload: list[str], name: str = "nxt", span: int = SPAN) -> DataFrame:
    """Add the struct (order, *payload) of the following row of the entity; null on its last row."""
    d = keyed(df, entity, order, span).withColumn("_row", F.struct(order, *payload))
    firsts = d.groupBy("_e", "_span").agg(F.min("_row").alias("_first"))
    firsts = firsts.select("_e", "_span", F.lead("_first").over(Window.partitionBy("_e").orderBy("_span")).alias("_following"))
    d = d.withColumn(name, F.lead("_row").over(in_span(order))).join(firsts, ["_e", "_span"])
    return d.withColumn(name, F.coalesce(name, "_following")).drop("_e", "_span", "_row", "_following")


def with_carried(df: DataFrame, entity: list[str], order: str, values: dict[str, Column], span: int = SPAN) -> DataFrame:
    """Add, per name, the last non-null value of the expression strictly before the row."""
    d = keyed(df, entity, order, span).withColumns({f"_v_{k}": v for k, v in values.items()})
    ends = d.groupBy("_e", "_span").agg(*[F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.col(order))).alias(f"_e_{k}") for k in values])
    ends = ends.select("_e", "_span", *[F.last(f"_e_{k}", True).over(_before()).alias(f"_in_{k}") for k in values])
    local = in_span(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"_l_{k}": F.last(f"_v_{k}", True).over(local) for k in values}).join(ends, ["_e", "_span"])
    d = d.withColumns({k: F.coalesce(f"_l_{k}", f"_in_{k}") for k in values})
    return d.drop("_e", "_span", *[p + k for k in values for p in ("_v_", "_l_", "_in_")])


def with_neighbours(df: DataFrame, entity: list[str], order: str, values: dict[str, Column], span: int = SPAN) -> DataFrame:
    """Add ``pos`` and, per name, ``{name}_prev`` and ``{name}_next``: structs (pos, v) of the nearest non-null value before and after."""
    d = keyed(df, entity, order, span).withColumns({f"_v_{k}": v for k, v in values.items()})
    d = d.withColumn("_local", F.row_number().over(in_span(order)).cast("long") - 1)
    at = {k: F.when(F.col(f"_v_{k}").isNotNull(), F.struct(F.col("_local").alias("pos"), F.col(f"_v_{k}").alias("v"))) for k in values}
    ends = d.groupBy("_e", "_span").agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"{p}{k}") for k, c in at.items() for f, p in ((F.min, "_f_"), (F.max, "_t_"))])
    ends = ends.withColumn("_before", F.coalesce(F.sum("_n").over(_before()), F.lit(0)))
    moved = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.pos") + F.col("_before")).alias("pos"), F.col(f"{c}.v").alias("v")))
    ends = ends.withColumns({p + k: moved(p + k) for k in values for p in ("_f_", "_t_")})
    ends = ends.select("_e", "_span", "_before", *[F.last(f"_t_{k}", True).over(_before()).alias(f"_in_{k}") for k in values], *[F.first(f"_f_{k}", True).over(_after()).alias(f"_out_{k}") for k in values])
    up, down = in_span(order).rowsBetween(Window.unboundedPreceding, -1), in_span(order).rowsBetween(1, Window.unboundedFollowing)
    d = d.withColumns({f"_p_{k}": F.last(c, True).over(up) for k, c in at.items()} | {f"_q_{k}": F.first(c, True).over(down) for k, c in at.items()}).join(ends, ["_e", "_span"])
    d = d.withColumns({"pos": F.col("_local") + F.col("_before")} | {f"{k}_prev": F.coalesce(moved(f"_p_{k}"), F.col(f"_in_{k}")) for k in values} | {f"{k}_next": F.coalesce(moved(f"_q_{k}"), F.col(f"_out_{k}")) for k in values})
    return d.drop("_e", "_span", "_local", "_before", *[p + k for k in values for p in ("_v_", "_p_", "_q_", "_in_", "_out_")])


def with_run_start(df: DataFrame, entity: list[str], order: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """Add the order value at which the run of equal ``value`` (nulls are equal) began."""
    d = keyed(df, entity, order, span).withColumn("_value", value)
    begins = F.when(F.row_number().over(in_span(order)) > 1, F.when(~F.col("_value").eqNullSafe(F.lag("_value").over(in_span(order))), F.col(order)))
    d = d.withColumn("_begins", begins)
    ends = d.groupBy("_e", "_span").agg(F.min(order).alias("_at"), F.min_by("_value", order).alias("_first"), F.max_by("_value", order).alias("_last"), F.max("_begins").alias("_inner"))
    small = Window.partitionBy("_e").orderBy("_span")
    goes_on = (F.row_number().over(small) > 1) & F.col("_first").eqNullSafe(F.lag("_last").over(small))
    ends = ends.withColumn("_open", F.when(~goes_on, F.col("_at")))
    ends = ends.withColumn("_since", F.last(F.coalesce("_inner", "_open"), True).over(_before()))
    ends = ends.select("_e", "_span", F.coalesce("_open", "_since").alias("_since"))
    d = d.withColumn(name, F.max("_begins").over(in_span(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(ends, ["_e", "_span"])
    return d.withColumn(name, F.coalesce(name, "_since")).drop("_e", "_span", "_value", "_begins", "_since")


def first_delivery(df: DataFrame, key: list[str], row_id: str, cols: list[str]) -> DataFrame:
    """Keep, of rows with equal ``key``, the one with the smallest ``row_id`` (partial aggregation)."""
    kept = df.groupBy(*key).agg(F.min_by(F.struct(row_id, *cols), row_id).alias("_k"))
    return kept.select(*key, *[F.col(f"_k.{c}").alias(c) for c in (row_id, *cols)])
