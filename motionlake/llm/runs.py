"""Repeated consecutive events: collapse each run into one row with its count and duration.

Events are canonicalised first, then the difference of the row number within the entity and the row
number within entity and canonical event identifies the runs; row numbers are taken on two levels
(see ``functions.chunked``), so a hot entity is spread over tasks.

Canonicalising null-tolerant states: a null contradicts nothing, so whether a row breaks a run can depend
on where the run began. Breaks that hold wherever it began (a gap, or a contradiction by the row just
before) are found by windows. Between two of them a run that starts at s ends before the first row that contradicts
a value known since s: a pointer from every possible start to the next one. Few possible starts are followed by
one fold; more than ``FOLD_MOST`` by doubling the pointers, in rounds that grow with the logarithm of their number.

Defined results: rows without an order value take part in no run; of rows equal in entity and order
the one with the smallest row_id counts; null entity keys form an entity; states null throughout a run
stay null; extra columns are ignored; an empty table gives no runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.chunked import first_delivery, null_safe_join, span_of, with_carried, with_position
from motionlake.session import discard, materialise

#: Possible breaks between two certain ones that are folded in one row; more are followed by pointer doubling.
FOLD_MOST = 256


def row_number_difference(events: DataFrame, entity: list[str], order: str, event: list[str]) -> DataFrame:
    """Add ``run``: constant exactly within a run of equal ``event`` values of an entity."""
    d = with_position(events, entity, order, "_in_entity")
    d = with_position(d, [*entity, *event], order, "_in_event")
    return d.withColumn("run", F.col("_in_entity") - F.col("_in_event")).drop("_in_entity", "_in_event")


def _folded(maybe: DataFrame, entity: list[str], order: str) -> DataFrame:
    """Starts among the few possible breaks of each block, one after the other."""
    rows = maybe.groupBy(*entity, "block").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "back"))).alias("rows"))
    step = F.aggregate(
        "rows",
        F.struct(F.col("block").alias("s"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, x: F.when(x["back"] >= acc["s"], F.struct(x["o"].alias("s"), F.concat(acc["starts"], F.array(x["o"])).alias("starts"))).otherwise(acc),
        lambda acc: acc["starts"],
    )
    return rows.select(*entity, F.explode(step).alias(order))


def _doubled(maybe: DataFrame, entity: list[str], order: str) -> DataFrame:
    """Starts among any number of possible breaks: those that the pointers reach from the block's first row."""
    key = [*entity, "block"]
    nodes = maybe.select(*key, F.col(order).alias("o")).union(maybe.select(*key, F.col("block").alias("o")).distinct())
    at = nodes.select(*key, F.col("o").alias("at"), F.lit(None).cast("long").alias("j")).union(maybe.select(*key, F.col("back").alias("at"), F.col(order).alias("j")))
    # the next start after s is the first row that is contradicted by a row at s or later
    at = at.withColumn("_span", span_of("at"))
    later = at.groupBy(*key, "_span").agg(F.min("j").alias("_least"))
    later = later.withColumn("_later", F.min("_least").over(Window.partitionBy(*key).orderBy("_span").rowsBetween(1, Window.unboundedFollowing))).drop("_least")
    local = F.min("j").over(Window.partitionBy(*key, "_span").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    at = null_safe_join(at.withColumn("_local", local).filter("j IS NULL"), later, [*key, "_span"], "inner")
    nodes = materialise(at.select(*key, F.col("at").alias("o"), F.least("_local", "_later").alias("nxt"), (F.col("at") == F.col("block")).alias("reached")))
    while not nodes.filter("reached AND nxt IS NOT NULL").isEmpty():
        hit = nodes.filter("reached").select(*key, F.col("nxt").alias("o")).filter("o IS NOT NULL").distinct().withColumn("hit", F.lit(True))
        jump = nodes.select(*key, F.col("o").alias("nxt"), F.col("nxt").alias("nxt2"))
        joined = null_safe_join(null_safe_join(nodes, hit, [*key, "o"], "left"), jump, [*key, "nxt"], "left")
        last, nodes = nodes, materialise(joined.select(*key, "o", F.col("nxt2").alias("nxt"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")))
        discard(last)
    return nodes.filter("reached AND o <> block").select(*entity, F.col("o").alias(order))


def _extra_starts(marked: DataFrame, entity: list[str], order: str, fold_most: int) -> DataFrame:
    """Starts that depend on earlier ones: greedy over the possible breaks between two certain breaks."""
    certain = with_carried(marked.filter("sure OR back IS NOT NULL"), entity, order, {"block": F.when(F.col("sure"), F.col(order))})
    maybe = materialise(certain.filter(~F.col("sure") & (F.col("back") >= F.col("block"))).select(*entity, order, "block", "back"))
    many = materialise(maybe.groupBy(*entity, "block").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > fold_most).drop("_n").withColumn("_many", F.lit(True)))
    if many.isEmpty():
        return _folded(maybe, entity, order).withColumn("extra", F.lit(True))
    split = null_safe_join(maybe, many, [*entity, "block"], "left")
    some, rest = split.filter("_many IS NULL").drop("_many"), materialise(split.filter("_many").drop("_many"))
    return _folded(some, entity, order).union(_doubled(rest, entity, order)).withColumn("extra", F.lit(True))


def canonicalise(events: DataFrame, entity: list[str], order: str, states: list[str], max_gap: int, fold_most: int = FOLD_MOST) -> DataFrame:
    """(entity, order, stretch, states): each row with its run's known states; ``stretch`` changes at gaps."""
    at = F.col(order)
    d = with_carried(events, entity, order, {"_prev": at, **{f"_last_{s}": F.when(F.col(s).isNotNull(), F.struct(at.alias("at"), F.col(s).alias("v"))) for s in states}})
    clash: list[Column] = [F.when(F.col(s) != F.col(f"_last_{s}.v"), F.col(f"_last_{s}.at")) for s in states]
    d = d.withColumn("back", F.greatest(*clash, F.lit(None).cast("long")))
    gap = F.col("_prev").isNull() | (at - F.col("_prev") > max_gap)
    d = d.withColumns({"gap": gap, "sure": gap | F.coalesce(F.col("back") == F.col("_prev"), F.lit(False))})
    marked = materialise(d.select(*entity, order, *states, "back", "gap", "sure"))
    d = null_safe_join(marked, _extra_starts(marked, entity, order, fold_most), [*entity, order], "left")
    start = F.when(F.col("sure") | F.coalesce("extra", F.lit(False)), at)
    d = d.withColumns({"_start": start, "_gap": F.when(F.col("gap"), at)})
    d = with_carried(d, entity, order, {"start": F.col("_start"), "stretch": F.col("_gap")})
    d = materialise(d.select(*entity, order, *states, F.coalesce("_start", "start").alias("start"), F.coalesce("_gap", "stretch").alias("stretch")))
    known = d.groupBy(*entity, "start").agg(*[F.min_by(s, F.when(F.col(s).isNotNull(), at)).alias(f"known_{s}") for s in states])
    d = null_safe_join(d, known, [*entity, "start"], "inner")
    return d.select(*entity, order, "stretch", *[F.col(f"known_{s}").alias(s) for s in states])


def collapse_runs(rows: DataFrame, entity: list[str], order: str, states: list[str], row_id: str = "row_id", max_gap: int = 5, fold_most: int = FOLD_MOST) -> DataFrame:
    """(entity, first, last, states, n, duration): one row per run; duration is last minus first order value."""
    events = first_delivery(rows.filter(F.col(order).isNotNull()), [*entity, order], row_id, states).select(*entity, order, *states)
    runs = row_number_difference(canonicalise(events, entity, order, states, max_gap, fold_most), [*entity, "stretch"], order, states)
    out = runs.groupBy(*entity, "stretch", *states, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.select(*entity, "first", "last", *states, "n", (F.col("last") - F.col("first")).alias("duration"))
