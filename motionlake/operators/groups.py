"""Tags and grouped views: tags are columns of the recordings, so grouping moves no data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.functions.chunked import null_safe_join
from motionlake.model import ENTITY


def normalised(tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """Tags in lower case without outer blanks; blank ones are null."""
    return tags.select("handle", *[F.nullif(F.lower(F.trim(n)), F.lit("")).alias(n) for n in names])


def add_tags(recordings: DataFrame, tags: DataFrame, overwrite: bool = False) -> DataFrame:
    clash = (set(tags.columns) & set(recordings.columns)) - {"handle"}
    if clash and not overwrite:
        raise ValueError(f"tags exist: {sorted(clash)}")
    return null_safe_join(recordings.drop(*clash), tags, ["handle"], "left")


def add_usermeta(recordings: DataFrame, handle: str, meta: dict[str, str], overwrite: bool = False) -> DataFrame:
    """Add entries to the map ``usermeta`` of a handle's recordings; present keys raise unless ``overwrite``."""
    have = F.col("usermeta") if "usermeta" in recordings.columns else F.create_map().cast("map<string,string>")
    d = recordings.withColumn("usermeta", F.coalesce(have, F.create_map().cast("map<string,string>")))
    mine = F.col("handle") == F.lit(handle)
    new = F.create_map(*[F.lit(x) for kv in meta.items() for x in kv])
    clash = F.arrays_overlap(F.map_keys("usermeta"), F.map_keys(new))
    if not overwrite and not d.filter(mine & clash).isEmpty():
        raise ValueError(f"usermeta exists on {handle}")
    kept = F.map_filter("usermeta", lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return d.withColumn("usermeta", F.when(mine, F.map_concat(kept, new)).otherwise(F.col("usermeta")))


def add_tag(recordings: DataFrame, handle: str, name: str, value: str, overwrite: bool = False) -> DataFrame:
    """Set one tag of one handle; a present value raises unless ``overwrite``."""
    have = F.col(name) if name in recordings.columns else F.lit(None).cast("string")
    d = recordings.withColumn(name, have)
    mine = F.col("handle") == F.lit(handle)
    if not overwrite and not d.filter(mine & F.col(name).isNotNull()).isEmpty():
        raise ValueError(f"{name} exists on {handle}")
    return d.withColumn(name, F.when(mine, F.lit(value)).otherwise(F.col(name)))


def unmatched(recordings: DataFrame, tags: DataFrame) -> DataFrame:
    """(handle, missing): handles with tags but no recording, and recordings without tags."""
    have = recordings.select("handle").filter("handle IS NOT NULL").distinct()
    unknown = tags.join(have, "handle", "left_anti").select("handle", F.lit("recording").alias("missing"))
    return unknown.unionByName(have.join(tags, "handle", "left_anti").select("handle", F.lit("tags").alias("missing")))


def tags_info(recordings: DataFrame, names: Sequence[str]) -> DataFrame:
    """(tag, attached_to, missing_from, unique_values, value_counts as JSON-free sorted text)."""
    each = recordings.select(F.explode(F.array(*[F.struct(F.lit(n).alias("tag"), F.col(n).cast("string").alias("value")) for n in names])).alias("t")).select("t.*")
    n = each.groupBy("tag", "value").agg(F.count(F.lit(1)).alias("n"))
    has = F.col("value").isNotNull()
    pairs = F.array_sort(F.collect_list(F.when(has, F.concat_ws("=", "value", "n"))))
    return n.groupBy("tag").agg(F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("attached_to"), F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("missing_from"), F.count("value").alias("unique_values"), F.concat_ws(",", pairs).alias("value_counts"))


def group_by_tags(summary: DataFrame, recordings: DataFrame, names: Sequence[str], strict: bool = True) -> DataFrame:
    """The summary rows with their tags as columns; recordings lacking a tag raise (strict) or drop out."""
    tagged = recordings.select(*ENTITY, *names)
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull()
    if strict and (lacking := [r["handle"] for r in tagged.filter(~complete).select("handle").limit(20).collect()]):
        raise ValueError(f"tags missing on {lacking}")
    return null_safe_join(summary, tagged.filter(complete), ENTITY, "inner")


def map_recordings(frames: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Arbitrary function per recording (one recording at a time in a task); the escape hatch."""
    return frames.groupBy(*ENTITY).applyInPandas(fn, schema)
