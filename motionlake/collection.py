"""Collections of recordings: dict-like access, slices, tag groups, and results with arithmetic.

A collection is one PoseFrame whose recordings carry an order (``seq``, else handle and take); picking, slicing and grouping are filters and
tag columns, so nothing is copied. Operators take ``collection.pose`` and treat all recordings at once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions.chunked import null_safe_join, with_position
from motionlake.model import ENTITY, FRAME, PoseFrame
from motionlake.operators import groups


def loc(frames: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows whose frame lies in [start, end]; both ends belong to the slice."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(FRAME) >= start)
    if end is not None:
        inside = inside & (F.col(FRAME) <= end)
    return frames.filter(inside)


def iloc(frames: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows at positions start to stop - 1 of each recording in frame order; negative ones count from its end."""
    d = with_position(frames, ENTITY, FRAME, "_at")
    if any(v is not None and v < 0 for v in (start, stop)):
        d = null_safe_join(d, d.groupBy(*ENTITY).agg(F.max("_at").alias("_last")), ENTITY, "inner")
    else:
        d = d.withColumn("_last", F.lit(0))
    place = lambda v: F.lit(v) if v >= 0 else F.col("_last") + 1 + v
    if start is not None:
        d = d.filter(F.col("_at") >= place(start))
    if stop is not None:
        d = d.filter(F.col("_at") < place(stop))
    return d.drop("_at", "_last")


@dataclass(frozen=True)
class Collection:
    """Recordings with their frames; ``tags`` names the tag columns it is grouped by."""

    pose: PoseFrame
    tags: tuple[str, ...] = ()

    @staticmethod
    def from_list(poses: Sequence[PoseFrame]) -> Collection:
        """One collection of several; a recording that occurs twice raises. Points that some lack are null there."""
        frames, recordings = poses[0].frames, poses[0].recordings
        for p in poses[1:]:
            frames, recordings = frames.unionByName(p.frames, True), recordings.unionByName(p.recordings, True)
        twice = recordings.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect()
        if twice:
            raise ValueError(f"recordings occur twice: {[(r['handle'], r['take']) for r in twice]}")
        return Collection(PoseFrame(frames, recordings, poses[0].steps))

    def _order(self) -> list[str]:
        return ["seq"] if "seq" in self.pose.recordings.columns else list(ENTITY)

    def keys(self, limit: int | None = None) -> list[tuple]:
        """(handle, take) in order; the recordings, not the frames, come to the driver."""
        r = self.pose.recordings.orderBy(*self._order()).select(*ENTITY)
        return [tuple(x) for x in (r if limit is None else r.limit(limit)).collect()]

    def __len__(self) -> int:
        return self.pose.recordings.count()

    def __iter__(self):
        return iter(self.keys())

    def __contains__(self, handle: object) -> bool:
        return not self.pose.recordings.filter(F.col("handle") == F.lit(handle)).isEmpty()

    def _only(self, keep: DataFrame) -> Collection:
        recordings = null_safe_join(self.pose.recordings, keep, ENTITY, "left_semi")
        return replace(self, pose=replace(self.pose, frames=null_safe_join(self.pose.frames, keep, ENTITY, "left_semi"), recordings=recordings))

    def __getitem__(self, which: str | int | slice) -> Collection:
        """The recordings of a handle, or those at a position or slice of the order."""
        rec = self.pose.recordings
        if isinstance(which, str):
            if which not in self:
                raise KeyError(which)
            return self._only(rec.filter(F.col("handle") == which).select(*ENTITY))
        keys = self.keys()
        picked = keys[which] if isinstance(which, slice) else [keys[which]]
        return self._only(rec.sparkSession.createDataFrame(picked, rec.select(*ENTITY).schema))

    def without(self, handle: str) -> Collection:
        return self._only(self.pose.recordings.filter(~F.col("handle").eqNullSafe(F.lit(handle))).select(*ENTITY))

    def loc(self, start: int | None = None, end: int | None = None) -> Collection:
        return replace(self, pose=self.pose.with_frames(loc(self.pose.frames, start, end)))

    def iloc(self, start: int | None = None, stop: int | None = None) -> Collection:
        return replace(self, pose=self.pose.with_frames(iloc(self.pose.frames, start, stop)))

    def groupby(self, *tags: str) -> Collection:
        """Grouped by tag columns; recordings that lack one raise."""
        lacking = self.pose.recordings.filter(" OR ".join(f"`{t}` IS NULL" for t in tags)).select("handle").limit(20).collect()
        if lacking:
            raise ValueError(f"tags missing on {[r['handle'] for r in lacking]}")
        return replace(self, tags=tags)

    @property
    def is_grouped(self) -> bool:
        return bool(self.tags)

    def flatten(self) -> Collection:
        return replace(self, tags=())

    def regroup(self, *tags: str) -> Collection:
        return self.flatten().groupby(*(tags or self.tags))

    def group_keys(self) -> list[tuple[str, ...]]:
        """Tag values of the groups as text, in order of their first recording."""
        if not self.tags:
            raise ValueError("not grouped")
        order = F.struct(*self._order())
        g = self.pose.recordings.groupBy(*[F.col(t).cast("string").alias(t) for t in self.tags]).agg(F.min(order).alias("_o")).orderBy("_o")
        return [tuple(r[t] for t in self.tags) for r in g.collect()]

    def get_group(self, key: Sequence[str]) -> Collection:
        match = F.lit(True)
        for t, v in zip(self.tags, key, strict=True):
            match = match & (F.col(t).cast("string") == F.lit(v))
        keep = self.pose.recordings.filter(match).select(*ENTITY)
        if keep.isEmpty():
            raise KeyError(tuple(key))
        return self._only(keep).flatten()

    def map_leaves(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Collection:
        """An arbitrary function of each recording's frames; grouping stays."""
        return replace(self, pose=self.pose.with_frames(groups.map_recordings(self.pose.frames, fn, schema)))

    def per_handle(self, values: Mapping[str, object], name: str, kind: str = "double") -> Collection:
        """A different argument for each handle as a column; handles without one raise."""
        spark = self.pose.frames.sparkSession
        table = spark.createDataFrame([(k, v) for k, v in values.items()], f"handle string, `{name}` {kind}")
        lacking = self.pose.recordings.join(table, "handle", "left_anti").select("handle").limit(20).collect()
        if lacking:
            raise KeyError([r["handle"] for r in lacking])
        return replace(self, pose=self.pose.with_frames(self.pose.frames.join(table, "handle")))

    def result(self, value: Column) -> Result:
        return Result(self.pose.frames.select(*ENTITY, FRAME, value.alias("value")))

    def store(self, name: str, result: Result, overwrite: bool = False, metadata: dict | None = None) -> Collection:
        """Add a result as a feature column."""
        if name in self.pose.frames.columns and not overwrite:
            raise ValueError(f"{name} exists")
        r = result.df.select(*ENTITY, FRAME, F.col("value").alias(name, metadata=metadata or {}))
        return replace(self, pose=self.pose.with_frames(null_safe_join(self.pose.frames.drop(name), r, [*ENTITY, FRAME], "left")))


@dataclass(frozen=True)
class Result:
    """(handle, take, frame, value) with element-wise arithmetic; both sides must hold the same recordings."""

    df: DataFrame

    def map(self, fn: Callable[[Column], Column]) -> Result:
        return Result(self.df.withColumn("value", fn(F.col("value"))))

    def astype(self, kind: str) -> Result:
        return self.map(lambda v: v.cast(kind))

    def _with(self, other: Result | object, op: Callable[[Column, Column], Column]) -> Result:
        if not isinstance(other, Result):
            return self.map(lambda v: op(v, F.lit(other)))
        mine, theirs = (x.df.select(*ENTITY).distinct() for x in (self, other))
        apart = null_safe_join(mine, theirs, ENTITY, "left_anti").union(null_safe_join(theirs, mine, ENTITY, "left_anti")).limit(5).collect()
        if apart:
            raise KeyError([tuple(r) for r in apart])
        joined = null_safe_join(self.df, other.df.withColumnRenamed("value", "_other"), [*ENTITY, FRAME], "inner")
        return Result(joined.select(*ENTITY, FRAME, op(F.col("value"), F.col("_other")).alias("value")))

    def __add__(self, o):
        return self._with(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._with(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._with(o, lambda a, b: a * b)

    def __truediv__(self, o):
        return self._with(o, lambda a, b: F.try_divide(a.cast("double"), b))

    def __and__(self, o):
        return self._with(o, lambda a, b: a & b)

    def __or__(self, o):
        return self._with(o, lambda a, b: a | b)

    def __xor__(self, o):
        return self._with(o, lambda a, b: a != b)

    def __invert__(self):
        return self.map(lambda v: ~v)
