"""The data model: one row per recording and frame, points as structs, missing values as nulls."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions.chunked import first_delivery

ENTITY = ["handle", "take"]
FRAME = "frame"
DIMS = ("x", "y", "z")


def clean(c: Column) -> Column:
    """NaN as null: Spark orders NaN above every number."""
    return F.nanvl(c, F.lit(None).cast("double"))


def has_field(df: DataFrame, point: str, dim: str) -> bool:
    node = df.schema
    for part in [*point.split("."), dim]:
        found = next((f for f in getattr(node, "fields", []) if f.name == part), None)
        if found is None:
            return False
        node = found.dataType
    return True


def detector_frames(readings: DataFrame, points: Iterable[str] = ("p1", "p2", "p3")) -> DataFrame:
    """(handle, take, frame, points) from detector readings; ``conf`` becomes ``likelihood``.

    Rows without frame are left out; of re-delivered frames the smallest row_id counts.
    """
    points = list(points)
    r = first_delivery(readings.filter(F.col("frame_index").isNotNull()), [*ENTITY, "frame_index"], "row_id", points)
    return r.select(*ENTITY, F.col("frame_index").alias(FRAME), *[F.struct(*[clean(F.col(f"{p}.{d}")).alias(d) for d in DIMS], clean(F.col(f"{p}.conf")).alias("likelihood")).alias(p) for p in points])


@dataclass(frozen=True)
class PoseFrame:
    """Frames with the recordings they belong to and the cleaning steps already applied."""

    frames: DataFrame
    recordings: DataFrame
    steps: dict = field(default_factory=dict)

    @property
    def points(self) -> list[str]:
        """Point names in schema order; ``animal.point`` for several animals."""
        out = []
        for f in self.frames.schema.fields:
            inner = getattr(f.dataType, "fields", None)
            if not inner:
                continue
            if any(hasattr(g.dataType, "fields") for g in inner):
                out += [f"{f.name}.{g.name}" for g in inner if hasattr(g.dataType, "fields")]
            else:
                out.append(f.name)
        return out

    def once(self, step: str, value: object = True) -> dict:
        if step in self.steps:
            raise ValueError(f"{step} was applied before")
        return self.steps | {step: value}

    def with_frames(self, frames: DataFrame, steps: dict | None = None) -> PoseFrame:
        return replace(self, frames=frames, steps=self.steps if steps is None else steps)

    def store(self, name: str, value: Column, overwrite: bool = False, metadata: dict | None = None) -> PoseFrame:
        """Add a feature column; its metadata travels with the column."""
        if name in self.frames.columns and not overwrite:
            raise ValueError(f"{name} exists")
        return self.with_frames(self.frames.withColumn(name, value.alias(name, metadata=metadata or {})))
