"""The same features over a stream of readings: per-recording state, and time windows with a watermark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "handle string, take int, frame long, change double"


def live_distance_change(readings: DataFrame, point: str) -> DataFrame:
    """(handle, take, frame, change) of a stream (handle, take, frame, point struct), by frame order in a batch.

    The state is one position per recording. Readings at or before the last frame seen are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame, x, y = state.get if state.exists else (None, None, None)
        pdf = pd.concat(list(batches)).sort_values("frame").drop_duplicates("frame")
        rows = []
        for f, nx, ny in zip(pdf["frame"], pdf["x"], pdf["y"]):
            if frame is not None and f <= frame:
                continue
            change = math.hypot(nx - x, ny - y) if frame is not None and not any(v is None or v != v for v in (x, y, nx, ny)) else None
            rows.append((*key, int(f), change))
            frame, x, y = int(f), None if nx != nx else float(nx), None if ny != ny else float(ny)
        if frame is not None:
            state.update((frame, x, y))
        yield pd.DataFrame(rows, columns=["handle", "take", "frame", "change"])

    flat = readings.select("handle", "take", "frame", F.col(f"{point}.x").alias("x"), F.col(f"{point}.y").alias("y"))
    return flat.groupBy("handle", "take").applyInPandasWithState(step, OUT, "frame long, x double, y double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(readings: DataFrame, time: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(handle, take, start, n): readings per recording and time window; late rows beyond the watermark drop out."""
    r = readings.withColumn("_ts", F.col(time).cast("timestamp")).withWatermark("_ts", late)
    return r.groupBy("handle", "take", F.window("_ts", width)).agg(F.count(F.lit(1)).alias("n")).select("handle", "take", F.col("window.start").alias("start"), "n")
