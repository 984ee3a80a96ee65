"""Cleaning of keypoint tracks: likelihood filter, trim, rescale, smoothing, interpolation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions import exprs
from motionlake.functions.chunked import null_safe_join, with_neighbours
from motionlake.functions.quantiles import medians
from motionlake.functions.windows import bounded, per_entity, rolling
from motionlake.model import DIMS, ENTITY, FRAME, PoseFrame, has_field


def _map_points(pose: PoseFrame, change: Callable[[str, str], Column | None], frames: DataFrame | None = None) -> DataFrame:
    """Replace point fields by ``change(point, dim)`` where that gives a column."""
    frames = pose.frames if frames is None else frames
    for p in pose.points:
        for d in (*DIMS, "likelihood"):
            if has_field(frames, p, d) and (new := change(p, d)) is not None:
                top, *inner = p.split(".")
                frames = frames.withColumn(top, F.col(top).withField(".".join([*inner, d]), new))
    return frames


def correct_aspect_ratio(pose: PoseFrame, factor: float) -> PoseFrame:
    """Multiply every point's x; every point must have one."""
    if factor == 1.0:
        return pose
    for p in pose.points:
        if not has_field(pose.frames, p, "x"):
            raise KeyError(f"{p}.x")
    return pose.with_frames(_map_points(pose, lambda p, d: F.col(f"{p}.x") * factor if d == "x" else None))


def strip_column_names(names: Sequence[str]) -> dict[str, str]:
    """Old name to its last two dotted parts; clashing results raise."""
    new = {n: ".".join(n.split(".")[-2:]) for n in names}
    if len(set(new.values())) < len(new):
        raise ValueError("stripped names clash")
    return new


def time_as_expected(pose: PoseFrame, least: float, most: float) -> DataFrame:
    """(handle, take, seconds, expected): whether the recording's length lies in the closed interval."""
    span = pose.frames.groupBy(*ENTITY).agg((F.max(FRAME) - F.min(FRAME)).alias("frames"))
    span = null_safe_join(span, pose.recordings.select(*ENTITY, "fps"), ENTITY, "inner")
    seconds = F.try_divide(F.col("frames"), F.col("fps"))
    return span.select(*ENTITY, seconds.alias("seconds"), seconds.between(least, most).alias("expected"))


def trim(pose: PoseFrame, start: int | None = None, end: int | None = None) -> PoseFrame:
    """Inclusive slice by frame; a negative end counts from each recording's last frame."""
    f = pose.frames
    if start is not None:
        f = f.filter(F.col(FRAME) >= start)
    if end is not None and end >= 0:
        f = f.filter(F.col(FRAME) <= end)
    elif end is not None:
        f = per_entity(f, ENTITY, [F.max(FRAME).alias("_last")]).filter(F.col(FRAME) <= F.col("_last") + end).drop("_last")
    return pose.with_frames(f, pose.steps | {"trim": (start, end)})


def filter_likelihood(pose: PoseFrame, threshold: float) -> PoseFrame:
    """Coordinates of points with likelihood at or below the threshold become null; a null likelihood keeps them."""
    steps = pose.once("filter_likelihood", threshold)
    change = lambda p, d: F.when(F.col(f"{p}.likelihood") <= threshold, F.lit(None)).otherwise(F.col(f"{p}.{d}")) if d in DIMS and has_field(pose.frames, p, "likelihood") else None
    return pose.with_frames(_map_points(pose, change), steps)


def rescale_by_known_distance(pose: PoseFrame, p: str, q: str, metres: float, dims: Sequence[str] = ("x", "y")) -> PoseFrame:
    """Scale ``dims`` of all points so that the median distance of two points is ``metres``."""
    done = pose.steps.get("rescale", {})
    if set(done) & set(dims):
        raise ValueError("these dimensions were rescaled before")
    m = medians(pose.frames, ENTITY, {"_median": exprs.distance(p, q, dims)})
    f = null_safe_join(pose.frames, m.select(*ENTITY, F.try_divide(F.lit(metres), "_median").alias("_factor")), ENTITY, "inner")
    f = _map_points(pose, lambda r, d: F.col(f"{r}.{d}") * F.col("_factor") if d in dims else None, f).drop("_factor")
    return pose.with_frames(f, pose.steps | {"rescale": done | {d: metres for d in dims}})


def smooth_all(pose: PoseFrame, window: int | None = 3, method: str = "mean", overrides: Sequence[tuple[Sequence[str], str, int | None]] = (), dims: Sequence[str] = ("x", "y"), strict: bool = False, smoother: Callable[[pd.Series], pd.Series] | None = None) -> PoseFrame:
    """Trailing rolling mean or median per point; a window with a null, or too short, gives null.

    ``overrides`` set (points, method, window) for some points; a window of None or 0 leaves a point alone.
    ``smoother`` replaces the method by a function of one coordinate's whole series (one recording a task).
    """
    steps = pose.once("smooth", (window, method))
    spec = {p: (method, window) for p in pose.points}
    for points, m, k in overrides:
        unknown = set(points) - set(spec)
        if unknown and strict:
            raise ValueError(f"unknown points {sorted(unknown)}")
        spec |= {p: (m, k) for p in points if p in spec}
    spec = {p: (m, k) for p, (m, k) in spec.items() if k and k > 0}
    cols = {f"_s{i}": (p, d) for i, (p, d) in enumerate((p, d) for p in spec for d in dims if has_field(pose.frames, p, d))}
    if not cols:
        return pose.with_frames(pose.frames, steps)
    if smoother is not None:
        flat = pose.frames.withColumns({n: F.col(f"{p}.{d}") for n, (p, d) in cols.items()})

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(FRAME)
            for n in cols:
                pdf[n] = smoother(pdf[n])
            return pdf

        f = flat.groupBy(*ENTITY).applyInPandas(run, flat.schema)
    else:
        most = max(k for _, k in spec.values())
        f = bounded(pose.frames, ENTITY, FRAME, most - 1, 0, lambda w: {n: rolling(F.col(f"{p}.{d}"), w, spec[p][1], spec[p][0]) for n, (p, d) in cols.items()})
    back = {v: k for k, v in cols.items()}
    f = _map_points(pose, lambda p, d: F.col(back[p, d]) if (p, d) in back else None, f)
    return pose.with_frames(f.drop(*cols), steps)


def smooth(pose: PoseFrame, params: Mapping[str, tuple[str, int | None]]) -> PoseFrame:
    """Trailing window over x, y and z by (method, window) of every point; a point without entry raises. Older form of ``smooth_all``."""
    lacking = set(pose.points) - set(params)
    if lacking:
        raise ValueError(f"no parameters for {sorted(lacking)}")
    return smooth_all(pose, None, overrides=[([p], m, k) for p, (m, k) in params.items()], dims=DIMS, strict=True)


def smoothing_params(pose: PoseFrame, points: Sequence[Sequence[str]], methods: Sequence[str], windows: Sequence[int]) -> dict[str, tuple[str, int]]:
    """(method, window) per point from lists of points with one method and window each; for ``smooth``."""
    out = {p: (m, k) for some, m, k in zip(points, methods, windows, strict=True) for p in some}
    unknown = set(out) - set(pose.points)
    if unknown:
        raise ValueError(f"unknown points {sorted(unknown)}")
    return out


def interpolate(pose: PoseFrame, method: str = "linear", limit: int = 1, dims: Sequence[str] = DIMS) -> PoseFrame:
    """Fill at most ``limit`` nulls at the start of each gap, by row position; all likelihoods become null.

    ``linear``: between the values on either side, the last value after the end. ``pad``: the last value.
    ``nearest``: the nearer value (the earlier on ties). Nulls before the first value stay.
    """
    if method not in ("linear", "pad", "nearest"):
        raise ValueError(f"unknown method {method}")
    steps = pose.once("interpolate", (method, limit))
    cols = {f"_i{i}": (p, d) for i, (p, d) in enumerate((p, d) for p in pose.points for d in dims if has_field(pose.frames, p, d))}
    f = with_neighbours(pose.frames, ENTITY, FRAME, {n: F.col(f"{p}.{d}") for n, (p, d) in cols.items()})

    def filled(n: str, c: Column) -> Column:
        prev, nxt, pos = F.col(f"{n}_prev"), F.col(f"{n}_next"), F.col("pos")
        line = prev["v"] + (nxt["v"] - prev["v"]) * (pos - prev["pos"]) / (nxt["pos"] - prev["pos"])
        near = F.when(nxt["pos"] - pos < pos - prev["pos"], nxt["v"]).otherwise(prev["v"])
        value = {"linear": F.coalesce(line, prev["v"]), "pad": prev["v"], "nearest": F.coalesce(near, prev["v"])}[method]
        return F.when(c.isNotNull(), c).when(pos - prev["pos"] <= limit, value)

    back = {v: k for k, v in cols.items()}
    change = lambda p, d: F.lit(None).cast("double") if d == "likelihood" else filled(back[p, d], F.col(f"{p}.{d}")) if (p, d) in back else None
    f = _map_points(pose, change, f)
    return pose.with_frames(f.drop("pos", *[f"{n}_{s}" for n in cols for s in ("prev", "next")]), steps)
