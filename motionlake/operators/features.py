"""Per-frame features with their conventional names, and boundaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions import exprs
from motionlake.functions.chunked import null_safe_join
from motionlake.functions.quantiles import medians
from motionlake.functions.windows import bounded
from motionlake.model import ENTITY, FRAME, PoseFrame

XY = ("x", "y")


def boundary_id(points: Sequence[str]) -> str:
    return "_".join(points) if len(points) <= 4 else "_".join([*points[:2], "...", *points[-2:]])


def named(kind: str, *points: str, dims: Sequence[str] = XY, value: float | None = None) -> str:
    """Conventional feature name, e.g. ``speed_of_p1_in_xy``."""
    d = "".join(dims)
    return {
        "distance_between": lambda p, q: f"distance_between_{p}_and_{q}_in_{d}",
        "within_distance": lambda p, q: f"within_distance_{p}_to_{q}_leq_{value}_in_{d}",
        "distance_change": lambda p: f"distance_change_{p}_in_{d}",
        "speed": lambda p: f"speed_of_{p}_in_{d}",
        "acceleration": lambda p: f"acceleration_of_{p}_in_{d}",
        "above_speed": lambda p: f"above_speed_{p}_geq_{value}_in_{d}",
        "below_speed": lambda p: f"below_speed_{p}_lt_{value}_in_{d}",
        "azimuth": lambda p, q: f"azimuth_from_{p}_to_{q}",
        "within_boundary_static": lambda p, b: f"within_boundary_static_{p}_in_{b}",
        "within_boundary_dynamic": lambda p, b: f"within_boundary_dynamic_{p}_in_{b}",
        "distance_to_boundary_static": lambda p, b: f"distance_to_boundary_static_{p}_in_{b}",
        "distance_to_boundary_dynamic": lambda p, b: f"distance_to_boundary_dynamic_{p}_in_{b}",
    }[kind](*points)


def with_motion(pose: PoseFrame, points: Sequence[str], dims: Sequence[str] = XY) -> PoseFrame:
    """Add ``change_``, ``speed_`` and ``acceleration_`` of the points, by row adjacency; one pass for all.

    Acceleration is the change of speed times fps; both need a recording with fps.
    """
    def add(w) -> dict[str, Column]:
        out = {}
        for p in points:
            def step(k: int, p=p) -> Column:
                return F.sqrt(sum((F.pow(F.lag(f"{p}.{d}", k).over(w) - F.lag(f"{p}.{d}", k + 1).over(w), 2) if k else F.pow(F.col(f"{p}.{d}") - F.lag(f"{p}.{d}").over(w), 2) for d in dims), F.lit(0.0)))
            out |= {f"change_{p}": step(0), f"_before_{p}": step(1)}
        return out

    f = bounded(pose.frames, ENTITY, FRAME, 2, 0, add)
    f = null_safe_join(f, pose.recordings.select(*ENTITY, F.col("fps").alias("_fps")), ENTITY, "left")
    f = f.withColumns({k: v for p in points for k, v in {f"speed_{p}": F.col(f"change_{p}") * F.col("_fps"), f"acceleration_{p}": (F.col(f"change_{p}") - F.col(f"_before_{p}")) * F.col("_fps") * F.col("_fps")}.items()})
    return pose.with_frames(f.drop("_fps", *[f"_before_{p}" for p in points]))


def above_speed(point: str, speed: float) -> Column:
    return F.col(f"speed_{point}") >= speed


def below_speed(point: str, speed: float) -> Column:
    return F.col(f"speed_{point}") < speed


def all_above_speed(points: Sequence[str], speed: float) -> Column:
    return exprs.all_true([above_speed(p, speed) for p in points])


def all_below_speed(points: Sequence[str], speed: float) -> Column:
    return exprs.all_true([below_speed(p, speed) for p in points])


def point_medians(pose: PoseFrame, points: Sequence[str], dims: Sequence[str] = XY) -> DataFrame:
    """(handle, take, {point}: struct of exact medians); one row per recording."""
    m = medians(pose.frames, ENTITY, {f"{p}|{d}": F.col(f"{p}.{d}") for p in points for d in dims})
    return m.select(*ENTITY, *[F.struct(*[F.col(f"`{p}|{d}`").alias(d) for d in dims]).alias(p) for p in points])


def define_boundary(pose: PoseFrame, points: Sequence[str], scaling: float = 1.0, scaling_y: float | None = None, centre: str | Sequence[str] | None = None) -> DataFrame:
    """(handle, take, boundary array<struct<x, y>>): point medians scaled about a centre.

    The centre is the mean of the vertices, the median of one point, or the mean of several medians.
    """
    about = list(points) if centre is None else [centre] if isinstance(centre, str) else list(centre)
    m = point_medians(pose, sorted({*points, *about}))
    mid = tuple(sum((F.col(f"{p}.{d}") for p in about), F.lit(0.0)) / len(about) for d in XY)
    vs = [exprs.scaled_vertex(v, mid, scaling, scaling if scaling_y is None else scaling_y) for v in exprs.point_vertices(points)]
    return m.select(*ENTITY, F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in vs]).alias("boundary"))


def with_boundary(pose: PoseFrame, boundaries: DataFrame) -> DataFrame:
    return null_safe_join(pose.frames, boundaries, ENTITY, "left")


def _vertices(pose: PoseFrame, points: Sequence[str], median: bool) -> tuple[DataFrame, list]:
    """Frames and the vertices of the boundary through the points: their medians, or where they are in each frame."""
    if not median:
        return pose.frames, exprs.point_vertices(points)
    return with_boundary(pose, define_boundary(pose, points)), exprs.boundary_vertices("boundary", len(points))


def within_boundary(pose: PoseFrame, point: str, boundary: Sequence[str], median: bool = True) -> PoseFrame:
    """Older form of the static (``median``) and dynamic boundary test; adds the conventionally named column."""
    f, v = _vertices(pose, boundary, median)
    name = named(f"within_boundary_{'static' if median else 'dynamic'}", point, boundary_id(boundary))
    return pose.with_frames(f.withColumn(name, exprs.contains(F.col(f"{point}.x"), F.col(f"{point}.y"), v)).drop("boundary"))


def distance_to_boundary(pose: PoseFrame, point: str, boundary: Sequence[str], median: bool = True) -> PoseFrame:
    """Older form of the static (``median``) and dynamic distance to a boundary."""
    f, v = _vertices(pose, boundary, median)
    name = named(f"distance_to_boundary_{'static' if median else 'dynamic'}", point, boundary_id(boundary))
    return pose.with_frames(f.withColumn(name, exprs.distance_to_outline(F.col(f"{point}.x"), F.col(f"{point}.y"), v)).drop("boundary"))


def ellipse_from_params(pose: PoseFrame, centre: str | Sequence[str], major: float, minor: float, angle: float = 0.0, n: int = 100) -> DataFrame:
    """(handle, take, boundary): ellipse with the given axis lengths about the median of the centre."""
    about = [centre] if isinstance(centre, str) else list(centre)
    m = point_medians(pose, about)
    cx, cy = (sum((F.col(f"{p}.{d}") for p in about), F.lit(0.0)) / len(about) for d in XY)

    def vertex(i: Column) -> Column:
        t = i * (2 * math.pi / n)
        a, b = major / 2 * F.cos(t), minor / 2 * F.sin(t)
        return F.struct((cx + a * math.cos(angle) - b * math.sin(angle)).alias("x"), (cy + a * math.sin(angle) + b * math.cos(angle)).alias("y"))

    return m.select(*ENTITY, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), vertex).alias("boundary"))


def fit_ellipse(xy: np.ndarray, weight: float = 0.1) -> tuple[float, float, float, float, float]:
    """(cx, cy, a, b, angle). More than 4 points: direct least squares conic fit; 4: the smallest residual
    plus ``weight`` times a·b, searched by simplex descent from the covariance ellipse."""
    c = xy.mean(0)
    s = float(np.abs(xy - c).max()) or 1.0
    x, y = ((xy - c) / s).T
    if len(xy) > 4:
        d1, d2 = np.stack([x * x, x * y, y * y], 1), np.stack([x, y, np.ones_like(x)], 1)
        s1, s2, s3 = d1.T @ d1, d1.T @ d2, d2.T @ d2
        t = -np.linalg.solve(s3, s2.T)
        m = np.linalg.solve(np.array([[0, 0, 2.0], [0, -1.0, 0], [2.0, 0, 0]]), s1 + s2 @ t)
        _, v = np.linalg.eig(m)
        v = v.real
        good = int(np.argmax(4 * v[0] * v[2] - v[1] ** 2))
        a, b, cc, d, e, f = np.r_[v[:, good], t @ v[:, good]]
        q = np.array([[a, b / 2], [b / 2, cc]])
        mid = np.linalg.solve(2 * q, -np.array([d, e]))
        level = -(f + np.array([d, e]) @ mid / 2)
        val, vec = np.linalg.eigh(q * np.sign(level))
        axes = np.sqrt(abs(level) / np.abs(val))
        return (*(mid * s + c), axes[0] * s, axes[1] * s, math.atan2(vec[1, 0], vec[0, 0]))

    def loss(p: np.ndarray) -> float:
        mx, my, a, b, th = p
        u, w = (x - mx) * math.cos(th) + (y - my) * math.sin(th), -(x - mx) * math.sin(th) + (y - my) * math.cos(th)
        return float((((u / a) ** 2 + (w / b) ** 2 - 1) ** 2).sum() + weight * abs(a * b)) if abs(a) > 1e-9 and abs(b) > 1e-9 else 1e18

    best = simplex(loss, np.array([0.0, 0.0, 1.0, 0.7, 0.3]))
    return (best[0] * s + c[0], best[1] * s + c[1], abs(best[2]) * s, abs(best[3]) * s, best[4])


def simplex(f, start: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Downhill simplex."""
    pts = [start] + [start + 0.25 * np.eye(len(start))[i] for i in range(len(start))]
    val = [f(p) for p in pts]
    for _ in range(rounds):
        o = np.argsort(val)
        pts, val = [pts[i] for i in o], [val[i] for i in o]
        if abs(val[-1] - val[0]) < 1e-14:
            break
        mid = np.mean(pts[:-1], axis=0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr < val[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            k = mid + 0.5 * (pts[-1] - mid)
            fk = f(k)
            if fk < val[-1]:
                pts[-1], val[-1] = k, fk
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [f(p) for p in pts]
    return pts[int(np.argmin(val))]


def ellipse_from_points(pose: PoseFrame, points: Sequence[str], n: int = 100, scaling: float = 1.0, weight: float = 0.1) -> DataFrame:
    """(handle, take, boundary): ellipse fitted to the medians of at least 4 points; one row per recording."""
    if len(points) < 4:
        raise ValueError("an ellipse needs at least 4 points")
    m = point_medians(pose, points).select(*ENTITY, F.array(*[F.array(f"{p}.x", f"{p}.y") for p in points]).alias("xy"))

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def outline(col: pd.Series) -> pd.Series:
        def one(v) -> list | None:
            xy = np.array([list(p) for p in v], dtype=float)
            if not np.isfinite(xy).all():
                return None
            cx, cy, a, b, th = fit_ellipse(xy, weight)
            t = np.arange(n) * 2 * np.pi / n
            u, w = scaling * a * np.cos(t), scaling * b * np.sin(t)
            return [{"x": p, "y": q} for p, q in zip(cx + u * np.cos(th) - w * np.sin(th), cy + u * np.sin(th) + w * np.cos(th))]

        return col.map(one)

    return m.select(*ENTITY, outline("xy").alias("boundary"))


def embedding(frames: DataFrame, shifts: dict[str, Sequence[int]]) -> DataFrame:
    """(entity, frame, lagged columns): ``c_t0``, ``c_t+1`` (future), ``c_t-1`` (past)."""
    missing = set(shifts) - set(frames.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    every = [s for v in shifts.values() for s in v]

    def add(w) -> dict[str, Column]:
        return {f"{c}_t{'+' if s > 0 else ''}{s}": F.lead(c, s).over(w) if s > 0 else F.lag(c, -s).over(w) if s < 0 else F.col(c) for c, v in shifts.items() for s in v}

    out = bounded(frames.select(*ENTITY, FRAME, *shifts), ENTITY, FRAME, max(0, -min(every)), max(0, *every, 0), add)
    return out.drop(*shifts)
