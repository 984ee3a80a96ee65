"""Several camera views: identity alignment and stereo triangulation."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions.assignment import assign
from motionlake.functions.chunked import null_safe_join


def pair_cost(a: str, b: str, keypoints: Sequence[str], no_overlap: float = 1e6) -> Column:
    """Sum of distances over keypoints valid in both views; a large constant without any."""
    d = [F.sqrt(F.pow(F.col(f"{a}.{k}.x") - F.col(f"{b}.{k}.x"), 2) + F.pow(F.col(f"{a}.{k}.y") - F.col(f"{b}.{k}.y"), 2)) for k in keypoints]
    valid = sum((x.isNotNull().cast("int") for x in d), F.lit(0))
    return F.when(valid > 0, sum((F.coalesce(x, F.lit(0.0)) for x in d), F.lit(0.0))).otherwise(no_overlap)


def align_ids(df: DataFrame, first: Sequence[str], second: Sequence[str], keypoints: Sequence[str]) -> DataFrame:
    """Add ``assignment``: for each animal of the first view the index of its animal in the second (0-based).

    Up to 4 animals all permutations are compared as expressions (the first in order on ties); more are
    assigned by a vectorised matching.
    """
    n = len(first)
    if len(second) != n:
        raise ValueError("both views need the same animals")
    cost = [[pair_cost(a, b, keypoints) for b in second] for a in first]
    if n <= 4:
        options = [F.struct(sum((cost[i][p[i]] for i in range(n)), F.lit(0.0)).alias("c"), F.lit(k).alias("k"), F.array(*map(F.lit, p)).alias("p")) for k, p in enumerate(itertools.permutations(range(n)))]
        return df.withColumn("assignment", F.array_min(F.array(*options))["p"])

    @F.pandas_udf("array<int>")
    def solve(flat: pd.Series) -> pd.Series:
        return flat.map(lambda v: [j for _, j in assign(np.array(v, float).reshape(n, n))])

    return df.withColumn("assignment", solve(F.array(*[c for row in cost for c in row])))


def undistort(uv: np.ndarray, k: np.ndarray, dist: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Normalised coordinates of pixels by fixed-point iteration of the radial-tangential model."""
    x0 = (uv[:, 0] - k[0, 2]) / k[0, 0]
    y0 = (uv[:, 1] - k[1, 2]) / k[1, 1]
    k1, k2, p1, p2, k3 = np.r_[dist, np.zeros(5)][:5]
    x, y = x0.copy(), y0.copy()
    for _ in range(rounds):
        r2 = x * x + y * y
        radial = 1 + ((k3 * r2 + k2) * r2 + k1) * r2
        dx, dy = 2 * p1 * x * y + p2 * (r2 + 2 * x * x), p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
        x, y = (x0 - dx) / radial, (y0 - dy) / radial
    return np.stack([x, y], axis=1)


def triangulate_points(a: np.ndarray, b: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Points in the first camera's frame from normalised coordinates: batched direct linear transform."""
    p1, p2 = np.eye(3, 4), np.hstack([r, t.reshape(3, 1)])
    m = np.stack([a[:, :1] * p1[2] - p1[0], a[:, 1:] * p1[2] - p1[1], b[:, :1] * p2[2] - p2[0], b[:, 1:] * p2[2] - p2[1]], axis=1)
    v = np.linalg.svd(m)[2][:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return v[:, :3] / v[:, 3:]


def stereo_triangulate(views: DataFrame, invert_z: bool = True) -> DataFrame:
    """Add ``xyz`` struct and ``likelihood`` to rows (u1, v1, l1, u2, v2, l2, k1, d1, k2, d2, r, t).

    ``r`` and ``t`` bring points of the first camera into the second. Rows with a missing coordinate give null.
    """

    @F.pandas_udf("struct<x: double, y: double, z: double>")
    def solve(u1: pd.Series, v1: pd.Series, u2: pd.Series, v2: pd.Series, k1: pd.Series, d1: pd.Series, k2: pd.Series, d2: pd.Series, r: pd.Series, t: pd.Series) -> pd.DataFrame:
        out = np.full((len(u1), 3), np.nan)
        uv1, uv2 = np.stack([u1, v1], 1).astype(float), np.stack([u2, v2], 1).astype(float)
        cams = pd.Series([str([np.asarray(x).tolist() for x in c]) for c in zip(k1.map(list), d1, k2.map(list), d2, r.map(list), t)])
        known = np.isfinite(uv1).all(1) & np.isfinite(uv2).all(1)
        for _, at in cams.groupby(cams).groups.items():
            i = np.asarray(at)
            i = i[known[i]]
            if not len(i):
                continue
            mat = lambda s: np.array([list(x) for x in s.iloc[i[0]]], float)
            vec = lambda s: np.array(list(s.iloc[i[0]]), float)
            a, b = undistort(uv1[i], mat(k1), vec(d1)), undistort(uv2[i], mat(k2), vec(d2))
            out[i] = triangulate_points(a, b, mat(r), vec(t))
        if invert_z:
            out[:, 2] = -out[:, 2]
        f = pd.DataFrame(out, columns=["x", "y", "z"])
        return f.where(f.notna(), None)

    d = views.withColumn("xyz", solve("u1", "v1", "u2", "v2", "k1", "d1", "k2", "d2", "r", "t"))
    return d.withColumns({"xyz": F.when(F.col("xyz.x").isNotNull(), F.col("xyz")), "likelihood": F.when(F.col("xyz.x").isNotNull(), F.least("l1", "l2"))})


def join_views(left: DataFrame, right: DataFrame, entity: list[str], order: str) -> DataFrame:
    """Frames that both views have; the views' columns as structs ``left`` and ``right``."""
    keys = [*entity, order]
    one = lambda d, n: d.select(*keys, F.struct(*[c for c in d.columns if c not in keys]).alias(n))
    return null_safe_join(one(left, "left"), one(right, "right"), keys, "inner")
