"""Column expressions of pose geometry. Nulls propagate; nothing here needs a UDF."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vertex = tuple[Column, Column]


def distance(p: str, q: str, dims: Sequence[str] = ("x", "y")) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(f"{p}.{d}") - F.col(f"{q}.{d}"), 2) for d in dims]))


def azimuth(p: str, q: str) -> Column:
    return F.atan2(F.col(f"{q}.y") - F.col(f"{p}.y"), F.col(f"{q}.x") - F.col(f"{p}.x"))


def azimuth_deviation(base: str, a: str, b: str) -> Column:
    """Signed angle between two directions from ``base``, in [-pi, pi)."""
    return F.pmod(azimuth(base, a) - azimuth(base, b) + F.pi(), 2 * F.pi()) - F.pi()


def within(value: Column, limit: float, absolute: bool = False) -> Column:
    return (F.abs(value) if absolute else value) <= limit


def all_true(conditions: Sequence[Column]) -> Column:
    """Three-valued AND."""
    return reduce(lambda a, b: a & b, conditions)


def point_vertices(points: Sequence[str]) -> list[Vertex]:
    return [(F.col(f"{p}.x"), F.col(f"{p}.y")) for p in points]


def boundary_vertices(boundary: str, n: int) -> list[Vertex]:
    """Vertices of an array<struct<x, y>> column with a known number of vertices."""
    return [(F.get(boundary, F.lit(i))["x"], F.get(boundary, F.lit(i))["y"]) for i in range(n)]


def _edges(vertices: Sequence[Vertex]) -> list[tuple[Vertex, Vertex]]:
    if len(vertices) < 3:
        raise ValueError("a boundary needs at least 3 vertices")
    return list(zip(vertices, [*vertices[1:], vertices[0]]))


def on_outline(x: Column, y: Column, vertices: Sequence[Vertex]) -> Column:
    tests = []
    for (ax, ay), (bx, by) in _edges(vertices):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        tests.append((cross == 0) & (x >= F.least(ax, bx)) & (x <= F.greatest(ax, bx)) & (y >= F.least(ay, by)) & (y <= F.greatest(ay, by)))
    return reduce(lambda a, b: a | b, tests)


def contains(x: Column, y: Column, vertices: Sequence[Vertex]) -> Column:
    """Even-odd rule; points on the outline are outside; null if the point or any vertex is null."""
    crossings = []
    for (ax, ay), (bx, by) in _edges(vertices):
        at = ax + F.try_divide((y - ay) * (bx - ax), by - ay)
        crossings.append(F.when(((ay > y) != (by > y)) & (x < at), 1).otherwise(0))
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in (x, y, *itertools.chain(*vertices))])
    odd = reduce(lambda a, b: a + b, crossings) % 2 == 1
    return F.when(known, odd & ~on_outline(x, y, vertices))


def distance_to_outline(x: Column, y: Column, vertices: Sequence[Vertex]) -> Column:
    parts = []
    for (ax, ay), (bx, by) in _edges(vertices):
        length = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
        t = F.try_divide((x - ax) * (bx - ax) + (y - ay) * (by - ay), length)
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(t, F.lit(0.0))))
        parts.append(F.sqrt(F.pow(x - (ax + t * (bx - ax)), 2) + F.pow(y - (ay + t * (by - ay)), 2)))
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in (x, y, *itertools.chain(*vertices))])
    return F.when(known, F.least(*parts))


def polygon_area(vertices: Sequence[Vertex]) -> Column:
    return F.abs(reduce(lambda a, b: a + b, [ax * by - bx * ay for (ax, ay), (bx, by) in _edges(vertices)])) / 2


def scaled_vertex(v: Vertex, centre: Vertex, sx: float, sy: float) -> Vertex:
    return v[0] + (centre[0] - v[0]) * (1 - sx), v[1] + (centre[1] - v[1]) * (1 - sy)
