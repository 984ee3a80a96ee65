"""Queries of the pose operators on the test tables, each with the SQL it is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake import collection
from motionlake.functions import exprs
from motionlake.functions.chunked import null_safe_join
from motionlake.model import ENTITY, FRAME, PoseFrame, detector_frames
from motionlake.operators import bfa, clean, features, groups, labels, ml, multiview, predictors, summary
from motionlake.session import read_table, shared_dir
from motionlake.sources import pose_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = "handle, take, frame"
TAGS = ["treatment", "timepoint", "room"]


def query(sql: str | None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def pose(spark: SparkSession, d: str) -> PoseFrame:
    return PoseFrame(detector_frames(read_table(spark, d, "yolo3r")), read_table(spark, d, "recordings"))


def r(c, name: str, digits: int = 5):
    return F.round(c, digits).alias(name)


def cols(df: DataFrame, *out, key=(*ENTITY, FRAME)) -> DataFrame:
    return df.select(*key, *out)


_P = ", ".join(f"CASE WHEN isnan({p}.{c}) THEN NULL ELSE {p}.{c} END AS {p}{n}" for p in ("p1", "p2", "p3") for c, n in (("x", "x"), ("y", "y"), ("z", "z"), ("conf", "l")))
FR = f"""f AS (SELECT handle, take, frame_index AS frame, {_P} FROM (
  SELECT *, row_number() OVER (PARTITION BY handle, take, frame_index ORDER BY row_id) AS k FROM yolo3r WHERE frame_index IS NOT NULL) q WHERE k = 1)"""
W = "WINDOW w AS (PARTITION BY handle, take ORDER BY frame)"
ON = "ON {0}.handle IS NOT DISTINCT FROM {1}.handle AND {0}.take IS NOT DISTINCT FROM {1}.take"


def dist(p: str, q: str) -> str:
    return f"sqrt(pow({p}x - {q}x, 2) + pow({p}y - {q}y, 2))"


# --- cleaning ---------------------------------------------------------------------------------


@query(f"WITH {FR} SELECT f.handle, f.take, round((max(frame) - min(frame)) / fps, 5) AS seconds, (max(frame) - min(frame)) / fps BETWEEN 10 AND 600 AS expected FROM f JOIN recordings r {ON.format('f', 'r')} GROUP BY f.handle, f.take, fps")
def time_as_expected(spark, d):
    return clean.time_as_expected(pose(spark, d), 10, 600).select(*ENTITY, r("seconds", "seconds"), "expected")


@query(f"WITH {FR}, l AS (SELECT *, max(frame) OVER (PARTITION BY handle, take) AS last FROM f WHERE frame >= 50) SELECT {KEY}, p1x AS x FROM l WHERE frame <= last - 100")
def trim(spark, d):
    return cols(clean.trim(pose(spark, d), 50, -100).frames, F.col("p1.x").alias("x"))


@query(f"WITH {FR} SELECT {KEY}, " + ", ".join(f"CASE WHEN {p}l <= 0.75 THEN NULL ELSE {p}{c} END AS {p}_{c}" for p in ("p1", "p2") for c in "xyz") + " FROM f")
def filter_likelihood(spark, d):
    return cols(clean.filter_likelihood(pose(spark, d), 0.75).frames, *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("p1", "p2") for c in "xyz"])


@query(f"WITH {FR} SELECT {KEY}, round(p1x * 1.25, 5) AS x, p1y AS y FROM f")
def aspect_ratio(spark, d):
    return cols(clean.correct_aspect_ratio(pose(spark, d), 1.25).frames, r("p1.x", "x"), F.col("p1.y").alias("y"))


@query(f"WITH {FR}, m AS (SELECT handle, take, median({dist('p1', 'p2')}) AS m FROM f GROUP BY 1, 2) SELECT f.handle, f.take, frame, CASE WHEN m <> 0 THEN round(p3x * 0.2 / m, 5) END AS x, p3z AS z FROM f JOIN m {ON.format('f', 'm')}")
def rescale_known_distance(spark, d):
    return cols(clean.rescale_by_known_distance(pose(spark, d), "p1", "p2", 0.2).frames, r("p3.x", "x"), F.col("p3.z").alias("z"))


@query(f"WITH {FR} SELECT {KEY}, CASE WHEN count(p1x) OVER t = 3 THEN round(avg(p1x) OVER t, 5) END AS x, CASE WHEN count(p2x) OVER u = 5 THEN round(median(p2x) OVER u, 5) END AS x2, p1z AS z FROM f WINDOW t AS (PARTITION BY handle, take ORDER BY frame ROWS 2 PRECEDING), u AS (PARTITION BY handle, take ORDER BY frame ROWS 4 PRECEDING)")
def smooth_all(spark, d):
    return cols(clean.smooth_all(pose(spark, d), 3, "mean", [(["p2"], "median", 5)]).frames, r("p1.x", "x"), r("p2.x", "x2"), F.col("p1.z").alias("z"))


_NUM = f"WITH {FR}, n AS (SELECT *, row_number() OVER w AS rn FROM f {W}), v AS (SELECT *, last_value(CASE WHEN p1x IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS pr, last_value(p1x IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN p1x IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS nr, first_value(p1x IGNORE NULLS) OVER a AS nv FROM n WINDOW b AS (PARTITION BY handle, take ORDER BY frame ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY handle, take ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "


@query(_NUM + f"SELECT {KEY}, round(CASE WHEN p1x IS NOT NULL THEN p1x WHEN rn - pr <= 2 THEN coalesce(pv + (nv - pv) * (rn - pr) / (nr - pr), pv) END, 5) AS x, CAST(NULL AS DOUBLE) AS likelihood FROM v")
def interpolate_linear(spark, d):
    return cols(clean.interpolate(pose(spark, d), "linear", 2).frames, r("p1.x", "x"), F.col("p1.likelihood").alias("likelihood"))


@query(_NUM + f"SELECT {KEY}, CASE WHEN p1x IS NOT NULL THEN p1x WHEN rn - pr <= 3 THEN CASE WHEN nr - rn < rn - pr THEN nv ELSE pv END END AS x FROM v")
def interpolate_nearest(spark, d):
    return cols(clean.interpolate(pose(spark, d), "nearest", 3).frames, F.col("p1.x").alias("x"))


# --- features ---------------------------------------------------------------------------------


@query(f"WITH {FR} SELECT {KEY}, round({dist('p1', 'p2')}, 5) AS distance_between_p1_and_p2_in_xy, {dist('p1', 'p3')} <= 75.0 AS within FROM f")
def distance_between(spark, d):
    return cols(pose(spark, d).frames, r(exprs.distance("p1", "p2"), features.named("distance_between", "p1", "p2")), exprs.within(exprs.distance("p1", "p3"), 75.0).alias("within"))


@query(f"WITH {FR} SELECT handle, take, " + ", ".join(f"round(median({p}{c}), 5) AS {p}_{c}" for p in ("p1", "p2", "p3") for c in "xy") + " FROM f GROUP BY 1, 2")
def point_median(spark, d):
    return features.point_medians(pose(spark, d), ["p1", "p2", "p3"]).select(*ENTITY, *[r(f"{p}.{c}", f"{p}_{c}") for p in ("p1", "p2", "p3") for c in "xy"])


_MED = "m AS (SELECT handle, take, " + ", ".join(f"median({p}{c}) AS {p}{c}" for p in ("p1", "p2", "p3") for c in "xy") + " FROM f GROUP BY 1, 2), c AS (SELECT *, (p1x + p2x + p3x) / 3 AS cx, (p1y + p2y + p3y) / 3 AS cy FROM m), bd AS (SELECT handle, take, " + ", ".join(f"{p}{a} + (c{a} - {p}{a}) * (1 - {s}) AS {v}{a}" for p, v in (("p1", "a"), ("p2", "b"), ("p3", "e")) for a, s in (("x", "8.0"), ("y", "6.0"))) + " FROM c)"
_STATIC = f"WITH {FR}, {_MED}, j AS (SELECT f.handle, f.take, frame, p1x AS x, p1y AS y, ax, ay, bx, by_ AS byy, ex, ey FROM f LEFT JOIN (SELECT handle, take, ax, ay, bx, \"by\" AS by_, ex, ey FROM bd) bd {ON.format('f', 'bd')}) "


def _sql_contains(v: list[tuple[str, str]], x: str = "x", y: str = "y") -> str:
    edges = list(zip(v, [*v[1:], v[0]]))
    odd = " + ".join(f"CASE WHEN (({ay} > {y}) <> ({by} > {y})) AND {x} < {ax} + ({y} - {ay}) * ({bx} - {ax}) / nullif({by} - {ay}, 0) THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in edges)
    on = " OR ".join(f"(({bx} - {ax}) * ({y} - {ay}) - ({by} - {ay}) * ({x} - {ax}) = 0 AND {x} BETWEEN least({ax}, {bx}) AND greatest({ax}, {bx}) AND {y} BETWEEN least({ay}, {by}) AND greatest({ay}, {by}))" for (ax, ay), (bx, by) in edges)
    known = " AND ".join(f"{c} IS NOT NULL" for c in [x, y, *(c for p in v for c in p)])
    return f"CASE WHEN {known} THEN (({odd}) % 2 = 1) AND NOT ({on}) END"


def _sql_outline(v: list[tuple[str, str]], x: str = "x", y: str = "y") -> str:
    parts = []
    for (ax, ay), (bx, by) in zip(v, [*v[1:], v[0]]):
        t = f"least(1.0, greatest(0.0, coalesce((({x} - {ax}) * ({bx} - {ax}) + ({y} - {ay}) * ({by} - {ay})) / nullif(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2), 0), 0.0)))"
        parts.append(f"sqrt(pow({x} - ({ax} + {t} * ({bx} - {ax})), 2) + pow({y} - ({ay} + {t} * ({by} - {ay})), 2))")
    known = " AND ".join(f"{c} IS NOT NULL" for c in [x, y, *(c for p in v for c in p)])
    return f"CASE WHEN {known} THEN round(least({', '.join(parts)}), 4) END"


_ABE = [("ax", "ay"), ("bx", "byy"), ("ex", "ey")]
_DYN = [("p1x", "p1y"), ("p2x", "p2y"), ("q3x", "q3y")]


@query(f"WITH {FR}, {_MED} SELECT handle, take, " + ", ".join(f'round("{v}{a}", 5) AS {v}_{a}' for v in "abe" for a in "xy") + " FROM bd")
def define_boundary(spark, d):
    b = features.define_boundary(pose(spark, d), ["p1", "p2", "p3"], 8.0, 6.0)
    return b.select(*ENTITY, *[r(F.get("boundary", F.lit(i))[a], f"{v}_{a}") for i, v in enumerate("abe") for a in "xy"])


@query(_STATIC + f"SELECT {KEY}, {_sql_contains(_ABE)} AS within_boundary_static_p1_in_zone, {_sql_outline(_ABE)} AS distance_to_boundary_static_p1_in_zone FROM j")
def boundary_static(spark, d):
    p = pose(spark, d)
    f = features.with_boundary(p, features.define_boundary(p, ["p1", "p2", "p3"], 8.0, 6.0))
    v = exprs.boundary_vertices("boundary", 3)
    x, y = F.col("p1.x"), F.col("p1.y")
    return cols(f, exprs.contains(x, y, v).alias(features.named("within_boundary_static", "p1", "zone")), r(exprs.distance_to_outline(x, y, v), features.named("distance_to_boundary_static", "p1", "zone"), 4))


@query(f"WITH {FR}, g AS (SELECT *, p3x + 100 AS q3x, p3y AS q3y, (p1x + p2x + p3x) / 3 + 10 AS x, (p1y + p2y + p3y) / 3 AS y FROM f) SELECT {KEY}, {_sql_contains(_DYN)} AS inside, {_sql_outline(_DYN)} AS distance, round(abs(" + " + ".join(f"{a} * {e} - {c} * {b}" for (a, b), (c, e) in zip(_DYN, [*_DYN[1:], _DYN[0]])) + ") / 2, 4) AS area FROM g")
def boundary_dynamic(spark, d):
    v = [(F.col("p1.x"), F.col("p1.y")), (F.col("p2.x"), F.col("p2.y")), (F.col("p3.x") + 100, F.col("p3.y"))]
    x, y = (F.col("p1.x") + F.col("p2.x") + F.col("p3.x")) / 3 + 10, (F.col("p1.y") + F.col("p2.y") + F.col("p3.y")) / 3
    return cols(pose(spark, d).frames, exprs.contains(x, y, v).alias("inside"), r(exprs.distance_to_outline(x, y, v), "distance", 4), r(exprs.polygon_area(v), "area", 4))


@query(f"WITH {FR}, {_MED} SELECT handle, take, round(abs(ax * \"by\" - bx * ay + bx * ey - ex * \"by\" + ex * ay - ax * ey) / 2, 2) AS area FROM bd")
def area_static(spark, d):
    b = features.define_boundary(pose(spark, d), ["p1", "p2", "p3"], 8.0, 6.0)
    return b.select(*ENTITY, r(exprs.polygon_area(exprs.boundary_vertices("boundary", 3)), "area", 2))


@query(f"WITH {FR}, m AS (SELECT handle, take, median(p1x) AS cx, median(p1y) AS cy FROM f GROUP BY 1, 2), i AS (SELECT unnest(generate_series(0, 7)) AS i) SELECT handle, take, CAST(i AS INT) AS vertex, round(cx + 60 * cos(i * 2 * pi() / 8) * cos(0.5) - 20 * sin(i * 2 * pi() / 8) * sin(0.5), 4) AS x, round(cy + 60 * cos(i * 2 * pi() / 8) * sin(0.5) + 20 * sin(i * 2 * pi() / 8) * cos(0.5), 4) AS y FROM m, i")
def ellipse_boundary(spark, d):
    b = features.ellipse_from_params(pose(spark, d), "p1", 120.0, 40.0, 0.5, 8)
    return b.select(*ENTITY, F.posexplode("boundary").alias("vertex", "v")).select(*ENTITY, "vertex", r("v.x", "x", 4), r("v.y", "y", 4))


_CH = f"WITH {FR}, s AS (SELECT *, sqrt(pow(p1x - lag(p1x) OVER w, 2) + pow(p1y - lag(p1y) OVER w, 2)) AS c1, sqrt(pow(p2x - lag(p2x) OVER w, 2) + pow(p2y - lag(p2y) OVER w, 2)) AS c2 FROM f {W}), v AS (SELECT s.*, r.fps, c1 * fps AS v1, c2 * fps AS v2 FROM s LEFT JOIN recordings r {ON.format('s', 'r')}), a AS (SELECT *, (v1 - lag(v1) OVER w) * fps AS a1 FROM v {W}) "


@query(_CH + f"SELECT {KEY}, round(c1, 5) AS distance_change_p1_in_xy, round(v1, 4) AS speed_of_p1_in_xy, round(a1, 3) AS acceleration_of_p1_in_xy FROM a")
def motion(spark, d):
    return cols(features.with_motion(pose(spark, d), ["p1"]).frames, r("change_p1", features.named("distance_change", "p1")), r("speed_p1", features.named("speed", "p1"), 4), r("acceleration_p1", features.named("acceleration", "p1"), 3))


@query(_CH + f"SELECT {KEY}, v1 >= 60.0 AS above_speed_p1_geq_60_in_xy, v1 < 60.0 AS below_speed_p1_lt_60_in_xy, v1 >= 60.0 AND v2 >= 60.0 AS all_above, v1 < 60.0 AND v2 < 60.0 AS all_below FROM a")
def speed_thresholds(spark, d):
    f = features.with_motion(pose(spark, d), ["p1", "p2"]).frames
    return cols(f, features.above_speed("p1", 60.0).alias(features.named("above_speed", "p1", value=60)), features.below_speed("p1", 60.0).alias(features.named("below_speed", "p1", value=60)), features.all_above_speed(["p1", "p2"], 60.0).alias("all_above"), features.all_below_speed(["p1", "p2"], 60.0).alias("all_below"))


_AZ = "atan2({1}y - {0}y, {1}x - {0}x)"
_DEV = f"({_AZ.format('p1', 'p2')} - {_AZ.format('p1', 'p3')} + pi())"
_MOD = f"((({_DEV} % (2 * pi())) + 2 * pi()) % (2 * pi())) - pi()"


@query(f"WITH {FR} SELECT {KEY}, round({_AZ.format('p1', 'p2')}, 5) AS azimuth_from_p1_to_p2, round({_MOD}, 5) AS deviation, {_MOD} <= 0.2 AS within, abs({_MOD}) <= 0.2 AS within_absolute FROM f")
def azimuth(spark, d):
    dev = exprs.azimuth_deviation("p1", "p2", "p3")
    return cols(pose(spark, d).frames, r(exprs.azimuth("p1", "p2"), features.named("azimuth", "p1", "p2")), r(dev, "deviation"), exprs.within(dev, 0.2).alias("within"), exprs.within(dev, 0.2, True).alias("within_absolute"))


@query(f"WITH {FR}, s AS (SELECT {KEY}, p1x AS a, p2y AS b FROM f) SELECT {KEY}, a AS a_t0, lead(a, 2) OVER w AS \"a_t+2\", lag(a, 3) OVER w AS \"a_t-3\", b AS b_t0, lead(b, 1) OVER w AS \"b_t+1\" FROM s {W}")
def embedding(spark, d):
    f = pose(spark, d).frames.select(*ENTITY, FRAME, F.col("p1.x").alias("a"), F.col("p2.y").alias("b"))
    return features.embedding(f, {"a": [0, 2, -3], "b": [0, 1]})


# --- labels -----------------------------------------------------------------------------------


def _half(c: str, n: int, how: str) -> str:
    return f"CASE WHEN count({c}) OVER {n} = {{0}} THEN round({how}({c}) OVER {n}, 5) END"


@query(f"WITH {FR} SELECT {KEY}, " + _half("p1x", "a", "avg").format(4) + " AS mean, " + _half("p1x", "b", "median").format(5) + " AS median FROM f WINDOW a AS (PARTITION BY handle, take ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), b AS (PARTITION BY handle, take ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def smooth_centred(spark, d):
    f = pose(spark, d).frames.select(*ENTITY, FRAME, F.col("p1.x").alias("x"))
    f = labels.smooth(labels.smooth(f, "x", "mean", 4, "mean"), "x", "median", 5, "median")
    return cols(f, r("mean", "mean"), r("median", "median"))


def state_frames(spark: SparkSession, d: str) -> DataFrame:
    """(handle, take, frame, state, mask): a label per frame from the position of p1, null where it is missing."""
    x, y = F.col("p1.x"), F.col("p1.y")
    state = F.when(x.isNull() | y.isNull(), None).when(x < 400, "west").when(x > 900, "east").when(y < 400, "north").otherwise("centre")
    return pose(spark, d).frames.select(*ENTITY, FRAME, state.alias("state"), (F.col("p1.likelihood") > 0.8).alias("mask"), (F.col("p2.likelihood") > 0.8).alias("other"))


_ST = FR + ", s AS (SELECT handle, take, frame, CASE WHEN p1x IS NULL OR p1y IS NULL THEN NULL WHEN p1x < 400 THEN 'west' WHEN p1x > 900 THEN 'east' WHEN p1y < 400 THEN 'north' ELSE 'centre' END AS state, p1l > 0.8 AS mask, p2l > 0.8 AS other FROM f)"


def _runs(c: str, of: str = "s") -> str:
    return f"ch AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR {c} IS DISTINCT FROM lag({c}) OVER w THEN 1 ELSE 0 END AS chg FROM {of} {W}), rn AS (SELECT *, sum(chg) OVER (PARTITION BY handle, take ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM ch), ln AS (SELECT *, count({c}) OVER (PARTITION BY handle, take, run) AS n FROM rn)"


@query(f"WITH {_ST}, e AS (SELECT {KEY}, unnest([lag(state, 1) OVER w, state, lead(state, 1) OVER w, lead(state, 2) OVER w]) AS v FROM s {W}), c AS (SELECT {KEY}, v, count(v) AS n FROM e GROUP BY {KEY}, v), k AS (SELECT {KEY}, sum(n) AS n, arg_min(v, (-n, v)) FILTER (v IS NOT NULL) AS m FROM c GROUP BY {KEY}) SELECT {KEY}, CASE WHEN n = 4 THEN m END AS state_mode FROM k")
def smooth_mode(spark, d):
    return cols(labels.smooth(state_frames(spark, d), "state", "mode", 4), "state_mode")


@query(f"WITH {_ST}, {_runs('state')}, kp AS (SELECT *, CASE WHEN n > 6 THEN state END AS k FROM ln) SELECT {KEY}, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY handle, take ORDER BY frame ROWS UNBOUNDED PRECEDING), first_value(k IGNORE NULLS) OVER (PARTITION BY handle, take ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS smoothed FROM kp")
def smooth_block(spark, d):
    return cols(labels.smooth_block(state_frames(spark, d), "state", 6, "smoothed"), "smoothed")


@query(f"WITH {_ST}, {_runs('state')} SELECT {KEY}, n >= 6 AS block FROM ln")
def get_block(spark, d):
    return cols(labels.get_block(state_frames(spark, d), "state", 6, "block"), "block")


@query(f"WITH {_ST}, z AS (SELECT {KEY}, coalesce(mask, FALSE) AS mask, coalesce(other, FALSE) AS other FROM s), {_runs('mask', 'z')} SELECT {KEY}, mask AND NOT bool_or(other) OVER (PARTITION BY handle, take, run) AS kept FROM rn")
def remove_block(spark, d):
    return cols(labels.remove_block(state_frames(spark, d), "mask", "other", "kept"), "kept")


# --- summaries --------------------------------------------------------------------------------


@query(f"WITH {_ST}, l AS (SELECT *, lag(mask) OVER w AS p FROM s WHERE mask IS NOT NULL {W}) SELECT handle, take, count(*) FILTER (mask AND NOT coalesce(p, FALSE)) AS onsets FROM l GROUP BY 1, 2")
def count_onset(spark, d):
    return summary.count_onset(state_frames(spark, d), "mask")


@query(f"WITH {_ST} SELECT s.handle, s.take, round(count(*) FILTER (mask) / fps, 5) AS time_true, round(count(*) FILTER (NOT mask) / fps, 5) AS time_false FROM s JOIN recordings r {ON.format('s', 'r')} GROUP BY s.handle, s.take, fps")
def time_true_false(spark, d):
    t = summary.time_true_false(state_frames(spark, d), "mask", read_table(spark, d, "recordings"))
    return t.select(*ENTITY, r("time_true", "time_true"), r("time_false", "time_false"))


@query(_CH + "SELECT handle, take, round(coalesce(sum(c1) FILTER (frame BETWEEN 100 AND 2000), 0), 4) AS total_distance FROM a GROUP BY 1, 2")
def total_distance(spark, d):
    return summary.total_distance(pose(spark, d), "p1", 100, 2000).select(*ENTITY, r("total_distance", "total_distance", 4))


@query(f"WITH {FR} SELECT handle, take, round(coalesce(sum(p1x), 0), 4) AS sum_x, round(avg(p1x), 5) AS mean_x, round(median(p1x), 5) AS median_x, max(p1x) AS max_x, min(p1x) AS min_x FROM f GROUP BY 1, 2")
def column_stats(spark, d):
    s = summary.column_stats(pose(spark, d).frames.select(*ENTITY, F.col("p1.x").alias("x")), "x")
    return s.select(*ENTITY, r("sum_x", "sum_x", 4), r("mean_x", "mean_x"), r("median_x", "median_x"), "max_x", "min_x")


STATES = ["centre", "east", "north", "west"]
_TR = f"{_ST}, l AS (SELECT *, lag(state) OVER w AS prev FROM s {W}), t AS (SELECT handle, take, prev, state AS curr, count(*) AS n FROM l WHERE prev <> state GROUP BY 1, 2, 3, 4)"


@query(f"WITH {_TR} SELECT * FROM t")
def transition_matrix(spark, d):
    return summary.transition_matrix(state_frames(spark, d), "state")


@query(f"WITH {_TR}, g AS (SELECT DISTINCT handle, take, a.s AS prev, b.s AS curr FROM f, (SELECT unnest({STATES}) AS s) a, (SELECT unnest({STATES}) AS s) b) SELECT g.handle, g.take, g.prev, g.curr, coalesce(n, 0) AS n FROM g LEFT JOIN t {ON.format('g', 't')} AND g.prev = t.prev AND g.curr = t.curr")
def transition_matrix_dense(spark, d):
    return summary.transition_matrix(state_frames(spark, d), "state", STATES)


@query(f"WITH {_ST}, l AS (SELECT *, lag(state) OVER w AS prev FROM s {W}) SELECT handle, take, state, count(*) FILTER (prev IS DISTINCT FROM state) AS onsets FROM l WHERE state IS NOT NULL GROUP BY 1, 2, 3")
def count_state_onsets(spark, d):
    return summary.count_state_onsets(state_frames(spark, d), "state")


@query(f"WITH {_ST} SELECT s.handle, s.take, state, round(count(*) / fps, 5) AS seconds FROM s JOIN recordings r {ON.format('s', 'r')} WHERE state IS NOT NULL GROUP BY s.handle, s.take, state, fps")
def time_in_state(spark, d):
    return summary.time_in_state(state_frames(spark, d), "state", read_table(spark, d, "recordings")).select(*ENTITY, "state", r("seconds", "seconds"))


@query(f"WITH {FR}, e AS (SELECT handle, take, frame, min(frame) OVER p AS lo, max(frame) OVER p AS hi FROM f WINDOW p AS (PARTITION BY handle, take)), i AS (SELECT unnest([0, 1, 2]) AS i) SELECT handle, take, CAST(i AS INT) AS bin, count(*) AS n, min(frame) AS first, max(frame) AS last FROM e, i WHERE frame BETWEEN floor(lo + (hi - lo) * i / 3.0) AND floor(lo + (hi - lo) * (i + 1) / 3.0) GROUP BY 1, 2, 3")
def make_bins(spark, d):
    b = summary.make_bins(pose(spark, d).frames.select(*ENTITY, FRAME), 3)
    return b.groupBy(*ENTITY, "bin").agg(F.count(F.lit(1)).alias("n"), F.min(FRAME).alias("first"), F.max(FRAME).alias("last"))


_TAGS = "g AS (SELECT handle, " + ", ".join(f"nullif(lower(trim({t})), '') AS {t}" for t in TAGS) + " FROM tags)"


@query(f"WITH {_ST}, {_TAGS}, m AS (SELECT *, lag(p1x) OVER w AS qx, lag(p1y) OVER w AS qy FROM f {W}), a AS (SELECT handle, take, round(coalesce(sum(sqrt(pow(p1x - qx, 2) + pow(p1y - qy, 2))), 0), 4) AS distance FROM m GROUP BY 1, 2), b AS (SELECT handle, take, count(*) FILTER (mask) AS n FROM s GROUP BY 1, 2) SELECT a.handle, a.take, distance, round(n / fps, 5) AS time_true, treatment AS tag_treatment, timepoint AS tag_timepoint, room AS tag_room FROM a LEFT JOIN b {ON.format('a', 'b')} LEFT JOIN recordings r {ON.format('a', 'r')} LEFT JOIN g ON a.handle = g.handle")
def oft_summary(spark, d):
    p = pose(spark, d)
    dist_ = summary.total_distance(p, "p1").select(*ENTITY, r("total_distance", "distance", 4))
    time = summary.time_true_false(state_frames(spark, d), "mask", p.recordings).select(*ENTITY, r("time_true", "time_true"))
    return summary.to_table(p.frames.select(*ENTITY).distinct(), [dist_, time], groups.normalised(read_table(spark, d, "tags"), TAGS))


@query(f"WITH {FR}, {_TAGS} SELECT treatment, timepoint, count(*) AS n, round(avg(p1x), 4) AS mean_x FROM f JOIN recordings r {ON.format('f', 'r')} JOIN g ON f.handle = g.handle WHERE treatment IS NOT NULL AND timepoint IS NOT NULL GROUP BY 1, 2")
def groupby_tags(spark, d):
    rec = groups.add_tags(read_table(spark, d, "recordings"), groups.normalised(read_table(spark, d, "tags"), TAGS))
    s = pose(spark, d).frames.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n"), F.sum("p1.x").alias("s"), F.count("p1.x").alias("c"))
    g = groups.group_by_tags(s, rec, ["treatment", "timepoint"], strict=False)
    return g.groupBy("treatment", "timepoint").agg(F.sum("n").alias("n"), F.round(F.try_divide(F.sum("s"), F.sum("c")), 4).alias("mean_x"))


@query(f"WITH {_TAGS}, j AS (SELECT r.handle, g.* EXCLUDE handle FROM recordings r LEFT JOIN g ON r.handle = g.handle), e AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tag, {t} AS value FROM j" for t in TAGS) + "), n AS (SELECT tag, value, count(*) AS n FROM e GROUP BY 1, 2) SELECT tag, CAST(coalesce(sum(n) FILTER (value IS NOT NULL), 0) AS BIGINT) AS attached_to, CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS missing_from, count(value) AS unique_values, coalesce(string_agg(value || '=' || n, ',' ORDER BY value || '=' || n) FILTER (value IS NOT NULL), '') AS value_counts FROM n GROUP BY tag")
def tags_info(spark, d):
    return groups.tags_info(groups.add_tags(read_table(spark, d, "recordings"), groups.normalised(read_table(spark, d, "tags"), TAGS)), TAGS)


@query("SELECT handle, 'recording' AS missing FROM tags WHERE handle NOT IN (SELECT handle FROM recordings WHERE handle IS NOT NULL) UNION ALL SELECT DISTINCT handle, 'tags' FROM recordings WHERE handle IS NOT NULL AND handle NOT IN (SELECT handle FROM tags WHERE handle IS NOT NULL)")
def unmatched_tags(spark, d):
    return groups.unmatched(read_table(spark, d, "recordings"), read_table(spark, d, "tags"))


_BFA = f"""WITH {_TR}, {_TAGS}, gr AS (SELECT r.handle, r.take, treatment AS grp FROM recordings r JOIN g ON r.handle = g.handle WHERE treatment IS NOT NULL),
pr AS (SELECT a.grp AS g1, b.grp AS g2 FROM (SELECT DISTINCT grp FROM gr) a JOIN (SELECT DISTINCT grp FROM gr) b ON a.grp < b.grp),
bo AS (SELECT g1 || '_vs_' || g2 AS pair, handle, take, grp = g1 AS own FROM pr JOIN gr ON grp = g1 OR grp = g2),
rk AS (SELECT pair, permutation, handle, take, own, row_number() OVER (PARTITION BY pair, permutation ORDER BY md5(concat_ws(':', coalesce(handle, ''), take, permutation, 7)), handle, take) AS k, count(*) FILTER (own) OVER (PARTITION BY pair, permutation) AS n1, count(*) FILTER (NOT own) OVER (PARTITION BY pair, permutation) AS n2 FROM bo, (SELECT unnest(generate_series(-1, 999)) AS permutation)),
wt AS (SELECT pair, permutation, handle, take, CASE WHEN CASE WHEN permutation < 0 THEN own ELSE k <= n1 END THEN 1.0 / n1 ELSE -1.0 / n2 END AS w FROM rk),
ce AS (SELECT pair, permutation, prev, curr, sum(n * w) AS d FROM wt JOIN t ON wt.handle IS NOT DISTINCT FROM t.handle AND wt.take IS NOT DISTINCT FROM t.take GROUP BY 1, 2, 3, 4),
ds AS (SELECT g1 || '_vs_' || g2 AS pair, q.permutation, round(coalesce(distance, 0), 6) AS distance FROM pr CROSS JOIN (SELECT unnest(generate_series(-1, 999)) AS permutation) q LEFT JOIN (SELECT pair, permutation, sum(abs(d)) AS distance FROM ce GROUP BY 1, 2) c ON c.pair = g1 || '_vs_' || g2 AND c.permutation = q.permutation)
"""


def _bfa(spark: SparkSession, d: str) -> DataFrame:
    rec = groups.add_tags(read_table(spark, d, "recordings"), groups.normalised(read_table(spark, d, "tags"), TAGS))
    g = rec.filter("treatment IS NOT NULL").select(*ENTITY, F.col("treatment").alias("grp"))
    return bfa.distances(summary.transition_matrix(state_frames(spark, d), "state"), g, 1000, 7)


@query(_BFA + "SELECT pair, CAST(permutation AS INT) AS permutation, round(distance, 5) AS distance FROM ds")
def bfa_distances(spark, d):
    return _bfa(spark, d).select("pair", "permutation", r(F.round("distance", 6), "distance"))


@query(_BFA + ", o AS (SELECT pair, distance AS observed FROM ds WHERE permutation < 0) SELECT ds.pair, round(observed, 5) AS observed, round(count(*) FILTER (observed > distance) / CAST(count(*) + 1 AS DOUBLE), 5) AS percentile, CASE WHEN stddev_pop(distance) > 0 THEN round((observed - avg(distance)) / stddev_pop(distance), 4) END AS zscore FROM ds JOIN o ON ds.pair = o.pair WHERE permutation >= 0 GROUP BY ds.pair, observed")
def bfa_stats(spark, d):
    return bfa.stats(_bfa(spark, d), 6).select("pair", r("observed", "observed"), r("percentile", "percentile"), r("zscore", "zscore", 4))


# --- scaling, clusters, neighbours ------------------------------------------------------------


def _xy(spark: SparkSession, d: str) -> DataFrame:
    return pose(spark, d).frames.select(*ENTITY, FRAME, F.col("p1.x").alias("ax"), F.col("p1.y").alias("ay"), F.col("p2.x").alias("bx"))


_XY = FR + ", q AS (SELECT handle, take, frame, p1x AS ax, p1y AS ay, p2x AS bx FROM f)"


@query(f"WITH {_XY}, m AS (SELECT avg(ax) AS mx, stddev_pop(ax) AS sx, avg(ay) AS my, stddev_pop(ay) AS sy FROM q) SELECT {KEY}, round((ax - mx) / sx, 5) AS ax, round((ay - my) / sy, 5) AS ay FROM q, m")
def normalize(spark, d):
    f = _xy(spark, d)
    return cols(ml.apply_scaling(f, ml.scaling_factors(f, ["ax", "ay"], True)), r("ax", "ax"), r("ay", "ay"))


@query(f"WITH {_XY}, m AS (SELECT stddev_pop(ax) AS sx, stddev_pop(ay) AS sy FROM q) SELECT {KEY}, round(ax / sx * 2, 5) AS ax, round(ay / sy * 2, 5) AS ay, round(bx * 0.5, 5) AS bx FROM q, m")
def custom_scaling(spark, d):
    f = ml.custom_scaling(_xy(spark, d), ["ax", "ay", "bx"], {"a": {"normalize": True, "scale": 2.0}, "b": {"scale": 0.5}})
    return cols(f, r("ax", "ax"), r("ay", "ay"), r("bx", "bx"))


CENTROIDS = [[300.0, 300.0, 300.0], [700.0, 500.0, 700.0], [1000.0, 700.0, 1000.0]]
_CD = [f"pow(ax - {a}, 2) + pow(ay - {b}, 2) + pow(bx - {c}, 2)" for a, b, c in CENTROIDS]
_AS = f"k AS (SELECT {KEY}, CASE WHEN ax IS NULL OR ay IS NULL OR bx IS NULL THEN NULL WHEN {_CD[0]} <= least({_CD[1]}, {_CD[2]}) THEN 0 WHEN {_CD[1]} <= {_CD[2]} THEN 1 ELSE 2 END AS kmeans_3 FROM q)"


@query(f"WITH {_XY}, {_AS} SELECT * FROM k")
def assign_centroids(spark, d):
    return cols(ml.assign_by_centroids(_xy(spark, d), ["ax", "ay", "bx"], CENTROIDS), "kmeans_3")


@query(f"WITH {_XY}, {_AS}, e AS (SELECT handle, take, count(*) AS n, count(kmeans_3) AS c, " + ", ".join(f"count(*) FILTER (kmeans_3 = {i}) AS c{i}" for i in range(3)) + " FROM k GROUP BY 1, 2) SELECT handle, take, round((n - c) / CAST(n AS DOUBLE), 5) AS percent_nan, " + ", ".join("CAST(" + " + ".join(f"CAST({t.format(i)} AS INT)" for i in range(3)) + f" AS INT) AS {name}" for name, t in (("num_missing", "(c{0} = 0)"), ("num_low", "(c{0} / CAST(n AS DOUBLE) < 0.05)"), ("num_high", "(c{0} / CAST(n AS DOUBLE) > 0.9)"))) + " FROM e")
def cluster_diagnostics(spark, d):
    c = ml.cluster_diagnostics(ml.assign_by_centroids(_xy(spark, d), ["ax", "ay", "bx"], CENTROIDS), ENTITY, "kmeans_3", 3)
    return c.select(*ENTITY, r("percent_nan", "percent_nan"), "num_missing", "num_low", "num_high")


@query(None)
def kmeans_embedding(spark, d):
    """Fitted labels depend on the start, so only rows are checked here and invariants in the tests."""
    f, _ = ml.cluster_embedding(_xy(spark, d), ["ax", "ay", "bx"], 4)
    return cols(f, "kmeans_4")


def _emb(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform(F.concat(F.slice("embedding", 1, 60), F.slice("embedding", 63, 2)), lambda v: v.cast("double")).alias("x"), F.array(F.col("embedding")[60].cast("double"), F.col("embedding")[61].cast("double")).alias("y"), F.col("label").alias("grp"))


_EM = "e AS (SELECT vec_id AS id, [CAST(v AS DOUBLE) FOR v IN embedding[1:60] || embedding[63:64]] AS x, CAST(embedding[61] AS DOUBLE) AS y1, CAST(embedding[62] AS DOUBLE) AS y2, label AS grp FROM embeddings)"


def _knn(cond: str) -> str:
    return f"WITH {_EM}, p AS (SELECT q.id, t.id AS tid, t.y1, t.y2, list_distance(q.x, t.x) AS d FROM e q JOIN e t ON {cond}), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, tid) AS r FROM p) SELECT id, round(avg(y1), 5) AS y1, round(avg(y2), 5) AS y2 FROM k WHERE r <= 5 GROUP BY id"


@query(_knn("q.id % 20 = 0 AND t.id <> q.id"))
def knn_regress(spark, d):
    """The stated query set: ids divisible by 20, against all rows but the query itself."""
    e = _emb(spark, d).withColumn("grp", F.col("id"))
    p = ml.knn_predict(e, e.filter("id % 20 = 0"), 5, other_group=True)
    return p.select("id", r(F.get("y", F.lit(0)), "y1"), r(F.get("y", F.lit(1)), "y2"))


@query(_knn("q.grp <> t.grp"))
def knn_leave_group_out(spark, d):
    e = _emb(spark, d)
    p = ml.knn_predict(e, e, 5, other_group=True)
    return p.select("id", r(F.get("y", F.lit(0)), "y1"), r(F.get("y", F.lit(1)), "y2"))


@query(f"WITH {_EM}, p AS (SELECT q.id, q.grp AS test_grp, t.grp AS train_grp, q.y1 AS a1, q.y2 AS a2, t.y1, t.y2, t.id AS tid, list_distance(q.x, t.x) AS d FROM e q JOIN e t ON q.id <> t.id), k AS (SELECT *, row_number() OVER (PARTITION BY id, train_grp ORDER BY d, tid) AS r FROM p), m AS (SELECT id, train_grp, test_grp, a1, a2, avg(y1) AS p1, avg(y2) AS p2 FROM k WHERE r <= 5 GROUP BY ALL) SELECT train_grp, test_grp, round(sqrt(avg((pow(a1 - p1, 2) + pow(a2 - p2, 2)) / 2)), 5) AS rms, count(*) AS n FROM m GROUP BY 1, 2")
def cross_predict(spark, d):
    return ml.cross_predict(_emb(spark, d), 5).select("train_grp", "test_grp", r("rms", "rms"), "n")


@query(f"WITH {_XY}, {_AS}, g AS (SELECT kmeans_3 AS label, count(*) AS c FROM k GROUP BY 1) SELECT CAST(i AS INT) AS label, coalesce(c, 0) AS count, round(coalesce(c, 0) / CAST((SELECT sum(c) FROM g) AS DOUBLE), 6) AS share FROM (SELECT unnest([0, 1, 2]) AS i) s LEFT JOIN g ON g.label = i")
def label_prevalence(spark, d):
    return ml.global_prevalence(ml.assign_by_centroids(_xy(spark, d), ["ax", "ay", "bx"], CENTROIDS), "kmeans_3", 3).select("label", "count", r("share", "share", 6))


@query(f"WITH {_XY} SELECT {KEY}, round(sqrt((pow(ax - bx, 2) + pow(ay - ax, 2)) / 2), 5) AS rms FROM q")
def rms_error(spark, d):
    return cols(ml.rms_error(_xy(spark, d), ["ax", "ay"], ["bx", "ax"]), r("rms", "rms"))


@query(None)
def pca_embeddings(spark, d):
    """Signs of components are free, so only rows are checked here and the spanned space in the tests."""
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v0"))
    return ml.apply_pca(ml.fit_pca(e, "v0", 4), e, "v0").select("vec_id", "pc")


# --- several views ----------------------------------------------------------------------------


def _views(spark: SparkSession, d: str) -> DataFrame:
    """Takes 0 and 1 of a handle as two views, joined on the frame."""
    f = pose(spark, d).frames
    one = lambda t: f.filter(F.col("take") == t).select("handle", FRAME, F.struct("p1", "p2").alias("a1"), F.struct("p3", "p2").alias("a2"))
    ren = lambda df: df.select("handle", FRAME, "a1", F.struct(F.col("a2.p3").alias("p1"), F.col("a2.p2").alias("p2")).alias("a2"))
    j = multiview.join_views(ren(one(0)), ren(one(1)), ["handle"], FRAME)
    return j.select("handle", FRAME, F.col("left.a1").alias("l1"), F.col("left.a2").alias("l2"), F.col("right.a1").alias("r1"), F.col("right.a2").alias("r2"))


_VW = FR + ", v AS (SELECT l.handle, l.frame, " + ", ".join(f"{s}.{p}{c} AS {s}{p}{c}" for s in ("l", "r") for p in ("p1", "p2", "p3") for c in ("x", "y", "z", "l")) + " FROM f l JOIN f r ON l.handle IS NOT DISTINCT FROM r.handle AND l.frame = r.frame AND l.take = 0 AND r.take = 1)"


def _cost(a: str, b: str) -> str:
    k = [f"sqrt(pow(l{p}x - r{q}x, 2) + pow(l{p}y - r{q}y, 2))" for p, q in ((a, b), ("p2", "p2"))]
    return f"CASE WHEN ({k[0]}) IS NULL AND ({k[1]}) IS NULL THEN 1e6 ELSE coalesce({k[0]}, 0) + coalesce({k[1]}, 0) END"


@query(f"WITH {_VW}, c AS (SELECT handle, frame, 0.0 + ({_cost('p1', 'p1')}) + ({_cost('p3', 'p3')}) AS same, 0.0 + ({_cost('p1', 'p3')}) + ({_cost('p3', 'p1')}) AS swapped FROM v) SELECT handle, frame, CASE WHEN same <= swapped THEN 0 ELSE 1 END AS first, CASE WHEN same <= swapped THEN 1 ELSE 0 END AS second FROM c")
def align_ids(spark, d):
    a = multiview.align_ids(_views(spark, d), ["l1", "l2"], ["r1", "r2"], ["p1", "p2"])
    return a.select("handle", FRAME, F.get("assignment", F.lit(0)).alias("first"), F.get("assignment", F.lit(1)).alias("second"))


@query(f"WITH {_VW} SELECT handle, frame, lp1x AS left_x, rp1x AS right_x, least(lp1l, rp1l) AS likelihood FROM v")
def view_inner_join(spark, d):
    return _views(spark, d).select("handle", FRAME, F.col("l1.p1.x").alias("left_x"), F.col("r1.p1.x").alias("right_x"), F.least("l1.p1.likelihood", "r1.p1.likelihood").alias("likelihood"))


@query(None)
def triangulate(spark, d):
    """A singular value decomposition per point: checked by projecting points back in the tests."""
    cal = read_table(spark, d, "calibration")
    side = lambda v, n: cal.filter(F.col("view_name") == v).select("rig", F.col("k").alias(f"k{n}"), F.col("dist").alias(f"d{n}"), *([F.col("t").alias("t")] if n == 2 else []))
    rec = read_table(spark, d, "recordings").filter("take = 0").select("handle", "rig")
    v = null_safe_join(_views(spark, d), rec, ["handle"], "inner").join(side("left", 1), "rig").join(side("right", 2), "rig")
    eye = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(3)]) for i in range(3)])
    v = v.select("handle", FRAME, F.col("l1.p1.x").alias("u1"), F.col("l1.p1.y").alias("v1"), F.col("l1.p1.likelihood").alias("l1"), F.col("r1.p1.x").alias("u2"), F.col("r1.p1.y").alias("v2"), F.col("r1.p1.likelihood").alias("l2"), "k1", "d1", "k2", "d2", eye.alias("r"), "t")
    return multiview.stereo_triangulate(v).select("handle", FRAME, "xyz", "likelihood")


# --- collections, readers, predictors ---------------------------------------------------------


@query(f"WITH {FR}, n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY handle, take) AS n FROM f {W}) SELECT {KEY}, p1x AS x FROM n WHERE rn > 10 AND rn <= n - 5 AND frame <= 400")
def slices(spark, d):
    return cols(collection.Collection(pose(spark, d)).iloc(10, -5).loc(None, 400).pose.frames, F.col("p1.x").alias("x"))


@query(f"WITH {FR}, {_TAGS} SELECT f.handle, f.take, frame, round((p1x - p2x) * 2 / p3x, 5) AS ratio, p1l > 0.8 AND NOT (p2l > 0.8) AS odd FROM f JOIN g ON f.handle = g.handle JOIN recordings r {ON.format('f', 'r')} WHERE treatment = 'high'")
def group_algebra(spark, d):
    p = pose(spark, d)
    rec = groups.add_tags(p.recordings, groups.normalised(read_table(spark, d, "tags"), TAGS)).filter("treatment IS NOT NULL")
    c = collection.Collection(PoseFrame(p.frames, rec)).groupby("treatment").get_group(["high"])
    x = {n: c.result(F.col(f"p{n}.x")) for n in (1, 2, 3)}
    odd = c.result(F.col("p1.likelihood") > 0.8) & ~c.result(F.col("p2.likelihood") > 0.8)
    c = c.store("ratio", (x[1] - x[2]) * 2 / x[3]).store("odd", odd)
    return cols(c.pose.frames, r("ratio", "ratio"), "odd")


_CUT = """cut AS (SELECT file_id, line_no, line, [trim(CASE WHEN c LIKE '"%' THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END) FOR c IN regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1)] AS cells FROM {} WHERE trim(line) <> '')"""


@query(f"WITH {_CUT.format('yolo3r_raw')}, h AS (SELECT file_id, max(cells) AS names FROM cut WHERE cells[1] = 'frame_index' GROUP BY 1), j AS (SELECT cut.*, names FROM cut JOIN h ON cut.file_id = h.file_id WHERE TRY_CAST(cells[1] AS DOUBLE) IS NOT NULL) SELECT CAST(file_id AS VARCHAR) AS path, CAST(trunc(CAST(cells[1] AS DOUBLE)) AS BIGINT) AS frame, " + ", ".join(f"CASE WHEN isnan(TRY_CAST(cells[list_position(names, '{a}')] AS DOUBLE)) THEN NULL ELSE TRY_CAST(cells[list_position(names, '{a}')] AS DOUBLE) END AS {b}" for a, b in (("p1.x", "x"), ("p2.y", "y"), ("p3.conf", "likelihood"))) + " FROM j")
def read_detector_lines(spark, d):
    t = read_table(spark, d, "yolo3r_raw").select(F.col("file_id").cast("string").alias("path"), "line").filter(F.trim("line") != "")
    return pose_csv.parse_keypoints(t, "yolo3r").select("path", FRAME, F.col("p1.x").alias("x"), F.col("p2.y").alias("y"), F.col("p3.likelihood").alias("likelihood"))


@query(f"WITH {_EM}, p AS (SELECT q.id, t.id AS tid, t.y1, t.y2, list_distance(q.x, t.x) AS d FROM e q JOIN e t ON q.id % 20 = 0 AND t.grp <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, tid) AS r FROM p) SELECT id, round(avg(y1), 5) AS y1, round(avg(y2), 5) AS y2 FROM k WHERE r <= 5 GROUP BY id")
def knn_predictor(spark, d):
    """The stated query set: ids divisible by 20, predicted from the rows of all labels but one by a saved and loaded bundle."""
    e = _emb(spark, d)
    path = f"{shared_dir(spark)}/motionlake-bundle-{uuid.uuid4().hex}"
    predictors.KNNPredictor(5).fit(e.filter("grp <> 0")).save(path)
    p = predictors.KNNPredictor.load(spark, path).predict(e.filter("id % 20 = 0"))
    return p.select("id", r(F.get("y", F.lit(0)), "y1"), r(F.get("y", F.lit(1)), "y2"))


@query(f"WITH {_XY} SELECT {KEY}, CASE WHEN ax IS NOT NULL AND ay IS NOT NULL THEN CAST(ax + ay > 1000 AS DOUBLE) END AS label FROM q")
def classify(spark, d):
    return cols(predictors.classify(_xy(spark, d), ["ax", "ay"], lambda f: (f["ax"] + f["ay"] > 1000).astype(float), "label"), "label")
