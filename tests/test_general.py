"""Edge cases of the general operators: nulls, empty tables, ties, repeated rows, clashing extra columns."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from motionlake.functions.assignment import assign
from motionlake.operators import drift, implausible, regular_grid, rejects

POINT = "struct<x: double, y: double, z: double, conf: double>"
READING = f"row_id long, handle string, take int, frame_index long, p1 {POINT}, slot string, _span int, x string"
RECORDING = "handle string, take int, fps double, width_px int, height_px int, grid_step int"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_assignment_equals_all_permutations():
    rng = np.random.default_rng(1)
    for t in range(60):
        n, m = (int(v) for v in rng.integers(1, 6, 2))
        c = rng.integers(0, 10, (n, m)).astype(float) if t % 2 else rng.random((n, m))
        a = c if n <= m else c.T
        best = min(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(a.shape[1]), len(a)))
        assert abs(sum(c[i, j] for i, j in assign(c)) - best) < 1e-9
    assert assign(np.zeros((0, 3))) == []


def reading(i, frame, x, y, handle="a", take=0, conf=0.9):
    return (i, handle, take, frame, None if x is None else (x, y, 1.0, conf), "s", 1, "x")


def test_grid_bridges_gaps_and_ignores_unusable(spark):
    data = [reading(1, 0, 1.0, 1.0), reading(2, 10, 11.0, 6.0), reading(3, 10, 99.0, 99.0), reading(4, None, 5.0, 5.0), reading(5, 4, float("nan"), 5.0), reading(6, 30, None, None),
            reading(7, 0, 1.0, 1.0, None), reading(8, 4, 1.0, 1.0, None), reading(9, 3, 1.0, 1.0, "no recording")]
    rec = spark.createDataFrame([("a", 0, 30.0, 100, 100, 2), (None, 0, None, 100, 100, 2), ("b", 0, 30.0, 9, 9, 0)], RECORDING)
    got = regular_grid.regular_grid(spark.createDataFrame(data, READING), rec)
    assert rows(got.filter("filled"), "handle", "slot") == [("a", 1), ("a", 2), ("a", 3), ("a", 4), (None, 1)]
    x = {r["slot"]: r["x"] for r in got.filter("handle = 'a'").collect()}
    assert x[0] == 1.0 and x[5] == 11.0 and all(x[i] < x[i + 1] for i in range(5))  # no step at either end
    assert regular_grid.regular_grid(spark.createDataFrame([], READING), rec).count() == 0


def test_grid_fit_finds_a_season(spark):
    slots = spark.range(400).select(F.lit("a").alias("handle"), F.lit(0).alias("take"), F.col("id").alias("slot"), (3 + 0.01 * F.col("id") + 2 * F.sin(2 * F.pi() * F.col("id") / 40)).alias("x"), F.lit(1.0).alias("y"), F.lit(40.0).alias("period"))
    b = regular_grid.fit(slots, 2).first()["beta_x"]
    assert abs(b[0] - 3) < 0.01 and abs(b[1] - 0.4) < 0.01 and abs(b[2] - 2) < 0.01


def brute_spikes(v, limit):
    out = set()
    for g in (1, 2, 3):
        for i in range(len(v) - g - 1):
            before, mid, after = v[i], v[i + 1 : i + 1 + g], v[i + 1 + g]
            if abs(before - after) <= limit and all(abs(m - before) > limit and abs(m - after) > limit for m in mid):
                out |= set(range(i + 1, i + 1 + g))
    return out


def test_spikes_equal_the_rule(spark):
    rng = random.Random(3)
    v, data, frame = 50.0, [], 0
    for i in range(900):
        v += rng.choice([-1, 1]) * 0.5
        frame += rng.randint(1, 3)
        spike = rng.random() < 0.02
        data.append(reading(i, frame, v + (40 if spike else 0) * rng.choice([-1, 1]), 50 + rng.random()))
    data += [reading(5000 + i, 10_000 + i, 70.0, 50 + rng.random()) for i in range(20)]  # frozen
    data += [reading(6000 + i, 20_000 + i, 60.0 + i % 2, 50 + rng.random(), conf=None if i else 2.0) for i in range(19)]
    rec = spark.createDataFrame([("a", 0, 30.0, 200, 200, 2)], RECORDING)
    f = implausible.flag_implausible(spark.createDataFrame(data, READING), rec)
    got = {r["frame_index"]: r for r in f.collect()}
    xs = [d[4][0] for d in data]
    ys = [d[4][1] for d in data]
    truth = set()
    for s in (xs, ys):
        truth |= {data[i][3] for i in brute_spikes(s, 20 * float(np.median(np.round(np.abs(np.diff(s)), 9))))}
    assert {k for k, r in got.items() if r["spike"]} >= truth - {20_000}
    assert {k for k, r in got.items() if r["frozen"]} == set(range(10_000, 10_020))
    assert got[20_000]["outside"]
    assert implausible.flag_implausible(spark.createDataFrame([], READING), rec).count() == 0


DLC = ["scorer,net,net,net", "bodyparts,p1,p1,p1", "coords,x,y,likelihood"]


def lines(spark, files):
    data = [(100 * f + n, f, n, s, "c") for f, ls in files.items() for n, s in enumerate(ls)]
    return spark.createDataFrame(data, "line_id long, file_id long, line_no int, line string, reason string")


def test_rejects_by_reason(spark):
    body = ['1,2.5,3,0.5', '2,"2,5",3,0.5', '3,2.5,3', '4,"2.5,3,0.5', '5,2".5,3,0.5', '6,"2"x,3,0.5', "7,NaN,,1", "8,1e3,+.5,1.01", "9,NA,1,1", "", None, '"x""y", 3 ,"4",0', "10,2.5,3,0.5,", "１,2,3,0", "11,２,3,0"]
    got = dict(rows(rejects.rejected(lines(spark, {1: DLC + body, 2: ["a,b"]}), lines(spark, {})), "line_id", "reason"))
    assert got == {104: "value", 105: "column_count", 106: "quoting", 107: "quoting", 108: "quoting", 110: "value", 111: "value", 115: "column_count", 117: "value"}
    good = {r["line_id"]: (r["c0"], r["values"]) for r in rejects.loaded(lines(spark, {1: DLC + body}), "dlc", "dlc_single").collect()}
    assert good[109] == ("7", [None, None, 1.0]) and good[114] == ('x"y', [3.0, 4.0, 0.0])
    ma = ["scorer,n,n", "animals,a,a", "bodyparts,p,p", "coords,x,likelihood", "1,2,0", "x,2,0", "-1,2,0"]
    assert rows(rejects.rejected(lines(spark, {}), lines(spark, {3: ma})), "line_id", "reason") == [(305, "value"), (306, "value")]


def test_lines_without_header_are_rejected(spark):
    got = rejects.classify_lines(lines(spark, {1: ["x", "y", "z", "1,2"]}), "dlc", "dlc_single")
    assert rows(got, "line_id", "reason") == [(103, "column_count")] or rows(got, "line_id", "reason") == [(103, None)]


def versions_of(spark, *files):
    """Detected (versions, changes, tables) of single-header files written one after the other, with ids 1, 2, ..."""
    meta = spark.createDataFrame([(i, "yolo3r", "f", i) for i in range(1, len(files) + 1)], "file_id long, layout string, feed string, written_at int")
    tables = drift.raw_tables(lines(spark, {i: f for i, f in enumerate(files, 1)}), lines(spark, {}), lines(spark, {}))
    return *drift.detect(tables, meta), tables


def test_drift_reports_and_unifies(spark):
    v1 = ["frame_index,p1.x,p1.conf,p1.z", "1,5.5,0.9,30.1", "2,5.6,0.8,30.2", "3,5.7,NA,29.9"]
    v2 = ["frame_no,p1.x,p1_conf,led", "4,5.5,0.91,1", "5,5.6,0.85,0", "6,5.7,,1"]
    v3 = ["frame_no,led,p1.score,p1.x", "7.0,1,91%,5", "8.0,0,85%,6", "9.0,1,88%,7", "10,0"]
    files = spark.createDataFrame([(3, "yolo3r", "f", 1), (1, "yolo3r", "f", 2), (2, "yolo3r", "f", 3), (9, "yolo3r", None, 1)], "file_id long, layout string, feed string, written_at int")
    tables = drift.raw_tables(lines(spark, {3: v1, 1: v2, 2: v3, 9: v1}), lines(spark, {}), lines(spark, {}))
    versions, changes = drift.detect(tables, files)
    assert rows(drift.report(changes), "file_id", "field_name", "change_kind") == sorted(
        [(1, "frame_no", "renamed"), (1, "p1_conf", "renamed"), (1, "led", "added"), (1, "p1.z", "removed"), (2, "p1.score", "renamed"), (2, "p1.score", "retyped"), (2, "frame_no", "retyped"), (2, "p1.x", "retyped")], key=repr)
    u = drift.unify(tables, versions, changes)
    assert rows(u.filter("file_id = 2 AND line_no = 1"), "frame_index", "`p1.conf`", "`p1.x`", "led") == [(7.0, "91%", 5.0, 1)]
    assert u.count() == 12 and rows(drift.unparsed(tables["yolo3r"]), "file_id", "line_no", "reason") == [(2, 4, "column_count")]
    none = {k: v.limit(0) for k, v in tables.items()}
    assert drift.detect(none, files)[1].count() == 0


def test_values_decide_renames(spark):
    rng = random.Random(4)

    def file(names, made, n=40):
        return [",".join(names)] + [",".join(str(m(i)) for m in made) for i in range(n)]

    count, x, conf, area, z = (lambda i: 100 + i), (lambda i: round(rng.uniform(0, 900), 2)), (lambda i: round(rng.uniform(0.6, 1), 3)), (lambda i: round(rng.uniform(2000, 4000), 1)), (lambda i: round(rng.gauss(30, 2), 2))
    first = file(["frame_index", "nose.x", "nose.conf", "p1.x", "p1.conf"], [count, x, conf, x, conf])
    # unrelated names with the same values; a whole point under another name; a counter under another name
    second = file(["nr", "snout.x", "snout.conf", "p1.x", "p1.quality"], [count, x, conf, x, conf])
    # a likely name with other values
    third = file(["nr", "snout.x", "snout.conf", "p1.x", "p1.score"], [count, x, conf, x, area])
    fourth = file(["nr", "snout.x", "snout.conf", "p1.x", "p1.score2", "p1.z"], [count, x, conf, x, area, z], 0)  # no line at all
    fifth = file(["nr", "snout.x", "snout.conf", "p1.x", "p1.height"], [count, x, conf, x, z])
    _, changes, _ = versions_of(spark, first, second, third, fourth, fifth)
    got = rows(changes, "file_id", "change_kind", "old_name", "new_name")
    names = [g for g in got if g[1] != "retyped"]
    assert [g for g in names if g[0] == 2] == sorted([(2, "renamed", "frame_index", "nr"), (2, "renamed", "nose.x", "snout.x"), (2, "renamed", "nose.conf", "snout.conf"), (2, "renamed", "p1.conf", "p1.quality")], key=repr)
    assert [g for g in names if g[0] == 3] == [(3, "added", None, "p1.score"), (3, "removed", "p1.quality", None)]
    # a file without lines still counts as the predecessor
    assert {(g[1], g[3] or g[2]) for g in names if g[0] == 4} >= {("added", "p1.z")} and any(g[0] == 5 and g[2] == "p1.score2" for g in names)


def test_sketches_add_up():
    rng = np.random.default_rng(2)
    v = rng.normal(30, 2, 5000)
    b, n = np.unique(drift.bins_of(v), return_counts=True)
    q = drift.quantiles([{"bin": int(x), "count": int(c)} for x, c in zip(b, n)])
    assert np.allclose(q, np.quantile(v, (0.05, 0.25, 0.5, 0.75, 0.95)), rtol=0.011)
    w = np.array([0.0, -3.5, 3.5, 1e-20, 1e250])
    assert np.allclose(drift.value_of(drift.bins_of(w)), [0, -3.5, 3.5, 0, 1e250], rtol=0.011)


def test_blocks_of_a_file_meet_its_header(spark, monkeypatch):
    body = [f"{i},{i}.5,1,0.5" for i in range(30)] + ["30,1"]
    whole = rows(rejects.classify_lines(lines(spark, {1: DLC + body}), "dlc", "dlc_single"), "line_id", "cells", "reason")
    monkeypatch.setattr(rejects, "BLOCK_LINES", 4)
    assert rows(rejects.classify_lines(lines(spark, {1: DLC + body}), "dlc", "dlc_single"), "line_id", "cells", "reason") == whole


def test_shares_and_percents_are_alike_up_to_the_bin_error():
    def field(v):
        b, n = np.unique(drift.bins_of(np.array(v, float)), return_counts=True)
        return {"steps": 40, "rises": 20, "sketch": [{"bin": int(x), "count": int(c)} for x, c in zip(b, n)]}

    share = [1.0] * 10 + [0.9] * 20 + [0.8] * 10
    assert drift.value_similarity(field(share), field([round(100 * v) for v in share])) > 0.8
    assert drift.value_similarity(field([28.0, 29.0, 30.0] * 9), field([2800.0, 2900.0, 3000.0] * 9)) < drift.VALUES_LEAST
