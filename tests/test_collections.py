"""Collections, predictors, loaders with handles and views, exact medians, ordered helpers across spans."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.collection import Collection, iloc
from motionlake.functions import chunked
from motionlake.functions.quantiles import medians
from motionlake.model import FRAME, PoseFrame
from motionlake.operators import clean, features, groups, labels, ml, predictors, summary
from motionlake.sources import pose_csv

POINT = "struct<x: double, y: double, z: double, likelihood: double>"


def recording(spark, handle, xs, **tags):
    data = [(handle, 0, i, (x, 0.0, 0.0, 1.0)) for i, x in enumerate(xs)]
    names = "".join(f", {k} string" for k in tags)
    return PoseFrame(spark.createDataFrame(data, f"handle string, take int, frame long, p1 {POINT}"), spark.createDataFrame([(handle, 0, 30.0, *tags.values())], f"handle string, take int, fps double{names}"))


@pytest.fixture(scope="module")
def three(spark):
    return Collection.from_list([recording(spark, h, [float(i) for i in range(n)], genotype=g) for h, n, g in (("A", 6, "WT"), ("B", 4, "KO"), ("C", 5, "WT"))])


def test_collection_access_and_groups(spark, three):
    assert three.keys() == [("A", 0), ("B", 0), ("C", 0)] and len(three) == 3 and "B" in three and "X" not in three
    assert three["B"].pose.frames.count() == 4 and three[1:].keys() == [("B", 0), ("C", 0)] and three[-1].keys() == [("C", 0)] and three.without("A").keys() == [("B", 0), ("C", 0)]
    with pytest.raises(KeyError):
        three["X"]
    with pytest.raises(ValueError):
        Collection.from_list([three.pose, three.pose])
    g = three.groupby("genotype")
    assert g.is_grouped and g.group_keys() == [("WT",), ("KO",)] and g.get_group(["WT"]).keys() == [("A", 0), ("C", 0)] and not g.flatten().is_grouped
    with pytest.raises(KeyError):
        g.get_group(["none"])
    assert {r["handle"]: r["n"] for r in three.iloc(1, -1).pose.frames.groupBy("handle").agg(F.count("frame").alias("n")).collect()} == {"A": 4, "B": 2, "C": 3}
    assert sorted(r["frame"] for r in three["A"].loc(2, 3).pose.frames.collect()) == [2, 3]
    assert iloc(three.pose.frames.limit(0), 0, 3).count() == 0
    assert {r["handle"]: r["limit"] for r in three.per_handle({"A": 1.0, "B": 2.0, "C": 3.0}, "limit").pose.frames.select("handle", "limit").distinct().collect()} == {"A": 1.0, "B": 2.0, "C": 3.0}
    with pytest.raises(KeyError):
        three.per_handle({"A": 1.0}, "limit")
    doubled = three.map_leaves(lambda f: f[["handle", "take", "frame"]].assign(n=len(f)), "handle string, take int, frame long, n long")
    assert doubled.pose.frames.filter("handle = 'A'").first()["n"] == 6


def test_results_have_arithmetic_with_key_checks(three):
    x = three.result(F.col("p1.x"))
    stored = three.store("y", (x + 1) * x / 2).pose.frames
    assert [r["y"] for r in stored.filter("handle = 'A'").orderBy(FRAME).collect()] == [0, 1, 3, 6, 10, 15]
    big = x.map(lambda v: v > 2)
    assert three.store("odd", big ^ ~big).pose.frames.filter("NOT odd").isEmpty() and (x - x).astype("long").df.filter("value <> 0").isEmpty()
    with pytest.raises(KeyError):
        x + three["A"].result(F.col("p1.x"))
    with pytest.raises(ValueError):
        three.store("p1", x)


def test_medians_are_exact(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 5), rng.gauss(0, 1e9), float(rng.randint(-2, 2)), None, float("nan")]), float(rng.randint(0, 3))) for _ in range(900)]
    data += [("inf", v, 0.0) for v in (float("inf"), float("inf"), 1.0)] + [("none", None, None), ("one", -7.25, 1.0)] + [("hot", 5.0 + i * 1e-9, 2.0) for i in range(500)]
    df = spark.createDataFrame(data, "e string, v double, w double")
    got = {r["e"]: (r["m"], r["o"]) for r in medians(df, ["e"], {"m": F.col("v"), "o": F.col("w")}).collect()}
    for e in {d[0] for d in data}:
        for k in (1, 2):
            v = [d[k] for d in data if d[0] == e and d[k] is not None and d[k] == d[k]]
            assert got[e][k - 1] == (float(np.median(v)) if v else None), (e, k)
    assert medians(df.limit(0), ["e"], {"m": F.col("v")}).count() == 0


def test_ordered_helpers_across_spans(spark):
    rng = random.Random(5)
    data = [(h, f, rng.choice([None, "x", "y"])) for h in ("a", None) for f in sorted(rng.sample(range(200), 90))]
    df = spark.createDataFrame(data, "h string, f long, s string")
    d = chunked.with_run_start(df, ["h"], "f", F.col("s"), "start", 7)
    d = chunked.with_neighbours(d, ["h"], "f", {"s": F.col("s")}, 7)
    d = chunked.with_carried(chunked.with_next(d, ["h"], "f", ["s"], "nxt", 7), ["h"], "f", {"last": F.col("s")}, 7)
    got = {(r["h"], r["f"]): r for r in d.collect()}
    for h in ("a", None):
        rows = [(f, s) for k, f, s in data if k == h]
        for i, (f, s) in enumerate(rows):
            r = got[h, f]
            j = i
            while j and rows[j - 1][1] == s:
                j -= 1
            before, after = [k for k in range(i) if rows[k][1]], [k for k in range(i + 1, len(rows)) if rows[k][1]]
            assert r["start"] == rows[j][0] and r["pos"] == i and r["last"] == (rows[before[-1]][1] if before else None)
            assert (r["s_prev"] and tuple(r["s_prev"])) == ((before[-1], rows[before[-1]][1]) if before else None)
            assert (r["s_next"] and tuple(r["s_next"])) == ((after[0], rows[after[0]][1]) if after else None)
            assert (r["nxt"] and tuple(r["nxt"])) == (rows[i + 1] if i + 1 < len(rows) else None)


def test_predictor_bundles(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 6))
    data = [(i, [float(v) for v in r], [float(r[0] + r[1])]) for i, r in enumerate(x)] + [(900, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0])]
    rows = spark.createDataFrame(data, "id long, x array<double>, y array<double>")
    ask = rows.filter("id % 10 = 0")
    exact = {q: x[np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:3], :2].sum(1).mean() for q in range(0, 200, 10)}
    for cls, args in ((predictors.KNNPredictor, {}), (predictors.PCAKNNPredictor, {"components": 6}), (predictors.ApproximateKNNPredictor, {"tables": 12, "axes": 2})):
        path = str(tmp_path / cls.__name__)
        cls(3, **args).fit(rows).save(path)
        got = {r["id"]: r["y"] and r["y"][0] for r in cls.load(spark, path).predict(ask).collect()}
        assert got[900] is None and np.mean([abs(got[q] - v) < 1e-9 for q, v in exact.items()]) >= (0.9 if cls is predictors.ApproximateKNNPredictor else 1)
    with pytest.raises(TypeError):
        predictors.PCAKNNPredictor.load(spark, str(tmp_path / "KNNPredictor"))
    with pytest.raises(ValueError):
        predictors.KNNPredictor().predict(ask)


def test_classifier_hooks(spark):
    df = spark.createDataFrame([(i, float(i % 2), None if i == 3 else 0.0, float(i % 2)) for i in range(20)], "id int, a double, b double, label double")
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    model = LogisticRegression().fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.filter("id <> 3")))
    for m in (model, lambda f: f["a"]):
        got = {r["id"]: r["c"] for r in predictors.classify(df, ["a", "b"], m, "c").collect()}
        assert got[3] is None and all(v == i % 2 for i, v in got.items() if i != 3)


def test_centroids_in_many_columns(spark):
    rng = np.random.default_rng(1)
    x, c = rng.standard_normal((50, 300)), rng.standard_normal((25, 300))
    names = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(99, *([None] * 300))], "id int, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r["kmeans_25"] for r in ml.assign_by_centroids(df, names, c.tolist()).select("id", "kmeans_25").collect()}
    want = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert got.pop(99) is None and got == dict(enumerate(want.tolist()))


def test_cross_predict_leaves_the_row_out(spark):
    rows = spark.createDataFrame([(1, [0.0], [1.0], "a"), (2, [0.1], [3.0], "a"), (3, [5.0], [7.0], "b")], "id long, x array<double>, y array<double>, grp string")
    got = {(r["train_grp"], r["test_grp"]): (round(r["rms"], 6), r["n"]) for r in ml.cross_predict(rows, 1).collect() if r["n"]}
    assert got == {("a", "a"): (2.0, 2), ("a", "b"): (4.0, 1), ("b", "a"): (round((26.0) ** 0.5, 6), 2)}


def test_loaders_with_handles_and_views(spark, tmp_path):
    one = "scorer,n,n\nbodyparts,p1,p1\ncoords,x,likelihood\n0,{},1.0\n"
    for name, v in (("r1/left", 1), ("r1/right", 2), ("r2/left", 3), ("r2/right", 4)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.csv").write_text(one.format(v))
    got = pose_csv.read_mapping(spark, {"mine": str(tmp_path / "r1/left.csv"), "other": str(tmp_path / "r2/right.csv")}, "dlc")
    assert sorted((r["handle"], r["p1"]["x"]) for r in got.collect()) == [("mine", 1.0), ("other", 4.0)]
    assert sorted(r["handle"] for r in pose_csv.read_folder(spark, str(tmp_path / "r1"), "dlc").collect()) == ["left", "right"]
    cal = {"views": {v: {"K": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "dist": [[0, 0, 0, 0, 0]]} for v in ("left", "right")}, "view_order": ["left", "right"], "relative_pose": {"R": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "T": [[0.1], [0], [0]]}}
    (tmp_path / "r1/calibration.json").write_text(json.dumps(cal))
    with pytest.raises(ValueError, match="calibration"):
        pose_csv.read_views(spark, str(tmp_path), "dlc")
    (tmp_path / "r2/calibration.json").write_text(json.dumps(cal, indent=1))
    frames, cals = pose_csv.read_views(spark, str(tmp_path), "dlc")
    assert sorted((r["handle"], r["view"], r["p1"]["x"]) for r in frames.collect()) == [("r1", "left", 1.0), ("r1", "right", 2.0), ("r2", "left", 3.0), ("r2", "right", 4.0)]
    assert {(r["handle"], r["view_name"], r["t"] and tuple(r["t"])) for r in cals.collect()} == {(h, v, (0.1, 0.0, 0.0) if v == "right" else None) for h in ("r1", "r2") for v in ("left", "right")}


def test_older_forms_and_metadata(spark, three):
    p = three["A"].pose
    s = clean.smooth(p, clean.smoothing_params(p, [["p1"]], ["mean"], [2])).frames
    assert [r["p1"]["x"] for r in s.orderBy(FRAME).collect()] == [None, 0.5, 1.5, 2.5, 3.5, 4.5]
    with pytest.raises(ValueError):
        clean.smooth(p, {})
    tri = PoseFrame(spark.createDataFrame([("a", 0, 0, (0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (1.0, 1.0))], "handle string, take int, frame long, a struct<x double, y double>, b struct<x double, y double>, c struct<x double, y double>, q struct<x double, y double>"), p.recordings)
    for median, kind in ((True, "static"), (False, "dynamic")):
        assert features.within_boundary(tri, "q", ["a", "b", "c"], median).frames.first()[f"within_boundary_{kind}_q_in_a_b_c"] is True
        assert features.distance_to_boundary(tri, "q", ["a", "b", "c"], median).frames.first()[f"distance_to_boundary_{kind}_q_in_a_b_c"] == 1.0
    rec = groups.add_usermeta(groups.add_usermeta(three.pose.recordings, "A", {"k": "1"}), "A", {"k": "2"}, True)
    assert {r["handle"]: r["usermeta"] for r in rec.collect()} == {"A": {"k": "2"}, "B": {}, "C": {}}
    with pytest.raises(ValueError):
        groups.add_tag(three.pose.recordings, "A", "genotype", "KO")
    t = summary.store(p.recordings.select("handle", "take"), labels.smooth(p.frames, "frame", "mean", 1, "m").groupBy("handle", "take").agg(F.sum("m").alias("v")), "total", meta={"of": "frame"})
    assert t.first()["total"] == 15 and t.schema["total"].metadata == {"of": "frame"}
