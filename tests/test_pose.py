"""Golden values of the pose operators, readers and stores."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motionlake.functions import exprs
from motionlake.model import ENTITY, FRAME, PoseFrame
from motionlake.operators import clean, features, groups, labels, ml, multiview, summary
from motionlake.sources import pose_csv, store
from motionlake.streaming import live

POINT = "struct<x: double, y: double, z: double, likelihood: double>"


def frames(spark, xs, handle="a"):
    data = [(handle, 0, i, (x, 0.0, 0.0, 1 - i / 10)) for i, x in enumerate(xs)]
    return PoseFrame(spark.createDataFrame(data, f"handle string, take int, frame long, p1 {POINT}"), spark.createDataFrame([(handle, 0, 30.0)], "handle string, take int, fps double"))


def series(df, col):
    return [r[0] for r in df.orderBy(FRAME).select(col).collect()]


def states(spark, values, kind="string"):
    return spark.createDataFrame([("a", 0, i, v) for i, v in enumerate(values)], f"handle string, take int, frame long, s {kind}")


def test_interpolation_golden(spark):
    p = clean.interpolate(frames(spark, [None, 1.0, None, None, 4.0, None, None]), "linear", 1)
    assert series(p.frames, "p1.x") == [None, 1.0, 2.0, None, 4.0, 4.0, None]
    assert set(series(p.frames, "p1.likelihood")) == {None}
    with pytest.raises(ValueError):
        clean.interpolate(p)


def test_likelihood_filter_is_inclusive(spark):
    p = clean.filter_likelihood(frames(spark, [1.0, 2.0, 3.0]), 0.9)
    assert series(p.frames, "p1.x") == [1.0, None, None]
    with pytest.raises(ValueError):
        clean.filter_likelihood(p, 0.5)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), min_size=1, max_size=12), st.integers(1, 4))
def test_smoothing_matches_pandas(spark, xs, k):
    import pandas as pd

    s = pd.Series(xs, dtype=float)
    for method in ("mean", "median"):
        got = series(clean.smooth_all(frames(spark, [None if x is None else float(x) for x in xs]), k, method).frames, "p1.x")
        want = getattr(s.rolling(k, min_periods=k), method)()
        assert [None if v is None else round(v, 9) for v in got] == [None if math.isnan(v) else round(v, 9) for v in want]


def test_custom_smoother_and_trim(spark):
    p = clean.smooth_all(frames(spark, [1.0, 2.0, 3.0]), smoother=lambda s: s * 2)
    assert series(p.frames, "p1.x") == [2.0, 4.0, 6.0]
    assert series(clean.trim(frames(spark, [1.0] * 6), 1, -2).frames, FRAME) == [1, 2, 3]


def test_summaries_golden(spark):
    mask = states(spark, [True, True, False, True, None, True, False], "boolean")
    assert summary.count_onset(mask, "s").first()["onsets"] == 2
    s = states(spark, ["A", "A", None, "A", "B", None, "A"])
    assert {(r["prev"], r["curr"]): r["n"] for r in summary.transition_matrix(s, "s").collect()} == {("A", "B"): 1}
    assert {r["state"]: r["onsets"] for r in summary.count_state_onsets(s, "s").collect()} == {"A": 3, "B": 1}
    five = states(spark, [1.0, 2.0, 3.0, 4.0, 5.0], "double")
    r = summary.column_stats(five, "s").first()
    assert (r["sum_s"], r["mean_s"], r["median_s"], r["max_s"], r["min_s"]) == (15, 3, 3, 5, 1)
    bins = summary.make_bins(five.withColumn("keep", F.lit(1)), 3)
    assert sorted((r["bin"], r["frame"]) for r in bins.collect()) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3), (2, 4)]


def test_label_runs(spark):
    s = states(spark, ["A", "A", "A", "B", None, "A", "A", "A", "C"])
    assert series(labels.smooth_block(s, "s", 2, "o"), "o") == ["A"] * 9
    assert series(labels.smooth_block(s, "s", 9, "o"), "o") == [None] * 9
    assert series(labels.get_block(s, "s", 3, "o"), "o") == [True] * 3 + [False] * 2 + [True] * 3 + [False]
    assert series(labels.smooth(s, "s", "mode", 3, "o"), "o") == [None, "A", "A", None, None, None, "A", "A", None]


def test_embedding_names(spark):
    e = features.embedding(states(spark, [0, 1, 2, 3, 4], "int").withColumnRenamed("s", "c"), {"c": [0, 1, -1]})
    assert set(e.columns) == {*ENTITY, FRAME, "c_t0", "c_t+1", "c_t-1"}
    assert series(e, "`c_t-1`") == [None, 0, 1, 2, 3]


def test_polygon_rules(spark):
    square = [(F.lit(0.0), F.lit(0.0)), (F.lit(4.0), F.lit(0.0)), (F.lit(4.0), F.lit(4.0)), (F.lit(0.0), F.lit(4.0))]
    d = spark.createDataFrame([(1.0, 1.0), (4.0, 2.0), (5.0, 2.0), (None, 1.0)], "x double, y double")
    got = d.select(exprs.contains(F.col("x"), F.col("y"), square), exprs.distance_to_outline(F.col("x"), F.col("y"), square), exprs.polygon_area(square)).collect()
    assert [tuple(r) for r in got] == [(True, 1.0, 16.0), (False, 0.0, 16.0), (False, 1.0, 16.0), (None, None, 16.0)]
    with pytest.raises(ValueError):
        exprs.contains(F.col("x"), F.col("y"), square[:2])


def test_ellipse_fit_recovers():
    t = np.linspace(0, 2 * np.pi, 9)[:-1]
    a, b, th = 5.0, 2.0, 0.4
    xy = np.stack([3 + a * np.cos(t) * np.cos(th) - b * np.sin(t) * np.sin(th), 1 + a * np.cos(t) * np.sin(th) + b * np.sin(t) * np.cos(th)], 1)
    cx, cy, p, q, _ = features.fit_ellipse(xy)
    assert np.allclose([cx, cy, max(p, q), min(p, q)], [3, 1, 5, 2], atol=1e-6)
    assert np.isfinite(features.fit_ellipse(xy[::2])).all()


def test_triangulation_round_trip(spark):
    rng = np.random.default_rng(0)
    pts = rng.uniform(-0.5, 0.5, (6, 3)) + [0, 0, 3]
    k = [[800.0, 0.0, 320.0], [0.0, 800.0, 240.0], [0.0, 0.0, 1.0]]
    data = []
    for p in pts:
        q = p + [0.1, 0, 0]
        data.append((float(800 * p[0] / p[2] + 320), float(800 * p[1] / p[2] + 240), 0.9, float(800 * q[0] / q[2] + 320), float(800 * q[1] / q[2] + 240), 0.8, k, [0.0] * 5, k, [0.0] * 5, np.eye(3).tolist(), [0.1, 0.0, 0.0]))
    data.append((None, *data[0][1:]))
    m, v = "array<array<double>>", "array<double>"
    df = spark.createDataFrame(data, f"u1 double, v1 double, l1 double, u2 double, v2 double, l2 double, k1 {m}, d1 {v}, k2 {m}, d2 {v}, r {m}, t {v}").coalesce(1)
    got = multiview.stereo_triangulate(df, invert_z=False).collect()
    assert np.allclose([list(r["xyz"]) for r in got[:-1]], pts, atol=1e-6)
    assert got[-1]["xyz"] is None and got[0]["likelihood"] == 0.8


def test_kmeans_labels_are_nearest(spark):
    df = spark.createDataFrame([(i, float(i % 2 * 10) + i * 0.01, None if i == 7 else 0.0) for i in range(40)], "id int, a double, b double")
    got, centres = ml.cluster_embedding(df, ["a", "b"], 2)
    r = {x["id"]: x["kmeans_2"] for x in got.collect()}
    assert len(centres) == 2 and r[7] is None and all(r[i] == i % 2 for i in range(40) if i != 7)


def test_readers_and_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/A.csv").write_text("scorer,n,n,n,n\nbodyparts,p1,p1,p2,p2\ncoords,x,likelihood,x,likelihood\n0,0,1.0,10,1.0\n1,1,0.75,nan,0.75\n")
    (tmp_path / "in/B.csv").write_text("scorer,n,n\nbodyparts,p1,p1\ncoords,x,likelihood\n0,5,1.0\n")
    d = pose_csv.read_keypoints(spark, str(tmp_path / "in"), "dlc", aspect_ratio=2.0)
    assert sorted((r["handle"], r["frame"], r["p1"]["x"], r["p2"] and r["p2"]["x"]) for r in d.collect()) == [("A", 0, 0.0, 20.0), ("A", 1, 2.0, None), ("B", 0, 10.0, None)]
    (tmp_path / "Y.csv").write_text("frame_index,p1.x,p1.conf,box.x1,box.conf,max_dim.x\n3,1,0.5,2,0.3,4\n")
    y = pose_csv.read_keypoints(spark, str(tmp_path / "Y.csv"), "yolo3r")
    assert y.columns == ["handle", "frame", "p1"] and y.first()["p1"].asDict() == {"x": 1.0, "likelihood": 0.5}
    store.save(d, str(tmp_path / "out"), partition_by=("handle",), meta={"fps": 30})
    back, meta = store.load(spark, str(tmp_path / "out"))
    assert meta == {"fps": 30} and back.columns == d.columns and back.dtypes == d.dtypes and back.count() == 3
    with pytest.raises(Exception, match="already exists"):
        store.save(d, str(tmp_path / "out"))


def test_tags(spark):
    rec = spark.createDataFrame([("A", 0), ("B", 0), (None, 0)], "handle string, take int")
    tags = groups.normalised(spark.createDataFrame([("A", " WT "), ("X", "T1")], "handle string, genotype string"), ["genotype"])
    r = groups.tags_info(groups.add_tags(rec, tags), ["genotype"]).first()
    assert (r["attached_to"], r["missing_from"], r["unique_values"], r["value_counts"]) == (1, 2, 1, "wt=1")
    assert sorted(map(tuple, groups.unmatched(rec, tags).collect())) == [("B", "tags"), ("X", "recording")]
    with pytest.raises(ValueError):
        groups.group_by_tags(rec.select(*ENTITY), groups.add_tags(rec, tags), ["genotype"])


def test_stream_of_changes(spark, tmp_path):
    batch = frames(spark, [0.0, 3.0, 7.0]).frames
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = live.live_distance_change(s, "p1").writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("changes").select("frame", "change").collect())) == [(0, None), (1, 3.0), (2, 4.0)]
