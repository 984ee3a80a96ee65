"""Readers of keypoint CSV exports: one-header detector files and three- or four-header network files."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.operators.rejects import split_cells, unquoted

# First cells of the header lines (fixed values of the formats).
HEADERS = {"dlc": ["scorer", "bodyparts", "coords"], "dlcma": ["scorer", "animals", "bodyparts", "coords"], "yolo3r": ["frame_index"]}
DROPPED = re.compile(r"(?:^|\.)(?:x1|y1|x2|y2)$")


def handle_of(path: str | Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, line) of all files in one job; files whose name starts with a dot or underscore are skipped."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).filter(F.trim("line") != "")


def _names(layout: str, rows: dict[str, list[str]]) -> list[str]:
    if layout == "yolo3r":
        cells = [re.sub(r"\.conf$", ".likelihood", c) for c in rows["frame_index"]]
        boxes = {c.rpartition(".")[0] for c in cells if DROPPED.search(c)}
        drop = {c for c in cells if DROPPED.search(c)} | {f"{b}.likelihood" for b in boxes} | {"max_dim.x", "max_dim.y"}
        return ["frame", *("" if c in drop else c for c in cells[1:])]
    parts = HEADERS[layout][1:]
    return ["frame", *(".".join(p) for p in zip(*(rows[p][1:] for p in parts)))]


def parse_keypoints(lines: DataFrame, layout: str, aspect_ratio: float = 1.0) -> DataFrame:
    """(path, frame, points as structs) of all files of (path, line) in one pass; points a file lacks are null.

    Each file's header is a row of its own and meets the file's lines in a join; only the distinct field names
    (schema, not data) come to the driver. Lines whose first cell is no number are left out; cells that are no
    numbers and NaN are null; files without a complete header give nothing. ``aspect_ratio`` multiplies every x.
    """
    heads = HEADERS[layout]
    cut = lines.withColumn("cells", F.transform(split_cells("line"), unquoted))
    first = F.get("cells", F.lit(0))
    rows = cut.filter(first.isin(heads)).groupBy("path").agg(*[F.max(F.when(first == h, F.col("cells"))).alias(f"h{i}") for i, h in enumerate(heads)])
    rows = rows.filter(F.expr(" AND ".join(f"h{i} IS NOT NULL" for i in range(len(heads)))))
    distinct = rows.select(*[f"h{i}" for i in range(len(heads))]).distinct().collect()  # one row per kind of header
    known = {tuple(tuple(r[f"h{i}"]) for i in range(len(heads))): _names(layout, {h: r[f"h{i}"] for i, h in enumerate(heads)}) for r in distinct}
    fields = sorted({n for names in known.values() for n in names[1:] if n})
    if not fields:
        raise ValueError("no file with a complete header")
    spark = lines.sparkSession
    kinds = [([list(h) for h in head], [names.index(f, 1) if f in names[1:] else -1 for f in fields]) for head, names in known.items()]
    table = spark.createDataFrame(kinds, "head array<array<string>>, place array<int>")
    files = rows.select("path", F.array(*[f"h{i}" for i in range(len(heads))]).alias("head")).join(table, "head").select("path", "place")
    data = cut.filter(first.try_cast("double").isNotNull()).select("path", "cells").join(files, "path")
    tree: dict = {}
    for i, n in enumerate(fields):
        node = tree
        *inner, dim = n.split(".")
        for p in inner:
            node = node.setdefault(p, {})
        at = F.get("place", F.lit(i))
        v = F.when(at >= 0, F.nanvl(F.get("cells", at).try_cast("double"), F.lit(None).cast("double")))
        node[dim] = v * aspect_ratio if dim == "x" else v, at >= 0

    def build(node: dict) -> tuple[Column, Column]:
        parts = {k: build(v) if isinstance(v, dict) else v for k, v in node.items()}
        there = F.lit(False)
        for _, t in parts.values():
            there = there | t
        return F.when(there, F.struct(*[v.alias(k) for k, (v, _) in parts.items()])), there

    cols = [(build(v)[0] if isinstance(v, dict) else v[0]).alias(k) for k, v in tree.items()]
    return data.select("path", F.get("cells", F.lit(0)).try_cast("double").cast("long").alias("frame"), *cols)


def read_keypoints(spark: SparkSession, paths: str | Sequence[str], layout: str, aspect_ratio: float = 1.0) -> DataFrame:
    """(handle, frame, points) of files or folders; the handle is the file's name without extension."""
    d = parse_keypoints(read_lines(spark, paths), layout, aspect_ratio)
    return d.select(handle_of("path").alias("handle"), *[c for c in d.columns if c != "path"])


def read_mapping(spark: SparkSession, files: Mapping[str, str], layout: str, aspect_ratio: float = 1.0) -> DataFrame:
    """(handle, frame, points) of a file per handle, all in one job."""
    plain = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    table = spark.createDataFrame(list(files.items()), "handle string, _file string").withColumn("_file", plain(F.col("_file")))
    d = parse_keypoints(read_lines(spark, list(files.values())), layout, aspect_ratio).withColumn("_file", plain(F.col("path")))
    return d.join(table, "_file").select("handle", *[c for c in d.columns if c not in ("path", "_file")])


def read_folder(spark: SparkSession, folder: str, layout: str, aspect_ratio: float = 1.0) -> DataFrame:
    """All CSV files of a folder; hidden files are skipped."""
    return read_keypoints(spark, f"{folder}/*.csv", layout, aspect_ratio)


def read_views(spark: SparkSession, folder: str, layout: str, aspect_ratio: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """((handle, view, frame, points), calibrations) of a folder per recording with a CSV file per view.

    Every recording needs its ``calibration.json``; (handle, view_name, k, dist, r, t) come from there, r and t of the second
    view against the first.
    """
    d = parse_keypoints(read_lines(spark, f"{folder}/*/*.csv"), layout, aspect_ratio)
    handle = lambda c: F.regexp_extract(c, r"([^/]+)/[^/]+$", 1)
    frames = d.select(handle("path").alias("handle"), handle_of("path").alias("view"), *[c for c in d.columns if c != "path"])
    raw = spark.read.text(f"{folder}/*/calibration.json", wholetext=True).select(handle(F.col("_metadata.file_path")).alias("handle"), F.col("value").alias("json"))
    lacking = frames.select("handle").distinct().join(raw, "handle", "left_anti").limit(5).collect()
    if lacking:
        raise ValueError(f"no calibration for {[r['handle'] for r in lacking]}")
    m = "array<array<double>>"
    c = raw.select("handle", F.from_json("json", f"views map<string, struct<K: {m}, dist: {m}>>, relative_pose struct<R: {m}, T: {m}>, view_order array<string>").alias("c"))
    c = c.select("handle", "c.view_order", "c.relative_pose", F.explode("c.views").alias("view_name", "v"))
    second = F.col("view_name") == F.get("view_order", F.lit(1))
    return frames, c.select("handle", "view_name", F.col("v.K").alias("k"), F.flatten("v.dist").alias("dist"), F.when(second, F.col("relative_pose.R")).alias("r"), F.when(second, F.flatten("relative_pose.T")).alias("t"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Tag CSV with a ``handle`` column; all tags are strings."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_calibration(path: str) -> dict:
    """Calibration JSON: {view: (K, dist)} and the pose (R, T) of the second view."""
    raw = json.loads(Path(path).read_text())
    return {"views": {v: (c["K"], c["dist"]) for v, c in raw["views"].items()}, "order": raw["view_order"], "r": raw["relative_pose"]["R"], "t": raw["relative_pose"]["T"], "image_size": raw.get("image_size")}
