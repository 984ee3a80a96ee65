"""Saving and loading: Parquet or CSV, with a manifest of the schema and metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionlake.model import ENTITY, PoseFrame

VERSION = 1


def save(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False, partition_by: tuple[str, ...] = (), meta: dict | None = None) -> None:
    """Write a table and its manifest; an existing path raises unless ``overwrite``."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(f"{path}/data")
    manifest = {"schema_version": VERSION, "format": fmt, "schema": df.schema.jsonValue(), "meta": meta or {}}
    df.sparkSession.createDataFrame([(json.dumps(manifest, allow_nan=False),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if manifest["schema_version"] != VERSION:
        raise ValueError(f"unknown version {manifest['schema_version']}")
    schema = T.StructType.fromJson(manifest["schema"])
    r = spark.read.schema(schema).format(manifest["format"])
    if manifest["format"] == "csv":
        r = r.option("header", True)
    return r.load(f"{path}/data").select(*schema.fieldNames()), manifest["meta"]


def save_pose(pose: PoseFrame, path: str, overwrite: bool = False) -> None:
    # hashed and sorted by recording, so that a handle's frames lie together without a folder for each handle
    frames = pose.frames.withColumn("_part", F.floor(F.col("frame") / 65_536)).repartition(*ENTITY, "_part").drop("_part").sortWithinPartitions(*ENTITY, "frame")
    save(frames, f"{path}/frames", overwrite=overwrite, meta={"steps": json.loads(json.dumps(pose.steps))})
    save(pose.recordings, f"{path}/recordings", overwrite=overwrite)


def load_pose(spark: SparkSession, path: str) -> PoseFrame:
    frames, meta = load(spark, f"{path}/frames")
    return PoseFrame(frames, load(spark, f"{path}/recordings")[0], meta.get("steps", {}))


def to_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One CSV file with a header: for small summary tables."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)
