"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only on one machine (a local master) a
    temporary folder is made and set where that is unset; a cluster without a named folder is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    own = tempfile.mkdtemp(prefix="motionlake-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir("file://" + own)
    return "file://" + own


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage (the files survive a lost executor) and keeps later passes from
    computing the input again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/motionlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more (the steps of a loop)."""
    for t in tables:
        for f in {name.rpartition("/")[0] for name in t.inputFiles()}:
            if f.rpartition("/")[2].startswith("motionlake-"):
                path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
