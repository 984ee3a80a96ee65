"""Predictors with one contract: ``fit`` on (id, x, y), ``predict`` on (id, x), ``save`` and ``load`` as a bundle.

Training rows with a missing value are dropped; rows to predict that are incomplete get null. The model of a nearest-neighbour
predictor is its training table, kept as Parquet beside a manifest with the class and its parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.feature import PCAModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionlake.operators import ml
from motionlake.session import materialise
from motionlake.sources import store


def _complete(rows: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.filter(F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v)))
    return rows


class KNNPredictor:
    """Mean target of the ``k`` nearest training rows, exactly."""

    def __init__(self, k: int = 5, **parameters: object):
        self.k, self.parameters, self.train = k, parameters, None

    def _prepare(self, rows: DataFrame) -> DataFrame:
        return rows

    def fit(self, rows: DataFrame) -> KNNPredictor:
        self.train = _complete(rows.select("id", "x", "y"), "x", "y")
        return self

    def _near(self, rows: DataFrame) -> DataFrame:
        return ml.knn_predict(self._prepare(self.train), self._prepare(rows), self.k)

    def predict(self, rows: DataFrame) -> DataFrame:
        """(id, y): one row per row of ``rows``."""
        if self.train is None:
            raise ValueError("fit first")
        return rows.select("id").join(self._near(_complete(rows.select("id", "x"), "x")), "id", "left")

    def save(self, path: str, overwrite: bool = False) -> None:
        store.save(self.train, f"{path}/train", overwrite=overwrite, meta={"class": type(self).__name__, "k": self.k, "parameters": self.parameters})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KNNPredictor:
        train, meta = store.load(spark, f"{path}/train")
        if meta["class"] != cls.__name__:
            raise TypeError(f"the bundle holds a {meta['class']}")
        made = cls(meta["k"], **meta["parameters"])
        made.train = train
        return made


class PCAKNNPredictor(KNNPredictor):
    """Nearest neighbours among the first ``components`` principal components."""

    def __init__(self, k: int = 5, components: int = 8):
        super().__init__(k, components=components)
        self.model: PCAModel | None = None

    def fit(self, rows: DataFrame) -> PCAKNNPredictor:
        super().fit(rows)
        self.model = ml.fit_pca(self.train, "x", self.parameters["components"])
        return self

    def _prepare(self, rows: DataFrame) -> DataFrame:
        return ml.apply_pca(self.model, rows, "x", "_pc").withColumn("x", F.col("_pc")).drop("_pc", "pc")

    def save(self, path: str, overwrite: bool = False) -> None:
        super().save(path, overwrite)
        w = self.model.write()
        (w.overwrite() if overwrite else w).save(f"{path}/pca")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PCAKNNPredictor:
        made = super().load(spark, path)
        made.model = PCAModel.load(f"{path}/pca")
        return made


class ApproximateKNNPredictor(KNNPredictor):
    """Nearest neighbours among the rows that share a bucket of one of ``tables`` random projections.

    Rows without ``k`` such neighbours are answered exactly, so every complete row gets a value.
    """

    def __init__(self, k: int = 5, tables: int = 8, axes: int = 6, seed: int = 0):
        super().__init__(k, tables=tables, axes=axes, seed=seed)

    def _buckets(self, rows: DataFrame, middle: list[float]) -> DataFrame:
        tables, axes, seed = (self.parameters[n] for n in ("tables", "axes", "seed"))
        planes = np.random.default_rng(seed).standard_normal((len(middle), tables * axes))
        at = np.array(middle)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.stack([np.asarray(v, float) for v in b.column(1).to_pylist()])
                    bits = ((x - at) @ planes > 0).reshape(len(x), tables, axes)
                    keys = (bits << np.arange(axes)).sum(axis=2) + (np.arange(tables) << axes)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(keys.astype(np.int64)), pa.list_(pa.int64()))], ["id", "keys"])

        return rows.select("id", "x").mapInArrow(run, "id long, keys array<long>").select("id", F.explode("keys").alias("key"))

    def _near(self, rows: DataFrame) -> DataFrame:
        first = self.train.select(F.size("x").alias("n")).first()
        if first is None:
            return super()._near(rows)
        middle = list(self.train.agg(*[F.avg(F.get("x", F.lit(i))) for i in range(first["n"])]).first())
        asked, held = self._buckets(rows, middle), self._buckets(self.train, middle).withColumnRenamed("id", "t")
        pairs = asked.join(held, "key").select("id", "t").distinct()
        d = F.aggregate(F.zip_with("x", "_x", lambda a, b: F.pow(a - b, 2)), F.lit(0.0), lambda a, b: a + b)
        near = pairs.join(rows, "id").join(self.train.select(F.col("id").alias("t"), F.col("x").alias("_x"), F.col("y").alias("_y")), "t").withColumn("d", d)
        w = Window.partitionBy("id").orderBy("d", "t")
        best = materialise(near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= self.k).select("id", "_y"))
        n = self.train.select(F.size("y").alias("n")).first()["n"]
        found = best.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.get("_y", F.lit(i))) for i in range(n)]).alias("y")).filter(F.col("n") >= self.k).select("id", "y")
        return found.unionByName(super()._near(rows.join(found, "id", "left_anti")))


def classify(df: DataFrame, columns: Sequence[str], model: Transformer | Callable[[pd.DataFrame], pd.Series], name: str, kind: str = "double") -> DataFrame:
    """Add a label by a user's model: an ML transformer on the assembled columns, or a function of a batch of rows.

    Rows with a missing column get null.
    """
    if isinstance(model, Transformer):
        d = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(df)
        out = model.transform(d)
        return out.select(*df.columns, F.when(ml.complete(columns), F.col("prediction").cast(kind)).alias(name))

    @F.pandas_udf(kind)
    def run(packed: pd.DataFrame) -> pd.Series:
        known = packed.notna().all(axis=1)
        out = pd.Series([None] * len(packed), dtype=object)
        if known.any():
            out[known.to_numpy()] = pd.Series(model(packed[known])).to_list()
        return out

    return df.withColumn(name, run(F.struct(*columns)))
