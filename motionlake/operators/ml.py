"""Scaling, clustering and nearest-neighbour regression on embeddings (columns or arrays)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most bytes of query rows (with their best neighbours) sent to every task at once.
QUERY_BYTES = 64 << 20


def scaling_factors(df: DataFrame, columns: Sequence[str], z_score: bool = False) -> dict[str, dict[str, float]]:
    """Population standard deviation (and mean) per column; one row comes to the driver."""
    aggs = [F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)] + [F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)]
    r = df.agg(*aggs).first()
    return {c: {"std": r[f"s_{i}"]} | ({"mean": r[f"m_{i}"]} if z_score else {}) for i, c in enumerate(columns)}


def apply_scaling(df: DataFrame, factors: Mapping[str, Mapping[str, float]]) -> DataFrame:
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(f.get("mean", 0.0)), F.lit(f["std"])) for c, f in factors.items()})


def custom_scaling(df: DataFrame, columns: Sequence[str], rules: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Scale columns whose name contains a rule's key: divide by the pooled deviation if ``normalize``, times ``scale``.

    Two rules on one column raise; a zero or unknown deviation counts as 1.
    """
    hit = {c: [k for k in rules if k in c] for c in columns}
    clash = {c: k for c, k in hit.items() if len(k) > 1}
    if clash:
        raise ValueError(f"conflicting rules: {clash}")
    normal = [c for c, k in hit.items() if k and rules[k[0]].get("normalize")]
    std = {c: f["std"] for c, f in scaling_factors(df, normal).items()} if normal else {}
    safe = {c: s if s and np.isfinite(s) else 1.0 for c, s in std.items()}
    return df.withColumns({c: F.col(c) / F.lit(safe.get(c, 1.0)) * F.lit(float(rules[k[0]].get("scale", 1.0))) for c, k in hit.items() if k})


def complete(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def assign_by_centroids(df: DataFrame, columns: Sequence[str], centroids: Sequence[Sequence[float]], name: str | None = None) -> DataFrame:
    """Nearest centroid by Euclidean distance, the lowest index on ties; null where a column is null.

    One Arrow pass of matrix products over the packed columns, so any number of columns and centroids will do; the
    distances to the centroids near the smallest are then taken again without cancellation.
    """
    if any(len(c) != len(columns) for c in centroids):
        raise ValueError("centroids and columns differ in number")
    table = np.array(centroids, float).reshape(len(centroids), len(columns))
    square = (table**2).sum(axis=1)

    @F.pandas_udf("int")
    def nearest(packed: pd.Series) -> pd.Series:
        known = packed.notna().to_numpy()
        out = np.full(len(packed), -1)
        if known.any():
            x = np.stack(packed[known].to_list()).astype(float)
            rough = square - 2 * (x @ table.T)
            least = rough.min(axis=1, keepdims=True)
            best, label = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
            close = rough <= least + 1e-9 * ((x**2).sum(axis=1, keepdims=True) + square.max())
            for i in range(len(table)):
                at = np.flatnonzero(close[:, i])
                d = ((x[at] - table[i]) ** 2).sum(axis=1)
                better = d < best[at]
                best[at[better]], label[at[better]] = d[better], i
            out[known] = label
        return pd.Series(out, dtype="Int32").mask(pd.Series(~known)).astype("Int32")

    packed = F.when(complete(columns), F.array(*[F.col(c).cast("double") for c in columns]))
    return df.withColumn(name or f"kmeans_{len(centroids)}", nearest(packed))


def cluster_embedding(df: DataFrame, columns: Sequence[str], k: int, seed: int = 0, decimation: int | None = None, order: Sequence[str] = ()) -> tuple[DataFrame, list[list[float]]]:
    """(df with ``kmeans_k``, centroids). k-means on complete rows, on every ``decimation``-th of them if set.

    Decimation picks by a hash of the ``order`` columns, so it needs no ordering of the rows.
    """
    full = df.filter(complete(columns))
    if decimation:
        full = full.filter(F.pmod(F.xxhash64(*order), F.lit(decimation)) == 0)
    vec = VectorAssembler(inputCols=list(columns), outputCol="features").transform(full).select("features")
    model = KMeans(k=k, seed=seed, initMode="k-means||").fit(vec)
    centres = sorted([float(x) for x in c] for c in model.clusterCenters())
    return assign_by_centroids(df, columns, centres, f"kmeans_{k}"), centres


def cluster_diagnostics(df: DataFrame, entity: list[str], label: str, n: int, low: float = 0.05, high: float = 0.9) -> DataFrame:
    """(entity, percent_nan, num_missing, num_low, num_high) over labels 0..n-1; shares count nulls below the line."""
    e = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("_n"), (F.count(F.lit(1)) - F.count(label)).alias("_null"), *[F.count_if(F.col(label) == i).alias(f"_c{i}") for i in range(n)])
    share = [F.col(f"_c{i}") / F.col("_n") for i in range(n)]
    count = lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
    return e.select(*entity, (F.col("_null") / F.col("_n")).alias("percent_nan"), count([F.col(f"_c{i}") == 0 for i in range(n)]).alias("num_missing"), count([s < low for s in share]).alias("num_low"), count([s > high for s in share]).alias("num_high"))


def global_prevalence(df: DataFrame, label: str, n: int) -> DataFrame:
    """(label, count, share) of labels 0..n-1 over all rows; nulls count below the line."""
    c = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("label"))
    full = every.join(c, "label", "full")
    total = full.groupBy().agg(F.sum("count").alias("_all"))
    return full.filter(F.col("label").isNotNull()).crossJoin(F.broadcast(total)).select("label", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce(F.try_divide(F.col("count").cast("double"), F.col("_all")), F.lit(0.0)).alias("share"))


def rms_error(df: DataFrame, actual: Sequence[str], predicted: Sequence[str], name: str = "rms") -> DataFrame:
    """Row-wise root mean square difference; null if any value is."""
    total = sum((F.pow(F.col(a) - F.col(b), 2) for a, b in zip(actual, predicted, strict=True)), F.lit(0.0))
    return df.withColumn(name, F.sqrt(total / len(actual)))


def knn_predict(train: DataFrame, query: DataFrame, k: int, other_group: bool = False) -> DataFrame:
    """(id, y): mean target array of the k nearest training rows, ties to the smaller id.

    ``train`` is (id, x array<double>, y array<double>[, grp]), ``query`` (id, x[, grp]). The queries go to the workers
    in blocks of at most ``QUERY_BYTES``; every task compares its share of the training rows with the whole block by matrix
    products and keeps the k best, so training rows never leave their task. With ``other_group`` neighbours of the query's own
    group are left out.
    """
    spark = train.sparkSession
    cols = ["id", "x", "y"] + (["grp"] if other_group else [])
    train = train.select(*cols).filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()) & ~F.exists("y", lambda v: v.isNull()))
    query = query.select("id", "x", *(["grp"] if other_group else [])).filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    first = train.select(F.size("x").alias("a"), F.size("y").alias("b")).first()
    if first is None:
        return query.select("id", F.lit(None).cast("array<double>").alias("y"))
    blocks = max(1, -(-query.count() * 8 * (first["a"] + 2 * k) // QUERY_BYTES))
    matrix = lambda c: np.stack([np.asarray(v, float) for v in c.to_pylist()])
    out = None
    for block in range(blocks):
        rows = (query if blocks == 1 else query.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).toArrow()
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast((rows.column("id").to_numpy(), matrix(rows.column("x")), np.array(rows.column("grp").to_pylist(), object) if other_group else None))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q, qg = shared.value
            best, who = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
            target = np.zeros((len(q), k, first["b"]))
            for batch in batches:
                if not batch.num_rows:
                    continue
                tid, tx, ty = batch.column(0).to_numpy(), matrix(batch.column(1)), matrix(batch.column(2))
                tg = np.array(batch.column(3).to_pylist(), object) if qg is not None else None
                square = (tx**2).sum(axis=1)
                for s in range(0, len(q), 1024):
                    part = q[s : s + 1024]
                    d = square - 2 * (part @ tx.T) + (part**2).sum(axis=1, keepdims=True)
                    if tg is not None:
                        d[qg[s : s + 1024][:, None] == tg[None, :]] = np.inf
                    slack = 1e-9 * (square.max() + (part**2).sum(axis=1))
                    kth = np.partition(d, min(k, len(tid)) - 1, axis=1)[:, min(k, len(tid)) - 1]
                    close = (d <= (np.minimum(kth, best[s : s + 1024, -1]) + slack)[:, None]) & np.isfinite(d)
                    for i in np.flatnonzero(close.any(axis=1)):
                        c = np.flatnonzero(close[i])
                        exact = ((tx[c] - part[i]) ** 2).sum(axis=1)
                        both, ids = np.r_[best[s + i], exact], np.r_[who[s + i], tid[c]]
                        o = np.lexsort((ids, both))[:k]
                        best[s + i], who[s + i], target[s + i] = both[o], ids[o], np.concatenate([target[s + i], ty[c]])[o]
            r, c = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(best[r, c]), pa.array(who[r, c]), pa.array(list(target[r, c]), pa.list_(pa.float64()))], ["id", "d", "t", "y"])

        found = train.mapInArrow(near, "id long, d double, t long, y array<double>")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return query.select("id", F.lit(None).cast("array<double>").alias("y"))
    w = Window.partitionBy("id").orderBy("d", "t")
    best = out.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return best.groupBy("id").agg(F.array(*[F.avg(F.get("y", F.lit(i))) for i in range(first["b"])]).alias("y"))


def cross_predict(rows: DataFrame, k: int, within: bool = True) -> DataFrame:
    """(train_grp, test_grp, rms, n): how well each group's rows predict every group's targets, by k nearest neighbours.

    ``rows`` is (id, x, y, grp). A group is tested on itself by leaving out the row itself; ``within=False`` leaves
    these pairs out. One pass over the queries per training group (groups are few: tags of recordings); rows without group
    take no part. ``rms`` is the root mean square over the rows' own root mean squares.
    """
    rows = rows.filter("grp IS NOT NULL")
    out = None
    for g in sorted(r["grp"] for r in rows.select("grp").distinct().collect()):
        train, other = rows.filter(F.col("grp") == F.lit(g)), rows.filter(F.col("grp") != F.lit(g)).select("id", "x", F.col("id").alias("grp"))
        query = other.unionByName(train.select("id", "x", F.col("id").alias("grp"))) if within else other
        # a row is a group of its own, so that it never predicts itself
        p = knn_predict(train.select("id", "x", "y", F.col("id").alias("grp")), query, k, other_group=True).select("id", F.col("y").alias("_p"))
        e = rows.join(p, "id").withColumn("_e", F.aggregate(F.zip_with("y", "_p", lambda a, b: F.pow(a - b, 2)), F.lit(0.0), lambda a, b: a + b) / F.size("y"))
        one = e.groupBy(F.col("grp").alias("test_grp")).agg(F.sqrt(F.avg("_e")).alias("rms"), F.count("_e").alias("n")).withColumn("train_grp", F.lit(g))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return rows.select(F.col("grp").alias("train_grp"), F.col("grp").alias("test_grp"), F.lit(0.0).alias("rms"), F.lit(0).cast("long").alias("n")).limit(0)
    return out.select("train_grp", "test_grp", "rms", "n")


def fit_pca(df: DataFrame, column: str, k: int) -> Model:
    """Principal components of an array column; ``model.write().save(path)`` keeps it."""
    return PCA(k=k, inputCol="v", outputCol="pc").fit(df.select(array_to_vector(column).alias("v")))


def apply_pca(model: Model, df: DataFrame, column: str, name: str = "pc") -> DataFrame:
    return model.transform(df.withColumn("v", array_to_vector(column))).withColumn(name, vector_to_array("pc")).drop("v")
