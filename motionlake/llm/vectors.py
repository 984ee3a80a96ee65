"""Shared steps of the vector operators: usable unit vectors, learned rotations, codes, hot modes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.session import discard, materialise

#: Most rows a rotation or the dense modes are fitted on; every row is indexed.
FIT_ROWS = 20_000


def usable_vectors(rows: DataFrame, key: list[str], row_id: str, data: str, dim: int) -> DataFrame:
    """(row_id, v): of equal keys the smallest row_id, with ``dim`` finite values that are not all zero."""
    one = rows.groupBy(*key).agg(F.min_by(F.struct(F.col(row_id).alias("row_id"), F.col(data).alias("v")), row_id).alias("r")).select("r.row_id", "r.v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return one.filter((F.size("v") == dim) & finite & F.exists("v", lambda x: x != 0))


def unit(a: np.ndarray) -> np.ndarray:
    a = a / np.abs(a).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def binary(a: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    a = np.ascontiguousarray(a)
    width = a.shape[1] * a.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(a), [None, pa.py_buffer(a)]).cast(pa.binary())


def floats(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Binary values as rows of single-precision numbers."""
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)


def as_floats(rows: DataFrame, key: str, dim: int, also: str | None = None) -> DataFrame:
    """(key[, also], x): ``v`` as the binary unit vector in single precision."""
    keep = [key, *([also] if also else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(matrix(b.column(b.schema.names.index("v")), dim)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(k)) for k in keep), binary(x)], [*keep, "x"])

    return rows.select(*keep, "v").mapInArrow(run, ", ".join(f"{k} long" for k in keep) + ", x binary")


def sample(vectors: DataFrame, dim: int, most: int = FIT_ROWS, seed: int = 5) -> np.ndarray:
    """At most ``most`` unit vectors, the ones with the smallest seeded hash of their id."""
    table = vectors.orderBy(F.xxhash64(F.lit(seed), "row_id")).limit(most).select("v").toArrow()
    return unit(matrix(table.column(0), dim)) if table.num_rows else np.zeros((0, dim))


def learn_rotation(x: np.ndarray, dim: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Rotation that brings ``x`` near the corners of the cube: alternate signs and orthogonal fits."""
    rng = np.random.default_rng(seed)
    r, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    for _ in range(rounds if len(x) > 4 * dim else 0):
        u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x)
        r = vt.T @ u.T
    return r


def dense_modes(x: np.ndarray, near: float = 0.8, least_share: float = 0.002, most: int = 128) -> np.ndarray:
    """Directions that hold at least ``least_share`` of the sample within cosine ``near`` (largest first)."""
    left = np.ones(len(x), bool)
    out: list[np.ndarray] = []
    if len(x) < 50:
        return np.zeros((0, x.shape[1]))
    tries = np.random.default_rng(3).permutation(len(x))[:2000]
    for i in tries:
        if not left[i] or len(out) >= most:
            continue
        c = x[i]
        inside = left & (x @ c >= near)
        if inside.sum() < max(10, least_share * len(x)):
            continue
        for _ in range(3):
            c = x[inside].sum(0)
            c = c / np.linalg.norm(c)
            inside = left & (x @ c >= near)
        if inside.sum() >= max(10, least_share * len(x)):
            out.append(c)
            left &= ~inside
    return np.array(out).reshape(-1, x.shape[1])


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 (any number of columns up to 62) as int64."""
    return (bits.astype(np.int64) << np.arange(bits.shape[1], dtype=np.int64)).sum(axis=1)


def sorted_groups(batches: Iterator[pa.RecordBatch], least: int = 2) -> Iterator[list[np.ndarray]]:
    """Columns (without the first, the key) of every whole group of at least ``least`` rows.

    Batches are sorted by the first column. Fixed-size binary columns become rows of bytes.
    """

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for c in batch.columns:
            if pa.types.is_binary(c.type):
                n = len(c)
                raw = b"".join(c.to_pylist())
                out.append(np.frombuffer(raw, np.uint8).reshape(n, -1))
            else:
                out.append(c.to_numpy(zero_copy_only=False))
        return out

    held: list[list[np.ndarray]] = []

    def flush() -> Iterator[list[np.ndarray]]:
        if sum(len(h[0]) for h in held) >= least:
            yield [np.concatenate([h[i] for h in held]) for i in range(1, len(held[0]))]
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = arrays(batch)
        edges = np.r_[0, np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1, len(cols[0])]
        if held and held[-1][0][-1] != cols[0][0]:
            yield from flush()
        sizes = np.diff(edges)
        last = len(sizes) - 1
        if held and last > 0:  # the first group goes on from the batch before and ends here
            held.append([c[: edges[1]] for c in cols])
            yield from flush()
            first = 1
        else:
            first = 0
        for g in np.flatnonzero(sizes[first:last] >= least) + first:
            yield [c[edges[g] : edges[g + 1]] for c in cols[1:]]
        held.append([c[edges[last] :].copy() for c in cols])
    if held:
        yield from flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the undirected edges (a, b): the smallest node reachable, for every node.

    Each round every node takes the smallest label beside it, one pointer jump follows, and the edges
    are drawn again between labels; the rounds grow with the logarithm of the longest chain.
    """
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct())
    labels = materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("u"), F.least("a", "p").alias("p"))
        parent = materialise(parent)
        old = (edges, labels)
        up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jump = materialise(parent.join(up, "p").select("u", F.col("pp").alias("p")))
        labels = materialise(labels.join(jump, labels["label"] == jump["u"], "left").select("node", F.coalesce("p", "label").alias("label")))
        a = edges.join(jump, edges["a"] == jump["u"]).select(F.col("p").alias("a"), "b")
        edges = materialise(a.join(jump, a["b"] == jump["u"]).select("a", F.col("p").alias("b")).filter("a <> b").distinct())
        discard(parent, jump, *old)
    discard(edges)
    return labels
