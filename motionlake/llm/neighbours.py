"""Most similar vectors: multi-index hashing over learned rotated binary codes.

A code is the signs of the unit vector under rotations learned on a bounded sample. The radius is the Hamming distance
that a pair of just the sought similarity exceeds with a chance of at most ``MISS``. The code is cut into one substring
more than the radius, each indexed by its value: by the pigeonhole principle two codes within the radius agree in one
whole substring, so reading the bucket of every substring retrieves every code within the radius. What a bucket holds
is compared on the quantised floats and, where these could reach the similarity, reranked on the floats. The length of the code follows
the number of rows: longer codes have longer substrings, so fuller buckets are traded for more tables.

Dense modes: a direction that holds a large share of all rows would fill its buckets. Such modes are found
on the sample; rows near a mode are coded relative to its centre. Rows near the border of a mode are coded both
ways, so every pair within the sought similarity shares at least one space. Directions seen from a centre differ in too
many bits for whole substrings: a mode is compared as one bucket, in parts, or, where that costs more, in as many
tables of short keys as miss a pair with a chance of at most ``MISS``. Buckets that hold more than ``BUCKET_ROWS`` rows
(estimated on the sample, which only spreads the work) are compared in parts, one task per pair of parts.

Exact copies: only the smallest row_id of equal vectors is indexed; the others are members of its class.

Defined results: rows without key, null, short, zero or non-finite vectors take no part; a table with
fewer than two usable vectors gives no pairs; ties in a top-k list go to the smaller row_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.llm import vectors as V
from motionlake.session import materialise

#: Chance that a pair of just the sought similarity lies beyond the radius (in a mode: shares no key).
MISS = 1e-3
#: Rotations a code has at most, and the comparisons that cost as much as moving one row.
MOST_ROTATIONS, COMPARED_PER_MOVE = 40, 400
BUCKET_ROWS = 4096
MODE_NEAR = 0.8
#: Copies of one vector beyond this many are linked to their representative only.
EXPAND_COPIES = 16
QUERY_BLOCK = 20_000


def radius_for(bits: int, p: float, miss: float = MISS) -> int:
    """Differing bits of ``bits`` that are exceeded with a chance of at most ``miss`` if each differs with chance ``p``."""
    term, total, r = (1 - p) ** bits, 0.0, 0
    while r < bits:
        total += term
        if 1 - total <= miss:
            return r
        term *= (bits - r) / (r + 1) * p / (1 - p)
        r += 1
    return bits


def cost(tables: int, width: float, rows: float) -> float:
    """Rows moved per row, with the comparisons in their buckets counted in the same unit."""
    fill = max(1.0, rows / 2.0**width)
    return tables * (max(1.0, fill / BUCKET_ROWS) + fill / COMPARED_PER_MOVE)


class Coder:
    """Learned codes and the bucket keys of a vector; small enough to be sent to every task."""

    def __init__(self, sample: np.ndarray, dim: int, n: int, min_cos: float, miss: float = MISS, pigeonhole: bool = True, bucket_rows: int = BUCKET_ROWS):
        self.dim, self.min_cos, self.miss = dim, min_cos, miss
        self.modes = V.dense_modes(sample, MODE_NEAR)
        chord = math.sqrt(2 - 2 * min_cos)
        rest, shares, spread = sample, [1.0], [1.0]
        if len(self.modes):
            inside = sample @ self.modes.T >= MODE_NEAR
            rest = sample[~inside.any(axis=1)]
            shares = [max(len(rest), 1) / max(len(sample), 1), *inside.mean(axis=0)]
            spread += [float(np.quantile(np.linalg.norm(sample[inside[:, j]] - c, axis=1), 0.01)) for j, c in enumerate(self.modes)]
        #: Per space the substrings, as (start, end) in the code.
        self.cuts: list[list[tuple[int, int]]] = []
        for j, (share, rho) in enumerate(zip(shares, spread)):
            # share of bits in which a pair of just the sought similarity differs; in a mode the members
            # nearest to its centre, whose directions from there differ most, set it
            p = min(0.5, math.acos(min_cos) / math.pi if j == 0 else 2 * math.asin(min(1.0, chord / (2 * max(rho, 1e-9)))) / math.pi)
            self.cuts.append(self._pigeonhole(p, share * n) if j == 0 and pigeonhole else self._bands(p, share * n))
        self.rotations = [V.learn_rotation(rest, dim, seed) for seed in range(-(-max(c[-1][1] for c in self.cuts) // dim))]
        self.hot: dict[int, int] = {}
        if n > bucket_rows and len(sample):
            for j, rows, keys in self.keys(sample):
                for t in range(keys.shape[1]):
                    key, count = np.unique(keys[:, t], return_counts=True)
                    parts = np.ceil(count * (n / len(sample)) / bucket_rows).astype(int)
                    many = (parts > 1) & ((count > 2) | (len(sample) >= n))
                    self.hot |= dict(zip(key[many].tolist(), parts[many].tolist()))

    def _pigeonhole(self, p: float, rows: float) -> list[tuple[int, int]]:
        """One substring more than the radius, of the code length that costs least."""
        best = None
        for r in range(1, MOST_ROTATIONS + 1):
            bits = r * self.dim
            tables = radius_for(bits, p, self.miss) + 1
            if tables <= bits and (best is None or cost(tables, bits / tables, rows) < best[0]):
                best = (cost(tables, bits / tables, rows), bits, tables)
        if best is None:
            return [(0, 0)]
        edges = np.linspace(0, best[1], best[2] + 1).astype(int).tolist()
        return list(zip(edges, edges[1:]))

    def _bands(self, p: float, rows: float) -> list[tuple[int, int]]:
        """One bucket for all, or tables of ``w`` bits that miss a pair with a chance of at most ``miss``, whatever costs least."""
        best = (cost(1, 0, rows), 0, 1)
        for w in range(1, 41):
            tables = math.ceil(math.log(self.miss) / math.log1p(-min((1 - p) ** w, 1 - 1e-12)))
            if tables * w <= MOST_ROTATIONS * self.dim and cost(tables, w, rows) < best[0]:
                best = (cost(tables, w, rows), w, tables)
        return [(t * best[1], (t + 1) * best[1]) for t in range(best[2])]

    def spaces(self, x: np.ndarray) -> list[np.ndarray]:
        """Rows of each space: 0 is the whole sphere, j the neighbourhood of mode j."""
        if not len(self.modes):
            return [np.arange(len(x))]
        sim = x @ self.modes.T
        border = math.cos(max(0.0, math.acos(MODE_NEAR) - math.acos(self.min_cos) - 1e-9))
        return [np.flatnonzero((sim < border).all(axis=1) | ~(sim >= MODE_NEAR).any(axis=1)), *(np.flatnonzero(s >= MODE_NEAR) for s in sim.T)]

    def keys(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per space: (space, rows, keys [row, table])."""
        for j, rows in enumerate(self.spaces(x)):
            if not len(rows):
                continue
            cuts = self.cuts[j]
            y = x[rows] - (self.modes[j - 1] if j else 0.0)
            bits = np.concatenate([np.zeros((len(rows), 0), bool), *(y @ r > 0 for r in self.rotations[: -(-cuts[-1][1] // self.dim)])], axis=1)
            yield j, rows, np.stack([V.pack(bits[:, a:b]) | (t << 40) | (j << 51) for t, (a, b) in enumerate(cuts)], axis=1)

    def tasks(self, x: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per table: (rows, key, lo, hi) with the parts of the key that meet in the task; a row of part i meets every part j."""
        for _, rows, keys in self.keys(x):
            for key in keys.T:
                lo, hi = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int32)
                hot = set(key.tolist()) & self.hot.keys() if self.hot else ()
                if not hot:
                    yield rows, key, lo, hi
                    continue
                cold = ~np.isin(key, list(hot))
                yield rows[cold], key[cold], lo[cold], hi[cold]
                for k in hot:
                    at = rows[key == k]
                    own = ((ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(self.hot[k])).astype(np.int32)
                    for other in range(self.hot[k]):
                        # the sign of hi tells the side: a row of the higher part of two is side 1
                        top = np.maximum(own, other)
                        yield at, np.full(len(at), k), np.minimum(own, other), np.where((own == top) & (own != other), -top - 1, top).astype(np.int32)


def _bucket_rows(vecs: DataFrame, coder) -> DataFrame:
    """(task, row_id, side, q): one row per vector and task; ``q`` is the unit vector in steps of 1/127. ``vecs`` is (row_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), V.unit(V.matrix(batch.column(1), c.dim))
            q = V.binary(np.round(x * 127).astype(np.int8))
            for rows, key, lo, hi in c.tasks(x, ids):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lo), pa.array(hi), batch.column(0).take(at), q.take(at)], ["key", "lo", "hi", "row_id", "q"])

    each = vecs.select("row_id", "v").mapInArrow(run, "key long, lo int, hi int, row_id long, q binary")
    side, top = F.when(F.col("hi") < 0, 1).otherwise(0), F.when(F.col("hi") < 0, -F.col("hi") - 1).otherwise(F.col("hi"))
    task = F.when((F.col("lo") == 0) & (F.col("hi") == 0), F.col("key")).otherwise(F.xxhash64("key", "lo", top))
    return each.select(task.alias("task"), "row_id", side.cast("tinyint").alias("side"), "q").repartition("task").sortWithinPartitions("task")


def possible_cosine(min_cos: float, dim: int) -> float:
    """Cosine of vectors in steps of 1/127 below which the floats never reach ``min_cos``."""
    return math.cos(min(math.pi, math.acos(min_cos) + 2 * math.asin(min(1.0, math.sqrt(dim) * 0.5 / 127))))


def _units(q: np.ndarray) -> np.ndarray:
    x = q.view(np.int8).astype(np.float32)
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


def bucket_pairs(vecs: DataFrame, coder, dim: int, min_cos: float, tile: int = 1024) -> DataFrame:
    """(a, b): distinct pairs a < b that share a bucket and whose quantised floats could reach ``min_cos``."""
    possible = possible_cosine(min_cos, dim) - 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b, held = [], [], 0

        def emit() -> pa.RecordBatch:
            pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for ids, side, q in V.sorted_groups(batches):
            x = _units(q)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            whole = not len(right)
            right = left if whole else right
            for i in range(0, len(left), tile):
                for j in range(i if whole else 0, len(right), tile):
                    near = x[left[i : i + tile]] @ x[right[j : j + tile]].T >= possible
                    u, v = np.nonzero(np.triu(near, 1) if whole and i == j else near)
                    if len(u):
                        u, v = ids[left[i + u]], ids[right[j + v]]
                        out_a.append(np.minimum(u, v))
                        out_b.append(np.maximum(u, v))
                        held += len(u)
            if held > 200_000:
                yield emit()
                out_a, out_b, held = [], [], 0
        if held:
            yield emit()

    return _bucket_rows(vecs, coder).mapInArrow(run, "a long, b long").distinct()


def _with_cosine(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """Add the exact cosine of each pair (a, b)."""
    va = vecs.select(F.col("row_id").alias("a"), F.col("v").alias("va"))
    vb = vecs.select(F.col("row_id").alias("b"), F.col("v").alias("vb"))
    j = pairs.join(va, "a").join(vb, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dim = len(batch.column(2)[0])
            cos = np.einsum("ij,ij->i", V.unit(V.matrix(batch.column(2), dim)), V.unit(V.matrix(batch.column(3), dim)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cos)], ["a", "b", "cosine"])

    return j.select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, cosine double")


def classes(vecs: DataFrame) -> DataFrame:
    """(row_id, v, rep, copies): each vector with the smallest row_id of its exact copies (128-bit hash of the values)."""
    keyed = vecs.withColumns({"_h": F.xxhash64("v"), "_g": F.xxhash64(F.lit(1), "v")})
    several = keyed.groupBy("_h", "_g").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    joined = keyed.join(materialise(several), ["_h", "_g"], "left")
    return joined.select("row_id", "v", F.coalesce("rep", "row_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))


def links(vecs: DataFrame, min_cos: float, dim: int) -> tuple[DataFrame, DataFrame]:
    """(row_id, v, rep, copies) of all vectors, and the pairs (a, b, cosine) of representatives of at least ``min_cos``."""
    spark = vecs.sparkSession
    members = materialise(classes(materialise(vecs.select("row_id", "v"))))
    reps = members.filter("row_id = rep").select("row_id", "v")
    coder = spark.sparkContext.broadcast(Coder(V.sample(reps, dim), dim, reps.count(), min_cos))
    found = materialise(bucket_pairs(reps, coder, dim, min_cos))
    return members, materialise(_with_cosine(found, reps).filter(F.col("cosine") >= min_cos))


def similar_pairs(vecs: DataFrame, min_cos: float, dim: int, expand: int = EXPAND_COPIES) -> DataFrame:
    """(row_id_a, row_id_b, cosine), a < b, of all pairs of at least ``min_cos``.

    Copies of one vector beyond ``expand`` are linked to their representative and stand for it otherwise;
    ``similar_classes`` has the class of every row.
    """
    members, found = links(vecs, min_cos, dim)
    several = materialise(members.filter("copies > 1").select("rep", "row_id", "copies"))
    shown = several.filter((F.col("copies") <= expand) | (F.col("row_id") == F.col("rep")))
    a = shown.select(F.col("rep").alias("a"), F.col("row_id").alias("ma"))
    b = shown.select(F.col("rep").alias("b"), F.col("row_id").alias("mb"))
    across = found.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"), "cosine")
    small = several.filter(F.col("copies") <= expand)
    same = small.select("rep", F.col("row_id").alias("x")).join(small.select("rep", F.col("row_id").alias("y")), "rep").filter("x < y").select("x", "y", F.lit(1.0).alias("cosine"))
    star = several.filter((F.col("copies") > expand) & (F.col("row_id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("row_id").alias("y"), F.lit(1.0).alias("cosine"))
    every = across.unionByName(same).unionByName(star)
    return every.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"), "cosine")


def similar_classes(vecs: DataFrame, min_cos: float, dim: int) -> DataFrame:
    """(row_id, class_id, copies, links): the smallest row_id of a row's exact copies, their number, and how many other classes reach ``min_cos`` with it."""
    members, found = links(vecs, min_cos, dim)
    n = found.select(F.col("a").alias("rep")).union(found.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.select("row_id", "rep", "copies").join(n, "rep", "left").select("row_id", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def bucket_nearest(vecs: DataFrame, coder, k: int, dim: int, spare: int = 4) -> DataFrame:
    """(a, b): per query row (``asked`` in (row_id, v, asked)) and bucket the ``k + spare`` most similar other rows on the quantised floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, side, q in V.sorted_groups(batches):
            x, asks = _units(q), np.flatnonzero(ids < 0)
            names = np.where(ids < 0, -ids - 1, ids)
            two = bool((side == 1).any())
            for i in range(0, len(asks), 512):
                rows = asks[i : i + 512]
                best_c, best_n = np.zeros((len(rows), 0), np.float32), np.zeros((len(rows), 0), np.int64)
                for j in range(0, len(ids), 4096):
                    c = x[rows] @ x[j : j + 4096].T
                    c[names[rows][:, None] == names[None, j : j + 4096]] = -2
                    if two:
                        c[side[rows][:, None] == side[None, j : j + 4096]] = -2
                    c, n = np.concatenate([best_c, c], axis=1), np.concatenate([best_n, np.broadcast_to(names[j : j + 4096], (len(rows), min(4096, len(ids) - j)))], axis=1)
                    top = min(k + spare, c.shape[1])
                    at = np.argpartition(-c, top - 1, axis=1)[:, :top]
                    best_c, best_n = np.take_along_axis(c, at, 1), np.take_along_axis(n, at, 1)
                of, at = np.nonzero(best_c > -2)
                if len(of):
                    yield pa.RecordBatch.from_arrays([pa.array(names[rows][of]), pa.array(best_n[of, at]), pa.array(best_c[of, at])], ["a", "b", "near"])

    # queries travel under -row_id - 1
    marked = vecs.select(F.when(F.col("asked"), -F.col("row_id") - 1).otherwise(F.col("row_id")).alias("row_id"), "v")
    found = _bucket_rows(marked, coder).mapInArrow(run, "a long, b long, near float").groupBy("a", "b").agg(F.max("near").alias("near"))
    w = Window.partitionBy("a").orderBy(F.desc("near"), "b")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + spare).select("a", "b")


def nearest(vecs: DataFrame, queries: DataFrame, k: int, dim: int, trust: float = 0.94, miss: float = 0.02) -> DataFrame:
    """(query_id, rank, row_id, cosine): the k most similar other vectors of each query row (row_id, v).

    The index answers queries whose k-th neighbour found has a cosine of at least ``trust``: it misses a nearer one with a
    chance of at most ``miss``. For the others the radius would make the probes outnumber the rows; they are compared
    with all rows, in blocks of at most ``QUERY_BLOCK`` queries, by matrix products. Row ids are not negative.
    """
    spark = vecs.sparkSession
    wanted = queries.select("row_id").distinct()
    vecs = materialise(vecs.select("row_id", "v").join(wanted.withColumn("asked", F.lit(True)), "row_id", "left").select("row_id", "v", F.coalesce("asked", F.lit(False)).alias("asked")))
    coder = spark.sparkContext.broadcast(Coder(V.sample(vecs, dim), dim, vecs.count(), trust, miss, False))
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    found = _with_cosine(materialise(bucket_nearest(vecs, coder, k, dim)), vecs).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    found = materialise(found)
    settled = found.filter((F.col("rank") == k) & (F.col("cosine") >= trust)).select("a")
    open_ = materialise(vecs.filter("asked").select("row_id", "v").join(settled.select(F.col("a").alias("row_id")), "row_id", "left_anti"))
    vecs = vecs.select("row_id", "v")
    blocks = max(1, -(-open_.count() // QUERY_BLOCK))
    loose, most = None, k + 4  # single precision orders the scan; the floats decide after it
    for block in range(blocks):
        part = open_ if blocks == 1 else open_.filter(F.pmod(F.xxhash64("row_id"), F.lit(blocks)) == block)
        rows = part.toArrow()
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast((rows.column(0).to_numpy(), V.unit(V.matrix(rows.column(1), dim)).astype(np.float32)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            best = np.full((len(qid), most), -2.0, np.float32)
            who = np.full((len(qid), most), -1, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column(0).to_numpy(), V.unit(V.matrix(batch.column(1), dim)).astype(np.float32)
                for at in range(0, len(ids), 2048):
                    sub, cand = ids[at : at + 2048], x[at : at + 2048]
                    for s in range(0, len(qid), 2048):
                        sim = q[s : s + 2048] @ cand.T
                        hit = np.flatnonzero((sim > best[s : s + 2048, -1:]).any(axis=1))
                        if not len(hit):
                            continue
                        sim = np.where(sub[None, :] == qid[s + hit][:, None], -2.0, sim[hit])
                        top = min(most, sim.shape[1])
                        cols = np.argpartition(-sim, top - 1, axis=1)[:, :top]
                        both = np.concatenate([best[s + hit], np.take_along_axis(sim, cols, 1)], axis=1)
                        names = np.concatenate([who[s + hit], sub[cols]], axis=1)
                        order = np.argsort(-both, axis=1, kind="stable")[:, :most]
                        best[s + hit], who[s + hit] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
            ok = best.ravel() > -2
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, most)[ok]), pa.array(who.ravel()[ok]), pa.array(best.ravel()[ok].astype(np.float64))], ["a", "b", "cosine"])

        scanned = vecs.mapInArrow(scan, "a long, b long, cosine double")
        loose = scanned if loose is None else loose.unionByName(scanned)
    out = found.join(settled, "a", "left_semi").select("a", "b", "cosine")
    if loose is not None:
        loose = loose.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("a", "b")
        out = out.unionByName(_with_cosine(materialise(loose), vecs))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("a").alias("query_id"), "rank", F.col("b").alias("row_id"), "cosine")
