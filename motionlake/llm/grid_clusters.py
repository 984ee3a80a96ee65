"""Grouping records into similarity clusters: grid density clustering over several grids.

Unit vectors are quantised (two steps per axis) on rotated axes, once per grid, so that a cell holds some tens of
unrelated rows. Within a cell rows are linked to the first row they reach (the quantised floats decide where they
can, the floats elsewhere); a cell with linked rows is dense and their number its density. Cells of different grids are
joined where they share rows; dense cells that differ in one axis are adjacent: those of sets that are still small are
joined where their first rows reach each other. Minimum labels are propagated over these links to convergence.

The number of axes follows the rows, the number of grids follows the axes: by simulation, as many as leave a smallest group
with all pairs at just the threshold less than half linked with a chance of at most ``MISS``. Half is enough, because
grids only propose: a row of each linked set is compared with all rows, and those that reach it are the cluster,
whether a grid linked them or not. A cluster counts as a group if it has enough rows, all its rows are
mutually similar and no other row reaches one of them. Rows beyond the sum of the angles of centre to farthest member and of
the threshold cannot reach; the others are compared with the members. All this is exact.

A cell that holds many rows (seen on a bounded sample, which only spreads the work) is split into parts by row_id, whose
first rows are joined like those of adjacent cells. Large clusters are compared in parts.

Defined results: unusable vectors take no part; exact copies are ordinary rows; a table with no group
gives no rows; ties in density go to the smaller row_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.llm import vectors as V
from motionlake.session import materialise

#: Unrelated rows a cell should hold, and the chance that a smallest group at just the threshold is less than half linked.
FILL, MISS, MOST_GRIDS = 64.0, 1e-3, 500
PART_ROWS, SEED_BLOCK, TILE = 8192, 20_000, 512
#: Slack of single precision in all comparisons with the threshold.
SLACK = 1e-6


def axes_for(n: int, dim: int) -> int:
    """Axes of a grid in which a cell holds about ``FILL`` of ``n`` unrelated rows."""
    return int(min(dim, 47, max(4, math.ceil(math.log2(max(n, 2) / FILL)))))


def seed_rows(least: int) -> int:
    """Rows of a group that have to be linked, so that it is found."""
    return max(2, -(-least // 2))


@lru_cache
def grids_needed(axes: int, all_pairs: float, least: int, draws: int = 4000) -> int:
    """Grids after which ``least`` rows at pairwise cosine ``all_pairs`` are less than half linked with a chance of at most ``MISS``."""
    rng = np.random.default_rng(7)
    share = max(all_pairs, 0.0)
    linked = np.broadcast_to(np.eye(least, dtype=bool), (draws, least, least)).copy()
    for grids in range(1, MOST_GRIDS):
        x = math.sqrt(share) * rng.standard_normal((draws, 1, axes), np.float32) + math.sqrt(1 - share) * rng.standard_normal((draws, least, axes), np.float32)
        cells = V.pack((x > 0).reshape(-1, axes)).reshape(draws, least)
        linked |= cells[:, :, None] == cells[:, None, :]
        reach = linked.astype(np.float32)
        for _ in range(max(1, math.ceil(math.log2(least)))):
            reach = np.minimum(reach @ reach, 1)
        if (reach.sum(axis=2).max(axis=1) < seed_rows(least)).mean() <= MISS:
            return grids
    return MOST_GRIDS


class Grids:
    """Rotations and cells; and, from a sample, into how many parts the cells with very many rows are split."""

    def __init__(self, dim: int, axes: int, grids: int, sample: np.ndarray, n: int):
        self.dim, self.axes = dim, axes
        self.rotations = [V.learn_rotation(np.zeros((0, dim)), dim, 100 + g)[:, :axes] for g in range(grids)]
        self.hot: dict[int, int] = {}
        for g in range(grids if n > PART_ROWS else 0):
            cells, rows = np.unique(self.cells(sample, g), return_counts=True)
            parts = np.ceil(rows * (n / max(len(sample), 1)) / PART_ROWS).astype(int)
            self.hot |= dict(zip(cells[(parts > 1) & (rows > 2)].tolist(), parts[(parts > 1) & (rows > 2)].tolist()))

    def cells(self, x: np.ndarray, g: int) -> np.ndarray:
        return V.pack(x @ self.rotations[g] > 0) | (g << 48)

    def parts(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The part of each row's cell, -1 where the cell is whole."""
        out = np.full(len(cells), -1, np.int32)
        if self.hot:
            for c in set(cells.tolist()) & set(self.hot):
                at = np.flatnonzero(cells == c)
                mixed = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                out[at] = (mixed % np.uint64(self.hot[c])).astype(np.int32)
        return out


def cell_rows(vecs: DataFrame, grids) -> DataFrame:
    """(task, cell, part, row_id, q): one row per vector and grid; ``q`` is the unit vector in steps of 1/127."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = grids.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), V.unit(V.matrix(batch.column(1), made.dim))
            q = V.binary(np.round(x * 127).astype(np.int8))
            for g in range(len(made.rotations)):
                cells = made.cells(x, g)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(made.parts(cells, ids)), batch.column(0), q], ["cell", "part", "row_id", "q"])

    each = vecs.select("row_id", "v").mapInArrow(run, "cell long, part int, row_id long, q binary")
    return each.select(F.when(F.col("part") < 0, F.col("cell")).otherwise(F.xxhash64("cell", "part")).alias("task"), "cell", "part", "row_id", "q")


def sure_and_possible(all_pairs: float, dim: int) -> tuple[float, float]:
    """Cosines of vectors in steps of 1/127 from which the floats surely, and below which they never, reach ``all_pairs``."""
    slip = 2 * math.asin(min(1.0, math.sqrt(dim) * 0.5 / 127))
    angle = math.acos(all_pairs)
    return math.cos(max(angle - slip, 0.0)), math.cos(min(angle + slip, math.pi))


def first_reached(x: np.ndarray, possible: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row the first row it perhaps reaches (itself without one before it) and the cosine to that."""
    label, cosine = np.arange(len(x)), np.ones(len(x), np.float32)
    firsts = np.zeros(0, np.int64)
    for i in range(0, len(x), TILE):
        rows = np.arange(i, min(i + TILE, len(x)))
        for j in range(0, len(firsts), 4 * TILE):
            some = firsts[j : j + 4 * TILE]
            c = x[rows] @ x[some].T
            hit = c >= possible
            got = hit.any(axis=1)
            if not got.any():
                continue
            to = hit.argmax(axis=1)[got]
            label[rows[got]], cosine[rows[got]] = some[to], c[got, to]
            rows = rows[~got]
        if not len(rows):
            continue
        c = x[rows] @ x[rows].T
        np.fill_diagonal(c, 1.0)
        to = (c >= possible).argmax(axis=1)
        label[rows], cosine[rows] = rows[to], c[np.arange(len(rows)), to]
        firsts = np.concatenate([firsts, rows[to == np.arange(len(rows))]])
    return label, cosine


def links(cells: DataFrame, dim: int, all_pairs: float) -> DataFrame:
    """(cell, part, row_id, rep, n, sure): linked rows with the first row they surely or perhaps reach in their cell, and how many reach it."""
    sure, possible = sure_and_possible(all_pairs, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["cell", "part", "row_id", "rep", "n", "sure"])

        for cell, part, ids, q in V.sorted_groups(batches):
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order].astype(np.int64), q[order].view(np.int8).astype(np.float32)
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            label, cosine = first_reached(x, possible)
            n = np.bincount(label, minlength=len(ids))[label]
            keep = n >= 2
            if not keep.any():
                continue
            own = label[keep] == np.flatnonzero(keep)
            held.append((cell[keep], part[keep], ids[keep], ids[label[keep]], n[keep], own | (cosine[keep] >= sure)))
            rows += int(keep.sum())
            if rows > 100_000:
                yield taken()
                held.clear()
                rows = 0
        if held:
            yield taken()

    return cells.repartition("task").sortWithinPartitions("task").mapInArrow(run, "cell long, part int, row_id long, rep long, n long, sure boolean")


def verified(pairs: DataFrame, vecs: DataFrame, dim: int, all_pairs: float) -> DataFrame:
    """The pairs (row_id, rep) whose floats reach ``all_pairs``."""
    both = pairs.join(vecs, "row_id").join(vecs.select(F.col("row_id").alias("rep"), F.col("v").alias("w")), "rep").select("row_id", "rep", "v", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, w = (V.unit(V.matrix(b.column(i), dim)) for i in (2, 3))
                yield b.select(["row_id", "rep"]).filter(pa.array((v * w).sum(axis=1) >= all_pairs - SLACK))

    return both.mapInArrow(run, "row_id long, rep long")


def adjacent(found: DataFrame, rows: DataFrame, axes: int, least: int) -> DataFrame:
    """(row_id, rep): first rows of dense cells that differ in one axis, and of the parts of one cell.

    Only sets (row_id, label) that are not half linked yet need their neighbours; the others are compared with all rows anyway."""
    small = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < seed_rows(least)).select("label")
    small = rows.join(small, "label", "left_semi").select(F.col("row_id").alias("rep"))
    firsts = materialise(found.filter("row_id = rep").select("cell", "part", "rep", "n").join(small, "rep", "left_semi"))
    dense = firsts.groupBy("cell").agg(F.max_by("rep", F.struct("n", -F.col("rep"))).alias("rep"))
    axis = F.explode(F.sequence(F.lit(0), F.lit(axes - 1)))
    each = dense.select("cell", "rep", axis.alias("axis")).select(F.col("cell").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("axis")))).alias("key"), "axis", "rep")
    sides = each.groupBy("key", "axis").agg(F.min("rep").alias("row_id"), F.max("rep").alias("rep")).filter("row_id <> rep").select("row_id", "rep")
    parts = firsts.filter("part >= 0").select("cell", F.col("rep").alias("row_id")).join(dense, "cell").filter("row_id <> rep").select("row_id", "rep")
    return sides.union(parts).distinct()


def propagated(pairs: DataFrame) -> DataFrame:
    """(row_id, label) of the linked pairs (row_id, rep): the smallest row reachable."""
    first = materialise(pairs.groupBy("row_id").agg(F.min("rep").alias("home")))
    labels = V.components(pairs.join(first, "row_id").select(F.col("home").alias("a"), F.col("rep").alias("b")))
    return first.join(labels, first["home"] == labels["node"], "left").select("row_id", F.coalesce("label", "home").alias("label"))


def labelled(vecs: DataFrame, dim: int, all_pairs: float, least: int, grids: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(row_id, label) of the linked rows with the smallest label reached, and (row_id, density), the density of their densest cell.

    Only links that hold on the floats are followed; a row with none that hold is a set of its own."""
    n = vecs.count()
    axes = axes_for(n, dim)
    made = vecs.sparkSession.sparkContext.broadcast(Grids(dim, axes, grids or grids_needed(axes, all_pairs, least), V.sample(vecs, dim) if n > PART_ROWS else np.zeros((0, dim)), n))
    found = materialise(links(cell_rows(vecs, made), dim, all_pairs))
    # a row with a sure link to another needs no more; first rows link to themselves
    settled = found.filter("sure AND row_id <> rep").select("row_id").distinct()
    doubtful = materialise(found.filter("NOT sure").select("row_id", "rep").distinct().join(settled, "row_id", "left_anti"))
    true = materialise(verified(doubtful, vecs, dim, all_pairs))
    alone = doubtful.select("row_id", F.col("row_id").alias("rep"))
    pairs = materialise(found.filter("sure").select("row_id", "rep").union(true).union(true.select("rep", "rep")).union(alone).distinct())
    rows = materialise(propagated(pairs))
    # adjacent dense cells matter only where their labels differ still
    ends = adjacent(found, rows, axes, least).join(rows.withColumnRenamed("label", "a"), "row_id").join(rows.select(F.col("row_id").alias("rep"), F.col("label").alias("b")), "rep")
    apart = ends.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("row_id", "rep")).alias("p"))
    apart = materialise(apart.select("a", "b", "p.row_id", "p.rep"))
    if not apart.isEmpty():
        held = verified(apart.select("row_id", "rep"), vecs, dim, all_pairs)
        joined = V.components(apart.join(held, ["row_id", "rep"]).select("a", "b"))
        rows = materialise(rows.join(joined.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("row_id", F.coalesce("least", "label").alias("label")))
    return rows, found.groupBy("row_id").agg(F.max("n").alias("density"))


def reached(vecs: DataFrame, seeds: DataFrame, dim: int, with_vector: bool = False) -> DataFrame:
    """(label, row_id, cosine[, x]): the rows of at least cosine ``least`` to each seed (label, x, least); all rows against all seeds."""
    spark = vecs.sparkSession
    blocks = max(1, -(-seeds.count() // SEED_BLOCK))
    schema = "label long, row_id long, cosine double" + (", x binary" if with_vector else "")
    names = ["label", "row_id", "cosine"] + (["x"] if with_vector else [])
    out = None
    for block in range(blocks):
        part = seeds if blocks == 1 else seeds.filter(F.pmod(F.xxhash64("label"), F.lit(blocks)) == block)
        t = part.select("label", "least", "x").toArrow()
        shared = spark.sparkContext.broadcast((t.column(0).to_numpy(), t.column(1).to_numpy().astype(np.float32), V.floats(t.column(2), dim)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            labels, low, centres = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = batch.column(0).to_numpy(), V.unit(V.matrix(batch.column(1), dim)).astype(np.float32)
                for i in range(0, len(x), 1024):
                    for j in range(0, len(labels), 2048):
                        c = x[i : i + 1024] @ centres[j : j + 2048].T
                        at, of = np.nonzero(c >= low[j : j + 2048])
                        if len(at):
                            cols = [pa.array(labels[j + of]), pa.array(ids[i + at]), pa.array(c[at, of].astype(np.float64))]
                            yield pa.RecordBatch.from_arrays(cols + ([V.binary(x[i + at])] if with_vector else []), names)

        found = vecs.select("row_id", "v").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def tight_groups(hits: DataFrame, sizes: DataFrame, dim: int, all_pairs: float) -> DataFrame:
    """(label, size, centre, far): clusters (label, row_id, x) in which any two reach ``all_pairs``; the direction of the
    mean and the cosine of the farthest row to it (null for clusters compared in parts). ``sizes`` is (label, size)."""
    full = hits.join(sizes, "label").select("label", "size", "row_id", "x")
    parts = F.ceil(F.col("size") / PART_ROWS).cast("int")
    full = full.withColumns({"parts": parts}).withColumn("own", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    tasks = full.select(F.xxhash64("label", lo, hi).alias("task"), "label", F.when((F.col("own") == hi) & (lo != hi), 1).otherwise(0).alias("side"), "parts", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, side, parts, raw in V.sorted_groups(batches, 1):
            x = np.ascontiguousarray(raw).view(np.float32).reshape(len(label), dim)
            a, b = x[side == 0], x[side == 1]
            if not len(b):
                b = a
            lowest = min(float((a[i : i + 1024] @ b[j : j + 1024].T).min()) for i in range(0, len(a), 1024) for j in range(0, len(b), 1024))
            centre, far = None, None
            if parts[0] == 1:
                mean = x.astype(np.float64).sum(axis=0)
                mean = (mean / np.linalg.norm(mean)).astype(np.float32)
                centre, far = mean.tobytes(), float((x @ mean).min())
            yield pa.RecordBatch.from_arrays([pa.array([int(label[0])]), pa.array([lowest]), pa.array([centre], pa.binary()), pa.array([far], pa.float64())], ["label", "lowest", "centre", "far"])

    lowest = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(run, "label long, lowest double, centre binary, far double")
    tight = lowest.groupBy("label").agg(F.min("lowest").alias("lowest"), F.first("centre").alias("centre"), F.first("far").alias("far")).filter(F.col("lowest") >= all_pairs - SLACK)
    return tight.join(sizes, "label").select("label", "size", "centre", "far")


def open_groups(members: DataFrame, outside: DataFrame, dim: int, all_pairs: float) -> DataFrame:
    """(label) of the groups in which an outside row reaches a member; both sides are (label, row_id, x)."""

    def parted(rows: DataFrame, side: int) -> DataFrame:
        size = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias(f"parts{side}"))
        return rows.join(size, "label").withColumn(f"part{side}", F.pmod(F.xxhash64("row_id"), F.col(f"parts{side}")).cast("int"))

    members = members.join(outside.select("label").distinct(), "label", "left_semi")
    a, b = parted(members, 0), parted(outside, 1)
    many_a, many_b = a.select("label", "parts0").distinct(), b.select("label", "parts1").distinct()
    a = a.join(many_b, "label").withColumn("part1", F.explode(F.sequence(F.lit(0), F.col("parts1") - 1)))
    b = b.join(many_a, "label").withColumn("part0", F.explode(F.sequence(F.lit(0), F.col("parts0") - 1)))
    sided = lambda d, side: d.select(F.xxhash64("label", "part0", "part1").alias("task"), "label", F.lit(side).alias("side"), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, side, raw in V.sorted_groups(batches):
            x = np.ascontiguousarray(raw).view(np.float32).reshape(len(label), dim)
            a, b = x[side == 0], x[side == 1]
            if any((a[i : i + 1024] @ b[j : j + 1024].T >= all_pairs - SLACK).any() for i in range(0, len(a), 1024) for j in range(0, len(b), 1024)):
                yield pa.RecordBatch.from_arrays([pa.array([int(label[0])])], ["label"])

    return sided(a, 0).union(sided(b, 1)).repartition("task").sortWithinPartitions("task").mapInArrow(run, "label long").distinct()


def cluster(vecs: DataFrame, dim: int, all_pairs: float = 0.87, least: int = 8, grids: int | None = None) -> DataFrame:
    """(cluster_row_id, row_id, size, density): one row per member of every tight group that no other row reaches."""
    vecs = materialise(vecs.select("row_id", "v"))
    rows, density = labelled(vecs, dim, all_pairs, least, grids)
    sets = rows.groupBy("label").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= seed_rows(least))
    enough = all_pairs - SLACK
    seeds = materialise(V.as_floats(sets.join(vecs, "row_id").select(F.col("row_id").alias("label"), "v"), "label", dim).withColumn("least", F.lit(enough)))
    hits = materialise(reached(vecs, seeds, dim, True))
    clusters = hits.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("row_id").alias("cluster_row_id"), F.min("cosine").alias("farthest")).filter(F.col("size") >= least)
    # all seeds of a closed group reach the same rows, so of clusters with one first row any will do
    clusters = materialise(clusters.groupBy("cluster_row_id").agg(F.min_by(F.struct("label", "size", "farthest"), "label").alias("c")).select("cluster_row_id", "c.*"))
    inside = materialise(hits.join(clusters.select("label"), "label", "left_semi").select("label", "row_id", "x"))
    groups = materialise(tight_groups(inside, clusters.select("label", "size"), dim, all_pairs).join(clusters.select("label", "cluster_row_id", "farthest"), "label").join(seeds.select("label", "x"), "label"))
    angle = F.acos(F.least(F.coalesce("far", "farthest"), F.lit(1.0))) + math.acos(enough)
    around = groups.select("label", F.coalesce("centre", "x").alias("x"), (F.cos(F.least(angle, F.lit(math.pi))) - SLACK).alias("least"))
    outside = reached(vecs, materialise(around), dim).select("label", "row_id").join(inside.select("label", "row_id"), ["label", "row_id"], "left_anti")
    outside = V.as_floats(materialise(outside).join(vecs, "row_id").select("row_id", "label", "v"), "row_id", dim, "label")
    closed = groups.join(open_groups(inside, materialise(outside), dim, all_pairs), "label", "left_anti").select("label", "size", "cluster_row_id")
    members = inside.select("label", "row_id").join(closed, "label").join(density, "row_id", "left")
    return members.select("cluster_row_id", "row_id", "size", F.coalesce("density", F.lit(1)).alias("density"))


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_row_id, size, typical): size and the row_ids of members of the densest cell."""
    best = members.groupBy("cluster_row_id").agg(F.max("density").alias("density"), F.first("size").alias("size"))
    dense = members.select("cluster_row_id", "row_id", "density").join(best, ["cluster_row_id", "density"])
    ranked = dense.withColumn("k", F.row_number().over(Window.partitionBy("cluster_row_id").orderBy("row_id"))).filter(F.col("k") <= typical)
    return ranked.groupBy("cluster_row_id").agg(F.first("size").alias("size"), F.sort_array(F.collect_list("row_id")).alias("typical"))
