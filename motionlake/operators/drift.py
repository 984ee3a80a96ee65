"""Schemas that drift between files: detect added, removed, renamed and retyped fields, and unify.

Every field of every file gets its type from exact counts per lexical kind. Fields whose header text a
neighbouring file of the feed lacks get a value sketch besides: a histogram of the numeric part over
logarithmic bins (relative error ``BIN`` / 2) with counts, missing cells and rises from line to line. Sketches
are counts, so partial ones made per batch add up in one hash aggregation, however large a file is.

Fields that vanish and fields that appear between a file and the one before it in its feed are matched by
minimum-cost bipartite assignment. The score of a pair weighs value sketch, name, place among the fields that stay and
type; values that differ forbid a match whatever the names say, and alike values carry one whatever the names
say. A point that vanishes as a whole may come back under another name, if quantity and values agree. Rename
links are then followed back by pointer jumping, so that every field gets the name it had first.

Defined results: files without a header line take no part; a file without a line that parses has its header's
fields, all of the narrowest kind (``long``), as has a field without any value; a null feed is a feed of its own;
files written at the same time are ordered by file_id; of fields with equal names in a file the first counts; an
empty input gives empty outputs. Extra input columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motionlake.functions.assignment import assign
from motionlake.functions.chunked import null_safe_join
from motionlake.operators import rejects
from motionlake.session import discard, materialise

WHOLE = r"^[+-]?[0-9]+$"
NUMERIC_PART = re.compile(r"([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*(%?)")
#: Header words known to mean the same quantity; empty unless the caller knows the feed.
SYNONYMS: tuple[tuple[str, ...], ...] = ()
#: Width of a bin of the value sketch in natural logarithms; magnitudes below TINY count as 0.
BIN, TINY = 0.02, 1e-12
#: Shares of a pair's score, the least score of a match, the least similarity of known values, and the share of rising steps of a counter.
SKETCH_WEIGHT, NAME_WEIGHT, PLACE_WEIGHT, TYPE_WEIGHT = 0.55, 0.2, 0.15, 0.1
MATCH_LEAST, VALUES_LEAST, RISING = 0.4, 0.3, 0.9
PART = "file_id long, pos int, n long, n_long long, n_num long, n_cells long, steps long, rises long, bin int, count long"


def bins_of(v: np.ndarray) -> np.ndarray:
    """Signed logarithmic bin of each value; 0 for magnitudes below ``TINY``."""
    size = np.abs(v)
    b = np.round(np.log(np.maximum(size, TINY) / TINY) / BIN).astype(np.int64) + 1
    return np.where(size < TINY, 0, np.where(v < 0, -b, b)).astype(np.int32)


def value_of(b: np.ndarray) -> np.ndarray:
    return np.where(b == 0, 0.0, np.sign(b) * TINY * np.exp((np.abs(b) - 1) * BIN))


def numeric_part(text: str) -> float:
    """The first number in a text (NaN without one); a percent sign divides by 100."""
    m = NUMERIC_PART.search(text)
    return float(m[1]) / (100 if m[2] else 1) if m else math.nan


def _numbers(col: pa.Array, is_num: pa.Array) -> np.ndarray:
    out = pc.cast(pc.if_else(is_num, col, pa.scalar(None, pa.string())), pa.float64()).to_numpy(zero_copy_only=False).copy()
    rest = pc.and_(pc.is_valid(col), pc.invert(pc.fill_null(is_num, False)))
    at = np.flatnonzero(rest.to_numpy(zero_copy_only=False))
    if len(at):
        coded = col.take(pa.array(at)).dictionary_encode()
        each = np.array([numeric_part(t) for t in coded.dictionary.to_pylist()])
        out[at] = each[coded.indices.to_numpy(zero_copy_only=False)]
    out[~(np.abs(out) < 1e300)] = np.nan
    return out


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial profiles of the fields of each file: a row of counts (bin null) and one per filled bin of sketched fields."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file_id, line_no = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("file_id", "line_no"))
        marks = batch.column(batch.schema.names.index("sketched"))
        rows: list[np.ndarray] = []
        for j in rejects.judged(batch):
            if not len(j.at):
                continue
            order = np.lexsort((line_no[j.at], file_id[j.at]))
            at, take = j.at[order], pa.array(order)
            files, first, code = np.unique(file_id[at], return_index=True, return_inverse=True)
            sketched = pc.fill_null(marks.take(pa.array(at[first])), "").to_pylist()
            for k, c in enumerate(j.columns):
                c = c.take(take)
                c = pc.if_else(pc.is_in(pc.ascii_lower(c), pa.array(["", "na", "nan"])), pa.scalar(None, pa.string()), c)
                is_num = pc.match_substring_regex(c, rejects.NUMBER)
                tests = [pc.is_valid(c), pc.fill_null(pc.match_substring_regex(c, WHOLE), False), pc.fill_null(is_num, False)]
                counts = [np.bincount(code, t.to_numpy(zero_copy_only=False), len(files)) for t in tests] + [np.bincount(code, minlength=len(files))]
                steps = rises = np.zeros(len(files))
                wanted = np.array([m[k : k + 1] == "1" for m in sketched])
                if wanted.any():
                    v = _numbers(c, is_num)
                    known = np.flatnonzero(wanted[code] & np.isfinite(v))
                    v, of = v[known], code[known]
                    on = np.r_[False, of[1:] == of[:-1]] if len(of) else np.zeros(0, bool)
                    steps = np.bincount(of, on, len(files))
                    rises = np.bincount(of, on & np.r_[False, v[1:] > v[:-1]] if len(of) else on, len(files))
                    cells, n = np.unique(np.stack([of, bins_of(v)]), axis=1, return_counts=True)
                    rows.append(np.stack([files[cells[0]], np.full(len(n), k), *np.zeros((6, len(n)), np.int64), cells[1], n]))
                rows.append(np.stack([files, np.full(len(files), k), *(x.astype(np.int64) for x in (*counts, steps, rises)), np.full(len(files), 1 << 30), np.zeros(len(files), np.int64)]))
        if not rows:
            continue
        t = np.concatenate([r.astype(np.int64) for r in rows], axis=1)
        cols = [pa.array(t[i]) for i in range(10)]
        cols[1] = pa.array(t[1].astype(np.int32))
        cols[8] = pa.array(t[8].astype(np.int32), mask=t[8] == 1 << 30)
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PART.split(", ")])


def all_headers(tables: dict[str, DataFrame]) -> DataFrame:
    """(file_id, names, width, likelihood, table) of the files of all raw tables (by layout)."""
    parts = [rejects.headers(t, layout).select("file_id", "names", "width", "likelihood", F.lit(layout).alias("table")) for layout, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def chain(heads: DataFrame, files: DataFrame) -> DataFrame:
    """Headers with (layout, feed, prev_file_id, seq, sketched): the file before it in its feed, and a 0/1 mask of the
    fields that the file before or after lacks."""
    w = Window.partitionBy("layout", "feed").orderBy("written_at", "file_id")
    d = files.select("file_id", "layout", "feed", "written_at").join(heads, "file_id")
    d = d.withColumns({"prev_file_id": F.lag("file_id").over(w), "seq": F.row_number().over(w) - 1, "_before": F.lag("names").over(w), "_after": F.lead("names").over(w)})
    moved = F.transform("names", lambda n: F.when(F.coalesce(~F.array_contains("_before", n), F.lit(False)) | F.coalesce(~F.array_contains("_after", n), F.lit(False)), F.lit("1")).otherwise(F.lit("0")))
    return d.withColumn("sketched", F.concat_ws("", moved)).drop("_before", "_after", "written_at")


def profile_fields(tables: dict[str, DataFrame], chained: DataFrame) -> DataFrame:
    """(file_id, pos, n, n_long, n_num, n_cells, steps, rises, sketch) of every field that has lines that parse."""
    parts = []
    for layout, lines in tables.items():
        heads = chained.filter(F.col("table") == layout).select("file_id", "width", "likelihood", "sketched")
        data = rejects.lines_with_headers(lines.select("file_id", "line_no", "line"), layout, heads)
        parts.append(data.select("file_id", "line_no", "line", "quoted_ok", "width", "likelihood", "first_digits", "judge_values", "sketched").mapInArrow(_profiles, PART))
    p = reduce(DataFrame.unionByName, parts).groupBy("file_id", "pos", "bin")
    counts = ("n", "n_long", "n_num", "n_cells", "steps", "rises")
    p = p.agg(*[F.sum(c).alias(c) for c in (*counts, "count")])
    sketch = F.sort_array(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "count"))))
    return p.groupBy("file_id", "pos").agg(*[F.sum(c).alias(c) for c in counts], sketch.alias("sketch"))


def file_versions(tables: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """One row per file with a header: (layout, feed, file_id, prev_file_id, seq, fields in header order)."""
    chained = materialise(chain(all_headers(tables), files))
    profiles = profile_fields(tables, chained)
    named = chained.select("file_id", F.posexplode("names").alias("pos", "field"))
    first = named.groupBy("file_id", "field").agg(F.min("pos").alias("pos"))
    kind = F.when(F.coalesce(F.col("n_long") == F.col("n"), F.lit(True)), "long").when(F.col("n_num") == F.col("n"), "double").otherwise("string")
    f = first.join(profiles, ["file_id", "pos"], "left").select("file_id", F.struct("pos", "field", kind.alias("kind"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_cells", "steps", "rises")], "sketch").alias("f"))
    f = f.groupBy("file_id").agg(F.sort_array(F.collect_list("f")).alias("fields"))
    return chained.select("layout", "feed", "file_id", "prev_file_id", "seq").join(f, "file_id")


def _words(name: str, points: set[str]) -> tuple[str, str]:
    """Point and quantity of a field name; the point is '' where there is none."""
    head, dot, tail = name.rpartition(".")
    if dot:
        return head.lower(), tail.lower()
    for sep in ("_", "-", " "):
        head, got, tail = name.partition(sep)
        if got and head.lower() in points:
            return head.lower(), tail.lower()
    return "", name.lower()


def _name_similarity(a: str, b: str, synonyms) -> float:
    a, b = (re.sub(r"[^a-z0-9]", "", x) for x in (a, b))
    if a == b or any(a in g and b in g for g in synonyms):
        return 1.0
    grams = [{x[i : i + 2] for i in range(len(x) - 1)} or {x} for x in (a, b)]
    return 2 * len(grams[0] & grams[1]) / (len(grams[0]) + len(grams[1]))


def _rising(f) -> bool:
    return f["steps"] >= 2 and f["rises"] > RISING * f["steps"]


def quantiles(sketch) -> np.ndarray | None:
    """Five quantiles of a sketch's values, None without values."""
    s = [] if sketch is None else list(sketch)
    if not s:
        return None
    b, n = np.array([x["bin"] for x in s]), np.array([x["count"] for x in s], float)
    return value_of(b)[np.searchsorted(np.cumsum(n) / n.sum(), (0.05, 0.25, 0.5, 0.75, 0.95))]


def value_similarity(a, b) -> float | None:
    """How alike the values of two fields are, in [0, 1]; None where one of them has no numbers.

    Counters are alike whatever their values; shares in [0, 1] and the same in hundredths count nine tenths."""
    rises = _rising(a), _rising(b)
    qa, qb = quantiles(a["sketch"]), quantiles(b["sketch"])
    if qa is None or qb is None:
        return None
    if all(rises):
        return 1.0
    if any(rises) and min(a["steps"], b["steps"]) >= 8:  # fewer steps may all rise by chance
        return 0.0

    def alike(p: np.ndarray, q: np.ndarray) -> float:
        width = max(p[4] - p[0], q[4] - q[0], 1e-9 + 0.1 * max(abs(p[2]), abs(q[2])))
        return math.exp(-float(np.abs(p - q).mean()) / width)

    scaled = [0.9 * alike(100 * p, q) for p, q in ((qa, qb), (qb, qa)) if 0 <= p[0] and p[4] <= 1 + 2 * BIN]  # up to the error of a bin
    return max(alike(qa, qb), *scaled, 0.0)


def match_fields(before: list[dict], after: list[dict], synonyms=SYNONYMS) -> list[tuple[str, str, str]]:
    """Changes between two versions: (change_kind, name before or None, name after or None)."""
    old, new = {f["field"]: f for f in before}, {f["field"]: f for f in after}
    gone, come = [f for f in old if f not in new], [f for f in new if f not in old]
    points = {n.rpartition(".")[0].lower() for n in (*old, *new) if "." in n}
    word = {n: _words(n, points) for n in (*old, *new)}
    of_old, of_new = ({word[n][0] for n in names} for names in (old, new))

    def beside(names: list[str], stays) -> dict[str, tuple]:
        """The nearest field before and after that stays."""
        out = {}
        for i, n in enumerate(names):
            out[n] = (next((x for x in names[i - 1 :: -1] if x in stays), None) if i else None, next((x for x in names[i + 1 :] if x in stays), None))
        return out

    place_old, place_new = beside(list(old), new), beside(list(new), old)
    score = np.zeros((len(gone), len(come)))
    for i, a in enumerate(gone):
        (pa_, qa) = word[a]
        for j, b in enumerate(come):
            (pb, qb) = word[b]
            name, values = _name_similarity(qa, qb, synonyms), value_similarity(old[a], new[b])
            if values is not None and values < VALUES_LEAST:
                continue
            if pa_ != pb and not (pa_ and pb and pa_ not in of_new and pb not in of_old and name == 1.0):
                continue
            # unrelated extras without a point may well hold alike numbers: there, only a counter needs no name
            if not pa_ and name < 0.5 and not (_rising(old[a]) and _rising(new[b])):
                continue
            place = sum(x == y for x, y in zip(place_old[a], place_new[b])) / 2
            if values is None:  # one side has no numbers: name and place have to speak
                values = 0.5 * max(name, place)
            score[i, j] = SKETCH_WEIGHT * values + NAME_WEIGHT * name + PLACE_WEIGHT * place + TYPE_WEIGHT * (old[a]["kind"] == new[b]["kind"])
    # every field may also stay alone, at the price of the least acceptable score
    cost = np.full((len(gone), len(come) + len(gone)), 0.0)
    cost[:, : len(come)] = np.where(score >= MATCH_LEAST, MATCH_LEAST - score, np.inf)
    pairs = {gone[i]: come[j] for i, j in assign(cost) if j < len(come)}
    out = [("renamed", a, b) for a, b in pairs.items()]
    out += [("removed", a, None) for a in gone if a not in pairs]
    out += [("added", None, b) for b in come if b not in pairs.values()]
    kept = pairs | {f: f for f in old if f in new}
    return out + [("retyped", a, b) for a, b in kept.items() if old[a]["kind"] != new[b]["kind"]]


def changes(versions: DataFrame, synonyms=SYNONYMS) -> DataFrame:
    """(file_id, prev_file_id, change_kind, old_name, new_name) for each file against its predecessor."""
    prev = versions.select(F.col("file_id").alias("prev_file_id"), F.col("fields").alias("before"))
    pairs = versions.select("file_id", "prev_file_id", F.col("fields").alias("after")).join(prev, "prev_file_id")
    look = lambda c: F.array_sort(F.transform(c, lambda f: F.struct(f["field"], f["kind"])))
    pairs = pairs.filter(look("before") != look("after"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(f, p, *c) for f, p, b, a in zip(pdf["file_id"], pdf["prev_file_id"], pdf["before"], pdf["after"]) for c in match_fields(list(b), list(a), synonyms)]
            yield pd.DataFrame(rows, columns=["file_id", "prev_file_id", "change_kind", "old_name", "new_name"])

    return pairs.select("file_id", "prev_file_id", "before", "after").mapInPandas(run, "file_id long, prev_file_id long, change_kind string, old_name string, new_name string")


def report(found: DataFrame) -> DataFrame:
    return found.select("file_id", F.coalesce("new_name", "old_name").alias("field_name"), "change_kind")


def field_kinds(versions: DataFrame) -> DataFrame:
    """(file_id, field_name, kind) of every field of every file."""
    return versions.select("file_id", F.explode("fields").alias("f")).select("file_id", F.col("f.field").alias("field_name"), F.col("f.kind").alias("kind"))


def canonical_names(versions: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, field, canonical): the name under which the field first appeared in its feed.

    Nodes are (file, name) of renamed or newly named fields only; a node points to the name's last
    (re)naming before the rename. Pointers are doubled until nothing changes, so the rounds grow
    with the logarithm of the longest rename chain.
    """
    place = versions.select("file_id", "layout", "feed", "seq")
    starts = null_safe_join(found.filter(F.col("change_kind").isin("renamed", "added")).select("file_id", F.col("new_name").alias("field"), F.when(F.col("change_kind") == "renamed", F.col("old_name")).alias("from_name")), place, ["file_id"], "inner")
    firsts = versions.filter(F.col("prev_file_id").isNull()).select("file_id", F.explode("fields.field").alias("field"), F.lit(None).cast("string").alias("from_name"), "layout", "feed", "seq")
    seg = materialise(starts.unionByName(firsts))
    # ends of a naming: the next start of the same name in the feed
    w = Window.partitionBy("layout", "feed", "field").orderBy("seq")
    seg = seg.withColumn("until", F.coalesce(F.lead("seq").over(w), F.lit(2**31 - 1)))
    node = seg.select("layout", "feed", F.col("field").alias("from_name"), F.col("seq").alias("p_seq"), F.col("until").alias("p_until"))
    named = seg.filter(F.col("from_name").isNotNull())
    linked = null_safe_join(named, node, ["layout", "feed", "from_name"], "left").filter((F.col("p_seq") < F.col("seq")) & (F.col("p_until") >= F.col("seq")))
    roots = seg.filter(F.col("from_name").isNull()).select("layout", "feed", "field", "seq", "until", F.col("field").alias("root"), F.col("seq").alias("root_seq"))
    ptr = materialise(roots.unionByName(linked.select("layout", "feed", "field", "seq", "until", F.col("from_name").alias("root"), F.col("p_seq").alias("root_seq"))))
    while True:
        up = ptr.select("layout", "feed", F.col("field").alias("root"), F.col("seq").alias("root_seq"), F.col("root").alias("up"), F.col("root_seq").alias("up_seq"))
        jumped = null_safe_join(ptr, up, ["layout", "feed", "root", "root_seq"], "left")
        jumped = jumped.withColumns({"moved": F.coalesce((F.col("up_seq") != F.col("root_seq")) | (F.col("up") != F.col("root")), F.lit(False)), "root": F.coalesce("up", "root"), "root_seq": F.coalesce("up_seq", "root_seq")}).drop("up", "up_seq")
        last, ptr = ptr, materialise(jumped)
        discard(last)
        if ptr.filter("moved").isEmpty():
            break
        ptr = ptr.drop("moved")
    fields = versions.select("file_id", "layout", "feed", F.col("seq").alias("at"), F.explode("fields.field").alias("field"))
    named = null_safe_join(fields, ptr.select("layout", "feed", "field", "seq", "until", "root"), ["layout", "feed", "field"], "left")
    return named.filter((F.col("seq") <= F.col("at")) & (F.col("at") < F.col("until"))).select("file_id", "field", F.col("root").alias("canonical"))


def unify(tables: dict[str, DataFrame], versions: DataFrame, found: DataFrame) -> DataFrame:
    """One consistent table of all readings: (layout, feed, file_id, line_no, columns named canonically).

    A canonical field is ``long`` where it is whole numbers in every file, ``double`` where it is numeric in
    every file, else ``string``; fields that a file lacks are null. Only the list of distinct canonical names
    (schema, not data) comes to the driver. Lines that do not parse are left out; ``unparsed`` lists them.
    """
    names = materialise(canonical_names(versions, found))
    fields = versions.select("file_id", F.explode("fields").alias("p")).select("file_id", F.col("p.field").alias("field"), F.col("p.pos").alias("pos"), F.col("p.kind").alias("kind")).join(names, ["file_id", "field"])
    rank = F.when(F.col("kind") == "long", 0).when(F.col("kind") == "double", 1).otherwise(2)
    schema = sorted((r["canonical"], r["kind"]) for r in fields.groupBy("canonical").agg(F.max(rank).alias("kind")).collect())
    firsts = fields.groupBy("file_id", "canonical").agg(F.min("pos").alias("pos"))
    place = F.map_from_entries(F.collect_list(F.struct("canonical", "pos")))
    wanted = F.array(*[F.lit(n) for n, _ in schema])
    index = firsts.groupBy("file_id").agg(place.alias("_m")).select("file_id", F.transform(wanted, lambda n: F.try_element_at("_m", n)).alias("_index"))
    heads = versions.select("file_id", "layout", "feed", "prev_file_id").join(index, "file_id").join(materialise(all_headers(tables)), "file_id")
    out = None
    for layout, lines in tables.items():
        data = rejects.lines_with_headers(lines.select("file_id", "line_no", "line"), layout, heads.filter(F.col("table") == layout)).filter(F.col("_index").isNotNull())
        cells = _cells(data)
        out = cells if out is None else out.unionByName(cells)

    def column(i: int, name: str, kind: int) -> Column:
        v = F.get("cells", F.get("_index", F.lit(i)))
        v = F.when(F.lower(v).isin("", "na", "nan"), None).otherwise(v)
        return (v.try_cast("long") if kind == 0 else v.try_cast("double") if kind == 1 else v).alias(name)

    return out.select("layout", "feed", "file_id", "line_no", *[column(i, n, k) for i, (n, k) in enumerate(schema)])


def _cells(data: DataFrame) -> DataFrame:
    """(layout, feed, file_id, line_no, _index, cells) of the lines that parse."""
    keep = ["layout", "feed", "file_id", "line_no", "_index"]
    schema = data.select(*keep).schema.add("cells", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for j in rejects.judged(batch):
                if not len(j.at):
                    continue
                w = len(j.columns)
                cells = pa.concat_arrays(j.columns).take(pa.array(np.arange(len(j.at) * w).reshape(w, -1).T.ravel()))
                cells = pa.ListArray.from_arrays(pa.array((np.arange(len(j.at) + 1) * w).astype(np.int32)), cells)
                kept = batch.select(keep).take(pa.array(j.at))
                yield pa.RecordBatch.from_arrays([*kept.columns, cells], [*keep, "cells"])

    return data.select(*keep, "line", "quoted_ok", "width", "likelihood", "first_digits", "judge_values").mapInArrow(run, schema)


def unparsed(yolo3r_raw: DataFrame) -> DataFrame:
    """(file_id, line_no, reason) of the single-header lines that do not parse (the other layouts: ``rejects.rejected``)."""
    return rejects.classify_lines(yolo3r_raw, "yolo3r", "yolo3r_raw", False).filter(F.col("reason").isNotNull()).select("file_id", "line_no", "reason")


def raw_tables(yolo3r_raw: DataFrame, dlc: DataFrame, dlcma: DataFrame) -> dict[str, DataFrame]:
    return {"yolo3r": yolo3r_raw, "dlc": dlc, "dlcma": dlcma}


def detect(tables: dict[str, DataFrame], files: DataFrame, synonyms=SYNONYMS) -> tuple[DataFrame, DataFrame]:
    """(versions, changes) of the raw tables by layout; both are written once."""
    versions = materialise(file_versions(tables, files))
    return versions, materialise(changes(versions, synonyms))
