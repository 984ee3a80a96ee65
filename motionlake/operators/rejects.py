"""Rows that fail to parse: split raw lines into typed rows and rejects with a reason.

Structure is judged by ``pyarrow.csv``: every line goes in with its ordinal in front, and the
reader's invalid-row callback hands back lines with the wrong number of cells. Everything is read
as strings; whole columns are then stripped, cast and tested, and failing cells are labelled.

Lines meet their file's header by (file, block of lines), so one huge file is spread over tasks.

Defined results: null and empty lines are in neither output; a file without its coordinate header
line has no expected width, so its lines are rejected as ``column_count``; equal lines are judged
one by one; extra columns of the input are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the input format.
CELL = r'"(?:[^"]|"")*"|[^",]*'
WELL_QUOTED = rf"^(?:{CELL})(?:,(?:{CELL}))*$"
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
HEADER_LINES = {"yolo3r": 1, "dlc": 3, "dlcma": 4}
#: Lines of one file that meet its header in one task at most.
BLOCK_LINES = 65_536
OUT = "source_table string, file_id long, line_id long, line_no int, cells array<string>, reason string, bad_cell int"


def split_cells(line: str | Column) -> Column:
    """Cells of a well-quoted line, quotes kept, empty cells included."""
    return F.regexp_extract_all(line, F.lit(rf"(?:^|,)({CELL})"), F.lit(1))


def unquoted(cell: str | Column) -> Column:
    """A cell without enclosing quotes and outer blanks."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    bare = F.trim(cell)
    inner = F.replace(F.regexp_extract(bare, r'(?s)^"(.*)"$', 1), F.lit('""'), F.lit('"'))
    return F.when(bare.startswith('"'), F.trim(inner)).otherwise(bare)


def parse(lines: pa.Array, width: int) -> tuple[np.ndarray, list[pa.Array], np.ndarray, np.ndarray]:
    """Well-quoted lines of ``width`` cells: (ordinals, columns of bare strings, bad ordinals, cells they have)."""
    bad: list[tuple[int, int]] = []

    def on_invalid(row: csv.InvalidRow) -> str:
        bad.append((int(row.text.partition(",")[0]), row.actual_columns - 1))
        return "skip"

    numbered = pc.binary_join_element_wise(pc.cast(pa.array(np.arange(len(lines))), pa.string()), lines.cast(pa.string()), ",")
    text = "\n".join(numbered.to_pylist()).encode() + b"\n"
    names = [f"f{i}" for i in range(width + 1)]
    table = csv.read_csv(
        io.BytesIO(text),
        read_options=csv.ReadOptions(use_threads=False, column_names=names, block_size=max(1 << 20, len(text) + 1)),
        parse_options=csv.ParseOptions(invalid_row_handler=on_invalid, quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=True),
        convert_options=csv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
    ).combine_chunks()
    columns = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], pa.string()) for c in table.columns]
    wrong = np.array(bad, np.int64).reshape(-1, 2)
    return pc.cast(columns[0], pa.int64()).to_numpy(zero_copy_only=False), [pc.ascii_trim_whitespace(c) for c in columns[1:]], wrong[:, 0], wrong[:, 1]


def _invalid(columns: list[pa.Array], likelihood: str, first_digits: bool) -> np.ndarray:
    """Per row the index of the first cell that is no valid value, -1 without one."""
    out = np.full(len(columns[0]) if columns else 0, -1, np.int32)
    for k in range(len(columns) - 1, -1, -1):
        col = columns[k]
        if k == 0 and not first_digits:
            continue
        if k == 0:
            ok = pc.match_substring_regex(col, "^[0-9]+$")
        else:
            number = pc.match_substring_regex(col, NUMBER)
            missing = pc.or_(pc.equal(col, ""), pc.equal(pc.ascii_lower(col), "nan"))
            ok = pc.or_(number, missing)
            if likelihood[k : k + 1] == "1":
                value = pc.cast(pc.if_else(number, col, pa.scalar(None, pa.string())), pa.float64())
                inside = pc.fill_null(pc.and_(pc.greater_equal(value, 0.0), pc.less_equal(value, 1.0)), True)
                ok = pc.and_(ok, inside)
        out[~ok.to_numpy(zero_copy_only=False)] = k
    return out


class Judged:
    """The lines of a batch with one layout: ``at`` row numbers that parse, with their ``columns``; and the rejects."""

    def __init__(self, at: np.ndarray, columns: list[pa.Array], rejects: list[tuple[np.ndarray, str, np.ndarray]]):
        self.at, self.columns, self.rejects = at, columns, rejects


def judged(batch: pa.RecordBatch) -> Iterator[Judged]:
    """Lines of a batch (line, quoted_ok, width, likelihood, first_digits, judge_values) by layout."""
    col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    ok = pc.fill_null(col["quoted_ok"], False).to_numpy(zero_copy_only=False)
    width = pc.fill_null(col["width"], -1).to_numpy(zero_copy_only=False)
    nothing = np.zeros(0, np.int64)
    yield Judged(nothing, [], [(np.flatnonzero(~ok), "quoting", nothing)])
    yield Judged(nothing, [], [(np.flatnonzero(ok & (width < 0)), "column_count", nothing)])
    mask = pc.fill_null(col["likelihood"], "").dictionary_encode()
    layout = mask.indices.to_numpy(zero_copy_only=False) * 2 + col["first_digits"].to_numpy(zero_copy_only=False)
    for w, code in {*zip(width[ok & (width >= 0)].tolist(), layout[ok & (width >= 0)].tolist())}:
        rows = np.flatnonzero(ok & (width == w) & (layout == code))
        order, columns, wrong, have = parse(col["line"].take(pa.array(rows)), w)
        rejects = [(rows[wrong], "column_count", have)]
        if col["judge_values"][int(rows[0])].as_py():
            bad = _invalid(columns, mask.dictionary[code // 2].as_py(), bool(code % 2))
            rejects.append((rows[order[bad >= 0]], "value", bad[bad >= 0]))
            keep = pa.array(np.flatnonzero(bad < 0))
            columns, order = [c.take(keep) for c in columns], order[bad < 0]
        yield Judged(rows[order], columns, rejects)


def _classifier(with_cells: bool):
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            reason, bad = np.full(n, None, object), np.full(n, -1, np.int32)
            at, flat, sizes = [], [], np.zeros(n, np.int64)
            for j in judged(batch):
                for rows, why, cell in j.rejects:
                    reason[rows] = why
                    if len(cell):
                        bad[rows] = cell
                if with_cells and len(j.at):
                    w = len(j.columns)
                    by_row = np.arange(len(j.at) * w).reshape(w, -1).T.ravel()
                    flat.append(pa.concat_arrays(j.columns).take(pa.array(by_row)))
                    at.append(np.repeat(j.at, w))
                    sizes[j.at] = w
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("source_table", "file_id", "line_id", "line_no")]
            if at:
                order = np.argsort(np.concatenate(at), kind="stable")
                cells = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.concat_arrays(flat).take(pa.array(order)), mask=pa.array(sizes == 0))
            else:
                cells = pa.nulls(n, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*keep, cells, pa.array(reason, pa.string()), pa.array(bad, pa.int32(), mask=bad < 0)], ["source_table", "file_id", "line_id", "line_no", "cells", "reason", "bad_cell"])

    return classify


def headers(lines: DataFrame, layout: str) -> DataFrame:
    """(file_id, names, width, likelihood): field names of each file and a 0/1 mask of its likelihood cells."""
    n = HEADER_LINES[layout]
    if layout == "yolo3r":
        rows = lines.filter(F.col("line_no") == 0).groupBy("file_id").agg(F.max("line").alias("h"))
        rows = rows.filter(F.trim("h") != "").select("file_id", F.transform(split_cells("h"), unquoted).alias("names"))
        return rows.select("file_id", "names", F.size("names").alias("width"), F.lit("").alias("likelihood"))
    rows = lines.filter(F.col("line_no") < n).groupBy("file_id").agg(*[F.max(F.when(F.col("line_no") == i, split_cells("line"))).alias(f"h{i}") for i in range(1, n)])
    parts = [F.col(f"h{i}") for i in range(1, n)]
    coords = parts[-1]

    def named(i: Column) -> Column:
        return F.when(i == 0, F.lit("c0")).otherwise(F.concat_ws(".", *[unquoted(F.get(p, i)) for p in parts]))

    every = F.sequence(F.lit(0), F.size(coords) - 1)
    return rows.filter(coords.isNotNull()).select(
        "file_id",
        F.transform(every, named).alias("names"),
        F.size(coords).alias("width"),
        F.concat_ws("", F.transform(coords, lambda c: F.when(F.lower(unquoted(c)) == "likelihood", F.lit("1")).otherwise(F.lit("0")))).alias("likelihood"),
    )


def lines_with_headers(lines: DataFrame, layout: str, heads: DataFrame) -> DataFrame:
    """Data lines (the columns of ``lines``) with the columns of their file's header and what ``judged`` needs.

    The join is by (file, block of lines): a header is repeated once per block of its file.
    """
    block = F.floor(F.coalesce("line_no", F.lit(0)) / BLOCK_LINES).cast("int")
    upto = lines.groupBy("file_id").agg(F.max(block).alias("_last"))
    heads = heads.join(upto, "file_id").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")
    data = lines.filter((F.col("line_no") >= HEADER_LINES[layout]) & (F.trim("line") != ""))
    # \r and \n inside a line would be taken for a line end by the reader; as blanks they judge alike.
    data = data.withColumns({"line": F.translate("line", "\r\n", "  "), "_block": block})
    data = data.withColumns({"quoted_ok": F.col("line").rlike(WELL_QUOTED), "first_digits": F.lit(layout == "dlcma"), "judge_values": F.lit(layout != "yolo3r")})
    return data.join(heads, ["file_id", "_block"], "left").drop("_block")


def classify_lines(lines: DataFrame, layout: str, source_table: str, with_cells: bool = True) -> DataFrame:
    """Judge every data line of a raw table (columns file_id, line_id, line_no, line).

    Returns ``OUT``: valid lines have ``cells`` (bare strings; null if not ``with_cells``) and a null ``reason``;
    rejects have null cells, the first reason that holds (``quoting``, ``column_count``, ``value``), for
    ``value`` the index of the first failing cell and for ``column_count`` the number of cells. Lines of the
    ``yolo3r`` layout are judged by structure only.
    """
    lines = lines.select("file_id", "line_id" if "line_id" in lines.columns else F.lit(None).cast("long").alias("line_id"), "line_no", "line")
    data = lines_with_headers(lines, layout, headers(lines, layout).select("file_id", "width", "likelihood"))
    return data.select(F.lit(source_table).alias("source_table"), "file_id", "line_id", "line_no", "line", "quoted_ok", "width", "likelihood", "first_digits", "judge_values").mapInArrow(_classifier(with_cells), OUT)


def rejected(dlc: DataFrame, dlcma: DataFrame) -> DataFrame:
    both = classify_lines(dlc, "dlc", "dlc_single", False).unionByName(classify_lines(dlcma, "dlcma", "dlcma_multi", False))
    return both.filter(F.col("reason").isNotNull())


def loaded(lines: DataFrame, layout: str, source_table: str) -> DataFrame:
    """Valid lines, typed: (file_id, line_id, line_no, c0 string, values array<double>), missing cells null."""
    good = classify_lines(lines, layout, source_table).filter(F.col("reason").isNull())
    return good.select("source_table", "file_id", "line_id", "line_no", F.get("cells", F.lit(0)).alias("c0"), F.transform(F.slice("cells", F.lit(2), F.size("cells") - 1), lambda c: F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))).alias("values"))
