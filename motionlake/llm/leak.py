"""Evaluation texts leaking into training text.

Pigeonhole edit matching: a passage of ``window`` units (words; letters for items written without
spaces) holds at least ``errors + 1`` whole pieces of the item's aligned pieces, so a passage with up
to ``errors`` edited units keeps one piece intact. All pieces of a block of items are found in one pass
(Aho-Corasick) and every hit is verified with Myers' bit-parallel distance.

Documents are only read in a narrow pass: nothing of the corpus is shuffled. Items are a fixed set
that goes to the workers in blocks of at most ``block_items``; any number of items is handled, one
pass per block.

Defined results: null or empty texts and items shorter than the window leak nothing; an item that
occurs twice in the items table is reported under each item_id; a document is reported once per item,
with its longest passage; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm import mail

WORDS, LETTERS, ERRORS, BLOCK_ITEMS = 12, 24, 1, 5000
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
OUT = "doc_id long, item_id long, exact boolean, units int, edits int, item_start int, passage string"


def words(text: str) -> list[str]:
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
    return _WORD.findall(text.casefold())


def spaceless(text: str) -> bool:
    """Whether an item is written without spaces between its words."""
    return not re.search(r"\w\s+\w", text)


def myers(pattern: str, text: str) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text`` (bit-parallel, any length)."""
    m = len(pattern)
    if not m:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    plus, minus, score, best = full, 0, m, m
    for c in text:
        e = eq.get(c, 0)
        x = e | minus
        d = (((e & plus) + plus) ^ plus) | e
        up, down = minus | ~(d | plus) & full, plus & d
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(x | up) & full, up & x
        best = min(best, score)
    return best


class _Side:
    """Items of one kind (words or letters), their pieces and the automaton over them."""

    def __init__(self, items: list[tuple[int, list[str] | str]], window: int, errors: int, glue: str):
        self.window, self.errors, self.glue = window, errors, glue
        self.piece = (window + 1) // (errors + 2)
        self.items = [(i, u) for i, u in items if len(u) >= window]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, units) in enumerate(self.items):
            for at in range(0, len(units) - self.piece + 1, self.piece):
                places.setdefault(self._text(units[at : at + self.piece]), []).append((k, at))
        self.near: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, where in places.items():
            self.automaton.add_word(text, where)
        if places:
            self.automaton.make_automaton()

    def _text(self, units: list[str] | str) -> str:
        return f" {' '.join(units)} " if self.glue else "".join(units)

    def _near(self, part: list[str] | str, units: list[str] | str, at: int, u: int) -> bool:
        key = (self.glue.join(part), self.glue.join(units[max(0, at - 1) : max(0, at + u + 1)]))
        known = self.near.get(key)
        if known is None:
            if len(self.near) > 100_000:
                self.near.clear()
            known = self.near[key] = myers(*key) <= self.errors
        return known

    def find(self, units: list[str] | str) -> dict[int, tuple]:
        """Best passage per item index: (exact, units matched, edits, item start, text)."""
        best: dict[int, tuple] = {}
        if not self.items or len(units) < self.piece:
            return best
        text = self._text(units)
        hits = list(self.automaton.iter(text))
        if not hits:
            return best
        if self.glue:
            start_of, at = {}, 1
            for i, u in enumerate(units):
                start_of[at] = i
                at += len(u) + 1
        seen: set[tuple[int, int]] = set()
        done: dict[tuple[int, int], int] = {}
        for end, where in hits:
            for k, at in where:
                item = self.items[k][1]
                if self.glue:
                    length = sum(map(len, item[at : at + self.piece])) + self.piece + 1
                    i = start_of[end - length + 2]
                else:
                    i = end - self.piece + 1
                diagonal = (k, i - at)
                if done.get(diagonal, -1) >= at:  # inside a run already followed
                    continue
                a, b = at, at + self.piece
                shift = i - at
                while a > 0 and a + shift > 0 and item[a - 1] == units[a + shift - 1]:
                    a -= 1
                while b < len(item) and b + shift < len(units) and item[b] == units[b + shift]:
                    b += 1
                done[diagonal] = b - 1
                run = b - a
                if run >= self.window:
                    found = (True, run, 0, a, self.glue.join(item[a:b]))
                else:  # every run holds a whole piece, and the intact piece may lie in the shorter run
                    found = None
                    # a longer passage goes on at one end of the run, where the next units differ by few edits
                    u = 1 if self.glue else 4
                    more, less = min(u, len(item) - b, self.window - run), min(u, a, self.window - run)
                    right = more > 0 and self._near(item[b : b + more], units, b + shift, more)
                    left = less > 0 and self._near(item[a - less : a], units, a + shift - less, less)
                    starts = ({a} if right else set()) | ({b - self.window} if left else set()) | ({(a + b - self.window) // 2} if left and right else set())
                    for s in {max(0, min(x, len(item) - self.window)) for x in starts}:
                        if (k, s + 1_000_000 * (i - at + 1)) in seen:
                            continue
                        seen.add((k, s + 1_000_000 * (i - at + 1)))
                        lo, hi = max(0, s + shift - self.errors), s + shift + self.window + self.errors
                        if self.glue:  # an edit changes at most two words
                            there = set(units[lo:hi])
                            if sum(x not in there for x in item[s : s + self.window]) > 2 * self.errors:
                                continue
                        passage = self.glue.join(item[s : s + self.window])
                        edits = myers(passage, self.glue.join(units[lo:hi]))
                        if edits <= self.errors and (found is None or edits < found[2]):
                            found = (False, self.window, edits, s, passage)
                    if found is None:
                        continue
                if k not in best or found[:2] > best[k][:2]:
                    best[k] = found
        return best


def find_leaks(documents: DataFrame, items: DataFrame, window_words: int = WORDS, window_letters: int = LETTERS, errors: int = ERRORS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Documents that hold a passage of an item: ``OUT``, one row per (doc_id, item_id).

    ``exact`` tells that at least the window's length stands there unchanged; other rows are passages
    with up to ``errors`` single-character edits.
    """
    spark = documents.sparkSession
    rows = items.select("item_id", "text").filter(F.col("text").isNotNull())
    docs = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    out = None
    n_items = rows.count()
    for block in range(max(1, -(-n_items // block_items))):
        part = rows if n_items <= block_items else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(-(-n_items // block_items))) == block)
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            texts = shared.value
            spaced = _Side([(i, words(t)) for i, t in texts if not spaceless(t)], window_words, errors, " ")
            dense = _Side([(i, "".join(words(t))) for i, t in texts if spaceless(t)], window_letters, errors, "")
            for batch in batches:
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    best: dict[int, tuple] = {}
                    for body in mail.text_parts(text):
                        units = words(mail.without_quote_marks(body))
                        hits = [(spaced.items[k][0], v) for k, v in spaced.find(units).items()]
                        if dense.items:
                            hits += [(dense.items[k][0], v) for k, v in dense.find("".join(units)).items()]
                        for item, v in hits:
                            if item not in best or v[:2] > best[item][:2]:
                                best[item] = v
                    rows += [(doc, item, *v) for item, v in best.items()]
                cols = list(zip(*rows)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "exact", "units", "edits", "item_start", "passage"])

        found = docs.mapInArrow(run, OUT)
        out = found if out is None else out.unionByName(found)
    return out
