"""Sentence units of message bodies in any script.

Document-centred disambiguation: whether a word before a period is an abbreviation, and whether the
capitalised word after it is a common word or a name, is decided by unambiguous occurrences in the same
document (followed by a lower-case word, a comma or a number; written in lower case elsewhere), and by
the counts over the whole corpus where the document has none. Scripts without case or spaces have their
own terminators; marks inside paired quotes and brackets never end a unit.

Defined results: null texts, texts without a blank line and blocks without a letter or digit give no
units; very long texts are processed whole; repeated rows give repeated units; the language column is
not used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm import mail

OPENERS = {"(": ")", "[": "]", "（": "）", "«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "‹": "›", "《": "》"}
WIDE = "。！？｡"
#: Danda, Arabic question mark and full stop, Armenian, Ethiopic, Khmer, Tibetan and Myanmar marks.
ENDS = ".!?…‼⁇⁈⁉।॥؟۔։።፧។༎།။" + WIDE
_MARK = re.compile(rf"[{re.escape(ENDS)}]+(?:[  ]?[{re.escape(ENDS)}]+)*|[()\[\]（）«»“”„「」『』‹›《》\"]")
_LINE = re.compile(r"[^\n]*\n|[^\n]+\Z")
_GAP = re.compile(r"\n[ \t\r]*\n")
_SPECIAL = re.compile(r"^(?:>|- |[0-9]+\. )", re.M)
_SIGNATURE = re.compile(r"^-- \r?$", re.M)
_LIST = re.compile(r"(?:- |[0-9]+\. )")
_NEXT = re.compile(r"[\s  ]*([^\w\s]*)(\w[\w'’.-]*)?")
_INSIDE = re.compile(r"(?<=[\w,])\s([^\W\d_][^\W\d_'’]*)(?![\w@.'’])")
_DOT = re.compile(r"\.(?:([,;:])|(?=\s|\Z)\s*([^\w\s]*)(\w[\w'’.-]*)?)")
_OUTER = "()[]«»“”„\"「」『』¿¡,;:—–"
_FIRST = re.compile(r"[^\W\d_]+")
_ADDRESS = re.compile(r"\S+@\S+")
_INITIAL = re.compile(r"\w\.\Z")
VOWELS = frozenset("aeiouyаеёиоуыэюяäöüáéíóúàèùâêîôû")
#: Abbreviations that stand before names have at most so many letters.
TITLE_LETTERS = 5
#: Corpus tables larger than this many rows are joined instead of being sent to every worker.
SEND_MOST = 300_000


def blocks(text: str, start: int) -> list[tuple[int, int, int]]:
    """(start, end, marker length) of stretches in which line breaks are mere blanks."""
    stop = _SIGNATURE.search(text, start)
    end = stop.start() if stop else len(text)
    out: list[tuple[int, int, int]] = []
    at = start
    while at < end:
        gap = _GAP.search(text, at, end)
        upto = gap.start() if gap else end
        if _SPECIAL.search(text, at, upto):
            open_at, marker, last = -1, 0, at
            for m in _LINE.finditer(text, at, upto):
                line = m.group().rstrip()
                listed = _LIST.match(m.group())
                if open_at >= 0 and (not line or line[0] == ">" or listed):
                    out.append((open_at, last, marker))
                    open_at = -1
                if line and line[0] != ">":
                    if open_at < 0:
                        open_at, marker = m.start(), listed.end() if listed else 0
                    last = m.start() + len(line)
            if open_at >= 0:
                out.append((open_at, last, marker))
        else:
            piece = text[at:upto]
            if piece.strip():
                out.append((at, at + len(piece.rstrip()), 0))
        at = gap.end() if gap else end
    return out


def _word_before(block: str, start: int, at: int) -> str:
    words = block[max(start, at - 40) : at].split()
    if not words or block[at - 1].isspace():
        return ""
    word = words[-1]
    for i in range(len(word) - 1, -1, -1):
        if word[i] in _OUTER:
            return word[i + 1 :]
    return word


class Evidence:
    """Unambiguous occurrences of words in a text.

    ``inside`` counts word forms after another word or a comma, so lower case shows an ordinary word
    and upper case a name. ``dots`` counts, per word before a period: t all, a before a lower-case word
    or comma, d before a number, b at a block's end; and s: forms that start a block that ends properly.
    """

    def __init__(self, text: str = "", spans: list[tuple[int, int, int]] = (), lazy: bool = False):
        self.inside: Counter = Counter()
        self.dots: Counter = Counter()
        self._pending = (text, spans)
        if not lazy:
            self._count()

    def _count(self) -> None:
        (text, spans), self._pending = self._pending, None
        for s, e, marker in spans:
            block = text[s + marker : e]
            if "@" in block:
                block = _ADDRESS.sub("0", block)
            self.inside.update(_INSIDE.findall(block))
            if block[-1:] in ENDS:
                first = _FIRST.match(block)
                if first and first.group().istitle():
                    self.dots["s" + first.group().lower()] += 1
            for m in _DOT.finditer(block):
                low = _word_before(block, 0, m.start()).lower()
                if not low[:1].isalpha():
                    continue
                mark, lead, follow = m.group(1), m.group(2) or "", m.group(3) or ""
                self.dots["t" + low] += 1
                if mark or follow.islower() and not lead:
                    self.dots["a" + low] += 1
                elif not follow and not lead:
                    self.dots["b" + low] += 1
                elif not lead.strip("+") and any(map(str.isdigit, follow)):
                    self.dots["d" + low] += 1

    def __call__(self, kind: str, low: str) -> int:
        if self._pending:  # most documents have nothing to decide
            self._count()
        if kind == "l":
            return self.inside[low]
        return self.inside[low.capitalize()] if kind == "u" else self.dots[kind + low]

    def tokens(self) -> Counter:
        c = Counter(self.dots)
        for form, n in self.inside.items():
            c[("l" if form.islower() else "u") + form.lower()] += n
        return c


def _is_common(word: str, own: Evidence, corpus: Callable[[str], int]) -> bool:
    """Whether a capitalised word is an ordinary word that merely starts a sentence."""
    if _INITIAL.match(word):
        return False
    low = word.rstrip(".'’-").lower()
    here = own("l", low) - own("u", low)
    if here:
        return here > 0
    return corpus("l" + low) > corpus("u" + low) or corpus("s" + low) > max(9, 8 * corpus("u" + low))


def _paired(block: str) -> list[tuple[int, int, int]]:
    """Terminator runs and matched openers/closers: (position, end, depth after) with depth of matched pairs only."""
    marks = list(_MARK.finditer(block))
    stack: list[tuple[str, int]] = []
    match: dict[int, int] = {}
    for k, m in enumerate(marks):
        ch = m.group()
        if ch[0] in ENDS:
            continue
        want = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == ch), None)
        if ch == '"':
            before = block[m.start() - 1] if m.start() else " "
            opens = want is None and (before.isspace() or before in "(「“«—-")
            if want is None and not opens:
                continue
        else:
            opens = ch in OPENERS and not (ch == "“" and want is not None)
        if opens:
            stack.append(('"' if ch == '"' else OPENERS[ch], k))
        elif want is not None:
            match[stack[want][1]] = k
            match[k] = stack[want][1]
            del stack[want:]
        elif ch == "”" and any(s[0] == "“" for s in stack):  # „…” is written too
            want = max(i for i, s in enumerate(stack) if s[0] == "“")
            match[stack[want][1]] = k
            match[k] = stack[want][1]
            del stack[want:]
    return [(m.start(), m.end(), (0 if m.group()[0] in ENDS else 0 if k not in match else 1 if match[k] > k else -1)) for k, m in enumerate(marks)]


def _ends_here(block: str, unit: int, at: int, stop: int, after: int, opener: int, own: Evidence, corpus: Callable[[str], int]) -> bool:
    """Whether the terminator run block[at:stop], with closers up to ``after``, ends the unit.

    ``opener`` is the place of the outermost bracket or quote just closed, -1 without one."""
    run = block[at:stop]
    rest = _NEXT.match(block, after)
    lead, follow = rest.group(1), rest.group(2) or ""
    if not follow and not lead and not block[after:].strip():
        return True
    spaced = after < len(block) and block[after].isspace()
    quoted = opener >= 0
    first = follow[:1]
    cased = first.isupper() or first.islower()
    if run[0] in WIDE:
        return not quoted
    if run.strip("…") == "" and not spaced:
        return False  # an interjection written without spaces
    if not spaced:
        return False
    if lead[:1] in ("—", "–", "-", ",", ";", ":"):
        return False
    mixed = first.islower() and not follow.islower()
    if first.islower() and not mixed:
        return False
    if quoted:
        if not cased or mixed:
            return mixed and run[-1] == "."
        if _is_common(follow, own, corpus):
            return True
        return run[-1] in ".…" and not block[unit:opener].strip()
    if run in ("...", "…") or run.endswith("..."):
        free = at > 0 and block[at - 1].isspace()
        return not free or _is_common(follow, own, corpus)
    if run != ".":
        return True
    w = _word_before(block, unit, at)
    if not w:
        return True
    low = w.lower()
    number = any(c.isdigit() for c in follow) and not lead.strip("+")
    letters = [c for c in w if c.isalpha()]
    if w.isdigit():
        return bool(lead) or (first.isupper() and _is_common(follow, own, corpus)) or not cased and not number

    if number:
        here = own("a", low) + own("d", low) - own("b", low)
        return not (here > 0 or len(letters) == 1 or here == 0 and corpus("a" + low) + corpus("d" + low) > corpus("b" + low))
    if len(letters) == 1 and (w[0].isupper() or not letters[0].islower()):
        return False  # an initial, or a one-letter title in a script without case
    if not cased and letters and not letters[0].isupper() and not letters[0].islower():
        return not ("." in w or len(letters) <= 1 or corpus("t" + low) >= 3 and corpus("b" + low) == 0 and corpus("a" + low) + corpus("d" + low) > 0)
    total, final = corpus("t" + low), corpus("b" + low)
    strange = len(letters) <= 3 and not any(c in VOWELS for c in low) and final * 50 <= total
    title = strange or len(letters) <= TITLE_LETTERS and total >= 3 and final * 50 < total
    if not title and not (len(letters) <= TITLE_LETTERS and own("a", low) + own("d", low) > own("b", low)):
        return True
    return lead[:1] in ("¿", "¡") or first.isupper() and _is_common(follow, own, corpus)


def _candidates(block: str, marker: int) -> Iterator[tuple[int, int, int, int]]:
    """(at, stop, after, opener) of the terminator runs outside paired marks, as ``_ends_here`` takes them."""
    marks = _paired(block)
    opens: list[int] = []
    for k, (at, stop, turn) in enumerate(marks):
        if turn == 1:
            opens.append(at)
        elif turn == -1:
            opens and opens.pop()
        if turn or block[at] not in ENDS or at < marker:
            continue
        after, opener, level, j = stop, -1, len(opens), k + 1
        while level and j < len(marks) and marks[j][2] == -1 and not block[after : marks[j][0]].strip():
            level -= 1
            after, opener = marks[j][1], opens[level]
            j += 1
        while level == 0 and j < len(marks) and marks[j][0] == after and block[marks[j][0]] in "\"”»)」":
            after = marks[j][1]
            j += 1
        if level == 0:
            yield at, stop, after, opener


def units(text: str, spans: list[tuple[int, int, int]], corpus: Callable[[str], int], own: Evidence | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of the blocks."""
    own = Evidence(text, spans, lazy=True) if own is None else own
    out: list[tuple[int, int]] = []
    for s, e, marker in spans:
        block = text[s:e]
        unit, cuts = 0, []
        for at, stop, after, opener in _candidates(block, marker):
            if _ends_here(block, unit, at, stop, after, opener, own, corpus):
                cuts.append((unit, after))
                unit = after
        cuts.append((unit, len(block)))
        for a, b in cuts:
            piece = block[a:b]
            if any(c.isalnum() for c in piece):
                lead = len(piece) - len(piece.lstrip())
                out.append((s + a + lead, s + a + len(piece.rstrip())))
    return out


def tokens_wanted(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """Every corpus token that ``units`` could ask for, whatever the counts and the earlier decisions are."""
    out: set[str] = set()
    for s, e, marker in spans:
        block = text[s:e]
        starts = [0]  # of the unit, if any of the boundaries before holds
        for at, stop, after, _ in _candidates(block, marker):
            follow = _NEXT.match(block, after).group(2)
            if follow:
                out.update(kind + follow.rstrip(".'’-").lower() for kind in "lus")
            if block[at:stop] == ".":
                out.update(kind + _word_before(block, unit, at).lower() for unit in starts for kind in "tbad")
            starts = [0, *(u for u in starts[1:] if u > after - 100), after]
    return out


def plain_body(text: str) -> int:
    """Offset of the body of a message that is text/plain without transfer encoding, else -1."""
    head, at = mail.split(text)
    return at if mail.content_type(head)[0] == "text/plain" and mail.encoding(head) in ("", "8bit", "7bit") and "7bit" != mail.encoding(head) else -1


def bodies(text: str) -> list[tuple[str, list[tuple[int, int, int]], bool]]:
    """(text, blocks, whether offsets count in the raw message) of every text part."""
    at = plain_body(text)
    if at >= 0:
        return [(text, blocks(text, at), True)]
    return [(p, blocks(p, 0), False) for p in mail.text_parts(text)]


def corpus_counts(documents: DataFrame) -> DataFrame:
    """(token, n): the evidence of all documents, pre-counted per batch, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Evidence()

        def counted() -> pa.RecordBatch:
            c = total.tokens()
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for body, spans, _ in bodies(text):
                    one = Evidence(body, spans)
                    total.inside.update(one.inside)
                    total.dots.update(one.dots)
            if len(total.inside) + len(total.dots) > 200_000:
                yield counted()
                total = Evidence()
        yield counted()

    return documents.select("text").filter(F.col("text").isNotNull()).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


OUT = "doc_id long, part int, in_message boolean, unit int, sent_start long, sentence string"


def _parts(text: str, plain_only: bool) -> list[tuple[str, list[tuple[int, int, int]], bool]]:
    if not plain_only:
        return bodies(text)
    at = plain_body(text)
    return [(text, blocks(text, at), True)] if at >= 0 else []


def _emit(doc: int, text: str, corpus: Callable[[str], int], plain_only: bool) -> list[tuple]:
    return [(doc, p, raw, k, a, body[a:b]) for p, (body, spans, raw) in enumerate(_parts(text, plain_only)) for k, (a, b) in enumerate(units(body, spans, corpus))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 6
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "part", "in_message", "unit", "sent_start", "sentence"])


def split_sentences(documents: DataFrame, plain_only: bool = False, send_most: int = SEND_MOST) -> DataFrame:
    """Sentence units of every document: ``OUT``.

    ``sent_start`` counts code points in the raw text for plain unencoded messages (``in_message``), in
    the decoded part otherwise. Corpus counts are sent to the workers while they have at most
    ``send_most`` rows; a larger table is joined to the words each document needs.
    """
    from motionlake.session import materialise

    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    counts = materialise(corpus_counts(documents))
    if counts.count() <= send_most:
        shared = spark.sparkContext.broadcast({r["token"]: r["n"] for r in counts.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                yield _batch([r for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in _emit(doc, text, lambda t: table.get(t, 0), plain_only)])

        return docs.mapInArrow(run, OUT)

    docs = docs.withColumn("_key", F.monotonically_increasing_id())

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tokens = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                asked = set().union(*(tokens_wanted(body, spans) for body, spans, _ in _parts(text, plain_only)))
                keys += [key] * len(asked)
                tokens += sorted(asked)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(tokens, pa.string())], ["_key", "token"])

    docs = materialise(docs)
    asked = docs.select("_key", "text").mapInArrow(needed, "_key long, token string").join(counts, "token")
    known = asked.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("_counts"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                table = dict(own or ())
                rows += _emit(doc, text, lambda t, table=table: table.get(t, 0), plain_only)
            yield _batch(rows)

    return docs.join(known, "_key", "left").select("doc_id", "text", "_counts").mapInArrow(run_joined, OUT)
