"""Documents to blocks and sentences with exact offsets.

Texts are cut where Spark holds them, batch by batch: lines set block borders (fenced code, lines
that stand alone, list items, quotes, blank lines), and inside a block only terminators are
looked at, each with a bounded view to its left.  The work is in proportion to the text, however
long a line, a fence or a document is.  Offsets count code points.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textgate.functions import lexicons
from textgate.functions.patterns import PY_BLANK

_ABBREVIATIONS = frozenset(lexicons.ABBREVIATIONS)
#: The last two letters of each: most words are told by theirs.
_LAST_TWO = frozenset(a[-2:] for a in _ABBREVIATIONS)
_CLOSERS = "\"'’”)\\]}"
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})(.*)", re.DOTALL)
_ALONE = re.compile(r"[ \t]{0,3}(?:#{1,6}[ \t]|\||(?:[-*_][ \t]*){3,}\Z|={3,}[ \t]*\Z)")
_QUOTE = re.compile(r"[ \t]*>")
_ITEM = re.compile(r"[ \t]{0,32}(?:[-*+][ \t]|[0-9]{1,12}[.)][ \t])")
_FULL = re.compile(f"[^{PY_BLANK}]")
_STOP = re.compile("[.!?…]")
_LINE = re.compile("[^\n]*\n|[^\n]+")
_TAIL = re.compile(f"[.!?…]*[{_CLOSERS}]*(?:[*~`_]++(?![^\\W_]))?[{_CLOSERS}]*[ \\t]*\\r?\\n?")
_MARKER = re.compile(r"(?:\A|\n)[ \t]*[0-9]+\Z")
_WORD = re.compile(r"(?:[^\W\d_]|\.)+\Z")
_PLAIN = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_/\\-")
_DIGITS, _STOPS = frozenset("0123456789"), tuple(".!?…")
_ENDS = _CLOSERS.replace("\\", "") + "*~`_"
#: Characters looked back at for an abbreviation, one more than the longest has, and for the number of a list item.
_BACK, _MARKER_BACK = max(map(len, _ABBREVIATIONS)) + 1, 45

Piece = tuple[int, int]


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Start, end and whether the block stays whole; together they are the text."""
    at, fence, quoting, begun, whole = 0, "", False, 0, False
    for line in text.split("\n"):
        after = min(at + len(line) + 1, len(text))
        line = line.removesuffix("\r")
        border: list[tuple[int, bool]] = []
        if not fence and line[:1].isalpha():
            pass
        elif fence or line.lstrip(" \t")[:3] in ("```", "~~~"):
            mark = _FENCE.match(line)
            if not fence:
                fence, border = mark[1], [(at, True)]
            elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not _FULL.search(mark[2]):
                fence, border = "", [(after, False)]
            quoting = False
        elif not _FULL.search(line):
            border, quoting = [(at, False), (after, False)], False
        elif _ALONE.match(line):
            border, quoting = [(at, True), (after, False)], False
        elif _QUOTE.match(line):
            border, quoting = ([] if quoting else [(at, False)]), True
        elif _ITEM.match(line):
            border, quoting = [(at, False)], False
        for place, stays in border:
            if place > begun:
                yield begun, place, whole
            begun, whole = place, stays
        at = after
    if at > begun:
        yield begun, at, whole


def _is_abbreviation(text: str, dot: int) -> bool:
    before = text[max(0, dot - _BACK) : dot]
    last = before[-2:]
    if len(last) == 2 and last.isascii() and last.isalpha() and last.lower() not in _LAST_TWO:
        return False
    word = _WORD.search(before)
    if not word or len(word[0]) == _BACK:
        return False
    return word[0].lower() in _ABBREVIATIONS or (len(word[0]) == 1 and word[0].isupper())


def _in_token(text: str, at: int) -> bool:
    """A terminator inside a number, a name, a path or an address."""
    before, after = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
    if before not in _PLAIN or not before or not after:
        return False
    if after == "_":
        close = text.find("_", at + 2, at + 41)
        return close < 0
    return after.isalnum() or after in "/\\-"


def _is_number(text: str, dot: int) -> bool:
    """The dot after the number of a list item."""
    if not dot or text[dot - 1] not in _DIGITS:
        return False
    begin = max(0, dot - _MARKER_BACK)
    m = _MARKER.search(text[begin:dot])
    return bool(m) and (m[0][0] == "\n" or begin == 0)


def pieces(text: str) -> Iterator[Piece]:
    """Start and end of each sentence or whole block; joined they are the text."""
    for begin, to, whole in blocks(text):
        start = begin
        if not whole:
            resume = begin
            for m in _STOP.finditer(text, begin, to):
                at = m.start()
                if at < resume or _in_token(text, at) or (m[0] == "." and (_is_abbreviation(text, at) or _is_number(text, at))):
                    continue
                resume = _TAIL.match(text, at + 1, to).end()
                yield start, resume
                start = resume
        if start < to:
            yield start, to


def completes(sentence: str) -> bool:
    """Ends, after closing marks, with a terminator that no abbreviation explains."""
    bare = sentence.strip(_STRIP).rstrip(_ENDS)
    return bare.endswith(_STOPS) and not (bare[-1] == "." and _is_abbreviation(bare, len(bare) - 1))


_STRIP = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{PY_BLANK}]", c))


@F.pandas_udf(T.IntegerType())
def _complete(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else sum(completes(t[a:b]) for a, b in pieces(t)) for t in texts], dtype="Int32")


_complete = _complete.asNondeterministic()


def complete_sentences(text: Column) -> Column:
    """How many complete sentences a text has; null for null."""
    return _complete(text)


@F.arrow_udf(T.BooleanType())
def _several(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        told = (None if t is None else any(itertools.islice((1 for a, b in pieces(t) if completes(t[a:b])), 1, 2)) for t in (x.as_py() for x in texts))
        yield pa.array(told, pa.bool_())


_several = _several.asNondeterministic()


def several_sentences(text: Column) -> Column:
    """Whether a text has more than one complete sentence; it is cut up to the second.  Null for null."""
    return _several(text)


#: Documents whose pieces are handed on at once: what is held grows with these, not with the batch or the table.
_AT_ONCE = 64


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, _AT_ONCE):
            yield batch.slice(first, _AT_ONCE)


def sentences(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``sent_idx``, ``sentence``, ``start``, ``end`` and ``complete``; blank pieces are dropped.

    A null or empty text has no sentences; rows are cut one by one, so repeated rows repeat theirs.
    """
    kept = [f"keep_{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col(text).alias("text"))
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in kept), "sent_idx int, sentence string, start int, end int, complete boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows, index, parts, starts, ends = [], [], [], [], []
            for row, value in enumerate(batch.column("text")):
                whole, n = value.as_py() or "", 0
                for a, b in pieces(whole):
                    if _FULL.search(part := whole[a:b]):
                        rows.append(row)
                        index.append(n)
                        parts.append(part)
                        starts.append(a)
                        ends.append(b)
                        n += 1
            where = pa.array(rows, pa.int64())
            own = [pa.array(index, pa.int32()), pa.array(parts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array([completes(p) for p in parts], pa.bool_())]
            yield pa.record_batch([*(batch.column(k).take(where) for k in kept), *own], names=[*kept, "sent_idx", "sentence", "start", "end", "complete"])

    out = df.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "sent_idx", "sentence", "start", "end", "complete")


def paragraph_spans(text: str) -> Iterator[Piece]:
    """Start and end of each run of lines that are not blank, with the end of its last line."""
    start = at = 0
    for line in _LINE.findall(text):
        if not line.strip(" \t\n\r\x0b\x0c"):
            if start < at:
                yield start, at
            start = at + len(line)
        at += len(line)
    if start < at:
        yield start, at


def paragraphs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``start``, ``end`` and ``paragraph``: runs of lines that are not blank.

    Rows are cut one by one: rows that share their ``keep`` columns, and repeated rows, have their own paragraphs.
    """
    kept = [f"keep_{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col(text).alias("text"))
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in kept), "start long, end long, paragraph string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows, starts, ends, parts = [], [], [], []
            for row, value in enumerate(batch.column("text")):
                whole = value.as_py() or ""
                for a, b in paragraph_spans(whole):
                    rows.append(row)
                    starts.append(a)
                    ends.append(b)
                    parts.append(whole[a:b])
            where = pa.array(rows, pa.int64())
            yield pa.record_batch([*(batch.column(k).take(where) for k in kept), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(parts, pa.string())], names=[*kept, "start", "end", "paragraph"])

    return df.mapInArrow(run, schema).select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "start", "end", "paragraph")


def clauses(text: Column) -> Column:
    """Clauses in order: cut at line ends, semicolons, cell walls, and at stops and colons with a blank behind."""
    return F.filter(F.split(text, f"[\\n;|]|[.:?!](?=[{PY_BLANK}]|\\z)"), lambda c: F.length(c) > 0)
