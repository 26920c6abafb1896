"""Markdown to the prose a reader sees, with the place of each character, and edits of the prose as edits of the source.

Projection and edits are Arrow functions over whole columns, one pass over a text each; places,
stretches and applied edits are columns.  Places count code points.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textgate.functions.patterns import PY_BLANK
from textgate.operators import guards, segment

PROJECTION = T.StructType(
    [
        T.StructField("text", T.StringType()),
        *(T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("offsets", "escaped")),
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("complete", T.BooleanType()),
    ]
)
EDITS = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("insert", T.StringType())]))

#: What opens a line without being prose: quotes, cells, headings, items, and their check boxes.
_OPENING = rf"(?:[{PY_BLANK}]{{0,3}}(?:>+[ \t]*|\|[ \t]*|(?:\#{{1,6}}|[-*+]|[0-9]+[.)])[ \t]+)(?:\[[ xX]\][ \t]+)?)+"
_HEAD = re.compile(_OPENING)
_PIECE = re.compile(
    rf"(?P<marker>(?<=\n){_OPENING})"
    r"|\\(?P<escape>[\\`*_{}\[\]()#+\-.!~=|>])"
    r"|(?P<ticks>`+)(?!`)(?P<code>(?s:.)+?)(?<!`)(?P=ticks)(?!`)"
    r"|(?P<embed>!\[\[[^\]\n]*\]\]|!\[[^\]\n]*\]\([^)\n]*\))"
    r"|\[\[(?P<target>[^\]|\n]*)(?:\|(?P<alias>[^\]\n]*))?\]\]"
    r"|\[(?P<link>[^\]\n]*)\]\([^)\n]*\)"
    r"|(?P<mark>\*\*|__|[*_]|==|~~)"
)
_FENCE = re.compile(rf"^[{PY_BLANK}]{{0,3}}(?:```|~~~)", re.MULTILINE)
_SPACE = re.compile(f"[{PY_BLANK}]")
_QUOTE_GAP = re.compile(r"(?:[ \t]*>[ \t]*)+")

Spans = list[tuple[int, int]]


def _is_markup(text: str, at: int, mark: str) -> bool:
    before, after = text[at - 1 : at] if at else "", text[at + len(mark) : at + len(mark) + 1]
    if mark[0] == "_":
        return not (before.isalnum() and after.isalnum())
    empty = lambda c: not c or bool(_SPACE.match(c))
    return not (empty(before) and empty(after))


def flattened(text: str) -> tuple[Spans, set[int], list[str]]:
    """The stretches of a text that are prose, places of escaped characters, and terms that must stay."""
    kept: Spans = []
    escapes: set[int] = set()
    terms: list[str] = []
    opened: dict[str, int] = {}
    head = _HEAD.match(text)
    at = head.end() if head and head.end() < len(text) else 0
    while m := _PIECE.search(text, at):
        start, kind = m.start(), m.lastgroup
        kept.append((at, start))
        at = m.end()
        if kind == "escape":
            kept.append(m.span(kind))
            escapes.add(m.start(kind))
        elif kind in ("code", "target", "alias", "link"):
            kept.append(m.span(kind))
            if m[kind].strip():
                terms.append(m[kind])
        elif kind == "mark":
            mark = m[kind]
            if not _is_markup(text, start, mark):
                kept.append((start, start + 1))
                at = start + 1
            elif opened.get(mark):
                opened[mark] -= 1
            elif text.find(mark, at) >= 0:
                opened[mark] = 1
            else:
                kept.append((start, at))
    kept.append((at, len(text)))
    return [(a, b) for a, b in kept if a < b], escapes, terms


def _project(text: str | None) -> dict | None:
    if text is None:
        return None
    if _FENCE.search(text):
        return {"text": text, "offsets": [], "escaped": [], "terms": [], "complete": False}
    kept, escapes, terms = flattened(text)
    prose = "".join(text[a:b] for a, b in kept)
    return {"text": prose, "offsets": [i for a, b in kept for i in range(a, b)], "escaped": sorted(escapes), "terms": terms, "complete": segment.completes(prose)}


@F.pandas_udf(PROJECTION)
def _projections(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = PROJECTION.names
    for texts in batches:
        yield pd.DataFrame([_project(t) or dict.fromkeys(names) for t in texts], columns=names, dtype=object)


def projection(text: Column) -> Column:
    """``text``, ``offsets``, ``escaped``, ``terms`` and ``complete``; a text with a fence stays as it is and is not complete."""
    return _projections(text)


def source_position(projected: Column, at: Column) -> Column:
    """Where a place of the prose is in the source; behind its last character, the place after that."""
    offsets = projected["offsets"]
    last = F.get(offsets, F.size(offsets) - 1) + 1
    return F.when(F.size(offsets) == 0, 0).when(at >= F.size(offsets), last).otherwise(F.get(offsets, F.greatest(at, F.lit(0))))


def source_runs(projected: Column, start: Column, end: Column) -> Column:
    """A stretch of the prose as unbroken stretches of the source; an escaped character brings its backslash.

    The characters' source places fall into islands: one begins wherever a place, with its backslash, does not follow the place before.
    """
    at = F.slice(projected["offsets"], start + 1, F.greatest(end - start, F.lit(0)))
    from_ = F.transform(at, lambda x: x - F.array_contains(projected["escaped"], x).cast("int"))
    every = F.sequence(F.lit(0), F.size(at) - 1)
    first = F.filter(every, lambda k: (k == 0) | (F.get(from_, k) > F.get(at, k - 1) + 1))
    last = F.concat(F.transform(F.slice(first, F.lit(2), F.size(first)), lambda k: k - 1), F.array(F.size(at) - 1))
    islands = F.zip_with(first, last, lambda i, j: F.struct(F.get(from_, i).cast("int").alias("from"), (F.get(at, j) + 1).cast("int").alias("to")))
    place = source_position(projected, start).cast("int")
    return F.when(F.size(at) > 0, islands).otherwise(F.array(F.struct(place.alias("from"), place.alias("to"))))


def _rewritten(prose: str, replacement: str) -> list[tuple[int, int, str]]:
    """What changes in the prose, as (start, end, insert): each gap between words that stay, and each word that stays in another case."""
    words = [(start, end, begin, until) for kind, _, _, start, end, _, _, begin, until in guards._aligned(prose, replacement) if kind == "equal"]
    edges = [(0, 0, 0, 0), *words, (len(prose), len(prose), len(replacement), len(replacement))]
    gaps = [(x[1], y[0], replacement[x[3] : y[2]]) for x, y in itertools.pairwise(edges)]
    recased = [(a, b, replacement[c:d]) for a, b, c, d in words]
    return sorted((a, b, new) for a, b, new in (*gaps, *recased) if prose[a:b] != new)


def _islands(source: str, places: np.ndarray, escaped: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    """The source stretches of some characters of the prose; the opening of a quoted line joins what stands before and behind it."""
    if start == end:
        spot = int(places[start]) if start < len(places) else int(places[-1]) + 1 if len(places) else 0
        return [(spot, spot)]
    begins, ends = places[start:end] - escaped[start:end], places[start:end] + 1
    cuts = [k for k in np.flatnonzero(begins[1:] > ends[:-1]) + 1 if not _QUOTE_GAP.fullmatch(source, ends[k - 1], begins[k])]
    return [(int(begins[i]), int(ends[j - 1])) for i, j in itertools.pairwise([0, *cuts, end - start])]


def _edits(source: str, replacement: str) -> list[tuple[int, int, str]]:
    """Gaps between words that stay are replaced; what stays keeps its own characters and the markup around it."""
    kept, escapes, _ = flattened(source)
    places = np.array([i for a, b in kept for i in range(a, b)], np.int64)
    escaped = np.isin(places, list(escapes)).astype(np.int64)
    out = []
    for start, end, new in _rewritten("".join(source[a:b] for a, b in kept), replacement):
        # the first stretch takes what is new, the others go
        stretches = _islands(source, places, escaped, start, end)
        out += [(a, b, text) for (a, b), text in zip(stretches, [new, *[""] * len(stretches)], strict=False) if a < b or text]
    return out


@F.pandas_udf(EDITS)
def _edit_lists(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([None if a is None or b is None else [dict(zip(("from", "to", "insert"), e, strict=True)) for e in _edits(a, b)] for a, b in zip(left, right, strict=True)], dtype=object)


def source_edits(source: Column, replacement: Column) -> Column:
    """Edits (from, to, insert) of a Markdown source, in order, after which its prose reads as ``replacement``.

    Markup stays even around nothing, where it may become prose (the back-ticks of an emptied code span).
    """
    return _edit_lists(source, replacement)


def applied(source: Column, edits: Column) -> Column:
    """The source with its edits made, from the last to the first."""
    step = lambda text, e: F.concat(F.substring(text, F.lit(1), e["from"]), e["insert"], F.substring(text, e["to"] + 1, F.lit(2**31 - 1)))
    return F.aggregate(F.reverse(edits), source, step)
