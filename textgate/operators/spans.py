"""Ranges of documents: what is no prose, spans clear of other spans, and offsets carried through edits.

Spans are (key, start, end), start included and end not.  Every join of spans is one ordered sweep of
each key with running values: no pairs are made, and a key with very many ranges costs a sort.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgate.operators import segment

# ---- ranges that are no prose

_FRONT = re.compile(r"---[ \t]*\r?\n(?:.*\r?\n)*?(?:---|\.\.\.)[ \t]*(?:\r?\n|\Z)")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*(?:\n|\Z)", re.MULTILINE)
#: Where a range may begin; each beginning has a way to its end.
_BEGIN = re.compile(r"^ {0,3}(?:`{3,}|~{3,})|<!--|%%|\$\$|`+|\$(?=[^\s$])|</?[a-zA-Z]", re.MULTILINE)
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9-]*(?:\s[^<>]*)?/?>")
_INLINE_MATH = re.compile(r"\$[^\s$](?:[^\n$]{0,1000}[^\s$])?\$(?![0-9])")


class _Ahead:
    """Finds of fixed strings from rising places; what is not there is looked for once."""

    def __init__(self, text: str):
        self.text, self.none = text, set()

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.none.add(what)
        return found


def not_prose(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind of front matter, code, comments, math and tags, outermost alone, in order.

    Fences and comments without an end reach to the text's end; other beginnings without an end are prose.
    """
    at, ahead = 0, _Ahead(text)
    if m := _FRONT.match(text):
        yield 0, m.end(), "frontmatter"
        at = m.end()
    runs: dict[int, list[int]] | None = None
    while m := _BEGIN.search(text, at):
        a, mark = m.start(), m[0]
        end, kind = -1, ""
        if fence := (_FENCE.match(text, a) if mark.lstrip(" ")[:3] in ("```", "~~~") else None):
            close = re.compile(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*(?:\n|\Z)", re.MULTILINE).search(text, fence.end())
            end, kind = close.end() if close else len(text), "code"
        elif mark == "<!--":
            close = ahead.find("-->", m.end())
            end, kind = close + 3 if close >= 0 else len(text), "comment"
        elif mark in ("%%", "$$"):
            close = ahead.find(mark, m.end())
            end, kind = close + 2 if close >= 0 else -1, "comment" if mark == "%%" else "math"
        elif mark[0] == "`":
            if runs is None:  # places of back-tick runs by their length, last first
                runs = {}
                for r in re.finditer("`+", text):
                    runs.setdefault(len(r[0]), []).append(r.start())
                for places in runs.values():
                    places.reverse()
            places = runs.get(len(mark), [])
            while places and places[-1] <= a:
                places.pop()
            if places:
                end, kind = places[-1] + len(mark), "code"
        elif mark[0] == "$":
            if hit := _INLINE_MATH.match(text, a):
                end, kind = hit.end(), "math"
        elif hit := _TAG.match(text, a):
            end, kind = hit.end(), "html"
        if kind and end > a:
            yield a, end, kind
            at = end
        else:
            at = m.end()


def excluded_ranges(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``start``, ``end`` and ``kind`` of what no proposer may be shown; rows are read one by one, a null text has none."""
    df = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segment._few(batches):
            rows, starts, ends, kinds = [], [], [], []
            for row, value in enumerate(batch.column("text")):
                for a, b, kind in not_prose(value.as_py() or ""):
                    rows.append(row)
                    starts.append(a)
                    ends.append(b)
                    kinds.append(kind)
            yield pa.record_batch([batch.column("key").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds, pa.string())], names=["key", "start", "end", "kind"])

    return df.mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, start long, end long, kind string").withColumnRenamed("key", key)


# ---- spans against spans


def touched(spans: DataFrame, ranges: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Adds ``touched``: whether some range of the key, whatever other ranges it overlaps, has a place in common with the span.

    A range that begins at or before the span touches it if the largest end of those reaches into it; one that begins
    inside touches it: the largest end so far is carried forwards, and the nearest start backwards.  Empty ranges and empty
    spans have no place.  Spans and ranges with a null key touch nothing.
    """
    kind = spans.schema[start].dataType
    rows = spans.select(F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias("__row"), F.col(key).alias("__key"), F.col(start).alias("__at"), F.lit(1).alias("__kind"))
    other = ranges.where((F.col(start) < F.col(end)) & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(start).cast(kind).alias("__at"), F.lit(0).alias("__kind"), F.col(end).cast(kind).alias("__end"))
    both = rows.unionByName(other, allowMissingColumns=True)
    so_far = Window.partitionBy("__key").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = Window.partitionBy("__key").orderBy(F.desc("__at"), F.desc("__kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.when(F.col("__kind") == 0, F.col("__at"))
    met = both.withColumn("__reach", F.max("__end").over(so_far)).withColumn("__next", F.last(begun, True).over(from_here)).where("__kind = 1")
    a, b = F.col(f"__row.{start}"), F.col(f"__row.{end}")
    some = (a < b) & ((F.col("__reach") > a) | (F.col("__next") < b))
    return met.select("__row.*", F.coalesce(some, F.lit(False)).alias("touched"))


def clear_of(spans: DataFrame, ranges: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """The spans that no range of their key has a place in common with: an anti-join on overlap."""
    return touched(spans, ranges, key, start, end).where("not touched").drop("touched")


def why_left_out(sentence: Column, complete: Column, excluded: Column) -> Column:
    """Why a sentence is not for a proposer, the first of: it lies in what is no prose, has no letter, opens a fence, is unfinished; null if it is."""
    return (
        F.when(excluded, "excluded").when(~sentence.rlike("\\p{L}"), "no-letter").when(sentence.rlike("(?m)^[\\s\\u00a0]{0,3}(?:```|~~~)"), "fence").when(~F.coalesce(complete, F.lit(False)), "incomplete")
    )


def eligible(sentences: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentences with ``left_out``: null for those that a proposer may be shown, or why not."""
    met = touched(sentences, ranges, key)
    return met.withColumn("left_out", why_left_out(F.col("sentence"), F.col("complete"), F.col("touched"))).drop("touched")


# ---- offsets through a change set

#: What is met at one place, in order: the end of a replacement, its start, a mark that stays, an insertion, a mark that moves on.
_CLOSE, _OPEN, _STAYS, _INSERT, _MOVES = range(5)


def reanchored(marks: DataFrame, edits: DataFrame, key: str, at: str = "at", side: str = "side", start: str = "start", end: str = "end", size: str = "size") -> DataFrame:
    """Marks with ``now``, their offset after all edits of their key, and ``deleted``, whether what they stood in is gone.

    An edit puts ``size`` characters for those from ``start`` to ``end``; all are in old offsets, and edits of a key do not
    overlap.  A mark with a negative ``side`` stays before what is inserted at its place, any other goes behind it; one inside
    what is replaced goes to its beginning or end.  Marks keep their other columns; keys without edits keep their offsets.
    """
    rows = marks.select(F.struct(*[F.col(f"`{c}`") for c in marks.columns]).alias("__row"), F.col(key).alias("__key"), F.col(at).cast("long").alias("__at"), F.when(F.col(side) < 0, _STAYS).otherwise(_MOVES).alias("__kind"))
    a, b, n = (F.col(c).cast("long") for c in (start, end, size))
    delta, opened = (n - (b - a)).alias("__delta"), F.struct(a.alias("start"), b.alias("end"), n.alias("size")).alias("__open")
    spot = lambda place, kind, *more: F.struct(place.alias("__at"), F.lit(kind).alias("__kind"), *more)
    none = F.lit(None).cast("struct<start:bigint,end:bigint,size:bigint>").alias("__open")
    insertion = F.array(spot(a, _INSERT, delta, none))
    replacement = F.array(spot(a, _OPEN, F.lit(0).cast("long").alias("__delta"), opened), spot(b, _CLOSE, delta, none))
    events = edits.select(F.col(key).alias("__key"), F.explode(F.when(a == b, insertion).otherwise(replacement)).alias("e")).select("__key", "e.*")
    both = rows.unionByName(events, allowMissingColumns=True)
    over = Window.partitionBy("__key").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("__moved", F.coalesce(F.sum("__delta").over(over), F.lit(0))).withColumn("__in", F.last("__open", True).over(over)).where(f"__kind in ({_STAYS}, {_MOVES})")
    inside = F.coalesce((F.col("__in.start") < F.col("__at")) & (F.col("__at") < F.col("__in.end")), F.lit(False))
    put = F.col("__in.start") + F.when(F.col("__kind") == _MOVES, F.col("__in.size")).otherwise(0)
    return met.select("__row.*", (F.col("__moved") + F.when(inside, put).otherwise(F.col("__at"))).alias("now"), inside.alias("deleted"))
