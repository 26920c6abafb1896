"""Places in texts: tokens and clauses with their offsets, and addresses with line, column and what they stand in.

Texts are read where Spark holds them, in Arrow batches, in time in proportion to them.  Offsets count code points.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textgate.functions import lexicons as lex
from textgate.functions import masks
from textgate.functions.patterns import PY_BLANK

_SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_SPACED = T.StructType([*_SPAN.fields, T.StructField("space", T.BooleanType())])
_TOKEN = re.compile(f"(?P<space>[{PY_BLANK}]+)|[^\\W_]+(?:['’][^\\W\\d_]+)*|(?:[^\\w{PY_BLANK}]|_)+")
_CUT = re.compile(f"[\\n;|]|[.:?!](?=[{PY_BLANK}]|\\Z)")


@F.pandas_udf(T.ArrayType(_SPACED))
def _tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else [{"text": m[0], "start": m.start(), "end": m.end(), "space": m["space"] is not None} for m in _TOKEN.finditer(t)] for t in texts], dtype=object)


def token_spans(text: Column, spaces: bool = False) -> Column:
    """Tokens (``text``, ``start``, ``end``, ``space``), and on request the white space between, so that they are the text; null for null."""
    return _tokens(text) if spaces else F.filter(_tokens(text), lambda t: ~t["space"])


@F.pandas_udf(T.ArrayType(_SPAN))
def _clauses(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        out = []
        for t in texts:
            edges = [0] if t is None else [0, *(p for m in _CUT.finditer(t) for p in m.span()), len(t)]
            out.append(None if t is None else [{"text": t[a:b], "start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b])
        yield pd.Series(out, dtype=object)


def clause_spans(text: Column) -> Column:
    """Clauses (``text``, ``start``, ``end``), cut as ``segment.clauses`` cuts them."""
    return _clauses(text)


def trimmed_span(text: Column, start: Column, end: Column) -> Column:
    """A stretch of a text without the blanks at its ends: (``text``, ``start``, ``end``); what is blank alone is empty at its end."""
    inner = F.substring(text, start + 1, end - start)
    head = F.length(F.regexp_extract(inner, f"^[{PY_BLANK}]*+", 0))
    rest = F.substring(inner, head + 1, F.length(inner))
    told = F.regexp_replace(rest, f"(?<![{PY_BLANK}])[{PY_BLANK}]++$", "")
    return F.struct(told.alias("text"), (start + head).cast("int").alias("start"), (start + head + F.length(told)).cast("int").alias("end"))


# ---- addresses

_URL = re.compile(lex.ABSOLUTE_ADDRESS, re.IGNORECASE)
_RELATIVE = re.compile(lex.RELATIVE_ADDRESS, re.IGNORECASE)
_REQUESTS = [(re.compile(p, re.IGNORECASE), name) for p, name in lex.REQUEST_PLACES]
#: Characters before an address that are looked at, and characters told of one without a scheme.
_BEFORE, _TOLD = 60, 60


def _addresses(text: str) -> Iterator[tuple[int, str, str, str]]:
    for m in _URL.finditer(text):
        before = text[max(0, m.start() - _BEFORE) : m.start()]
        yield m.start(), m[0], re.split("[/?#]", m[0].split("://", 1)[1], maxsplit=1)[0], next((name for p, name in _REQUESTS if p.search(before)), lex.MENTIONED)
    for m in _RELATIVE.finditer(text):
        yield m.start(), text[m.start() : m.start() + _TOLD].split("\n")[0].strip(), lex.NO_SCHEME, lex.INHERITS


def addresses(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every absolute or scheme-less address: ``key``, ``line``, ``column``, ``start``, ``url``, ``host``, ``position`` and ``loopback``.

    ``position`` says what the address stands in: an attribute, a style, a call, or a mention alone.  Lines and columns count from 1;
    the rows of a text come in order of their kind and place.  A null text has none; rows are read one by one.
    """
    df = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[tuple] = []
            for row, value in enumerate(batch.column("text")):
                whole = value.as_py() or ""
                begins: list[int] | None = None
                for at, url, host, position in _addresses(whole):
                    if begins is None:
                        begins = [0, *(m.end() for m in re.finditer("\n", whole))]
                    line = bisect.bisect_right(begins, at)
                    rows.append(row)
                    found.append((line, at - begins[line - 1] + 1, at, url, host, position))
            line, column, start, url, host, position = zip(*found, strict=True) if found else ((),) * 6
            yield pa.record_batch(
                [batch.column("key").take(pa.array(rows, pa.int64())), pa.array(line, pa.int32()), pa.array(column, pa.int32()), pa.array(start, pa.int32()), pa.array(url, pa.string()), pa.array(host, pa.string()), pa.array(position, pa.string())],
                names=["key", "line", "column", "start", "url", "host", "position"],
            )

    out = df.mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, line int, column int, start int, url string, host string, position string")
    return out.withColumn("loopback", masks.is_loopback(F.regexp_replace("host", ":[0-9]+$", ""))).withColumnRenamed("key", key)
