"""Fill-in-middle forms of documents by piece tables.

A document is a list of descriptors ``(buffer, start, end)`` over two buffers that never
change: its own UTF-8 bytes and the sentinels' bytes.  Cutting splits the descriptor that the
cut falls in, an arrangement is a permutation of descriptors with sentinels between them, and
the inverse permutation of what lies between an output's sentinels gives the document back.
Hashes read the descriptors one after the other; only the output column is ever joined.

Units are runs of ASCII letters, or one code point of another kind.  Two cuts are drawn from
the hash of the document's id; empty texts, texts that hold a sentinel and a share of all
others stay plain.

Defined cases: a null text is empty; a null id draws as an empty one, so all rows with a null
id draw alike; equal rows give equal rows; very long texts are read whole, as bytes; an empty
table gives an empty result; extra columns of any name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgate.llm import _words

TEXT, SENTINELS = 0, 1
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
MARKS = (b"<P>", b"<M>", b"<S>")  # of prefix, middle and suffix
#: The order in which the three parts stand; each follows its own sentinel.
ARRANGEMENTS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass(frozen=True)
class Infill:
    """``plain_from`` of a hundred documents are rearranged; of those, ``spm_below`` of a hundred have the suffix first."""

    seed: int = 1
    plain_from: int = 90
    spm_below: int = 20


class Piece(NamedTuple):
    buffer: int
    start: int
    end: int


Pieces = list[Piece]
Buffers = tuple[memoryview, memoryview]
_SENTINELS = memoryview(b"".join(MARKS))


def sentinel(part: int) -> Piece:
    start = sum(len(m) for m in MARKS[:part])
    return Piece(SENTINELS, start, start + len(MARKS[part]))


def cut(pieces: Pieces, at: int) -> tuple[Pieces, Pieces]:
    """The pieces before and from ``at``, counted in bytes of what they stand for."""
    left: Pieces = []
    for k, p in enumerate(pieces):
        size = p.end - p.start
        if at < size:
            head = [p._replace(end=p.start + at)] if at else []
            return left + head, [p._replace(start=p.start + at), *pieces[k + 1 :]]
        left.append(p)
        at -= size
    return left, []


def arranged(parts: tuple[Pieces, Pieces, Pieces], form: str) -> Pieces:
    """The parts in the form's order, each behind its sentinel."""
    return [p for k in ARRANGEMENTS[form] for p in (sentinel(k), *parts[k])]


def restored(output: memoryview, form: str) -> Pieces:
    """Pieces of the document within an output: what stands between the sentinels, put back in the document's order.

    No part holds a sentinel, and a sentinel's first character stands nowhere else in one, so the
    first find of each is the right one.
    """
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    order, whole = ARRANGEMENTS[form], bytes(output)
    marks, at = [], 0
    for part in order:
        at = whole.index(MARKS[part], at)
        marks.append(at)
        at += len(MARKS[part])
    ends = [*marks[1:], len(whole)]
    found = {part: Piece(TEXT, a + len(MARKS[part]), b) for part, a, b in zip(order, marks, ends, strict=True)}
    return [found[PREFIX], found[MIDDLE], found[SUFFIX]]


def streamed(buffers: Buffers, pieces: Pieces) -> Iterator[memoryview]:
    for p in pieces:
        yield buffers[p.buffer][p.start : p.end]


def digest(buffers: Buffers, pieces: Pieces) -> str:
    h = hashlib.sha256()
    for part in streamed(buffers, pieces):
        h.update(part)
    return h.hexdigest()


def unit_starts(data: np.ndarray) -> np.ndarray:
    """The first byte of each unit of UTF-8 bytes."""
    letter = _LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    return np.flatnonzero(first | (~letter & ((data & 0xC0) != 0x80)))


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _drawn(doc_id: int | None, cfg: Infill) -> list[int]:
    h = hashlib.sha256(f"{cfg.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def infill(doc_id: int | None, text: bytes, cfg: Infill = Infill()) -> tuple:
    """The row of one document."""
    data = np.frombuffer(text, np.uint8)
    starts = unit_starts(data)
    n = len(starts)
    h1, h2, h3, h4 = _drawn(doc_id, cfg)
    buffers = (memoryview(text), _SENTINELS)
    whole = [Piece(TEXT, 0, len(text))] if text else []
    if not text or any(m in text for m in MARKS) or h3 % 100 >= cfg.plain_from:
        form, table, sizes = "plain", whole, (None, None)
    else:
        form = "spm" if h4 % 100 < cfg.spm_below else "psm"
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (int(starts[k]) if k < n else len(text) for k in (low, high))
        prefix, rest = cut(whole, a)
        middle, suffix = cut(rest, b - a)
        table, sizes = arranged((prefix, middle, suffix), form), (_chars(data[:a]), _chars(data[a:b]))
    output = b"".join(streamed(buffers, table))
    back = (memoryview(output), _SENTINELS)
    return (doc_id, n, form, *sizes, output, digest(buffers, table), digest(back, restored(back[0], form)))


def fill_in_middle(docs: DataFrame, cfg: Infill = Infill(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each document row: ``doc_id``, units ``n``, ``form``, code points of prefix and middle, ``output`` and the digests of output and restored text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch, limit=8 << 20):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                rows = [infill(d, t or b"", cfg) for d, t in zip(part.column("doc_id").to_pylist(), texts, strict=True)]
                ids, n, form, prefix, middle, output, sha, back = zip(*rows, strict=True)
                whole = pa.array(output, pa.large_binary()).cast(pa.large_string())
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), whole.cast(pa.string()), pa.array(sha), pa.array(back)],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


#: The same cuts over lists of units; the restored text is the document's own.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
  CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST(h1 % (len(units) + 1) AS BIGINT) AS x, CAST(h2 % (len(units) + 1) AS BIGINT) AS y,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:least(x, y)], '') AS a, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS b, array_to_string(units[greatest(x, y) + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(coalesce(a, '')) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(coalesce(b, '')) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || coalesce(a, '') || '<S>' || coalesce(z, '') || '<M>' || coalesce(b, '') ELSE '<S>' || coalesce(z, '') || '<P>' || coalesce(a, '') || '<M>' || coalesce(b, '') END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
