"""Vectorised word and shingle hashing over Arrow string columns.

A word is a run of bytes other than space and ``\\x09-\\x0D``.  All these bytes are
ASCII, so splitting the UTF-8 buffer equals splitting the decoded text.  Every helper
works on whole texts; long buffers are cut at white space and hashed piece by piece, so
temporaries stay small however long one text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240601)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MAX_WORD = 4096
_POWERS = np.cumprod(np.full(_MAX_WORD, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)
PIECE = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else offsets


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cut = np.flatnonzero(np.diff(size // limit, prepend=0)) + 1
    cut = np.unique(np.concatenate([[0], cut, [batch.num_rows]]))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; words never cross a row's border."""
    space = _SPACE[data]
    before = np.ones(len(data), dtype=bool)
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.ones(len(data), dtype=bool)
    after[:-1] = space[1:]
    inner = offsets[1:-1]
    after[inner[inner > 0] - 1] = True
    return np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that hold no bytes between them but white space."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = _BYTE[data[at + np.repeat(starts, lengths)]]
    power = _POWERS[at % _MAX_WORD]
    if lengths.max() > _MAX_WORD:  # beyond the table, the number of the stretch counts as well
        far = np.flatnonzero(at >= _MAX_WORD)
        power[far] *= mix((at[far] // _MAX_WORD).astype(np.uint64)) | np.uint64(1)
    values *= power
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _MULT)


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and each row's offsets into them."""
    data, offsets = text_buffer(column)
    if lower:
        data = _LOWER[data]
    starts, ends = word_spans(data, offsets)
    rows = np.searchsorted(starts, offsets)
    out = np.empty(len(starts), np.uint64)
    step = 300_000
    for a in range(0, len(starts), step):
        out[a : a + step] = _hash_spans(data, starts[a : a + step], ends[a : a + step])
    return out, rows


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` consecutive words from each place; ``len(words) - n + 1`` of them."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for k in range(1, n):
        out *= _MULT
        out += words[k : k + count]
    return mix(out)


def row_grams(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``gram_hashes`` without those that cross a row's border, and each row's offsets."""
    every = gram_hashes(words, n)
    sizes = np.maximum(np.diff(rows) - (n - 1), 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.repeat(rows[:-1], sizes) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
    return every[keep], offsets


def shingle_sets(words: np.ndarray, rows: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct ``n``-word shingles, sorted; a shorter row's words are one shingle."""
    grams, offsets = row_grams(words, rows, n)
    parts, sizes = [], np.zeros(len(rows) - 1, np.int64)
    for i in range(len(rows) - 1):
        a, b = rows[i], rows[i + 1]
        if b - a >= n:
            own = np.unique(grams[offsets[i] : offsets[i + 1]])
        elif b > a:
            own = mix(gram_hashes(words[a:b], int(b - a)) + np.uint64(b - a))
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
