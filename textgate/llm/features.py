"""Document statistics from the raw bytes of Arrow strings: one row a text, one column a statistic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from textgate.llm import _words

# Byte classes.
_CLASSES = ("lower", "upper", "digit", "stop", "shout", "quote", "symbol", "bar", "line", "blank", "high")
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:", b"!?", b"'\"()-", b"#*$%&<>@^~=+/\\{}[]_`", b"|", b"\n", b" \t\r\x0b\x0c", range(128, 256))):
    _CLASS[list(_bytes)] = _k
NAMES = (
    *(f"share_{c}" for c in _CLASSES),
    "log_words",
    "word_length",
    "word_length_spread",
    "longest_word",
    "distinct_words",
    "top_word",
    "adjacent_repeats",
    "repeated_trigrams",
    "words_a_line",
    "repeated_lines",
    "stops_a_word",
    "capitals_a_word",
    "ends_with_stop",
)


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _repeats(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values and of the commonest one in each row."""
    n = len(cuts) - 1
    distinct, top = np.zeros(n), np.zeros(n)
    for i in range(n):
        if cuts[i + 1] > cuts[i]:
            own = np.sort(hashes[cuts[i] : cuts[i + 1]])
            runs = np.diff(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])))
            distinct[i], top[i] = len(runs) / len(own), runs.max() / len(own)
    return distinct, top


def statistics(column: pa.Array) -> np.ndarray:
    """Float matrix with the columns ``NAMES``; an empty or null text has zeros."""
    data, offsets = _words.text_buffer(column)
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    out = np.zeros((n, len(NAMES)))
    kinds = _CLASS[data]
    counts = np.stack([_sums(kinds == k, offsets) for k in range(len(_CLASSES))], axis=1) if len(data) else np.zeros((n, len(_CLASSES)))
    out[:, : len(_CLASSES)] = counts / size[:, None]
    starts, ends = _words.word_spans(data, offsets)
    cuts = np.searchsorted(starts, offsets)
    length = (ends - starts).astype(np.float64)
    number = np.diff(cuts)
    some = np.maximum(number, 1)
    words, _ = _words.word_hashes(column, lower=True)
    at = len(_CLASSES)
    out[:, at] = np.log1p(number)
    mean = _sums(length, cuts) / some
    out[:, at + 1] = mean
    out[:, at + 2] = np.sqrt(np.maximum(_sums(length**2, cuts) / some - mean**2, 0))
    filled = np.flatnonzero(number)
    if len(filled):
        out[filled, at + 3] = np.maximum.reduceat(length, cuts[:-1][filled])
    out[:, at + 4], out[:, at + 5] = _repeats(words, cuts)
    same = np.zeros(len(words))
    same[1:] = words[1:] == words[:-1]
    same[cuts[:-1][cuts[:-1] < len(words)]] = 0
    out[:, at + 6] = _sums(same, cuts) / some
    grams, own = _words.row_grams(words, cuts, 3)
    distinct, _ = _repeats(grams, own)
    out[:, at + 7] = np.where(np.diff(own) > 0, 1 - distinct, 0)
    lines = counts[:, _CLASSES.index("line")] + 1
    out[:, at + 8] = number / lines
    texts = column.to_pylist()
    out[:, at + 9] = [0.0 if not t or "\n" not in t else 1 - len(set(p := t.split("\n"))) / len(p) for t in texts]
    out[:, at + 10] = counts[:, _CLASSES.index("stop")] / some
    out[:, at + 11] = counts[:, _CLASSES.index("upper")] / some
    out[:, at + 12] = [float(bool(t) and t.rstrip()[-1:] in (".", "!", "?")) for t in texts]
    return out
