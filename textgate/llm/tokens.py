"""Exact token counts from a compiled finite-state transducer.

The tokenizer is a cascade.  A small transducer over character classes splits a text into
pieces (contractions, letter runs, single numbers, other runs); its transitions say whether a
piece begins.  A second, over bytes, counts a piece's byte-pair tokens; its transitions carry
the number of tokens that become certain.

*Splitting in parallel.*  Text is laid out in equal chunks, one a lane.  Every lane first
runs the splitter from each of its few states, which gives the chunk's map from state to
state; a prefix scan composes these maps in a logarithmic number of steps and so tells every
lane its true start.  A second run from there marks the pieces.

*Counting.*  A byte-pair encoding is the one token sequence in which every two neighbours
would also stay apart on their own.  So what matters after a prefix is, for each of its
suffixes that may still grow into a token, the token before that suffix and the count so far.
That is the transducer's state; states and transitions are compiled when first met, and equal
residues share a state.  All pieces of a batch descend together, one gather a byte.  Their
number is bounded, and they are compiled afresh when it is reached.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgate.llm import _words

TOKENIZER = "word_bpe_49k.json"
# Classes of the splitter: white space, letters that may follow an apostrophe, other letters, numbers, apostrophe, rest.
_SPACE, _NUMBER, _REST, _APOSTROPHE, _LETTER = range(5)
_TAILS = "stmdrvle"
_CLASSES = 5 + len(_TAILS)
# States after a character: between pieces, in letters, after a number, in a run of the rest, after an opening
# apostrophe, then after 'r or 'v (e may follow) and after 'l (l may follow), and after a whole contraction.
_GAP, _WORD, _NUM, _RUN, _OPEN, _OPEN_E, _OPEN_L, _DONE = range(8)
_STATES = 8


def _splitter() -> np.ndarray:
    """Next state by (state, class)."""
    table = np.zeros((_STATES, _CLASSES), np.uint8)
    for state in range(_STATES):
        for c in range(_CLASSES):
            tail = _TAILS[c - 5] if c >= 5 else ""
            letter = c == _LETTER or bool(tail)
            if state == _OPEN and tail in tuple("stmd"):
                to = _DONE
            elif state == _OPEN and tail in ("r", "v"):
                to = _OPEN_E
            elif state == _OPEN and tail == "l":
                to = _OPEN_L
            elif (state == _OPEN_E and tail == "e") or (state == _OPEN_L and tail == "l"):
                to = _DONE
            elif letter:
                to = _WORD
            elif c == _NUMBER:
                to = _NUM
            elif c == _SPACE:
                to = _GAP
            elif c == _APOSTROPHE and state not in (_RUN, _OPEN):
                to = _OPEN
            else:
                to = _RUN
            table[state, c] = to
    return table


SPLIT = _splitter()
CHUNK = 128


def classes(codes: np.ndarray) -> np.ndarray:
    """The class of each code point, one lookup for each distinct one beyond ASCII."""
    small = np.array([_class(chr(c)) for c in range(128)], np.uint8)
    out = small[np.minimum(codes, 127)]
    wide = np.flatnonzero(codes > 127)
    if len(wide):
        distinct, back = np.unique(codes[wide], return_inverse=True)
        out[wide] = np.array([_class(chr(c)) for c in distinct], np.uint8)[back]
    return out


def _class(c: str) -> int:
    if c == "'":
        return _APOSTROPHE
    if c in _TAILS:
        return 5 + _TAILS.index(c)
    kind = unicodedata.category(c)[0]
    if kind == "L":
        return _LETTER
    if kind == "N":
        return _NUMBER
    return _SPACE if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else _REST


def chunk_starts(lanes: np.ndarray) -> np.ndarray:
    """The splitter's state before each lane of a (place, lane) array of classes.

    A lane's map from start to end state is constant once all its runs have met, as they do at
    the first white space; only lanes whose runs are still apart are run from every state.
    """
    n = lanes.shape[1]
    one = np.full(n, _GAP, np.uint8)
    for row in lanes:
        one = SPLIT[one, row]
    maps = np.repeat(one[:, None], _STATES, axis=1)  # lane, start state -> end state
    open_lanes, state = np.arange(n), np.repeat(np.arange(_STATES, dtype=np.uint8)[:, None], n, axis=1)
    for k, row in enumerate(lanes):
        state = SPLIT[state, row[open_lanes]]
        if k % 8 == 7:
            apart = (state != state[0]).any(axis=0)
            open_lanes, state = open_lanes[apart], state[:, apart]
            if not len(open_lanes):
                break
    maps[open_lanes] = state.T
    shift = 1
    while shift < n:  # prefix scan under composition of maps
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.intp), axis=1)
        shift *= 2
    return np.concatenate([[_GAP], maps[:-1, _GAP]]).astype(np.uint8)


def states(kinds: np.ndarray) -> np.ndarray:
    """The splitter's state after each character."""
    width = min(CHUNK, max(1, len(kinds)))
    pad = -len(kinds) % width
    lanes = np.concatenate([kinds, np.full(pad, _SPACE, np.uint8)]).reshape(-1, width).T
    lanes = np.ascontiguousarray(lanes)
    state = chunk_starts(lanes)
    out = np.empty_like(lanes)
    for k, row in enumerate(lanes):
        state = SPLIT[state, row]
        out[k] = state
    return out.T.ravel()[: len(kinds)]


_IN_WORD = np.isin(np.arange(_STATES), (_WORD, _OPEN_E, _OPEN_L))
_IN_RUN = np.isin(np.arange(_STATES), (_RUN, _OPEN))


def piece_starts(kinds: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character.

    A letter starts one unless it continues a letter run or a contraction; what followed an
    apostrophe but made no contraction is the apostrophe alone, then letters.
    """
    n = len(kinds)
    before = np.full(n, _GAP, np.uint8)
    before[1:] = after[:-1]
    start = np.zeros(n, bool)
    # a contraction that failed after 'r, 'v or 'l: the letter there starts a word
    failed = np.zeros(n, bool)
    pending = (after == _OPEN_E) | (after == _OPEN_L)
    failed[:-1] = pending[:-1] & (after[1:] != _DONE)
    if n:
        failed[-1] = pending[-1]
    start |= failed
    start |= (after == _WORD) & ~_IN_WORD[before]
    start |= after == _NUM
    start |= (after == _RUN) & ~_IN_RUN[before]
    start |= after == _OPEN
    return start


class CountTransducer:
    """Token counts of byte strings under a byte-pair encoding with an end-of-word mark."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>", limit: int = 120_000):
        self.end, self.limit = end, limit
        self.ranks = {pair: k for k, pair in enumerate(map(tuple, merges))}
        self.text = _byte_letters()
        self.vocab = vocab
        whole = [t[: -len(end)] if t.endswith(end) else t for t in vocab]
        self.tokens = set(vocab)
        self.prefixes = {t[:k] for t in whole for k in range(1, len(t) + 1)}
        self.halves = {a + b: (k, a, b) for (a, b), k in self.ranks.items()}  # each token's last merge
        self.reset()

    def reset(self) -> None:
        # a state: the prefix's suffixes that may grow, longest first, each with the token before it and a relative count
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.column = np.full(256, -1, np.int32)
        self.columns = 0
        self.next = np.full((1024, 8), -1, np.int32)
        self.last = np.full((1024, 8), -1, np.int16)
        self.emit = np.zeros((1024, 8), np.int8)
        self._state((("", "", 0),))

    def apart(self, a: str, b: str) -> bool:
        """Whether token ``a`` before token ``b`` is how the two encode together.

        Undoes the merges next to the border, latest first: a merge across the border must never
        have come before the one just undone.  Of equal merges the left one comes first.
        """
        if not a:
            return True
        ranks, halves = self.ranks, self.halves
        limit = len(ranks)
        while True:
            across = ranks.get((a, b))
            if across is not None and across < limit:
                return False
            left, right = halves.get(a), halves.get(b)
            if left is not None and (right is None or left[0] > right[0]):
                limit, a = left[0], left[2]
            elif right is not None:
                limit, b = right[0] + 1, right[1]
            else:
                return True

    def _state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
            if found == len(self.next):
                self.next, self.last, self.emit = (np.concatenate([t, np.full_like(t, f)]) for t, f in ((self.next, -1), (self.last, -1), (self.emit, 0)))
        return found

    def _column(self, byte: int) -> int:
        if self.column[byte] < 0:
            if self.columns == self.next.shape[1]:
                self.next, self.last, self.emit = (np.concatenate([t, np.full_like(t, f)], axis=1) for t, f in ((self.next, -1), (self.last, -1), (self.emit, 0)))
            self.column[byte] = self.columns
            self.columns += 1
        return int(self.column[byte])

    def compile(self, state: int, byte: int) -> None:
        """Fills the transition on a byte within a piece and the one on a piece's last byte."""
        c, column = self.text[byte], self._column(byte)
        key = self.keys[state]
        grown = [(suffix + c, token, n) for suffix, token, n in key]
        ends = [n + 1 for suffix, token, n in grown if suffix + self.end in self.tokens and self.apart(token, suffix + self.end)]
        assert len(ends) == 1, (key, c)
        self.last[state, column] = ends[0]
        # the token that ends here, should the piece go on
        hit = [(suffix, n + 1) for suffix, token, n in grown if suffix in self.tokens and self.apart(token, suffix)]
        assert len(hit) == 1, (key, c)
        alive = [x for x in grown if x[0] in self.prefixes]
        alive.append(("", hit[0][0], hit[0][1]))
        least = min(n for _, _, n in alive)
        self.next[state, column] = self._state(tuple((s, t, n - least) for s, t, n in alive))
        self.emit[state, column] = least

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each piece ``data[start : start + length]``, all of length 1 or more."""
        if len(self.keys) > self.limit:
            self.reset()
        total = np.zeros(len(starts), np.int32)
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        alive = len(order)
        state = np.zeros(alive, np.int32)
        out = np.zeros(alive, np.int32)
        step = 0
        while alive:
            inner = int(np.searchsorted(-left[:alive], -(step + 1), side="left"))  # pieces longer than step + 1
            byte = data[at[:alive] + step]
            column = self.column[byte]
            missing = column < 0
            if not missing.any():
                missing = self.last[state[:alive], column] < 0
            if missing.any():
                for s, b in {*zip(state[:alive][missing].tolist(), byte[missing].tolist(), strict=True)}:
                    self.compile(s, b)
                column = self.column[byte]
                missing = self.last[state[:alive], column] < 0
                for s, b in {*zip(state[:alive][missing].tolist(), byte[missing].tolist(), strict=True)}:
                    self.compile(s, b)
            here = state[:alive]
            out[inner:alive] += self.last[here[inner:], column[inner:]]
            out[:inner] += self.emit[here[:inner], column[:inner]]
            state[:inner] = self.next[here[:inner], column[:inner]]
            alive, step = inner, step + 1
        total[order] = out
        return total


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[b] = chr(256 + k)
    return out


class Tokenizer:
    """Counts tokens as the vocabulary file's own library does, without added begin or end marks."""

    def __init__(self, spec: dict):
        self.transducer = CountTransducer(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        for k, text in enumerate(texts):
            text = text or ""
            if self.special and "<|" in text:
                text, extra[k] = self.special.subn("\n", text)
            if not text.isascii():
                # letter by letter, as a character map: a final sigma is no special case
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            parts.append(text.lower())
        sizes = np.array([len(p) + 1 for p in parts])
        whole = "\n".join(parts) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        kinds = classes(codes)
        start = piece_starts(kinds, states(kinds))
        width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        offset = np.cumsum(width) - width
        first = np.flatnonzero(start)
        # a piece ends where the next starts or white space comes
        edge = np.flatnonzero(start | (kinds == _SPACE))
        ends = edge[np.searchsorted(edge, first, side="right")]
        found = self.transducer.counts(data, offset[first], offset[ends] - offset[first])
        cuts = np.searchsorted(first, np.concatenate([[0], np.cumsum(sizes)]))
        total = np.concatenate([[0], np.cumsum(found, dtype=np.int64)])
        return total[cuts[1:]] - total[cuts[:-1]] + extra


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every document.

    The vocabulary at ``path`` is read once on the driver (a few MB, whatever the data) and
    broadcast.  A null or empty text has no bytes and no tokens; rows are counted one by one, so
    repeated rows and ties get equal counts; an empty table gives an empty result; other columns
    are not read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load(path))
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for batch in batches:
            tokenizer = tokenizer or Tokenizer(spec.value)
            for part in _words.slices(batch):
                yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), pa.array(tokenizer.counts(part.column("text").to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return df.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
