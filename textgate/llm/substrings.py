"""Removal of word passages that an earlier document also has.

A window of ``window`` words is removed from a document if the same words start in a document
with a smaller id.  Two indexes find such windows.

*Suffix automata of hot reference shards.*  Passages that many documents share are read from
their earliest document, dealt to shards of bounded size, and compiled into suffix automata
that are broadcast; their total size has a fixed bound.  Documents that hold such a passage
are streamed through them: the matching statistic at each word is the longest match that ends
there, and where it reaches the window, the state's smallest reference id decides.

*Sharded fingerprints for the rest.*  All passages of a corpus cannot be broadcast, so what the
automata leave open goes to the task that holds its anchor: the smallest hash among the short
word runs inside the window.  Equal windows have equal anchors, and neighbouring windows mostly
share one, so they travel together.  There, sorted by anchor and id, each window's first
document is the smallest.  Within an anchor 48 bits tell windows apart (the anchor's own 64
bits come on top).  Anchors that a count finds very frequent are split by the window's own
hash, so a common phrase with different words around it fills no task.

Defined cases: a null text has no words; a text shorter than a window loses nothing; rows with
a null id are neither compared nor removed from; repeated rows with equal id and text are one
document and get the same result; rows of one id with different texts are judged each on its
own; ties cannot be, as the smaller id decides; very long texts are read whole, in pieces; an
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgate.llm import _words
from textgate.llm._store import stored


@dataclass(frozen=True)
class Substrings:
    """Hot references: at most ``hot_passages`` passages of ``2 * reach + window`` words."""

    window: int = 13
    anchor: int = 4
    sample: int = 64
    hot_docs: int = 16
    hot_passages: int = 512
    #: an anchor of this many sampled windows is split, or of this part of all of them if that is more
    hot_anchor: int = 256
    hot_part: int = 100_000
    reach: int = 200
    shard_words: int = 20_000
    run: int = 24


class SuffixAutomaton:
    """Of word sequences with ids; each state knows the smallest id its matches end in."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [1 << 62]

    def add(self, words: list[bytes], doc: int) -> None:
        """Adds one passage; matches never cross passages, as every one starts at the root."""
        last = 0
        for w in words:
            last = self._extend(last, w, doc)

    def _extend(self, last: int, w: bytes, doc: int) -> int:
        known = self.next[last].get(w)
        if known is not None and self.length[known] == self.length[last] + 1:
            self.first[known] = min(self.first[known], doc)
            return known
        if known is not None:
            return self._clone(last, w, known, doc)
        state = self._new({}, self.length[last] + 1, 0, doc)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q, 1 << 62)
        return state

    def _clone(self, p: int, w: bytes, q: int, doc: int) -> int:
        copy = self._new(dict(self.next[q]), self.length[p] + 1, self.link[q], doc)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _new(self, moves: dict[bytes, int], length: int, link: int, doc: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(doc)
        return len(self.next) - 1

    def close(self) -> None:
        """Hands each state's smallest id down its suffix links."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            self.first[up] = min(self.first[up], self.first[s])

    def ends(self, words: list[bytes], window: int, doc: int) -> Iterator[int]:
        """Places where a window ends that a reference with a smaller id than ``doc`` has."""
        state = matched = 0
        moves, link, length, first = self.next, self.link, self.length, self.first
        for i, w in enumerate(words):
            while state and w not in moves[state]:
                state = link[state]
                matched = length[state]
            to = moves[state].get(w)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                if first[at] < doc:
                    yield i


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _anchors(words: np.ndarray, rows: np.ndarray, cuts: np.ndarray, cfg: Substrings) -> np.ndarray:
    """The smallest short-run hash within each window."""
    if not cuts[-1]:
        return np.zeros(0, np.uint64)
    sizes = np.diff(cuts)
    every = _sliding_min(_words.gram_hashes(words, cfg.anchor), cfg.window - cfg.anchor + 1)
    return every[np.repeat(rows[:-1], sizes) + np.arange(cuts[-1]) - np.repeat(cuts[:-1], sizes)]


def hot_anchors(docs: DataFrame, cfg: Substrings) -> np.ndarray:
    """Anchors of very many windows, sorted, from a sample of windows; at most ``hot_part`` of them, whatever the input."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch):
                words, rows = _words.word_hashes(part.column("text"))
                grams, cuts = _words.row_grams(words, rows, cfg.window)
                some = np.flatnonzero(_words.mix(grams) % np.uint64(cfg.sample) == 0)
                key, n = np.unique(_anchors(words, rows, cuts, cfg)[some].view(np.int64), return_counts=True)
                yield pa.record_batch([pa.array(key), pa.array(n)], names=["anchor", "n"])

    seen = stored(docs.select("text").mapInArrow(sampled, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= cfg.hot_anchor), "anchors")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = seen.where(F.col("n") >= max(cfg.hot_anchor, total // cfg.hot_part)).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in many], np.int64).view(np.uint64))


def hot_automata(docs: DataFrame, cfg: Substrings) -> tuple[np.ndarray, list[SuffixAutomaton]]:
    """Hashes that mark a hot passage, sorted, and the automata of the reference shards."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch):
                grams, cuts = _words.row_grams(*_words.word_hashes(part.column("text")), cfg.window)
                some = np.flatnonzero(grams % np.uint64(cfg.sample) == 0)
                row = np.searchsorted(cuts, some, side="right") - 1
                ids = part.column("doc_id").to_numpy()[row]
                order = np.lexsort((ids, grams[some]))
                key, doc = grams[some][order], ids[order]
                fresh = np.ones(len(key), bool)
                fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                key, doc = key[fresh], doc[fresh]
                head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                yield pa.record_batch([pa.array(key[head].view(np.int64)), pa.array(doc[head]), pa.array(np.diff(np.concatenate([head, [len(key)]])))], names=["gram", "first", "n"])

    seen = docs.mapInArrow(sampled, "gram long, first long, n long").groupBy("gram").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    hot = seen.where(F.col("n") >= cfg.hot_docs).orderBy(F.desc("n"), "gram").limit(cfg.hot_passages).collect()
    marks = np.sort(np.array([r["gram"] for r in hot], np.int64).view(np.uint64))
    if not len(marks):
        return marks, []
    wanted = docs.sparkSession.sparkContext.broadcast(marks)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch):
                grams, cuts = _words.row_grams(*_words.word_hashes(part.column("text")), cfg.window)
                hit = np.flatnonzero(np.isin(grams, wanted.value))
                row = np.searchsorted(cuts, hit, side="right") - 1
                out: list[tuple[int, int, bytes]] = []
                for r in np.unique(row):
                    words, id_ = _split(part.column("text")[int(r)].as_py()), part.column("doc_id")[int(r)].as_py()
                    for h in hit[row == r]:
                        p = int(h - cuts[r])
                        out.append((id_, grams[h].view(np.int64), b" ".join(words[max(0, p - cfg.reach) : p + cfg.window + cfg.reach])))
                yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["doc_id", "gram", "words"])

    # the earliest document of each mark alone: at most hot_passages texts, so a broadcast of their ids
    first = docs.sparkSession.createDataFrame([(r["first"],) for r in hot], "doc_id long").distinct()
    found = docs.join(F.broadcast(first), "doc_id").mapInArrow(passages, "doc_id long, gram long, words binary")
    found = found.groupBy("gram").agg(F.min_by("words", F.struct("doc_id", "words")).alias("words"), F.min("doc_id").alias("doc_id"))
    shards, size = [SuffixAutomaton()], 0
    for r in sorted(found.collect(), key=lambda r: (r["doc_id"], r["gram"])):
        words = bytes(r["words"]).split()
        if size + len(words) > cfg.shard_words:
            shards.append(SuffixAutomaton())
            size = 0
        shards[-1].add(words, r["doc_id"])
        size += len(words)
    for s in shards:
        s.close()
    return marks, shards


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


#: ``head`` packs a run's first window (32 bits), number of windows (5) and mask of covered ones (24).
SENT = "anchor long, doc_id long, mark short, head long, prints binary"


def _send(part: pa.RecordBatch, marks: np.ndarray, shards: list[SuffixAutomaton], hot: np.ndarray, cfg: Substrings) -> pa.RecordBatch:
    """Runs of windows that share an anchor: those known to be covered as a mask, the others' fingerprints."""
    words, rows = _words.word_hashes(part.column("text"))
    grams, cuts = _words.row_grams(words, rows, cfg.window)
    ids, text_marks = part.column("doc_id").to_numpy(), part.column("mark").to_numpy()
    sizes = np.diff(cuts)
    row = np.repeat(np.arange(part.num_rows), sizes)
    doc = ids[row]
    known = np.zeros(len(grams), bool)
    if len(marks) and len(grams):
        at = np.minimum(np.searchsorted(marks, grams), len(marks) - 1)
        for r in np.unique(row[marks[at] == grams]):
            own = _split(part.column("text")[int(r)].as_py())
            for shard in shards:
                for end in shard.ends(own, cfg.window, int(ids[r])):
                    known[cuts[r] + end - cfg.window + 1] = True
    # windows that an earlier document of this slice has
    order = np.lexsort((doc, grams))
    key = grams[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    least = np.repeat(doc[order][head], np.diff(np.concatenate([head, [len(key)]]))) if len(key) else doc
    known[order] |= doc[order] > least
    place = np.arange(len(grams)) - np.repeat(cuts[:-1], sizes)
    anchor = _anchors(words, rows, cuts, cfg)
    if len(hot) and len(grams):
        # equal windows still meet, as both hashes are the same for them
        split = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
        anchor = np.where(split, _words.mix(anchor ^ grams), anchor)
    new = np.ones(len(grams), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    run = np.flatnonzero(new)
    since = np.arange(len(grams)) - np.repeat(run, np.diff(np.concatenate([run, [len(grams)]]))) if len(grams) else place
    run = np.flatnonzero(since % cfg.run == 0)
    n = np.diff(np.concatenate([run, [len(grams)]]))
    bit = since % cfg.run
    mask = np.add.reduceat(known.astype(np.int64) << bit, run) if len(run) else np.zeros(0, np.int64)
    body = np.ascontiguousarray(grams[~known])
    body = body.view(np.uint8).reshape(-1, 8)[:, :6].ravel() if len(body) else np.zeros(0, np.uint8)
    length = np.add.reduceat(~known, run, dtype=np.int64) if len(run) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(6 * length)]).astype(np.int32)
    prints = pa.Array.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])
    # a run without open windows only carries its mask: any task will do
    where = np.where(length > 0, anchor[run], _words.mix(doc[run].astype(np.uint64) + place[run].astype(np.uint64)))
    return pa.record_batch(
        [pa.array(where.view(np.int64)), pa.array(doc[run]), pa.array(text_marks[row[run]]), pa.array((place[run].astype(np.int64) << 29) | (n.astype(np.int64) << 24) | mask), prints],
        names=["anchor", "doc_id", "mark", "head", "prints"],
    )


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of covered windows, from rows sorted by anchor and id; an anchor may go on in the next batch."""
    last_anchor, last_key, last_doc = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, doc = (batch.column(c).to_numpy() for c in ("anchor", "doc_id"))
        start = batch.column("head").to_numpy()
        start, n, mask = start >> 29, (start >> 24) & 31, start & 0xFFFFFF
        prints = batch.column("prints")
        lengths = np.diff(np.frombuffer(prints.buffers()[1], np.int32)[prints.offset : prints.offset + len(prints) + 1]) // 6
        body = np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(-1, 6)
        low = np.zeros((len(body), 8), np.uint8)
        low[:, :6] = body
        own = np.repeat(np.arange(batch.num_rows), lengths)
        key = _words.mix(_words.mix(anchor.view(np.uint64))[own] ^ low.view(np.uint64).ravel())
        owner = doc[own]
        # open windows are the zero bits of the mask, in order
        width = int(n.max())
        open_bits = ((mask[:, None] >> np.arange(width)) & 1 == 0) & (np.arange(width) < n[:, None]) & (lengths > 0)[:, None]
        bit = np.nonzero(open_bits)[1]
        if last_anchor is not None and anchor[0] == last_anchor:
            every_key, every_doc = np.concatenate([last_key, key]), np.concatenate([last_doc, owner])
        else:
            every_key, every_doc, last_key = key, owner, last_key[:0]
        order = np.lexsort((every_doc, every_key))
        sorted_key = every_key[order]
        head = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if len(order) else np.zeros(0, np.int64)
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(every_doc[order][head], np.diff(np.concatenate([head, [len(order)]]))) if len(order) else 0
        least = least[len(last_key) :]
        found = np.bincount(own, ((owner > least).astype(np.int64) << bit).astype(np.float64), batch.num_rows).astype(np.int64)
        tail = anchor[own] == anchor[-1]
        keys, first = np.unique(key[tail], return_index=True)
        docs = least[tail][first]
        if last_anchor is not None and anchor[0] == anchor[-1] == last_anchor and len(last_key):
            rest = ~np.isin(last_key, keys)
            keys, docs = np.concatenate([last_key[rest], keys]), np.concatenate([last_doc[rest], docs])
        last_anchor, last_key, last_doc = anchor[-1], keys, docs
        both = found | mask
        some = np.flatnonzero(both)
        span = (start << 32) | both
        yield pa.record_batch([batch.column("doc_id").take(pa.array(some)), batch.column("mark").take(pa.array(some)), pa.array(span[some])], names=["doc_id", "mark", "span"])


def _finish(text: str | None, spans: list[int] | None, window: int) -> tuple[int, int, bytes]:
    words = _split(text)
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        start, mask = s >> 32, s & 0xFFFFFFFF
        while mask:
            low = (mask & -mask).bit_length() - 1
            gone[start + low] += 1
            gone[min(start + low + window, len(words))] -= 1
            mask &= mask - 1
    # several rows of one id give the same windows again: only covered or not matters
    removed = np.cumsum(gone[:-1]) > 0
    return len(words), int(removed.sum()), b" ".join(w for w, r in zip(words, removed.tolist(), strict=True) if not r)


def repeated_spans(docs: DataFrame, cfg: Substrings = Substrings()) -> DataFrame:
    """``doc_id``, ``mark`` and the list of covered windows (start and mask) of documents that have some."""
    valid = docs.where("doc_id is not null")
    marks, shards = hot_automata(valid.select("doc_id", "text"), cfg)
    shared = docs.sparkSession.sparkContext.broadcast((marks, shards, hot_anchors(valid, cfg)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch):
                yield _send(part, *shared.value, cfg)

    sent = valid.mapInArrow(send, SENT).repartition("anchor").sortWithinPartitions("anchor", "doc_id")
    return sent.mapInArrow(_resolve, "doc_id long, mark short, span long").groupBy("doc_id", "mark").agg(F.collect_list("span").alias("spans"))


def _marked(base: DataFrame) -> DataFrame:
    """Adds ``mark``, which tells the different texts of one id apart: 0 wherever an id has one text."""
    texts = base.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("hash"))
    several = stored(texts.groupBy("doc_id").agg(F.array_sort(F.collect_set("hash")).alias("hashes")).where("size(hashes) > 1"), "several")
    if not several.limit(1).count():
        return base.withColumn("mark", F.lit(0).cast("short"))
    numbered = several.select(F.col("doc_id").alias("__id"), F.posexplode("hashes").alias("__mark", "__hash"))
    joined = base.join(numbered, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    return joined.select("doc_id", "text", F.coalesce("__mark", F.lit(0)).cast("short").alias("mark"))


def remove_repeats(docs: DataFrame, cfg: Substrings = Substrings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text`` of every document."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = _marked(base)
    joined = base.join(repeated_spans(base, cfg), ["doc_id", "mark"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch):
                out = [_finish(t, s, cfg.window) for t, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True)]
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string()), pa.array([o[2].decode("utf-8", "replace") for o in out], pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


#: The digest columns of ``remove_repeats``.
ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM g JOIN f USING (s) WHERE f.first < g.doc_id),
k AS (SELECT w.doc_id, p.i, w.words[p.i] AS word FROM w, unnest(range(1, len(w.words) + 1)) AS p(i)),
l AS (SELECT k.doc_id, count(*) AS n, count(c.i) AS gone, coalesce(string_agg(k.word, ' ' ORDER BY k.i) FILTER (c.i IS NULL), '') AS kept FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.i = k.i GROUP BY k.doc_id)
SELECT w.doc_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_words, CAST(coalesce(l.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(l.kept, '')) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id)
"""
