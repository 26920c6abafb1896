"""Ranked lexical search: the best documents for each item, by best-first search over document intervals.

1. The items are cut into blocks whose texts have a bounded size; a block's terms go to all
   tasks.  One pass over the texts stores, for every document, its number of terms and how
   often it holds each of the block's terms.  Sums over that table give the statistics.
2. Tasks read the table in shards of at most ``shard`` documents or ``postings`` postings,
   numbered by ascending id.  A shard has one posting list for each term, all in one array,
   and a sparse table of range maxima over it.
3. An item's search holds intervals of documents in a heap.  An interval's bound is the sum,
   over the item's terms, of the weight times the largest impact of the term's postings in it.
   The interval of the highest bound is split at the document of the largest single impact,
   which is scored; small intervals are scored as a whole.  The search ends where no bound
   reaches the last of the best scores, which a task carries from shard to shard.
4. Every task gives at most ``k`` documents an item; the best of these are the result.

Nothing is dealt by term, so frequent terms skew nothing.  All statistics cover all documents.

Defined cases: a null or empty text has no term and takes no part; rows count one by one, also
those that repeat an id, and rank one after the other; a null id ranks after all others of its
score; an item without a known term has no row; repeated items with the same text count once,
with other texts each is ranked on its own; very long texts are read whole; extra columns of
any name are not read.  ``90 * n * N`` must stay below 2**63.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgate.llm import _words
from textgate.llm._store import Store

INDEX = "doc_id long, n long, terms array<int>, counts array<int>"
RESULT = "item int, doc_id long, score long"
#: A null id, in the order of ids.
NO_ID = np.iinfo(np.int64).max
# Bytes of terms, and the constants of the score.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
WEIGHT, FLAT, SLOPE, SCALE, STEP, SPREAD = 1000, 10, 90, 1_000_000_000, 1000, 8


@dataclass(frozen=True)
class Search:
    k: int = 10
    #: bytes of items whose terms are held by every task; beyond it the items go in several blocks
    block_bytes: int = 8 << 20
    shard: int = 8192
    postings: int = 1_000_000
    #: documents of an interval that are scored in one step
    leaf: int = 96


def terms(text: str | None) -> list[bytes]:
    """All terms, with repeats; only A-Z are lower-cased."""
    return TERM.findall(text.encode().lower()) if text else []


def index(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, number of terms ``n``, and the vocabulary's terms with their counts, of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            for part in _words.slices(batch):
                ids, sizes, names, counts = [], [], [], []
                for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if found := terms(t):
                        own = Counter(map(number, found))
                        own.pop(None, None)
                        ids.append(d)
                        sizes.append(len(found))
                        names.append(list(own))
                        counts.append(list(own.values()))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(names, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, INDEX)


class Shard:
    """Posting lists of some documents and their range maxima."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, cuts: np.ndarray, names: np.ndarray, counts: np.ndarray, documents: int, length: int, vocabulary: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.documents = ids[order], len(ids)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        m = FLAT + SLOPE * sizes * documents // length
        doc = np.repeat(np.arange(len(ids)), np.diff(cuts))
        impact = SCALE * counts.astype(np.int64) // (STEP * counts.astype(np.int64) + SPREAD * m[doc])
        key = names.astype(np.int64) * self.documents + place[doc]
        by_key = np.argsort(key)
        self.key = key[by_key]
        self.impact = impact[by_key].astype(np.int32)
        self.lists = np.searchsorted(self.key, np.arange(vocabulary + 1) * self.documents)
        longest = int(np.diff(self.lists).max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        for size in range(2, longest + 1):
            self.log[size] = self.log[size >> 1] + 1
        # row r holds the maximum of 2**r postings from each place
        self.maxima = np.empty((int(self.log[longest]) + 1, len(self.impact)), np.int32)
        self.maxima[0] = self.impact
        for r in range(1, len(self.maxima)):
            half = 1 << (r - 1)
            self.maxima[r] = self.maxima[r - 1]
            np.maximum(self.maxima[r - 1][:-half], self.maxima[r - 1][half:], out=self.maxima[r][:-half])

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest impact of each range of postings ``a <= at < b``; 0 where it is empty."""
        out = np.zeros(len(a), np.int64)
        some = np.flatnonzero(b > a)
        a, b = a[some], b[some]
        r = self.log[b - a]
        out[some] = np.maximum(self.maxima[r, a], self.maxima[r, b - (1 << r)])
        return out

    def search(self, names: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], cfg: Search) -> None:
        """Betters ``best``, ``(score, -id)`` ascending, by this shard's documents."""
        a, b = self.lists[names], self.lists[names + 1]
        some = b > a
        names, weights, a, b = names[some], weights[some], a[some], b[some]
        heap: list[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]] = []

        def opened(low: int, high: int, a: np.ndarray, b: np.ndarray) -> None:
            if low < high:
                each = weights * self.most(a, b)
                bound = int(each.sum())
                if bound and (len(best) < cfg.k or (bound, -int(self.ids[low])) > best[0]):
                    heapq.heappush(heap, (-bound, low, high, each, a, b))

        def offer(score: int, doc: int) -> None:
            found = (score, -int(self.ids[doc]))
            if len(best) < cfg.k:
                heapq.heappush(best, found)
            elif found > best[0]:
                heapq.heapreplace(best, found)

        opened(0, self.documents, a, b)
        while heap:
            bound, low, high, each, a, b = heapq.heappop(heap)
            if len(best) == cfg.k and (-bound, -int(self.ids[low])) <= best[0]:
                if -bound < best[0][0]:
                    break
                continue
            if high - low <= cfg.leaf:
                sizes = b - a
                at = np.repeat(a - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                doc = self.key[at] - np.repeat(names * self.documents + low, sizes)
                scores = np.bincount(doc, np.repeat(weights, sizes) * self.impact[at].astype(np.int64), high - low)
                for k in np.flatnonzero(scores >= max(1, best[0][0] if len(best) == cfg.k else 1)):
                    offer(int(scores[k]), low + int(k))
                continue
            top = int(each.argmax())
            peak = a[top] + int(self.impact[a[top] : b[top]].argmax())
            doc = int(self.key[peak] - names[top] * self.documents)
            at = np.searchsorted(self.key, names * self.documents + doc)
            hit = (at < b) & (self.key[np.minimum(at, len(self.key) - 1)] == names * self.documents + doc)
            offer(int((weights[hit] * self.impact[at[hit]]).sum()), doc)
            opened(low, doc, a, at)
            opened(doc + 1, high, at + hit, b)


def _shards(batches: Iterator[pa.RecordBatch], documents: int, length: int, vocabulary: int, cfg: Search) -> Iterator[Shard]:
    held: list[pa.RecordBatch] = []
    rows = postings = 0

    def made() -> Shard:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t.column("terms").chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        ids = t.column("doc_id").fill_null(NO_ID).to_numpy()
        return Shard(ids, t.column("n").to_numpy(), np.concatenate([[0], np.cumsum(sizes)]), lists.flatten().to_numpy(), t.column("counts").chunk(0).flatten().to_numpy(), documents, length, vocabulary)

    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            held.append(part)
            rows += part.num_rows
            postings += len(part.column("terms").flatten())
            if rows >= cfg.shard or postings >= cfg.postings:
                yield made()
                held, rows, postings = [], 0, 0
    if held:
        yield made()


def _best(indexed: DataFrame, items: list[np.ndarray], weights: np.ndarray, documents: int, length: int, cfg: Search) -> DataFrame:
    """Each task's best documents for the items, given by their terms' numbers."""
    shared = indexed.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for shard in _shards(batches, documents, length, len(weights), cfg):
            for names, own in zip(items, best, strict=True):
                shard.search(names, weights[names], own, cfg)
        rows = [(k, None if -d == NO_ID else -d, s) for k, own in enumerate(best) for s, d in own]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return indexed.where(F.size("terms") > 0).mapInArrow(run, RESULT)


def _block(docs: DataFrame, rows: list[tuple[int, str]], store: Store, cfg: Search, text: str, doc_id: str) -> DataFrame:
    """Candidates for one block of items, ``rows``: each task's best documents of each."""
    texts = [list(dict.fromkeys(terms(t))) for _, t in rows]
    vocabulary = {t: k for k, t in enumerate(dict.fromkeys(t for own in texts for t in own))}
    indexed = store.put(index(docs, vocabulary, text, doc_id), "index")
    documents, length = indexed.agg(F.count("*"), F.sum("n")).first()
    held = np.zeros(len(vocabulary), np.int64)
    for term, n in indexed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect():  # at most the block's terms
        held[term] = n
    weights = np.array([math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in held], np.int64)
    found = _best(indexed, [np.array([vocabulary[t] for t in own], np.int64) for own in texts], weights, documents, length or 1, cfg)
    names = indexed.sparkSession.createDataFrame([(k, item) for k, (item, _) in enumerate(rows)], "item int, item_id long")
    return found.join(F.broadcast(names), "item").select("item", "item_id", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, cfg: Search = Search(), text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ``k`` best documents with a score above 0."""
    store = Store(docs.sparkSession)
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // cfg.block_bytes + 1
    found = []
    for b in range(blocks):
        # a block is about ``block_bytes``, and never less than one item
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        found.append(store.put(_block(docs, [tuple(r) for r in rows], store, cfg, text, doc_id).withColumn("block", F.lit(b)), "best"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k).select("item_id", "rank", "doc_id", "score")


#: The same scores over every posting of an item's terms.
ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM s),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, g GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN s USING (doc_id), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM f WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
