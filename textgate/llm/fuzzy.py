"""Near-duplicate documents by SimHash, found through Golay-code fuzzy hashing.

1. A document's fingerprint has 64 bits: the majority over the XXH64 of its four-word
   shingles, repeats counted.  Equal fingerprints become one row.
2. A fingerprint is cut into segments of 22, 21 and 21 bits.  The perfect Golay code of length
   23 maps a segment, padded with zeros, to the codewords within four bits: one of them where
   the nearest is within two bits, six where it is at three.  Segments up to two bits apart
   always share a codeword, and for segments one bit apart the nearest codeword of one is
   among those of the other.
3. Four errors over three segments leave two cases.  Either one segment is equal and another
   differs in two bits at most: the keys are an equal segment with each codeword of another.
   Or no segment is equal, so two of them differ in one bit each: one side stores the pair of
   their nearest codewords, the other looks all pairs of codewords up.  Parities sharpen
   these keys: one error turns a segment's parity, two errors leave it.
4. Every fingerprint of a key is compared with the smallest one stored there, a number of
   comparisons linear in the keys.  Where the components of these links leave a key's
   fingerprints apart, the key is searched fully, in blocks: the members of its largest
   component meet all others, but never each other.  A task gives only links that unite.

Every pair within the radius has a common key, so the components are exact.  A fingerprint
has 120 keys; N random ones meet in about N * 8e-7 false candidates each, which cost one
comparison of two integers.

Defined cases: a null or empty text, or one without words, has fingerprint zero, linked like
any other; repeated rows and equal texts share a component; rows of one id with different
texts share one as well; rows with a null id get a fingerprint, link nothing and have a null
component; very long texts are hashed in pieces; extra columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgate.llm import _words
from textgate.llm._store import Store
from textgate.llm.components import components

# Generator polynomial of the Golay code, its length, and the bits of its messages.
GENERATOR, LENGTH, MESSAGE = 0xAE3, 23, 12
_CHECK = LENGTH - MESSAGE
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
STORED, LOOKED_UP, BOTH = 0, 1, 2
#: Kinds of keys: an equal segment and another's codeword; two codewords of which the first is the first kind here.
EQUAL = list(permutations(range(3), 2))
TURNED = list(combinations(range(3), 2))
_KIND = 34
FIRST_TURNED = len(EQUAL) << _KIND
KEYS = "key long, fp long, side byte"


@dataclass(frozen=True)
class SimHash:
    shingle: int = 4
    seed: int = 42
    #: the keys are made for four bits; fewer may be asked for
    radius: int = 4
    #: members of a key that a block holds, and of a group that are compared in one step
    block: int = 2048
    small: int = 32


def fingerprint(text: str, cfg: SimHash = SimHash()) -> int:
    """The majority bits of the hashes of a text's shingles."""
    words = text.encode().translate(_LOWER).split()  # splits at the six ASCII blanks
    if not words:
        return 0
    n = max(1, len(words) - cfg.shingle + 1)
    counts = np.zeros(64, np.int64)
    digest, seed, size = xxhash.xxh64_intdigest, cfg.seed, cfg.shingle
    for a in range(0, n, 65_536):
        hashes = np.array([digest(b" ".join(words[i : i + size]), seed) for i in range(a, min(n, a + 65_536))], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, cfg: SimHash = SimHash(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed number, of every document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch):
                values = np.array([fingerprint(t or "", cfg) for t in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.record_batch([part.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Golay:
    """Tables of the code: the remainder of every 23-bit word, and for each remainder the error patterns of up to four bits."""

    def __init__(self) -> None:
        self.low, self.high = self._remainders(np.arange(1 << 12)), self._remainders(np.arange(1 << (LENGTH - 12)) << 12)
        ones = np.int64(1) << np.arange(LENGTH)
        patterns = [np.array([ones[list(c)].sum() for c in combinations(range(LENGTH), w)], np.int64) for w in range(5)]
        self.errors, filled = np.full((1 << _CHECK, 6), -1, np.int64), np.zeros(1 << _CHECK, np.int64)
        for group in patterns:  # the nearest codeword comes first
            for e, s in zip(group, self.remainder(group), strict=True):
                self.errors[s, filled[s]] = e
                filled[s] += 1

    @staticmethod
    def _remainders(words: np.ndarray) -> np.ndarray:
        words = words.astype(np.int64)
        for bit in range(LENGTH - 1, _CHECK - 1, -1):
            words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - _CHECK)), words)
        return words

    def remainder(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def near(self, words: np.ndarray) -> np.ndarray:
        """Indices of the codewords within four bits, one row a word, -1 where it has but one; the nearest first."""
        errors = self.errors[self.remainder(words)]
        return np.where(errors >= 0, (words[:, None] ^ errors) >> _CHECK, -1)


def keys(fps: np.ndarray, golay: Golay, stored_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of fingerprints, the place of each key's fingerprint, and the side the key is for."""
    parts = [(fps >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = [golay.near(p) for p in parts]
    odd = [np.bitwise_count(p).astype(np.int64) & 1 for p in parts]
    every = np.arange(len(fps))
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    for kind, (i, j) in enumerate(EQUAL):
        at, nth = np.nonzero(near[j] >= 0)
        out.append((kind << _KIND | parts[i][at] << MESSAGE | near[j][at, nth], at, BOTH))
    for kind, (i, j) in enumerate(TURNED, len(EQUAL)):
        k = 3 - i - j
        # where all three segments differ in one bit, the third one's parity turns as well: the first pair leaves it out
        third = odd[k] if kind > len(EQUAL) else np.zeros_like(odd[k])
        head, pairs = kind << _KIND, near[i][:, 0] << MESSAGE | near[j][:, 0]
        out.append((head | pairs << 3 | odd[i] << 2 | odd[j] << 1 | third, every, STORED))
        if not stored_only:
            at, a, b = np.nonzero((near[i][:, :, None] >= 0) & (near[j][:, None, :] >= 0))
            pairs = near[i][at, a] << MESSAGE | near[j][at, b]
            out.append((head | pairs << 3 | (1 - odd[i][at]) << 2 | (1 - odd[j][at]) << 1 | third[at], at, LOOKED_UP))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.concatenate([np.full(len(x[0]), x[2], np.int8) for x in out])


def _keyed(fps: DataFrame, stored_only: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                own = batch.column("fp").slice(a, 2000).to_numpy()
                key, at, side = keys(own.view(np.uint64), golay, stored_only)
                yield pa.record_batch([pa.array(key), pa.array(own[at]), pa.array(side)], names=["key", "fp", "side"])

    return fps.select("fp").mapInArrow(run, KEYS)


def _near(a: Column, b: Column, cfg: SimHash) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= cfg.radius


def _uniting(group: dict[str, np.ndarray], cfg: SimHash) -> list[tuple[int, int]]:
    """Links of one block or pair of blocks that unite its components; fewer than it has members."""
    fp, side, own = group["fp"].view(np.uint64), group["side"], group["own"]
    label = np.unique(group["root"], return_inverse=True)[1]
    left, right = (np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max()))
    found: list[tuple[int, int]] = []
    for i in left:
        able = right[(label[right] != label[i]) & ((side[right] + side[i]) % 2 == 1 if side[i] != BOTH else True)]
        for j in able[np.bitwise_count(fp[able] ^ fp[i]) <= cfg.radius]:
            if label[j] != label[i]:
                found.append((int(group["fp"][i]), int(group["fp"][j])))
                label[label == label[j]] = label[i]
    return found


def _hits(rows: dict[str, np.ndarray], number: np.ndarray, cfg: SimHash) -> np.ndarray:
    """For groups of at most ``cfg.small`` rows: which of them hold a link between components; all rows are compared with the next, the one after, ..."""
    fp, some = rows["fp"].view(np.uint64), np.zeros(int(number[-1]) + 1, bool)
    sizes = np.bincount(number)
    for d in range(1, min(cfg.small, int(sizes.max(initial=1)))):
        both = np.flatnonzero(number[:-d] == number[d:])
        near = (np.bitwise_count(fp[both] ^ fp[both + d]) <= cfg.radius) & (rows["root"][both] != rows["root"][both + d])
        near &= (rows["side"][both] != rows["side"][both + d]) | (rows["side"][both] == BOTH)
        some[number[both[near]]] = True
    return some | (sizes > cfg.small)


def _searched(df: DataFrame, cfg: SimHash) -> DataFrame:
    """Uniting links of all groups ``key``, ``x``, ``y``."""
    names = ["key", "x", "y", "own", "fp", "side", "root"]

    def links(table: dict[str, np.ndarray], number: np.ndarray) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        cuts = np.searchsorted(number, np.arange(number[-1] + 2))
        for g in np.flatnonzero(_hits(table, number, cfg)):
            found += _uniting({c: v[cuts[g] : cuts[g + 1]] for c, v in table.items()}, cfg)
        return pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            rows = {c: np.concatenate([rest[c], v]) for c, v in rows.items()} if rest else rows
            new = np.zeros(len(rows["key"]), bool)
            for c in names[:3]:
                new[1:] |= rows[c][1:] != rows[c][:-1]
            number = np.cumsum(new)
            cut = int(np.searchsorted(number, number[-1]))  # the last group may go on
            if cut:
                yield links({c: v[:cut] for c, v in rows.items()}, number[:cut])
            rest = {c: v[cut:] for c, v in rows.items()}
        if rest:
            yield links(rest, np.zeros(len(rest["key"]), np.int64))

    return df.select(*names).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _blocks(entries: DataFrame, cfg: SimHash) -> DataFrame:
    """Rows of keys whose members lie in several components, by pair of blocks ``x <= y``; a row's own block is ``own``.

    Blocks below ``few`` hold what is not in the key's largest component; they meet all blocks.
    Those from ``few`` on hold the largest, and meet only blocks below.
    """
    sizes = entries.groupBy("key", "root").agg(F.count("*").alias("n"))
    kinds = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("several")).where("several > 1")
    cut = entries.join(kinds, "key").withColumn("few", F.ceil((F.col("all") - F.col("most")) / cfg.block).cast("int")).withColumn("many", F.ceil(F.col("most") / cfg.block).cast("int"))
    place, main = F.xxhash64("fp"), F.col("root") == F.col("main")
    cut = cut.withColumn("own", F.when(main, F.col("few") + F.pmod(place, F.col("many"))).otherwise(F.pmod(place, F.col("few"))).cast("int"))
    last = F.when(main, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return cut.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).select("key", "x", "y", "own", "fp", "side", "root")


def links(fps: DataFrame, store: Store, cfg: SimHash = SimHash()) -> DataFrame:
    """``node`` and ``root`` of the distinct fingerprints ``fp`` that are within the radius of another; components are exact."""
    if cfg.radius > 4:
        raise ValueError("the keys find all pairs of up to four differing bits")
    stored_at = _keyed(fps, stored_only=True).groupBy("key").agg(F.min("fp").alias("first"), F.max("fp").alias("last"))
    least = stored_at.where(f"first <> last or key >= {FIRST_TURNED}")
    entries = _keyed(fps, stored_only=False).join(least.hint("merge"), "key").where("fp <> first or first <> last")
    entries = store.put(entries.withColumn("several", F.col("first") != F.col("last")).drop("last"), "keys")
    stars = entries.where((F.col("fp") != F.col("first")) & _near(F.col("fp"), F.col("first"), cfg))
    star = store.put(components(stars.select(F.col("fp").alias("a"), F.col("first").alias("b")).distinct()), "stars")
    apart = entries.where("several").drop("several", "first").join(star.hint("merge"), F.col("fp") == F.col("node"), "left")
    apart = store.put(apart.withColumn("root", F.coalesce("root", "fp")).drop("node"), "apart")
    more = _searched(_blocks(apart, cfg), cfg)
    united = store.put(components(star.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "united")
    store.drop(entries, star, apart)
    return united


def similar(docs: DataFrame, cfg: SimHash = SimHash(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` (smallest id reachable) of each document row."""
    store = Store(docs.sparkSession)
    marked = store.put(fingerprints(docs, cfg, text, doc_id), "fingerprints")
    named = marked.where("doc_id is not null")
    fps = store.put(named.groupBy("fp").agg(F.min("doc_id").alias("head")), "distinct")
    united = links(fps, store, cfg)
    # an id may stand in several rows with different texts: then it links their fingerprints
    several = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    several = named.join(several, "doc_id").where("fp > a").select("a", F.col("fp").alias("b")).distinct()
    roots = components(united.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(several))
    known = store.put(fps.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "head", F.coalesce("root", "fp").alias("root")), "roots")
    least = known.groupBy("root").agg(F.min("head").alias("component_id"))
    of = store.put(known.select("fp", "root").join(least.hint("merge"), "root").drop("root"), "of")
    out = marked.join(of.hint("merge"), "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
