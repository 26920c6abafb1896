"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Every document's distinct five-word shingles are hashed; for each of ``bands * rows``
   permutations the minimum is taken.  Its low ``bits`` are packed into a signature, and the
   whole minima of a band are hashed to one key.
2. Documents with equal shingle sets become one class, represented by its smallest id.
3. Each representative is paired with the smallest id of its buckets, which is a number of
   pairs linear in the documents.  Pairs are confirmed on full sets and give components.
4. Buckets whose members fall into several components after that are compared in pairs of
   blocks: the similarity of each pair of different components is estimated from equal
   signature fields (less those equal by chance), and pairs near enough make clusters.  A
   task gives one row for each document with such a partner, never the pairs.
5. The full sets of a cluster meet in pairs of blocks.  A task compares all of different
   components and gives the links that unite some: fewer than it has documents, though every
   link between different components is looked for.

Defined cases: a null or empty text, or one without words, has the empty set and no link: its
component is its own id; a text shorter than a shingle is one shingle; repeated rows and equal
texts share a component; rows of one id with different texts share one as well; rows with a
null id take part in nothing and get a null component.  Very long texts are read whole, hashed
in pieces.  Extra columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgate.llm import _words
from textgate.llm._store import Store
from textgate.llm.components import components

SIGNATURES = "doc_id long, n_shingles long, set_hash binary, bands array<long>, signature binary"


@dataclass(frozen=True)
class MinHash:
    """Banding misses a pair of similarity s with probability (1 - s**rows) ** bands: 5e-6 at 0.75."""

    shingle: int = 5
    percent: int = 75
    bands: int = 45
    rows: int = 5
    bits: int = 4
    #: 4.3 standard deviations of the estimate below the limit: a pair of 0.75 is missed with probability 8e-6
    estimate_floor: float = 0.62
    #: members of a bucket, members of a cluster or a star, and shingles of a cluster that a block holds
    block: int = 2048
    group: int = 512
    shingles: int = 1_000_000
    seed: int = 7

    @property
    def multipliers(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return rng.integers(1, 2**62, self.bands * self.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minima(values: np.ndarray, starts: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One row a permutation, one column a set."""
    out = np.empty((len(multipliers), len(starts)), np.uint64)
    scratch = np.empty_like(values)
    for k, m in enumerate(multipliers):
        np.multiply(values, m, out=scratch)
        out[k] = np.minimum.reduceat(scratch, starts)
    return out


def _signed(batch: pa.RecordBatch, cfg: MinHash) -> pa.RecordBatch:
    words, rows = _words.word_hashes(batch.column("text"), lower=True)
    values, offsets = _words.shingle_sets(words, rows, cfg.shingle)
    sizes = np.diff(offsets)
    some = np.flatnonzero(sizes)
    ids = batch.column("doc_id").to_pylist()
    empty = [None] * len(ids)
    bands, signatures, sums = list(empty), list(empty), list(empty)
    if len(some):
        starts = offsets[:-1][some]
        minima = _words.mix(_minima(values, starts, cfg.multipliers))
        keys = minima.reshape(cfg.bands, cfg.rows, -1)
        band = np.zeros((cfg.bands, len(some)), np.uint64)
        for r in range(cfg.rows):
            band = _words.mix(band + keys[:, r])
        band = np.ascontiguousarray(band.T).view(np.int64)
        low = (minima & np.uint64(2**cfg.bits - 1)).astype(np.uint8).T
        low = np.ascontiguousarray(low)
        a = np.add.reduceat(_words.mix(values), starts)
        b = np.add.reduceat(_words.mix(values ^ np.uint64(0x5555555555555555)), starts)
        digest = np.stack([a, b], axis=1)
        for j, i in enumerate(some):
            bands[i], signatures[i], sums[i] = band[j], _pack(low[j], cfg.bits), digest[j].tobytes() + int(sizes[i]).to_bytes(8, "little")
    return pa.record_batch(
        [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
        names=["doc_id", "n_shingles", "set_hash", "bands", "signature"],
    )


def _pack(fields: np.ndarray, bits: int) -> bytes:
    """Bit planes, so that equal fields are zero in the union of the planes' differences."""
    return np.packbits((fields[None, :] >> np.arange(bits, dtype=np.uint8)[:, None]) & 1, axis=1).tobytes()


def signatures(docs: DataFrame, cfg: MinHash = MinHash(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Set size, set hash, band keys and b-bit signature of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch):
                yield _signed(part, cfg)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SIGNATURES)


def _near(group: pa.Table, cfg: MinHash) -> pa.Table:
    """Documents in two blocks of one bucket that come near one of another component, each with the smallest id of its cluster.

    Near is an estimate that reaches the floor; clusters are the components of the near pairs.
    However many pairs are near, there is at most one row for each document.
    """
    ids, comps, sizes = (group.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles"))
    side = group.column("side").to_numpy()
    planes = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(ids), cfg.bits, -1)
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    label, some = np.arange(len(ids)), np.zeros(len(ids), bool)
    total = cfg.bands * cfg.rows
    chance = 1 / 2**cfg.bits
    for i in left:
        able = right[(comps[right] != comps[i]) & (100 * np.minimum(sizes[right], sizes[i]) >= cfg.percent * np.maximum(sizes[right], sizes[i]))]
        if side[i] == 0:
            able = able[ids[able] > ids[i]]
        if some[i]:  # of two that are in one cluster nothing more is learnt
            able = able[~(some[able] & (label[able] == label[i]))]
        if not len(able):
            continue
        differ = np.bitwise_or.reduce(planes[able] ^ planes[i], axis=1)
        equal = total - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        near = able[(equal / total - chance) / (1 - chance) >= cfg.estimate_floor]
        if len(near):
            some[i] = some[near] = True
            _unite(label, i, near)
    at = np.flatnonzero(some)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label[at], ids[at])
    return pa.table({"a": ids[at], "b": least[label[at]]})


def _by_group(df: DataFrame, keys: list[str], each: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``each`` of the rows with equal whole-number keys; a task takes many small groups in one call of Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def ready(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
            done = [each(table.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*rest, batch])
            columns = [table.column(k).to_numpy() for k in keys]
            new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
            yield from ready(table, cuts)
            rest = table.slice(cuts[-1]).to_batches()
        if rest:
            table = pa.Table.from_batches(rest)
            yield from ready(table, [0, table.num_rows])

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _unite(label: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Gives all with a label of ``others`` the label of ``i``; the first of ``others`` for each label that was another."""
    old, first = np.unique(label[others], return_index=True)
    first = others[first[old != label[i]]]
    if len(first):
        label[np.isin(label, old)] = label[i]
    return first


def _uniting(group: pa.Table, cfg: MinHash) -> pa.Table:
    """Confirmed links between two blocks of one cluster that unite its components: fewer than it has documents."""
    ids, side = group.column("doc_id").to_numpy(), group.column("side").to_numpy()
    label = np.unique(group.column("component").to_numpy(), return_inverse=True)[1]
    words, rows = _words.word_hashes(group.column("text"), lower=True)
    values, cuts = _words.shingle_sets(words, rows, cfg.shingle)
    kinds, values = np.unique(values, return_inverse=True)
    sizes, own = np.diff(cuts), np.zeros(len(kinds), bool)
    left, right = np.flatnonzero((side != 2) & (sizes > 0)), np.flatnonzero((side != 1) & (sizes > 0))
    flat = np.concatenate([values[cuts[j] : cuts[j + 1]] for j in right]) if len(right) else values
    starts = np.cumsum(sizes[right]) - sizes[right]
    found: list[tuple[int, int]] = []
    for i in left:
        open_ = np.flatnonzero((label[right] != label[i]) & (100 * np.minimum(sizes[right], sizes[i]) >= cfg.percent * np.maximum(sizes[right], sizes[i])))
        if not len(open_):
            continue
        own[values[cuts[i] : cuts[i + 1]]] = True
        if 4 * len(open_) < len(right):
            shared = np.array([own[values[cuts[j] : cuts[j + 1]]].sum() for j in right[open_]])
        else:
            shared = np.add.reduceat(own[flat], starts, dtype=np.int64)[open_]
        own[values[cuts[i] : cuts[i + 1]]] = False
        linked = right[open_][(shared > 0) & (100 * shared >= cfg.percent * (sizes[i] + sizes[right[open_]] - shared))]
        if len(linked):
            found += [(int(ids[i]), int(ids[j])) for j in _unite(label, i, linked)]
    return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})


def _linked(a: np.ndarray, b: np.ndarray, cfg: MinHash) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= cfg.percent * (len(a) + len(b) - shared)


def _confirm(store: Store, texts: DataFrame, pairs: DataFrame, cfg: MinHash) -> DataFrame:
    """The pairs ``a < b`` whose full sets are similar enough.

    Members ``b`` travel to their centre ``a`` in groups of at most about ``cfg.group``, the
    centre's text once to each group.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / cfg.group).alias("parts"))
    dealt = store.put(pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "pairs")
    wanted = dealt.select(F.col("b").alias("doc_id"), "a", "part", F.lit(1).alias("side"))
    wanted = wanted.unionByName(dealt.select(F.col("a").alias("doc_id"), "a", "part", F.lit(0).alias("side")).distinct())
    dealt_texts = texts.join(wanted, "doc_id").repartition("a", "part").sortWithinPartitions("a", "part", "side", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre: tuple[int, int] | None = None
        own: list[np.ndarray] = []  # one set, but for an id with several texts
        for batch in batches:
            for rows in _words.slices(batch):
                words, offsets = _words.word_hashes(rows.column("text"), lower=True)
                values, cuts = _words.shingle_sets(words, offsets, cfg.shingle)
                key = list(zip(rows.column("a").to_pylist(), rows.column("part").to_pylist(), strict=True))
                side, ids = rows.column("side").to_pylist(), rows.column("doc_id").to_pylist()
                found = []
                for i, k in enumerate(key):
                    mine = values[cuts[i] : cuts[i + 1]]
                    if side[i] == 0:
                        own = [*own, mine] if centre == k else [mine]
                        centre = k
                        continue
                    assert centre == k
                    if any(_linked(x, mine, cfg) for x in own):
                        found.append((k[0], ids[i]))
                yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return dealt_texts.select("a", "part", "side", "doc_id", "text").mapInArrow(run, "a long, b long")


def _in_blocks(df: DataFrame, groups: DataFrame, keys: list[str], parts: Callable[[Column, Column], Column], cfg: MinHash) -> DataFrame:
    """Rows by pair of blocks ``x <= y`` of their group, a row in each pair that its own block is in; ``side`` tells which.

    Only members of different components are to meet.  So the largest component of a group has blocks of its own behind those of the others, and meets
    these alone: its rows are copied once for each block of the others, not for each block of the group.  A group that fits one block stays whole.
    """
    one = F.lit(1)
    rest = F.greatest(parts(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")), one)
    cuts = groups.select(*keys, F.col("top.component").alias("main"), rest.alias("rest"), F.greatest(parts(F.col("top.n"), F.col("top.size")), one).alias("more"), (parts(F.col("n"), F.col("size")) <= 1).alias("whole"))
    at, main = F.xxhash64("doc_id", F.lit(cfg.seed)), F.col("component") == F.col("main")
    own = F.when(F.col("whole"), 0).when(main, F.col("rest") + F.pmod(at, F.col("more"))).otherwise(F.pmod(at, F.col("rest")))
    others = F.when(F.col("whole"), 1).when(main, F.col("rest")).otherwise(F.col("rest") + F.col("more"))
    cut = df.join(cuts, keys).select(*df.columns, own.cast("int").alias("own"), F.explode(F.sequence(F.lit(0), others.cast("int") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return cut.withColumn("side", side).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("own", "other")


def _groups(members: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Rows and summed ``size`` of each group, and ``top``: those of its largest component."""
    by = members.groupBy(*keys, "component").agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    return by.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "component", "size")).alias("top"))


def _clusters(store: Store, entries: DataFrame, known: DataFrame, cfg: MinHash) -> DataFrame:
    """``doc_id`` and ``cluster`` of the documents that come near one of another component in some bucket."""
    again = entries.join(known.select("doc_id", "component").distinct(), "doc_id")
    mixed = again.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "key")
    members = store.put(again.join(mixed, ["band", "key"]).select("doc_id", "band", "key", "component"), "mixed")
    # large buckets are cut into blocks, and each pair of blocks is compared on its own
    cut = _in_blocks(members, _groups(members, ["band", "key"], F.lit(0)), ["band", "key"], lambda n, size: F.ceil(n / cfg.block), cfg).drop("component")
    near = _by_group(cut.join(known, "doc_id"), ["band", "key", "x", "y"], lambda t: _near(t, cfg), "a long, b long")
    near = store.put(near.distinct(), "near")
    out = store.put(components(near).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")), "clusters")
    store.drop(near, members)
    return out


def _across(texts: DataFrame, clusters: DataFrame, known: DataFrame, cfg: MinHash) -> DataFrame:
    """Confirmed links ``a``, ``b`` that unite components within the clusters."""
    members = clusters.join(known.groupBy("doc_id", "component").agg(F.sum("n_shingles").alias("n")), "doc_id")
    parts = lambda n, size: F.ceil(F.greatest(n / cfg.group, size / cfg.shingles))
    cut = _in_blocks(members, _groups(members, ["cluster"], F.col("n")), ["cluster"], parts, cfg).drop("n")
    return _by_group(texts.join(cut, "doc_id"), ["cluster", "x", "y"], lambda t: _uniting(t, cfg), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, cfg: MinHash = MinHash(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept`` for each document row."""
    store = Store(docs.sparkSession)
    signed = store.put(signatures(docs, cfg, text, doc_id), "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = store.put(some.groupBy("set_hash").agg(F.min("doc_id").alias("head")), "classes")
    headed = store.put(some.select("doc_id", "n_shingles", "set_hash").join(classes.hint("merge"), "set_hash").drop("set_hash"), "heads")
    alone = store.put(signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles"), "alone")
    # an id may stand in several rows with different texts: then it links their classes
    several = headed.groupBy("doc_id").agg(F.min("head").alias("a"), F.max("head").alias("z")).where("a < z")
    several = headed.join(several, "doc_id").where("head > a").select("a", F.col("head").alias("b")).distinct()
    heads = some.join(classes.hint("merge"), "set_hash").where("doc_id = head").dropDuplicates(["doc_id", "set_hash"])
    heads = heads.select("doc_id", "n_shingles", "bands", "signature")
    keys = heads.select("doc_id", F.posexplode("bands").alias("band", "key"))
    least = keys.groupBy("band", "key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    entries = store.put(keys.join(least, ["band", "key"]), "buckets")
    signs = store.put(heads.drop("bands").join(entries.select("doc_id").distinct(), "doc_id"), "signs")
    # one shuffle of all texts, by merging whatever the sizes; from here on only texts that meet another
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = store.put(texts.hint("merge").join(signs.select("doc_id").distinct(), "doc_id"), "texts")
    # a document's smallest centre stands for its star; what that leaves apart comes in the clusters
    star = store.put(entries.where("doc_id > first").groupBy("doc_id").agg(F.min("first").alias("a")).select("a", F.col("doc_id").alias("b")), "pairs")
    roots = store.put(components(_confirm(store, texts, star, cfg).unionByName(several)), "roots")
    known = signs.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("root", "doc_id")).drop("root")
    known = store.put(known, "known")
    clusters = _clusters(store, entries, known, cfg)
    links = roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(_across(texts, clusters, known, cfg))
    united = store.put(components(links).withColumnRenamed("node", "head"), "roots")
    store.drop(signed, classes, entries, signs, texts, star, roots, known, clusters)
    out = headed.join(united.hint("merge"), "head", "left").select("doc_id", "n_shingles", F.coalesce("root", "head").alias("component_id"))
    out = out.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))


def keep_one(docs: DataFrame, cfg: MinHash = MinHash(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents, columns unchanged, of which each group of near-duplicates keeps one row of its smallest id.

    Of several rows with that id one stays, the same in each run; rows with a null id all stay.
    """
    gone = near_duplicates(docs, cfg, text, doc_id).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone"), F.lit(False).alias("__none")).distinct()
    # rows without an id spread over all tasks
    mark = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if not kind.startswith("map")])
    rows = docs.withColumn("__id", F.coalesce(F.col(doc_id).cast("long"), mark)).withColumn("__null", F.col(doc_id).isNull()).withColumn("__mark", mark)
    left = rows.join(gone, (F.col("__id") == F.col("__gone")) & (F.col("__null") == F.col("__none")), "left_anti")
    first = F.row_number().over(Window.partitionBy("__id", "__null").orderBy("__mark"))
    return left.withColumn("__nth", first).where("__nth = 1 or __null").select(*docs.columns)


#: The exact components, over every pair that shares a shingle.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
