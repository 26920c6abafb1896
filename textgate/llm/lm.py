"""Language-model scores from a log-bilinear neural model.

*Counts.*  One pass over all training texts counts every word, in part in the tasks and whole
after a groupBy; the commonest are listed, and the commonest of these are the model's words.
Both lists grow with the training tokens up to the documented sizes ``most_listed`` and
``widest``, which bound what is broadcast (about 100 and 130 MB); a word beyond them costs more
work, but counts as exactly.  A second pass counts the pairs of model words that follow each
other, as sparse blocks that are added up on the executors and stored there, once by previous
and once by next word.  Words outside the list are sent, document by document, to the task that
holds their hash, which learns their training count there; hot words are all in the list, so no
task gets a hot key.

*Model.*  The next word's log-probability is ``h_u . q_v + b_v`` less the log-normaliser of the
previous word ``u``; with one previous word its position's matrix is part of ``h``.  Parameters
are trained in numpy by noise-contrastive estimation on the executors.  With the ``q`` and ``b``
held the objective falls apart into previous words, with the ``h`` held into next words, so
each sweep is two jobs, in which every block of words climbs by itself over its own counted
pairs and over noise words drawn anew in each step, and sends back its vectors.  The driver
holds the vectors alone (``widest`` times 33 numbers a side), never pairs or gradients.
Afterwards the normalisers of all previous words are computed by one more job, so every score is
a normalised log-probability.  Words outside the model's vocabulary share one model token and
divide its probability by smoothed training counts.

Defined cases: a null or empty text is the end token alone; without training texts all counts
are zero and the model is uniform over its two special tokens; rows with equal id and text get
equal scores; words with equal counts are listed by their hash; very long texts are read whole; a null id is allowed and held out or not as the empty text; an empty table gives
an empty result.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgate.llm import _words
from textgate.llm._store import Store, stored


@dataclass(frozen=True)
class LogBilinear:
    """``frequent`` and ``vocabulary`` are the least sizes of the word list and of the model; both grow with the training tokens, up to ``most_listed`` and ``widest``.

    ``noise`` is the ratio of noise to data, ``draws`` the noise words that stand for its expectation in one of the ``steps`` of a sweep.
    """

    frequent: int = 16_384
    vocabulary: int = 1022
    most_listed: int = 4_000_000
    widest: int = 400_000
    size: int = 32
    noise: int = 10
    draws: int = 2048
    smoothing: int = 30
    sweeps: int = 8
    steps: int = 8
    rate: float = 0.1
    seed: int = 5

    def list_words(self, tokens: int) -> int:
        return max(self.frequent, min(int(16 * tokens**0.5), self.most_listed), self.model_words(tokens))

    def model_words(self, tokens: int) -> int:
        return max(self.vocabulary, min(int(3 * tokens**0.4), self.widest))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return _words.word_hashes(batch.column("text"), lower=True)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts, sorted, with their summed counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(n, head) if len(keys) else n


class Tally:
    """Counts by key of one task; parts are merged as they pile up."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.merged = self.held = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > max(1 << 21, 2 * self.merged):
            self.parts = [_summed(self.parts)]
            self.merged = self.held = len(self.parts[0][0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out, self.parts, self.merged, self.held = _summed(self.parts), [], 0, 0
        return out


def frequent_words(train: DataFrame, cfg: LogBilinear) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the commonest words of all training texts, commonest first; their counts; and the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def told() -> Iterator[pa.RecordBatch]:
            words, n = tally.take()
            for k in range(0, len(words), 1 << 17):
                yield pa.record_batch([pa.array(words[k : k + (1 << 17)]), pa.array(n[k : k + (1 << 17)])], names=["word", "n"])

        for batch in batches:
            for part in _words.slices(batch):
                tally.add(_tokens(part)[0].view(np.int64))
                if tally.merged > 4 << 20:
                    yield from told()
        yield from told()

    store = Store(train.sparkSession)
    words = store.put(train.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # words by count: at most about the root of twice the tokens many rows
    sizes = words.groupBy("n").agg(F.count("*").alias("words")).toArrow()
    by = np.stack([sizes.column("n").to_numpy(), sizes.column("words").to_numpy()], axis=1)
    by = by[np.argsort(-by[:, 0])]
    total = int((by[:, 0] * by[:, 1]).sum())
    limit = cfg.list_words(total)
    fits = int((np.cumsum(by[:, 1]) <= limit).sum())
    # all words of a count or none, unless the commonest alone are too many
    some = words.where(F.col("n") >= int(by[fits - 1, 0])) if fits else words.where(F.col("n") == int(by[0, 0]) if len(by) else F.lit(False)).orderBy("word").limit(limit)
    top = some.toArrow()
    store.drop(words)
    word, n = top.column("word").to_numpy(), top.column("n").to_numpy()
    order = np.lexsort((word, -n))
    return word[order].view(np.uint64), n[order], total


class Lexicon:
    """Frequent words: position by hash; the first ``vocabulary`` are model words."""

    def __init__(self, words: np.ndarray, vocabulary: int):
        self.size = len(words)
        self.order = np.argsort(words)
        self.sorted = words[self.order]
        self.model = min(vocabulary, len(words))
        self.end, self.other = self.model, self.model + 1  # model tokens: words, end, any other word

    def positions(self, words: np.ndarray) -> np.ndarray:
        """Position in the list; its length for a word not in it."""
        if not self.size:
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, words), self.size - 1)
        return np.where(self.sorted[at] == words, self.order[at], self.size)

    def pairs(self, positions: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Previous and next model token of every token, with an end before and after each row; and row offsets."""
        ids = np.minimum(np.where(positions < self.model, positions, self.other), self.other)
        n = len(rows) - 1
        cuts = rows + np.arange(n + 1)
        after = np.full(len(ids) + n, self.end)
        after[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(rows))] = ids
        before = np.full_like(after, self.end)
        before[1:] = after[:-1]
        return before, after, cuts


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys, as steps, with their counts."""
    return zlib.compress(np.diff(keys, prepend=0).tobytes() + n.astype(np.int64).tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = np.frombuffer(zlib.decompress(data), np.int64).reshape(2, -1)
    return np.cumsum(steps), n


def _added(group: pa.Table) -> pa.Table:
    total = _summed([_unpacked(b) for b in group.column("n").to_pylist()])
    return pa.table({"block": group.column("block").slice(0, 1), "n": pa.array([_packed(*total)], pa.binary())})


def _by_block(rows: np.ndarray, columns: np.ndarray, n: np.ndarray, width: int) -> list[tuple[int, bytes]]:
    """Cells as packed blocks of rows: row ``r`` is row ``r // blocks`` of block ``r % blocks``."""
    blocks = blocks_of(width)
    keys = rows // blocks * width + columns
    order = np.lexsort((keys, rows % blocks))
    keys, n = keys[order], n[order]
    cut = np.searchsorted((rows % blocks)[order], np.arange(blocks + 1))
    return [(k, _packed(keys[a:b], n[a:b])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]


def blocks_of(width: int) -> int:
    """Blocks of about 128 words, common and rare ones in each."""
    return max(16, width // 128)


def counts(train: DataFrame, lexicon: Lexicon, store: Store) -> tuple[DataFrame, int]:
    """Counted pairs of model tokens in stored blocks of previous tokens; and the number of documents."""
    shared = train.sparkSession.sparkContext.broadcast(lexicon)
    width = lexicon.model + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        tally, docs = Tally(), 0

        def told() -> Iterator[pa.RecordBatch]:
            keys, n = tally.take()
            rows = _by_block(keys // width, keys % width, n, width)
            rows.append((-1, _packed(np.zeros(1, np.int64), np.array([docs]))))
            salt = TaskContext.get().partitionId() % 64
            yield pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["block", "salt", "n"])

        for batch in batches:
            for part in _words.slices(batch):
                hashes, rows = _tokens(part)
                before, after, _ = lex.pairs(lex.positions(hashes), rows)
                tally.add(before * width + after)
                docs += part.num_rows
                if tally.merged > 4 << 20:
                    yield from told()
                    docs = 0
        if docs:
            yield from told()

    # in two steps, so that no task adds a block's part of every task
    parts = train.select("text").mapInArrow(run, "block int, salt int, n binary").groupBy("block", "salt").applyInArrow(_added, "block int, n binary")
    pairs = store.put(parts.repartition(blocks_of(width), "block").groupBy("block").applyInArrow(_added, "block int, n binary"), "pairs")
    number = pairs.where("block < 0").first()
    return pairs.where("block >= 0"), int(_unpacked(number["n"])[1][0]) if number else 0


def turned(pairs: DataFrame, width: int, store: Store) -> DataFrame:
    """The same pairs in stored blocks of next tokens."""
    blocks = blocks_of(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), strict=True):
                keys, n = _unpacked(data)
                rows = _by_block(keys % width, keys // width * blocks + block, n, width)
                yield pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["block", "n"])

    return store.put(pairs.mapInArrow(run, "block int, n binary").repartition(blocks, "block").groupBy("block").applyInArrow(_added, "block int, n binary"), "turned")


@dataclass
class Role:
    """The model tokens as previous or as next words.

    ``x`` are their vectors; the last coordinate is one for a previous word, and the bias less the log of the noise for a next one.  A pair that noise
    stands for weighs the product of both words' ``gain`` as data (the smoothing) and of their ``loss`` as noise; ``share`` is what words are drawn by.
    """

    x: np.ndarray
    gain: np.ndarray
    loss: np.ndarray
    share: np.ndarray

    def drawn(self, draws: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Words and weights whose weighted sums stand for sums over all words: evenly spaced draws, half by share and half alike for all."""
        chance = 0.5 * self.share + 0.5 / len(self.share)
        at = np.searchsorted(np.cumsum(chance), (np.arange(draws) + rng.random()) / draws)
        ids, times = np.unique(np.minimum(at, len(chance) - 1), return_counts=True)
        return ids, times / (draws * chance[ids])


def _chances(z: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.clip(z, -30, 30, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def climbed(own: Role, other: Role, rows: np.ndarray, columns: np.ndarray, seen: np.ndarray, free: int, rate: float, cfg: LogBilinear, rng: np.random.Generator) -> np.ndarray:
    """Vectors of ``own`` after ``steps`` of Adam on their first ``free`` coordinates; cells come in order of their rows, with their shares of the data."""
    x = own.x.copy()
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, cfg.steps + 1):
        grad = np.zeros_like(x)
        for a in range(0, len(rows), 1 << 16):
            i, y = rows[a : a + (1 << 16)], other.x[columns[a : a + (1 << 16)]]
            p = _chances(np.einsum("ij,ij->i", x[i], y))
            y *= (seen[a : a + (1 << 16)] * (1 - p))[:, None]
            head = np.flatnonzero(np.diff(i, prepend=-1))
            grad[i[head]] += np.add.reduceat(y, head, axis=0)
        ids, weight = other.drawn(cfg.draws, rng)
        y = other.x[ids]
        p = _chances(x @ y.T)
        data = np.outer(own.gain, (weight * other.gain[ids]).astype(np.float32))
        grad += (data - p * (data + np.outer(own.loss, (weight * other.loss[ids]).astype(np.float32)))) @ y
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        pace = np.float32(rate * min(1.0, 2 * (1 - step / (cfg.steps + 1))))
        move = pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + np.float32(1e-9))
        x[:, :free] += move[:, :free]
    return x


@dataclass
class Factors:
    """Trained model: ``h`` by previous token, ``q`` and ``b`` by next token, and the log-normalisers."""

    h: np.ndarray
    q: np.ndarray
    b: np.ndarray
    logz: np.ndarray

    def log10(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        out = np.empty(len(before))
        for k in range(0, len(before), 1 << 15):
            u, v = before[k : k + (1 << 15)], after[k : k + (1 << 15)]
            out[k : k + (1 << 15)] = np.einsum("ij,ij->i", self.h[u], self.q[v]) + self.b[v] - self.logz[u]
        return out / np.log(10)


def _sent_back(told: DataFrame, out: np.ndarray, blocks: int) -> np.ndarray:
    """Fills rows of ``out`` with the blocks that a job sends back; rows of other blocks stay."""
    table = told.toArrow()
    for block, data in zip(table.column("block").to_pylist(), table.column("x").to_pylist(), strict=True):
        out[block::blocks] = np.frombuffer(data, out.dtype).reshape(out[block::blocks].shape)
    return out


def _half_sweep(pairs: DataFrame, own: Role, other: Role, total: float, free: int, rate: float, number: int, cfg: LogBilinear) -> np.ndarray:
    """New vectors of ``own``, every block of them trained over its pairs."""
    shared = pairs.sparkSession.sparkContext.broadcast((own, other))
    width = len(own.x)
    blocks = blocks_of(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, fixed = shared.value
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), strict=True):
                keys, n = _unpacked(data)
                part = Role(*(v[block::blocks] for v in (mine.x, mine.gain, mine.loss, mine.share)))
                rng = np.random.default_rng([cfg.seed, number, block])
                x = climbed(part, fixed, keys // width, keys % width, (n / total).astype(np.float32), free, rate, cfg, rng)
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "x"])

    out = _sent_back(pairs.mapInArrow(run, "block int, x binary"), own.x.copy(), blocks)
    shared.destroy()
    return out


def factors(by_previous: DataFrame, by_next: DataFrame, occurrences: np.ndarray, cfg: LogBilinear) -> Factors:
    """Trains on stored pairs; ``occurrences`` are the model tokens' counts, as previous words and as next words alike."""
    spark, width = by_previous.sparkSession, len(occurrences)
    rng = np.random.default_rng(cfg.seed)
    unigram = (occurrences + 0.5) / (occurrences.sum() + 0.5 * width)
    # a context seen seldom leans on the unigram counts
    total = float(occurrences.sum() + cfg.smoothing * width)
    context, noise = (occurrences + cfg.smoothing) / total, cfg.noise * unigram
    h = np.concatenate([rng.normal(0, 0.1, (width, cfg.size)), np.ones((width, 1))], axis=1)
    q = np.concatenate([np.zeros((width, cfg.size)), np.log(unigram / noise)[:, None]], axis=1)
    previous = Role(h.astype(np.float32), np.full(width, cfg.smoothing / total, np.float32), context.astype(np.float32), context)
    following = Role(q.astype(np.float32), unigram.astype(np.float32), noise.astype(np.float32), unigram)
    for sweep in range(cfg.sweeps):
        rate = cfg.rate * (1 - sweep / cfg.sweeps)
        following.x = _half_sweep(by_next, following, previous, total, cfg.size + 1, rate, 2 * sweep, cfg)
        previous.x = _half_sweep(by_previous, previous, following, total, cfg.size, rate, 2 * sweep + 1, cfg)
    h, q, b = previous.x[:, :-1].copy(), following.x[:, :-1].copy(), following.x[:, -1] + np.log(noise).astype(np.float32)
    shared, blocks = spark.sparkContext.broadcast((h, q, b)), blocks_of(width)

    def normalisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, q, b = shared.value
        step = max(1, (1 << 22) // width)
        for batch in batches:
            for block in batch.column("id").to_pylist():
                own, out = h[block::blocks], []
                for k in range(0, len(own), step):
                    logits = (own[k : k + step] @ q.T + b).astype(np.float64)
                    top = logits.max(axis=1, keepdims=True)
                    out.append((top + np.log(np.exp(logits - top).sum(axis=1, keepdims=True)))[:, 0])
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([np.concatenate([*out, np.zeros(0)]).tobytes()], pa.binary())], names=["block", "x"])

    told = spark.range(0, blocks, 1, max(1, blocks // 4)).mapInArrow(normalisers, "block int, x binary")
    logz = _sent_back(told, np.zeros(width), blocks)
    shared.destroy()
    return Factors(h, q, b, logz)


def trained(train: DataFrame, cfg: LogBilinear) -> tuple[Lexicon, np.ndarray, int, Factors]:
    """The word list, its training counts, the number of training texts and the model."""
    store = Store(train.sparkSession)
    listed, frequency, tokens = frequent_words(train, cfg)
    lexicon = Lexicon(listed, cfg.model_words(tokens))
    by_previous, docs = counts(train, lexicon, store)
    by_next = turned(by_previous, lexicon.model + 2, store)
    model = frequency[: lexicon.model]
    fitted = factors(by_previous, by_next, np.concatenate([model, [docs, tokens - model.sum()]]).astype(np.float64), cfg)
    store.clear()
    return lexicon, frequency, docs, fitted


def scores(docs: DataFrame, cfg: LogBilinear = LogBilinear(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``held_out``, token counts, the unigram base score and the model's log10 probability of each text."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"))
    train = base.where(~F.col("held_out"))
    spark = docs.sparkSession
    first, frequency, texts, fitted = trained(train, cfg)
    known = np.concatenate([frequency, [0]]).astype(np.float64)
    shared = spark.sparkContext.broadcast((first, known, fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, n, bilinear = shared.value
        log_n = np.log10(n + 0.5)
        for batch in batches:
            for part in _words.slices(batch):
                hashes, rows = _tokens(part)
                at = lex.positions(hashes)
                before, after, cuts = lex.pairs(at, rows)
                model = np.add.reduceat(bilinear.log10(before, after), cuts[:-1])
                listed_here, held = at < lex.size, part.column("held_out").to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), np.diff(rows))

                def by_row(values: np.ndarray, row=row, part=part) -> np.ndarray:
                    return np.bincount(row, values, part.num_rows)

                known_words = by_row((n[at] > 0) & listed_here)
                listed_log = by_row(np.where(listed_here, log_n[at], 0.0))
                other_log = by_row(np.where(listed_here & (at >= lex.model), log_n[at], 0.0))
                others = by_row(at >= lex.model)
                # words outside the list: one row for each distinct one of a document
                rare = np.flatnonzero(~listed_here)
                order = rare[np.lexsort((hashes[rare], row[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
                head = np.flatnonzero(new)
                times = np.diff(np.concatenate([head, [len(order)]]))
                at_row = row[order[head]]
                sums = [np.diff(rows), known_words, listed_log, other_log, others, model]
                facts = np.ascontiguousarray(np.stack(sums, axis=1).astype(np.float64))
                ids = part.column("doc_id")
                own = _words.mix(np.arange(part.num_rows, dtype=np.uint64) + hashes[:1].sum())
                yield pa.record_batch(
                    [
                        pa.concat_arrays([ids, ids.take(pa.array(at_row))]),
                        pa.concat_arrays([part.column("mark"), part.column("mark").take(pa.array(at_row))]),
                        pa.array(np.concatenate([own, hashes[order[head]]]).view(np.int64)),
                        pa.array(np.concatenate([np.zeros(part.num_rows, np.int64), times * np.where(held[at_row], -1, 1)]).astype(np.int32)),
                        pa.array([*(f.tobytes() for f in facts), *[None] * len(head)], pa.binary()),
                    ],
                    names=["doc_id", "mark", "word", "n", "facts"],
                )

    kind = base.schema["doc_id"].dataType.simpleString()
    marked = base.select("doc_id", F.xxhash64("text").alias("mark"), "held_out", "text")
    sent = marked.mapInArrow(run, f"doc_id {kind}, mark long, word long, n int, facts binary").repartition("word").sortWithinPartitions("word")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Training counts of the words of one task; a word's rows are neighbours, and may go on in the next batch."""
        rest: pa.RecordBatch | None = None

        def told(rows: pa.RecordBatch) -> pa.RecordBatch:
            word, n = rows.column("word").to_numpy(), rows.column("n").to_numpy().astype(np.int64)
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            c = np.add.reduceat(np.maximum(n, 0), head)
            size = np.diff(np.concatenate([head, [len(word)]]))
            each, times = np.repeat(c, size), np.abs(n)
            seen = np.zeros(len(word), np.int64)
            seen[head] = c > 0
            return pa.record_batch(
                [rows.column("doc_id"), rows.column("mark"), rows.column("facts"), pa.array(times * np.log10(each + 0.5)), pa.array(times * (each > 0)), pa.array(seen), pa.array(np.maximum(n, 0))],
                names=["doc_id", "mark", "facts", "log_n", "known", "kinds", "train"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            word = rows.column("word").to_numpy()
            last = int(np.searchsorted(word, word[-1]))
            if last:
                yield told(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None:
            yield told(rest)

    looked = sent.mapInArrow(look_up, f"doc_id {kind}, mark long, facts binary, log_n double, known long, kinds long, train long")
    # repeated rows meet here: their sums are multiples, and the number of fact rows tells how many
    merged = looked.groupBy("doc_id", "mark").agg(
        F.count("facts").alias("copies"), F.first("facts", True).alias("facts"), F.sum("log_n").alias("log_n"), F.sum("known").alias("known"), F.sum("kinds").alias("kinds"), F.sum("train").alias("train")
    )
    merged = stored(merged, "scores")
    rare = merged.agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"), F.coalesce(F.sum("train"), F.lit(0)).alias("train")).first()
    total = int(frequency.sum() + texts + rare["train"])
    distinct = int((frequency > 0).sum() + rare["kinds"] + (texts > 0))
    log_total = float(np.log10(total + 0.5 * (distinct + 1)))
    listed_others = frequency[first.model :]
    others_total = float(np.log10(float(listed_others.sum() + rare["train"]) + 0.5 * float((listed_others > 0).sum() + rare["kinds"]) + 0.5))
    end_log, end_known = float(np.log10(texts + 0.5)), int(texts > 0)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            facts = np.frombuffer(b"".join(batch.column("facts").to_pylist()), np.float64).reshape(batch.num_rows, -1)
            words, known_words, listed_log, other_log, others, model = facts.T
            copies = batch.column("copies").to_numpy()
            log_n, rare_known = batch.column("log_n").to_numpy() / copies, batch.column("known").to_numpy() // copies
            n_tokens = words + 1
            base_score = listed_log + log_n + end_log - n_tokens * log_total
            score = model + other_log + log_n - others * others_total
            out = pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(n_tokens.astype(np.int64)),
                    pa.array((known_words + rare_known + end_known).astype(np.int64)),
                    pa.array(np.full(batch.num_rows, total)),
                    pa.array(base_score),
                    pa.array(score),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            yield out.take(pa.array(np.repeat(np.arange(batch.num_rows), copies)))

    done = merged.select("doc_id", "copies", "facts", "log_n", "known").mapInArrow(finish, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
