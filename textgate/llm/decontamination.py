"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame expressions only.

1. Benchmark items and documents are cut into words (A-Z in lower case) and hashed five-word
   shingles.  A window worth comparing shares a shingle with an item, so each shared shingle
   sets one item-sized window on the document, where the two shingles lie on each other.
2. Each such window and each item gets a 64-bit SimHash of its shingles.
3. Fingerprints are cut into ``radius + 1`` blocks.  Two within the radius agree on a whole
   block, so an equi-join on (item length, block number, block value) finds every pair within
   the radius; the Hamming distance then drops the rest.
4. What is left is confirmed by the weighted shingle similarity: the sum of the smaller over
   the sum of the larger shingle counts.

At the similarity limit of 0.75 the distance is 11 bits on average with a spread of 3, so the
default radius of 24 keeps such a pair with near certainty.

The benchmark's shingles are broadcast only if a count shows that there are few enough;
otherwise the same join shuffles.  Very long texts are cut into shingles whole; of windows with equal
similarity the first counts.  Defined cases: null or empty texts, and texts without words,
match nothing; an item or text of fewer than five words is one shingle of all its words and
matches only a whole text of the same words; items with equal texts match alike; repeated
document rows give one row for each item; rows with a null id give nothing; empty tables give
an empty result.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgate.llm._store import stored

SPACE = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Decontamination:
    shingle: int = 5
    similarity: float = 0.75
    radius: int = 24
    broadcast_shingles: int = 2_000_000
    broadcast_spots: int = 500_000


def words(text: str) -> Column:
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, SPACE), "")


def shingles(column: str, n: int) -> Column:
    """Hashes of each run of ``n`` words in an array column; of all words where there are fewer."""
    whole = F.when(F.size(column) > 0, F.array(F.xxhash64(F.array_join(column, " "), F.size(column)))).otherwise(F.array().cast("array<long>"))
    runs = F.transform(F.slice(column, F.lit(1), F.greatest(F.size(column) - (n - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(column, i + k) for k in range(1, n)]))
    return F.when(F.size(column) >= n, runs).otherwise(whole)


def simhash(column: str) -> Column:
    """The sign of each bit's sum over an array of hashes."""

    def bit(b: Column) -> Column:
        votes = F.aggregate(column, F.lit(0), lambda a, h: a + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
        return F.when(votes > 0, F.expr("1L")).otherwise(F.expr("0L"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    # bit 63 first, as doubling wraps no sooner than at the last step
    # never null, so that no filter on it is inferred and moved to where its input would be computed again
    return F.coalesce(F.aggregate(F.reverse(bits), F.expr("0L"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x)), F.expr("0L"))


def blocks(column: str, number: int) -> Column:
    """(number, value) of each of ``number`` blocks that together make up 64 bits."""
    edges = [64 * k // number for k in range(number + 1)]
    each = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col(column), a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value")) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    return F.array(*each)


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of smaller over sum of larger counts of two shingle arrays, which are as long as an item."""
    common = F.aggregate(
        F.array_distinct(F.col(a)),
        F.lit(0),
        lambda acc, h: acc + F.least(F.size(F.filter(F.col(a), lambda x: x == h)), F.size(F.filter(F.col(b), lambda x: x == h))),
    )
    total = F.size(a) + F.size(b)
    return F.when(total > 0, common / (total - common)).otherwise(0.0)


def contaminated(docs: DataFrame, benchmark: DataFrame, cfg: Decontamination = Decontamination(), text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``doc_id``, ``item_id``, ``word_start``, ``n_item_words``, ``hamming`` and ``similarity`` of the best window of each pair."""
    n = cfg.shingle
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words(item_text).alias("item_words")).distinct()
    items = items.withColumn("item_shingles", shingles("item_words", n)).withColumn("item_print", simhash("item_shingles")).withColumn("length", F.size("item_words"))
    # a benchmark is small; whether it still is decides how the join runs
    few = (items.agg(F.coalesce(F.sum(F.size("item_shingles")), F.lit(0)).alias("n")).first()["n"]) <= cfg.broadcast_shingles

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    # texts of items: a shingle, its place and the window length; equal ones once
    places = items.select(F.posexplode_outer("item_shingles").alias("item_place", "shingle"), "length").distinct()
    base = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), words(text).alias("words"))
    # a shingle travels with its place and the text's length alone; words come back once for each text that has a hit
    found = base.withColumn("shingles", shingles("words", n)).select("doc_id", "mark", F.size("words").alias("n_words"), F.posexplode_outer("shingles").alias("place", "shingle"))
    hits = found.join(small(places), "shingle").where((F.col("length") >= n) | (F.col("n_words") == F.col("length")))
    start = F.least(F.greatest(F.col("place") - F.col("item_place"), F.lit(0)), F.greatest(F.col("n_words") - F.col("length"), F.lit(0)))
    spots = hits.groupBy("doc_id", "mark", F.col("length"), start.alias("word_start")).agg(F.count("*").alias("shared"))
    spots = stored(spots.select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), "length", "word_start"), "spots")
    # a row of four numbers each: few enough by their count, they go to the texts; otherwise both sides are shuffled
    near_by = F.broadcast(spots) if spots.count() <= cfg.broadcast_spots else spots.hint("merge")
    with_words = base.join(near_by, (F.col("hit_id") == F.col("doc_id")) & (F.col("hit_mark") == F.col("mark")))
    windows = with_words.select("doc_id", "length", "word_start", F.slice("words", F.col("word_start") + 1, F.col("length")).alias("window"))
    windows = windows.groupBy("doc_id", "length", "word_start", "window").agg(F.count("*").alias("shared"))
    # a window within the similarity shares at least that part of its shingles in some alignment
    windows = windows.withColumn("shingles", shingles("window", n)).withColumn("print", simhash("shingles"))
    left = windows.withColumn("b", F.explode_outer(blocks("print", cfg.radius + 1))).select("*", "b.block", "b.value").drop("b")
    right = items.withColumn("b", F.explode_outer(blocks("item_print", cfg.radius + 1))).select("item_id", "item_shingles", "item_print", "length", "b.block", "b.value")
    near = left.join(small(right), ["length", "block", "value"]).withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).cast("int"))
    # of the blocks that agree the first one stands for the pair
    edges = [64 * k // (cfg.radius + 1) for k in range(cfg.radius + 2)]
    differs = F.col("print").bitwiseXOR(F.col("item_print"))
    first = F.coalesce(*[F.when(F.shiftrightunsigned(differs, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) == 0, F.lit(k)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
    near = near.where((F.col("hamming") <= cfg.radius) & (F.col("block") == first))
    sure = near.withColumn("similarity", weighted_similarity("shingles", "item_shingles")).where(F.col("similarity") >= cfg.similarity)
    best = F.struct(F.col("similarity"), (-F.col("word_start")).alias("before"), (-F.col("hamming")).alias("closer"), F.col("length"))
    out = sure.groupBy("doc_id", "item_id").agg(F.max(best).alias("best"))
    return out.select("doc_id", "item_id", (-F.col("best.before")).cast("long").alias("word_start"), F.col("best.length").cast("long").alias("n_item_words"), (-F.col("best.closer")).alias("hamming"), F.round("best.similarity", 6).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cfg: Decontamination = Decontamination(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents, columns unchanged, without those that hold a benchmark item.

    Texts are judged, by their 64-bit hash, not ids: of rows that share an id only those with such a text go, and
    a row with a null id goes as any other.  A null text holds no item and stays.
    """
    bad = contaminated(docs.select(F.xxhash64(text).alias("doc_id"), F.col(text).alias("text")), benchmark, cfg).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.xxhash64(text) == F.col("__bad"), "left_anti")


#: What ``contaminated`` returns, but for ``hamming``, over every aligned window.
ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM benchmark),
ds AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
bs AS (SELECT item_id, n, i, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT item_id, words, len(words) AS n, unnest(range(1, len(words) - 3)) AS i FROM b WHERE len(words) >= 5)),
a AS (SELECT DISTINCT d.doc_id, t.item_id, t.n, least(greatest(d.i - t.i, 0), greatest(len(w.words) - t.n, 0)) AS p FROM ds d JOIN bs t USING (s) JOIN w ON w.doc_id = d.doc_id),
x AS (SELECT a.doc_id, a.item_id, a.n, a.p, d.s, count(*) AS c FROM a JOIN ds d ON d.doc_id = a.doc_id AND d.i > a.p AND d.i <= a.p + a.n - 4 GROUP BY ALL),
y AS (SELECT item_id, s, count(*) AS c FROM bs GROUP BY ALL),
m AS (SELECT x.doc_id, x.item_id, x.n, x.p, sum(least(x.c, y.c)) AS common FROM x JOIN y ON x.item_id = y.item_id AND x.s = y.s GROUP BY ALL),
t AS (SELECT doc_id, item_id, n, p, sum(c) AS total FROM x GROUP BY ALL),
r AS (SELECT m.doc_id, m.item_id, m.n, m.p, m.common / (t.total + m.n - 4 - m.common) AS sim FROM m JOIN t USING (doc_id, item_id, n, p))
SELECT doc_id, item_id, CAST(arg_min(p, struct_pack(a := -sim, b := p)) AS BIGINT) AS word_start, CAST(any_value(n) AS BIGINT) AS n_item_words, round(max(sim), 6) AS similarity
FROM r WHERE sim >= 0.75 GROUP BY doc_id, item_id
"""
