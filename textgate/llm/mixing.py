"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. A document's size is its number of words.  Each source's target is its share, by weight,
   of ``percent`` of all words; a source stops at ``epochs`` times its size, and what it cannot
   take is shared again by weight until no source is above its stop.
2. Sources are cut into shards of about ``shard_docs`` documents by a seeded hash, so that a
   source with a third of all rows is many shards.  In a shard, documents stand in seeded
   order, once an epoch, as one line of words; the line is cut into equal blocks.
3. All blocks of the mix go to sources by highest quotients (target / 1, target / 3,
   target / 5, ...), and a source's blocks, full passes first, go to its shards by highest
   quotients of their words.  A search for the divisor counts seats at many divisors in one
   pass; only quotients near the last seat are ranked, so no task holds all shards.
4. Each shard takes its quota of blocks in seeded order, and a document takes the words of the
   chosen blocks that are its own, at most ``epochs`` times its size.
5. ``take_words`` gives these words: a document's text becomes its chosen stretches, epoch after
   epoch, so the words given by source are those of the targets.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own,
last in order; documents with equal ids but different texts are separate rows, and fully
repeated rows each have their own stretches, so they may take different numbers; equal quotients
go to the source first in code-point order, and to the shard with the smaller number; a very
long text is one document of many blocks; without any words nothing is taken; an empty table
gives an empty result.  Other columns are not read; one named ``taken`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgate.llm._store import Store


@dataclass(frozen=True)
class Mix:
    """Up to ``broadcast_sources`` rows, one a source, are broadcast; more are shuffled."""

    weights: tuple[int, ...] = (5, 2, 1)
    percent: int = 150
    epochs: int = 2
    block: int = 64
    shard_docs: int = 2000
    seed: int = 11
    broadcast_sources: int = 100_000


def targets(store: Store, sources: DataFrame, cfg: Mix = Mix()) -> DataFrame:
    """Adds each source's ``target`` to a table with one row a ``source`` and its size ``n``."""
    none = F.col("source").isNull()
    # places in order: sorted parts, and within each part a row number
    parts = store.put(sources.orderBy(none, "source").withColumn("part", F.spark_partition_id()), "sources")
    before = parts.groupBy("part").agg(F.count("*").alias("rows"))
    before = before.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(none, "source")) - 1
    weight = F.get(F.array(*[F.lit(w) for w in cfg.weights]), (place % len(cfg.weights)).cast("int"))
    weighed = parts.join(before, "part").withColumn("weight", weight).withColumn("stop", cfg.epochs * F.col("n")).drop("part", "before")
    weighed = store.put(weighed, "sources")
    words, weights = weighed.agg(F.sum("n"), F.sum("weight")).first()
    whole, each = cfg.percent / 100 * (words or 0), None
    while weights:
        last, each = each, whole / weights
        if each == last:
            break
        # what full sources leave is shared again, until no other is above its stop
        over = each * F.col("weight") > F.col("stop")
        full, weights = weighed.agg(F.coalesce(F.sum(F.when(over, F.col("stop"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        whole = cfg.percent / 100 * (words or 0) - full
    share = F.least(F.lit(each or 0.0) * F.col("weight"), F.col("stop").cast("double")) if weights else F.col("stop").cast("double")
    return weighed.withColumn("target", share).drop("weight", "stop")


def apportion(store: Store, rows: DataFrame, group: str, size: str, quota: str, limit: str, tie: str, small: bool = True, probes: int = 32, few: int = 10_000) -> DataFrame:
    """Adds ``seats``: each group's ``quota`` dealt by highest quotients ``size / (2 k + 1)``, at most ``limit`` to a row.

    Equal quotients go to the smaller ``tie``, which tells the rows of a group apart.  Each pass
    counts the seats at ``probes`` divisors between the bounds of every group and moves them
    closer, until at most ``few`` quotients lie between; these are ranked.  A quota beyond all
    limits fills them all.
    """
    able = rows.where((F.col(size) > 0) & (F.col(limit) > 0))

    def seats(divisor: Column) -> Column:
        return F.least(F.floor(F.col(size) / divisor + 0.5), F.col(limit)).cast("long")

    edge = [F.min(F.col(size) / F.col(limit)).alias("lo"), (2.5 * F.max(size)).alias("hi"), F.least(F.first(quota), F.sum(limit)).alias("need"), F.sum(limit).alias("at_lo"), F.lit(0).cast("long").alias("at_hi")]
    bounds, worst = store.put(able.groupBy(group).agg(*edge), "bounds"), None
    while True:
        joined = able.join(F.broadcast(bounds) if small else bounds.hint("merge"), group)
        last, worst = worst, bounds.agg(F.max(F.col("at_lo") - F.col("at_hi"))).first()[0] or 0
        if worst <= few or worst == last:
            break
        at = [F.col("lo") * F.pow(F.col("hi") / F.col("lo"), F.lit((j + 1) / (probes + 1))) for j in range(probes)]
        counted = joined.groupBy(group, "lo", "hi", "need", "at_lo", "at_hi").agg(F.array(*[F.struct(F.first(t).alias("t"), F.sum(seats(t)).alias("n")) for t in at]).alias("tried"))
        high, low = F.filter("tried", lambda x: x["n"] >= F.col("need")), F.filter("tried", lambda x: x["n"] < F.col("need"))
        closer = counted.select(
            group,
            "need",
            F.coalesce(F.array_max(F.transform(high, lambda x: x["t"])), "lo").alias("lo"),
            F.coalesce(F.array_min(F.transform(low, lambda x: x["t"])), "hi").alias("hi"),
            F.coalesce(F.array_min(F.transform(high, lambda x: x["n"])), "at_lo").alias("at_lo"),
            F.coalesce(F.array_max(F.transform(low, lambda x: x["n"])), "at_hi").alias("at_hi"),
        )
        bounds = store.put(closer, "bounds")
    sure = joined.withColumn("sure", seats(F.col("hi"))).withColumn("most", seats(F.col("lo")))
    open_ = sure.where("most > sure").withColumn("k", F.explode(F.expr("sequence(sure, most - 1)"))).withColumn("q", F.col(size) / (2 * F.col("k") + 1))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("q"), tie))
    more = open_.withColumn("rank", rank).where(F.col("rank") <= F.col("need") - F.col("at_hi")).groupBy(group, tie).agg(F.count("*").alias("more"))
    dealt = sure.select(group, tie, "sure").join(more, [group, tie], "left").select(group, tie, (F.col("sure") + F.coalesce("more", F.lit(0))).alias("seats"))
    return rows.join(dealt, [group, tie], "left").withColumn("seats", F.coalesce("seats", F.lit(0)).cast("long"))


def _words(text: str) -> Column:
    """Number of words: joining cuts with one space each tells it from two lengths."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def mix_sources(docs: DataFrame, cfg: Mix = Mix(), text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``source``, ``mark`` (of the text), ``size``, ``source_size``, ``target``, ``taken`` and ``stretches`` of every document.

    A stretch is an epoch and two places in the document's words: it goes from one up to the other.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _words(text).alias("size"), F.xxhash64(F.col(text), F.lit(cfg.seed)).alias("mark"))
    store = Store(docs.sparkSession)
    base = store.put(base, "sizes")
    plan = targets(store, base.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")), cfg)
    plan = store.put(plan.withColumnRenamed("n", "source_size").withColumn("parts", F.ceil(F.col("docs") / cfg.shard_docs).cast("long")), "plan")
    small = plan.count() <= cfg.broadcast_sources
    df = base.join(F.broadcast(plan) if small else plan.hint("merge"), base["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    df = df.withColumn("part", F.pmod(F.xxhash64("doc_id", "mark"), "parts"))
    # a place in the shard's line of words; equal rows stand side by side
    line = Window.partitionBy("source", "part").orderBy(F.xxhash64("mark", "doc_id", F.lit(cfg.seed)), "doc_id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = store.put(df.withColumn("to", F.sum("size").over(line)).withColumn("from", F.col("to") - F.col("size")), "lines")

    name = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    shards = df.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    shards = store.put(shards.withColumn("limit", F.ceil(F.col("words") / cfg.block).cast("long")).withColumn("owner", name), "shards")
    # a source's target in blocks of its own mean size, as the last block of a line is shorter
    own = shards.groupBy("owner").agg(F.sum("words").alias("words"), F.sum("limit").alias("pass"), F.first("target").alias("target")).where("words > 0")
    own = store.put(own.withColumn("votes", F.col("target") * F.col("pass") / F.col("words")).withColumn("all", cfg.epochs * F.col("pass")).withColumn("mix", F.lit(0)), "votes")
    blocks = own.agg(F.round(F.sum("votes")).cast("long")).first()[0] or 0
    own = apportion(store, own.withColumn("quota", F.lit(blocks)), "mix", "votes", "quota", "all", "owner").select("owner", "seats", "pass")
    own = own.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(cfg.epochs - 1))))
    # every full pass over a source comes before the next
    own = store.put(own.select("owner", "epoch", F.least(F.greatest(F.col("seats") - F.col("epoch") * F.col("pass"), F.lit(0)), F.col("pass")).alias("quota")).where("quota > 0"), "passes")
    lots = shards.join(F.broadcast(own) if small else own.hint("merge"), "owner").withColumn("lot", F.struct("owner", "epoch"))
    dealt = store.put(apportion(store, lots, "lot", "words", "quota", "limit", "part", small).select("source", "part", "epoch", "limit", "seats"), "quotas")
    blocks = dealt.where("seats > 0").withColumn("block", F.explode(F.expr("sequence(0L, limit - 1)")))
    draw = Window.partitionBy("source", "part", "epoch").orderBy(F.xxhash64("source", "part", "epoch", "block", F.lit(cfg.seed)), "block")
    chosen = blocks.withColumn("rank", F.row_number().over(draw)).where(F.col("rank") <= F.col("seats")).groupBy("source", "part", "block").agg(F.count("*").alias("times"), F.collect_list("epoch").alias("turns"))

    pieces = df.where("size > 0").select("source", "part", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / cfg.block), F.floor((F.col("to") - 1) / cfg.block))).alias("block"), "doc_id", "mark")
    # the chosen blocks grow with the words; the planner sees only the small table of quotas they come from
    mine = pieces.alias("p").join(chosen.hint("merge").alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.part") == F.col("c.part")) & (F.col("p.block") == F.col("c.block")))
    first = F.greatest(F.col("from"), F.col("p.block") * cfg.block) - F.col("from")
    last = F.least(F.col("to"), (F.col("p.block") + 1) * cfg.block) - F.col("from")
    each = F.transform("turns", lambda e: F.struct(e.alias("epoch"), F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last")))
    mine = mine.select(F.col("p.source").alias("s"), F.col("p.part").alias("q"), F.col("from").alias("f"), "times", "turns", first.alias("first"), last.alias("last"))
    taken = mine.groupBy("s", "q", "f").agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken"), F.array_sort(F.flatten(F.collect_list(each))).alias("stretches"))
    out = df.join(taken, df["source"].eqNullSafe(F.col("s")) & (df["part"] == F.col("q")) & (df["from"] == F.col("f")) & (df["size"] > 0), "left")
    return out.select("doc_id", df["source"], "mark", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "stretches")


def mixed(docs: DataFrame, cfg: Mix = Mix()) -> DataFrame:
    """``mix_sources`` without the join keys and stretches that ``take_words`` needs."""
    return mix_sources(docs, cfg).select("doc_id", "size", "source_size", "target", "taken")


def take_words(docs: DataFrame, cfg: Mix = Mix(), text: str = "text", source: str = "source", doc_id: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """The documents the mix takes words from, with these words as their text, plus ``taken``, their number (repeats counted).

    The blanks after a word stay with it, but for the last of an epoch; epochs are lines of
    their own.  ``n_chars``, if there is such a column, is brought up to date.
    """
    key = lambda i, m, s: F.struct(i.alias("i"), m.alias("m"), s.alias("s"))
    plan = mix_sources(docs, cfg, text, source, doc_id).where("size > 0")
    own = F.struct(F.coalesce("stretches", F.array()).alias("stretches"), F.col("taken"))
    plan = plan.groupBy(key(F.col("doc_id"), F.col("mark"), F.col("source")).alias("__own")).agg(F.array_sort(F.collect_list(own)).alias("__all"))
    left = docs.withColumn("__key", key(F.col(doc_id), F.xxhash64(F.col(text), F.lit(cfg.seed)), F.col(source)))
    # rows alike in id, text and source have as many entries, one each, in the same order in each run
    mark = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if not kind.startswith("map")])
    left = left.withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy(mark)))
    both = left.join(plan.hint("merge"), F.col("__key") == F.col("__own")).withColumn("__mine", F.element_at("__all", F.col("__nth"))).where("__mine.taken > 0")
    words = both.withColumn("__words", F.regexp_extract_all(F.col(text), F.lit("[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+"), F.lit(0)))

    def told(epoch: Column) -> Column:
        mine = F.filter("__mine.stretches", lambda x: x["epoch"] == epoch)
        parts = F.transform(mine, lambda x: F.array_join(F.slice("__words", x["first"] + 1, x["last"] - x["first"]), ""))
        return F.rtrim(F.array_join(parts, ""), F.lit(" \t\n\x0b\x0c\r"))

    body = F.array_join(F.filter(F.transform(F.sequence(F.lit(0), F.lit(cfg.epochs - 1)), told), lambda x: x != ""), "\n")
    out = words.withColumn("__text", body)
    values = {text: F.col("__text"), n_chars: F.length("__text").cast("long")}
    return out.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns if c != "taken"], F.col("__mine.taken").alias("taken"))
