"""State of suggestions and requests as event logs: windows over each key's events, so that state grows with the keys.

Events of one key are ordered by a sequence number; equal numbers of a key are not told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _so_far(key: str, seq: str) -> Window:
    return Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def live_suggestions(events: DataFrame, key: str = "id", seq: str = "seq", kind: str = "kind", text: str = "text") -> DataFrame:
    """What is left after all events: ``key``, ``suggested`` (source text) and ``dismissed`` (text), null where there is none.

    Kinds: "set" a suggestion on a source text, "remove" it, "dismiss" it for a text, and "sentence",
    the sentence as it now reads (null: it is gone), which ends suggestions and dismissals on other texts.
    """
    over = _so_far(key, seq)
    is_ = lambda *kinds: F.col(kind).isin(*kinds)
    now = F.struct(F.col(seq).alias("seq"), F.col(text).alias("text"))
    rows = events.withColumn("__set", F.last(F.when(is_("set"), now), True).over(over)).withColumn("__no", F.last(F.when(is_("dismiss"), now), True).over(over))
    other = lambda held: is_("sentence") & held.isNotNull() & ~F.col(text).eqNullSafe(held["text"])
    ends = rows.groupBy(key).agg(
        F.max("__set").alias("held"),
        F.max("__no").alias("no"),
        F.max(F.when(is_("remove", "dismiss") | other(F.col("__set")), F.col(seq))).alias("set_ended"),
        F.max(F.when(other(F.col("__no")), F.col(seq))).alias("no_ended"),
    )
    alive = lambda held, ended: F.when(F.col(ended).isNull() | (F.col(f"{held}.seq") > F.col(ended)), F.col(f"{held}.text"))
    return ends.select(key, alive("held", "set_ended").alias("suggested"), alive("no", "no_ended").alias("dismissed"))


def carried(suggested: DataFrame, sentences: DataFrame, keys: tuple[str, ...] = ("doc_id", "id")) -> DataFrame:
    """Suggestions whose sentence still stands and reads as their ``source``, at its place of now; all others are gone.

    ``suggested`` has ``source``, ``start`` and ``end`` beside the keys, ``sentences`` has ``sentence``, ``start`` and ``end``; a key
    has one sentence.
    """
    now = sentences.select(*keys, F.col("sentence").alias("__now"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    met = suggested.join(now, list(keys)).where(F.col("__now") == F.col("source"))
    place = {"start": F.col("__start"), "end": F.col("__end")}
    return met.select(*[place[c].alias(c) if c in place else F.col(c) for c in suggested.columns])


def entries(requests: DataFrame, key: str = "id", seq: str = "seq", same: tuple[str, ...] = ("text", "context"), priority: str = "priority") -> DataFrame:
    """Requests of a key as entries: a request with the text and context of the one before joins it, any other supersedes it.

    Adds ``entry``, ``since`` (its first request), ``superseded`` (the request that ended it, or null), ``n``
    and the latest ``priority``.
    """
    order = Window.partitionBy(key).orderBy(seq)
    first = F.row_number().over(order) == 1
    changed = first
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(order))
    rows = requests.withColumn("entry", F.sum(changed.cast("int")).over(_so_far(key, seq)))
    grouped = rows.groupBy(key, "entry").agg(F.min(seq).alias("since"), F.max_by(priority, seq).alias(priority), F.count("*").alias("n"), *[F.first(c).alias(c) for c in same])
    return grouped.withColumn("superseded", F.lead("since").over(Window.partitionBy(key).orderBy("entry")))


def withdrawn(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Entries, or any pending work, without those of the keys given."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def served(rows: DataFrame, group: str, slots: int, priority: str = "priority", since: str = "since") -> DataFrame:
    """The next entries of each group: lowest priority value first, first come on ties."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(priority, since))
    return rows.withColumn("rank", rank).where(F.col("rank") <= slots)


def committed(replies: DataFrame, begun: DataFrame, key: str = "id", at: str = "at") -> DataFrame:
    """Replies (``key``, ``entry``, ``at``) whose entry no request had superseded when they came."""
    ends = begun.select(key, "entry", "superseded")
    return replies.join(ends, [key, "entry"]).where(F.col("superseded").isNull() | (F.col(at) < F.col("superseded"))).drop("superseded")


def remembered(rows: DataFrame, memo: DataFrame, fingerprint: Column, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows that the memo answers under the same fingerprint, with its ``outcome``, and rows still to be judged."""
    known = memo.where(F.col("fingerprint") == fingerprint).select(key, "outcome").dropDuplicates([key])
    return rows.join(known, key), rows.join(known, key, "left_anti")


def memo_kept(memo: DataFrame, most: int = 20000) -> DataFrame:
    """The most recently used rows of a memo; a key's latest use counts."""
    last = memo.groupBy("key", "fingerprint").agg(F.max_by("outcome", "used").alias("outcome"), F.max("used").alias("used"))
    return last.orderBy(F.desc("used"), "key").limit(most)


def side_outputs(accepted: str, refused: str):
    """A ``foreachBatch`` function that appends accepted and refused verdicts of a stream to two Parquet folders.

    A batch that is repeated replaces its own folder, so no verdict is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        for path, rows in ((accepted, batch.where("accepted")), (refused, batch.where("not accepted"))):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
