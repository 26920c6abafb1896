"""State that a stream holds: answers that their text outlived, retries, suggestions, and gauges.

Every operator has a batch form, an ordinary query over the same log, which the stream's results
equal once its watermark has passed.  ``transformWithStateInPandas`` needs the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` must name it before the session's first stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# ---- answers and the texts they were made for


def fresh_answers(texts: DataFrame, answers: DataFrame, key: str = "id", at: str = "ts", text: str = "text", made_for: str = "made_for", answer: str = "answer_id", oldest: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streams: answers whose text is still the current one when they come; all others are stale and are dropped.

    ``texts`` has a row for every revision of a key's text, ``answers`` one for every answer with the text it was
    made for.  Both sides are joined over the ``oldest`` interval before an answer, the newest revision of it decides,
    and rows that come later than ``late`` are dropped; so the state holds that much of both streams and no more.
    Of revisions at one instant the greater text counts.  An answer without a revision in that interval is stale.
    """
    said = answers.withWatermark(at, late)
    known = texts.select(F.col(key).alias("__key"), F.col(at).alias("__since"), F.col(text).alias("__now")).withWatermark("__since", late)
    within = (F.col(key) == F.col("__key")) & (F.col("__since") <= F.col(at)) & (F.col("__since") >= F.col(at) - F.expr(f"INTERVAL {oldest}"))
    met = said.join(known, within)
    newest = met.groupBy(at, key, answer, made_for).agg(F.max_by("__now", F.struct("__since", "__now")).alias("__now"))
    return newest.where(F.col("__now") == F.col(made_for)).select(key, answer, F.col(at), F.col(made_for))


def as_of(points: DataFrame, history: DataFrame, key: str, at: str, value: str, name: str, oldest: str | None = None) -> DataFrame:
    """Adds ``name``: the ``value`` of the key's newest row of ``history`` at or before each point, null where there is none.

    Both sides go through one ordered sweep of each key, so no pairs are made.  Of rows at one instant the greatest value counts.
    """
    columns = [F.col(c) for c in points.columns]
    before = history.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col(at).alias("at"), F.col(value).alias("value")).alias("__held"))
    rows = points.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*columns).alias("__row"))
    both = before.unionByName(rows, allowMissingColumns=True)
    over = Window.partitionBy("__key").orderBy("__at", "__kind", F.col("__held.value")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__held", F.last("__held", True).over(over)).where("__kind = 1")
    held = F.col("__held.value")
    if oldest:
        held = F.when(F.col("__held.at") >= F.col("__at") - F.expr(f"INTERVAL {oldest}"), held)
    return found.select("__row.*", held.alias(name))


def fresh_answers_of_log(texts: DataFrame, answers: DataFrame, key: str = "id", at: str = "ts", text: str = "text", made_for: str = "made_for", answer: str = "answer_id", oldest: str = "1 hour") -> DataFrame:
    """The batch form of ``fresh_answers``."""
    met = as_of(answers, texts, key, at, text, "__now", oldest)
    return met.where(F.col("__now") == F.col(made_for)).select(key, answer, at, made_for)


# ---- retries

MOST_TRIES, FIRST_HOLD, LONGEST_HOLD = 2, 60, 600


class Retries(StatefulProcessor):
    """Of each key the text that failed, its tries and rounds; a timer ends each hold, another the state of a key that nothing touches."""

    def __init__(self, forget: int):
        self.forget = forget * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "text string, tries int, most int, rounds int, held long, touched long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N803
        log = pd.concat(list(rows)).sort_values(["ts", "seq"])
        entry = self.entry.get() if self.entry.exists() else None
        out = []
        for r in log.itertuples():
            now = int(r.ts.value // 1_000_000)
            if r.kind == "answered":
                entry = None
                continue
            text, tries, most, rounds, held, _ = entry if entry and entry[0] == r.text else (r.text, 0, MOST_TRIES, 0, 0, 0)
            if held and now >= held:  # the hold is over: one more try
                tries, held = most - 1, 0
            most = min(most, tries + 1) if r.kind == "failed" else most
            tries += 1
            if tries >= most:
                rounds += 1
                held = now + 1000 * min(FIRST_HOLD * 2 ** (rounds - 1), LONGEST_HOLD)
            entry = (text, tries, most, rounds, held, now)
            out.append((key[0], int(r.seq), "held" if held else "again", text, rounds, pd.Timestamp(held, unit="ms") if held else pd.NaT))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if entry is None:
            self.entry.clear()
        else:
            self.entry.update(entry)
            self.handle.registerTimer(entry[5] + self.forget)
            if entry[4]:
                self.handle.registerTimer(entry[4])
        yield _told(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.entry.exists():
            return
        text, tries, most, rounds, held, touched = self.entry.get()
        if held == at:
            self.entry.update((text, most - 1, most, rounds, 0, touched))
            yield _told([(key[0], None, "due", text, rounds, pd.Timestamp(at, unit="ms"))])
        if at >= touched + self.forget:
            self.entry.clear()

    def close(self) -> None:
        pass


RETRY = "id long, seq long, state string, text string, rounds int, until timestamp"


def _told(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["id", "seq", "state", "text", "rounds", "until"])
    return frame.astype({"id": "int64", "seq": "Int64", "state": object, "text": object, "rounds": "int32", "until": "datetime64[ns]"})


def retries(log: DataFrame, forget: int = 3600, late: str = "10 seconds") -> DataFrame:
    """A stream of ``id, seq, ts, text, kind`` as retry decisions.

    Kinds: "transient" failures allow two tries, a "failed" one, which would fail alike again, none more; "answered"
    ends the entry, and so does another text.  A failure gives "again" (try at once) or "held" with the instant
    ``until`` which the next try waits: a minute, doubled with each round up to ten.  When the watermark passes that
    instant, "due" is told once.  ``forget`` seconds after its last failure a key's state is gone.
    """
    rows = log.select("id", "seq", "ts", "text", "kind").withWatermark("ts", late)
    return rows.groupBy("id").transformWithStateInPandas(Retries(forget), RETRY, "Append", "EventTime")


def retries_of_log(log: DataFrame, key: str = "id", seq: str = "seq", at: str = "ts", text: str = "text", kind: str = "kind") -> DataFrame:
    """The batch form of ``retries`` for keys whose state was not forgotten: each failure's ``state``, ``rounds`` and ``until``.

    A key's run of failures on one text is an entry; its first failure counts as two where it would fail alike again,
    and every failure from the second on holds for a round more.
    """
    order = Window.partitionBy(key).orderBy(at, seq)
    answered = F.col(kind) == "answered"
    begins = ~F.col(text).eqNullSafe(F.lag(text).over(order)) | F.coalesce(F.lag(answered).over(order), F.lit(True))
    rows = log.withColumn("__entry", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(~answered)
    entry = Window.partitionBy(key, "__entry").orderBy(at, seq)
    alike = F.first(F.col(kind) == "failed").over(entry).cast("int")
    rounds = F.greatest(F.row_number().over(entry) + alike - 1, F.lit(0))
    hold = F.least(F.lit(FIRST_HOLD) * F.pow(F.lit(2.0), F.least(rounds, F.lit(10)) - 1), F.lit(float(LONGEST_HOLD))).cast("long")
    until = F.when(rounds > 0, F.timestamp_add("SECOND", hold, F.col(at)))
    return rows.select(key, seq, F.when(rounds > 0, "held").otherwise("again").alias("state"), text, rounds.cast("int").alias("rounds"), until.alias("until"))


# ---- suggestions and dismissals


class Suggestions(StatefulProcessor):
    """Of each document a map from sentence to what is suggested and dismissed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "sentence long", "suggested string, dismissed string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N803
        log = pd.concat(list(rows)).sort_values("seq")
        begun: dict[int, tuple] = {}
        now: dict[int, tuple] = {}
        for r in log.itertuples():
            at = (int(r.id),)
            if r.id not in now:
                now[r.id] = begun[r.id] = tuple(self.live.getValue(at)) if self.live.containsKey(at) else (None, None)
            suggested, dismissed = now[r.id]
            text = None if pd.isna(r.text) else r.text
            if r.kind == "set":
                suggested = text
            elif r.kind == "remove":
                suggested = None
            elif r.kind == "dismiss":
                suggested, dismissed = None, text
            elif r.kind == "sentence":
                suggested = suggested if suggested == text else None
                dismissed = dismissed if dismissed == text else None
            now[r.id] = (suggested, dismissed)
        changed = []
        for sentence, value in now.items():
            if value == (None, None):
                self.live.removeKey((int(sentence),))
            else:
                self.live.updateValue((int(sentence),), value)
            if value != begun[sentence]:
                changed.append((key[0], int(sentence), int(log["seq"].max()), *value))
        yield pd.DataFrame(changed, columns=["doc_id", "id", "seq", "suggested", "dismissed"]).astype({"doc_id": "int64", "id": "int64", "seq": "int64", "suggested": object, "dismissed": object})

    def close(self) -> None:
        pass


def suggestions(log: DataFrame) -> DataFrame:
    """A stream of ``doc_id, id, seq, kind, text`` as changes of a sentence's state: what is ``suggested`` and ``dismissed`` from ``seq`` on.

    Kinds as in ``requests.live_suggestions``: "set", "remove", "dismiss", and "sentence", the sentence as it now reads,
    which ends what stood on another text.  State is one entry for each sentence with a suggestion or a dismissal; a
    batch tells the sentences that it changed.  The newest change of each sentence is what the batch form gives.
    """
    rows = log.select("doc_id", "id", "seq", "kind", "text")
    return rows.groupBy("doc_id").transformWithStateInPandas(Suggestions(), "doc_id long, id long, seq long, suggested string, dismissed string", "Append", "None")


# ---- gauges


def gauges(log: DataFrame, at: str = "ts", width: str = "10 minutes", late: str = "10 minutes", outcome: Column | None = None, latency: str = "ms", failed: Column | None = None) -> DataFrame:
    """Each window's requests, failures, outcomes and latency: a stream aggregation for complete or update mode, or a batch one.

    In update mode a window is told again whenever it changes, and goes from the state once the watermark has passed its end.
    """
    rows = log.withWatermark(at, late) if log.isStreaming else log
    bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    shown = F.coalesce(outcome, F.lit(False)) if outcome is not None else F.lit(False)
    told = rows.groupBy(F.window(at, width).alias("w")).agg(
        F.count("*").alias("requests"), F.count_if(bad).alias("failures"), F.count_if(shown & ~bad).alias("shown"), F.max(F.when(~bad, F.col(latency))).alias("slowest"), F.sum(F.when(~bad, F.col(latency))).alias("total")
    )
    answered = F.col("requests") - F.col("failures")
    return told.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "failures", "shown", "slowest", F.when(answered > 0, F.col("total") / answered).alias("mean"))
