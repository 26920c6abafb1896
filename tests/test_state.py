"""State held by real streams, against the batch forms over the same log."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textgate.streaming import requests, state

START = datetime(2024, 1, 1)


def at(seconds):
    return (START + timedelta(seconds=seconds)).isoformat(sep=" ")


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _folder(spark, path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{path}/{k}")
        yield


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(path))


def _run(df, out, checkpoint, mode="append"):
    q = df.writeStream.format("parquet").outputMode(mode).option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return q.recentProgress


def test_stale_answers_are_dropped_and_the_state_is_bounded(spark, tmp_path):
    texts = "id long, ts string, text string"
    answers = "id long, ts string, answer_id long, made_for string"
    steps = [
        ([(1, at(0), "a"), (2, at(0), "x"), (1, at(100), "b")], [(1, at(50), 10, "a"), (2, at(60), 11, "x")]),
        # too late for the text it was made for; in time for the newer one; for a text that never was
        ([(2, at(150), "y")], [(1, at(120), 12, "a"), (1, at(130), 13, "b"), (2, at(140), 14, "z"), (2, at(149), 15, "x")]),
        # nothing stands within the hour before it
        ([(3, at(200), "old")], [(3, at(200 + 3700), 16, "old"), (1, at(160), 17, "b")]),
        ([(9, at(20_000), "t")], [(9, at(20_010), 18, "t")]),
        # late: an answer of long ago, for the text that stood then
        ([(9, at(40_000), "u")], [(1, at(125), 19, "b"), (9, at(40_001), 20, "u")]),
        ([(9, at(90_000), "v")], [(9, at(90_001), 21, "v")]),
        ([(9, at(190_000), "v")], [(9, at(190_001), 22, "w")]),
    ]
    typed = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    seen = []
    left, right = (_folder(spark, tmp_path / name, [s[k] for s in steps], schema) for k, (name, schema) in enumerate((("texts", texts), ("answers", answers))))
    for _ in zip(left, right, strict=True):
        fresh = state.fresh_answers(typed(_stream(spark, tmp_path / "texts", texts)), typed(_stream(spark, tmp_path / "answers", answers)))
        progress = _run(fresh, tmp_path / "out", tmp_path / "cp")
        seen.append(sum(o.numRowsTotal for o in progress[-1].stateOperators))
    got = {r.answer_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    log = [typed(spark.createDataFrame([r for s in steps for r in s[k]], schema)) for k, schema in ((0, texts), (1, answers))]
    batch = {r.answer_id for r in state.fresh_answers_of_log(*log).collect()}
    assert batch == {10, 11, 13, 15, 17, 18, 19, 20, 21}
    # the late one is lost, and the last batch's window is still open
    assert got == batch - {19}
    assert seen[-1] <= 8 < max(seen)


LOG = "id long, seq long, ts string, text string, kind string"


def _retry_log(rng, n):
    now, out = 0, []
    for k in range(n):
        now += rng.choice([1, 30, 70, 700])
        out.append((rng.randrange(4), k, at(now), rng.choice("aab"), rng.choice(["transient", "transient", "failed", "answered"])))
    return out


def test_retries_of_a_stream(rocks, tmp_path):
    log = _retry_log(random.Random(3), 60)
    end = (datetime.fromisoformat(log[-1][2]) - START).total_seconds()
    last = [(99, 1000, at(end + 4000), "z", "transient")]
    typed = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    batches = [log[:15], log[15:40], log[40:], last, [(99, 1001, at(end + 90_000), "z", "answered")], [(98, 1002, at(end + 90_100), "z", "answered")]]
    for _ in _folder(rocks, tmp_path / "in", batches, LOG):
        progress = _run(state.retries(typed(_stream(rocks, tmp_path / "in", LOG)), forget=50_000), tmp_path / "out", tmp_path / "cp")
    rows = rocks.read.parquet(str(tmp_path / "out")).collect()
    got = sorted((r.id, r.seq, r.state, r.text, r.rounds, r.until) for r in rows if r.state != "due" and r.id < 90)
    batch = state.retries_of_log(typed(rocks.createDataFrame(log, LOG)))
    assert got == sorted((r.id, r.seq, r.state, r.text, r.rounds, r.until) for r in batch.collect())
    due = [r for r in rows if r.state == "due"]
    held = {(r.id, r.text, r.until) for r in rows if r.state == "held"}
    assert due and all((r.id, r.text, r.until) in held for r in due)
    # timers have fired for every hold that stood at the end, and forgotten keys leave nothing
    assert sum(o.numRowsTotal for o in progress[-1].stateOperators) == 0


def test_a_hold_doubles_and_a_timer_grants_one_try(rocks, tmp_path):
    typed = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    batches = [
        [(1, 1, at(0), "a", "transient"), (1, 2, at(1), "a", "transient")],  # held until 61
        [(2, 3, at(100), "q", "failed")],  # alike again: held at once, until 160; the first hold ends
        [(1, 4, at(120), "a", "transient")],  # held for two minutes, until 240
        [(1, 5, at(130), "b", "transient")],  # another text begins anew
        [(3, 6, at(1000), "r", "transient")],
    ]
    for _ in _folder(rocks, tmp_path / "in", batches, LOG):
        _run(state.retries(typed(_stream(rocks, tmp_path / "in", LOG))), tmp_path / "out", tmp_path / "cp")
    got = [(r.id, r.seq, r.state, r.rounds, r.until and int((r.until - START).total_seconds())) for r in rocks.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, "again", 0, None), (1, 2, "held", 1, 61), (2, 3, "held", 1, 160), (1, None, "due", 1, 61), (1, 4, "held", 2, 240), (1, 5, "again", 0, None), (2, None, "due", 1, 160), (3, 6, "again", 0, None)], key=str)


def test_suggestions_of_a_stream_are_those_of_the_log(rocks, tmp_path):
    rng, schema = random.Random(5), "doc_id long, id long, seq long, kind string, text string"
    log = [(rng.randrange(3), rng.randrange(5), k, rng.choice(["set", "set", "remove", "dismiss", "sentence", "sentence"]), rng.choice(["a", "b", None])) for k in range(300)]
    log = [(d, i, s, k, None if k == "remove" else t or ("c" if k != "sentence" else None)) for d, i, s, k, t in log]
    for _ in _folder(rocks, tmp_path / "in", [log[:100], log[100:101], log[101:]], schema):
        progress = _run(state.suggestions(_stream(rocks, tmp_path / "in", schema)), tmp_path / "out", tmp_path / "cp")
    rows = rocks.read.parquet(str(tmp_path / "out")).collect()
    newest = {}
    for r in sorted(rows, key=lambda r: r.seq):
        newest[(r.doc_id, r.id)] = (r.suggested, r.dismissed)
    keyed = rocks.createDataFrame(log, schema).withColumn("id", F.struct("doc_id", "id"))
    batch = {(r.id.doc_id, r.id.id): (r.suggested, r.dismissed) for r in requests.live_suggestions(keyed).collect()}
    assert {k: v for k, v in newest.items() if v != (None, None)} == {k: v for k, v in batch.items() if v != (None, None)}
    # a batch tells changes alone, and nothing is kept of sentences without a suggestion
    assert len(rows) < len(log) and sum(o.numRowsTotal for o in progress[-1].stateOperators) == sum(v != (None, None) for v in batch.values())


def test_gauges_of_a_stream(spark, tmp_path):
    schema = "ts string, ms long, ok boolean, bad boolean"
    batches = [[(at(1), 5, True, False), (at(30), 50, False, True), (at(700), 7, False, False)], [(at(40), 9, True, False)], [(at(9000), 1, True, False)], [(at(2), 99, True, False)], [(at(20_000), 1, True, False)]]
    typed = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    told = []

    def keep(batch, number):
        told.extend((number, int((r.start - START).total_seconds()), r.requests, r.failures, r.shown, r.slowest, r["mean"]) for r in batch.collect())

    for _ in _folder(spark, tmp_path / "in", batches, schema):
        df = state.gauges(typed(_stream(spark, tmp_path / "in", schema)), outcome=F.col("ok"), failed=F.col("bad"))
        q = df.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    last = {}
    for _, start, *rest in told:
        last[start] = tuple(rest)
    # the window that was told twice, and the row that came after its window was closed
    assert last == {0: (3, 1, 2, 9, 7.0), 600: (1, 0, 0, 7, 7.0), 9000: (1, 0, 1, 1, 1.0), 19_800: (1, 0, 1, 1, 1.0)}
    assert [t[1] for t in told].count(0) == 2
    whole = state.gauges(typed(spark.createDataFrame([r for b in batches for r in b], schema)), outcome=F.col("ok"), failed=F.col("bad"))
    assert {int((r.start - START).total_seconds()): r.requests for r in whole.collect()} == {0: 4, 600: 1, 9000: 1, 19_800: 1}
