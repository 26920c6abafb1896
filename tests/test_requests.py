from pyspark.sql import functions as F

from textgate.operators import reports
from textgate.streaming import requests


def test_suggestions_end_with_their_text(spark):
    events = [
        (1, 1, "set", "a"), (1, 2, "sentence", "a"),
        (2, 1, "set", "a"), (2, 2, "sentence", "b"),
        (3, 1, "set", "a"), (3, 2, "dismiss", "a"), (3, 3, "sentence", "a"),
        (4, 1, "dismiss", "a"), (4, 2, "sentence", None),
        (5, 1, "set", "a"), (5, 2, "remove", None), (5, 3, "set", "c"),
    ]
    rows = requests.live_suggestions(spark.createDataFrame(events, "id int, seq int, kind string, text string")).collect()
    assert {r.id: (r.suggested, r.dismissed) for r in rows} == {1: ("a", None), 2: (None, None), 3: (None, "a"), 4: (None, None), 5: ("c", None)}


def test_requests_join_and_supersede(spark):
    asked = [(1, 1, "a", "x", 5), (1, 2, "a", "x", 1), (1, 3, "a", "y", 2), (1, 9, "b", "y", 0), (2, 4, None, None, 7)]
    begun = requests.entries(spark.createDataFrame(asked, "id int, seq int, text string, context string, priority int")).cache()
    got = {(r.id, r.entry): (r.since, r.priority, r.n, r.superseded) for r in begun.collect()}
    assert got == {(1, 1): (1, 1, 2, 3), (1, 2): (3, 2, 1, 9), (1, 3): (9, 0, 1, None), (2, 1): (4, 7, 1, None)}
    replies = spark.createDataFrame([(1, 1, 2), (1, 1, 4), (1, 3, 99), (2, 1, 5)], "id int, entry long, at int")
    assert sorted((r.id, r.entry, r.at) for r in requests.committed(replies, begun).collect()) == [(1, 1, 2), (1, 3, 99), (2, 1, 5)]
    gone = spark.createDataFrame([(1,), (1,)], "id int")
    assert [r.id for r in requests.withdrawn(begun, gone).collect()] == [2]
    assert [r.since for r in requests.served(begun.withColumn("g", F.lit(0)), "g", 2).orderBy("rank").collect()] == [9, 1]


def test_memo(spark):
    memo = spark.createDataFrame([("k", "f", "new", 2), ("k", "f", "old", 1), ("l", "g", "x", 5)], "key string, fingerprint string, outcome string, used int")
    kept = requests.memo_kept(memo, 2)
    known, open_ = requests.remembered(spark.createDataFrame([("k",), ("l",)], "key string"), kept, F.lit("f"))
    assert [tuple(r) for r in known.collect()] == [("k", "new")] and [r.key for r in open_.collect()] == ["l"]
    assert [r.key for r in requests.memo_kept(memo, 1).collect()] == ["l"]


def test_side_outputs(spark, tmp_path):
    write = requests.side_outputs(f"{tmp_path}/a", f"{tmp_path}/r")
    rows = spark.createDataFrame([(1, True), (2, False), (3, False)], "i int, accepted boolean")
    for _ in range(2):
        write(rows, 0)
    assert spark.read.parquet(f"{tmp_path}/a").count() == 1 and spark.read.parquet(f"{tmp_path}/r").count() == 2


def test_verifier_summary(spark):
    rows = [(True, "hide", "hide"), (True, "hide", "show"), (True, "show", "hide"), (True, "show", None), (False, "show", "hide"), (False, "hide", "error")]
    r = reports.verifier_summary(spark.createDataFrame(rows, "inRemit boolean, expected string, got string")).first()
    assert tuple(r) == (1, 2, 1, 2, 2, 1, 0, 1)


def test_rescored(spark):
    names = "source string, replacement string, rejectedText string, action string, rejection string, modelRejection string, by_model boolean, by_rule boolean"
    rows = [
        ("We met in order to talk.", "We met to talk.", None, "rewrite", None, None, True, False),
        ("We met 3 friends.", "We met 4 friends.", None, "rewrite", None, None, True, False),
        ("We met  3 friends.", "", "We met 4 friends.", "keep", "numbers-changed", None, False, False),
        ("We met.", "", None, "failed", None, None, False, False),
        ("We met.", "We  met.", None, "rewrite", None, None, False, True),
    ]
    got = {(r.source, r.replacement): (r.action, r.rejection, r.modelRejection, r.by_model, r.surfaced) for r in reports.rescored(spark.createDataFrame(rows, names)).collect()}
    assert got[("We met in order to talk.", "We met to talk.")] == ("rewrite", None, None, True, True)
    assert got[("We met 3 friends.", "")] == ("keep", "numbers-changed", "numbers-changed", False, False)
    assert got[("We met  3 friends.", "We met 3 friends.")] == ("rewrite", None, "numbers-changed", False, True)
    assert got[("We met.", "")] == ("failed", None, None, False, False)
    assert got[("We met.", "We  met.")][4] is True


def test_suggestions_move_with_their_sentence(spark):
    held = spark.createDataFrame([(1, 1, "a", 0, 1, "x"), (1, 2, "b", 2, 3, "y"), (2, 1, "a", 0, 1, "z")], "doc_id int, id int, source string, start int, end int, replacement string")
    now = spark.createDataFrame([(1, 1, "a", 10, 11), (1, 2, "changed", 12, 19), (3, 1, "a", 0, 1)], "doc_id int, id int, sentence string, start int, end int")
    out = requests.carried(held, now)
    assert out.columns == held.columns and [tuple(r) for r in out.collect()] == [(1, 1, "a", 10, 11, "x")]
