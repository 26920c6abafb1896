import random

from textgate.streaming import identity


def test_nearest_duplicate_wins_and_orphans_demote():
    before = [(0, "a", 0), (1, "b", 10), (2, "a", 20)]
    assert identity.matched(before, [(0, "a", 0), (1, "b", 10), (2, "a", 20)]) == [(0, 0, "kept"), (1, 1, "kept"), (2, 2, "kept")]
    assert identity.matched(before, [(0, "b", 0), (1, "a", 10)]) == [(0, 1, "moved"), (1, None, "new")]
    assert identity.matched([(0, "x", 0)], [(0, "y", 0)]) == [(0, 0, "changed")]


def _plain(before, after):
    """Every equal sentence looked at for each one."""
    used, found, changed = set(), {}, set()
    for k, text, start in after:
        able = [r for r in before if r[1] == text and r[0] not in used]
        if able:
            best = min(able, key=lambda r: (abs(r[2] - start), r[0]))
            used.add(best[0])
            found[k] = best[0]
    for k, _, _ in after:
        if k not in found and k < len(before) and k not in used:
            used.add(k)
            found[k] = k
            changed.add(k)
    texts = [r[1] for r in before]
    gone = {r[1] for r in before if texts.count(r[1]) > 1 and r[0] not in used}
    return [(k, None, "new") if k not in found or (k not in changed and t in gone) else (k, found[k], "changed" if k in changed else "kept" if found[k] == k else "moved") for k, t, _ in after]


def test_batch_agrees_with_a_plain_search(spark):
    rng, rows = random.Random(4), {0: [], 1: []}
    for doc in range(60):
        for side in rows:
            at = 0
            for k in range(rng.randrange(8)):
                rows[side].append((doc, k, rng.choice("abcd"), at))
                at += rng.randrange(1, 5)
    before, after = (spark.createDataFrame(rows[k], "doc_id long, sent_idx int, sentence string, start int") for k in (0, 1))
    got = {(r.doc_id, r.sent_idx): (r.was, r.state) for r in identity.reconciled(before, after).collect()}
    want = {}
    for doc in range(60):
        sides = [[r[1:] for r in rows[k] if r[0] == doc] for k in (0, 1)]
        want |= {(doc, k): (was, state) for k, was, state in _plain(*sides)}
    assert got == want
    assert sum(r["count"] for r in identity.reconciled(before, after).groupBy("state").count().collect()) == len(want)


def test_debounce(spark):
    edits = spark.createDataFrame([(1, 0, "a", "2024-01-01 00:00:00.000"), (1, 0, "b", "2024-01-01 00:00:00.100"), (1, 0, "c", "2024-01-01 00:00:01.000")], "doc_id long, sent_idx int, text string, ts string").selectExpr("doc_id", "sent_idx", "text", "cast(ts as timestamp) as ts")
    assert sorted(r.text for r in identity.debounced(edits).collect()) == ["b", "c"]


def test_stream_keeps_ids_and_drops_late_revisions(spark, tmp_path):
    schema = "doc_id long, rev long, sentences array<string>"
    source, out = tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate([[(1, 0, ["a", "b"])], [(1, 2, ["new", "a", "b"])], [(1, 1, ["zzz"])]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source / str(k)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(str(source))
        q = identity.tracked(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    rows = spark.read.parquet(str(out)).orderBy("rev", "sent_idx").collect()
    last = {r.sentence: r.id for r in rows if r.rev == 2}
    first = {r.sentence: r.id for r in rows if r.rev == 0}
    assert last["a"] == first["a"] and last["b"] == first["b"] and last["new"] not in first.values()
    assert 1 not in {r.rev for r in rows}
