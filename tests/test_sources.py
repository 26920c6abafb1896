"""Report files, snapshots that survive a crash, and JSON Lines from growing files."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from textgate.sources import ndjson, runs, snapshots


def _report(rows, **more):
    return json.dumps({"corpusName": "c", "model": {"id": "m"}, "rows": rows, **more})


@pytest.fixture
def folder(tmp_path):
    one = [
        {"id": "a", "source": "S one.", "action": "rewrite", "replacement": "S.", "surfaced": True, "milliseconds": 10, "stages": {"mechanics": False, "model": True}, "expectedAction": "rewrite"},
        {"id": "b", "source": "S two.", "action": "keep", "surfaced": False, "rejection": "numbers-changed", "rejectedText": "S 2.", "milliseconds": 30, "stages": {"model": False}, "expectedAction": "rewrite"},
        {"id": "c", "source": "S three.", "action": "keep", "surfaced": False, "milliseconds": 20, "expectedAction": "keep"},
        {"id": "d", "source": "S four.", "action": "failed", "rejection": "timeout", "milliseconds": 9999, "expectedAction": "rewrite"},
    ]
    two = [
        {"id": "a", "source": "S one.", "action": "rewrite", "replacement": "S.", "surfaced": True, "stages": {"model": True}, "expectedAction": "rewrite"},
        {"id": "b", "source": "S two.", "action": "rewrite", "replacement": "S two!", "surfaced": True, "modelRejection": "name-changed", "rejectedText": "S 2.", "stages": {"mechanics": True}, "expectedAction": "keep"},
        {"id": "e", "source": "S five.", "surfaced": False, "rejection": "numbers-changed", "expectedAction": "rewrite"},
    ]
    (tmp_path / "deep").mkdir()
    (tmp_path / "run-1.json").write_text(_report(one))
    (tmp_path / "deep" / "run-2.json").write_text(_report(two))
    (tmp_path / "run-3.json").write_text(_report(two)[:-40])
    (tmp_path / "run-4.json").write_text("[1, 2]")
    (tmp_path / "run-5.json").write_text('{"corpusName": "without rows"}')
    (tmp_path / "other.txt").write_text("no report")
    return tmp_path


def test_report_files_and_the_quarantine(spark, folder):
    files = runs.report_files(spark, str(folder), "run-*.json")
    broken = {r.run: r.error for r in runs.set_aside(files).collect()}
    assert broken == {"run-3": "no JSON object", "run-4": "no JSON object", "run-5": "no rows"}
    rows = runs.report_rows(files)
    got = {(r.run, r.id): r for r in rows.collect()}
    assert len(got) == 7
    body = (folder / "run-1.json").read_bytes()
    assert (got["run-1", "a"].sha256, got["run-1", "a"].bytes) == (hashlib.sha256(body).hexdigest(), len(body))
    with pytest.raises(FileNotFoundError):
        runs.report_files(spark, str(folder), "none-*.json")
    told = {(r.run, r.id): (r.outcome, r.rejection, r.proposed, r.shown, r.stage) for r in runs.outcomes(rows).collect()}
    assert told == {
        ("run-1", "a"): ("surfaced", None, "S.", "S.", "model"),
        ("run-1", "b"): ("refused", "numbers-changed", "S 2.", None, None),
        ("run-1", "c"): ("quiet", None, None, None, None),
        ("run-1", "d"): ("refused", "timeout", None, None, None),
        ("run-2", "a"): ("surfaced", None, "S.", "S.", "model"),
        ("run-2", "b"): ("surfaced", "name-changed", "S 2.", "S two!", "mechanics"),
        ("run-2", "e"): ("refused", "numbers-changed", None, None, None),
    }
    totals = {r.run: tuple(r)[1:] for r in runs.run_totals(runs.outcomes(rows)).collect()}
    assert totals == {"run-1": (4, 1, 2, 1, 1), "run-2": (3, 2, 1, 0, 0)}
    ledger = {(r.reason, r.run): (r.n, r.total, r.runs) for r in runs.reason_by_run(runs.outcomes(rows)).collect()}
    assert ledger == {("numbers-changed", "run-1"): (1, 2, 2), ("numbers-changed", "run-2"): (1, 2, 2), ("timeout", "run-1"): (1, 1, 1)}
    assert [(r.source, r.candidate, r["from"]) for r in runs.accepted_pairs(rows).collect()] == [("S one.", "S.", "run-2.json")]
    assert [(r.source, r.candidate, r["from"], r.reason) for r in runs.refused_pairs(rows).collect()] == [("S two.", "S 2.", "run-2.json", "name-changed")]
    summary = {r.run: r for r in runs.scored_runs(rows).collect()}
    assert (summary["run-1"].scored, summary["run-1"].recall, summary["run-1"].failures, summary["run-1"].latency_max, summary["run-1"].latency_p50) == (3, 0.5, 1, 30, 20)
    assert {(r.run, r.kind, r.value): r.n for r in runs.reasons(rows).collect()}[("run-1", "failureKinds", "timeout")] == 1


def test_a_version_counts_by_its_mark(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/baseline"
    table = lambda *rows: spark.createDataFrame(rows, "key string, bucket string")
    with pytest.raises(FileNotFoundError):
        snapshots.latest(spark, root)
    assert snapshots.history(spark, root).count() == 0
    assert snapshots.commit(table(("a", "accepted"), ("b", "refused")), root, "first\n“note”") == 1

    def dies(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # between the data and the mark
        m.setattr(snapshots, "marked", dies)
        with pytest.raises(KeyboardInterrupt):
            snapshots.commit(table(("z", "z")), root)
    assert {tuple(r) for r in snapshots.latest(spark, root).collect()} == {("a", "accepted"), ("b", "refused")}
    # within the mark: half of its bytes
    body = (tmp_path / "baseline" / "marks" / "000000000001.json").read_bytes()
    (tmp_path / "baseline" / "marks" / "000000000007.json").write_bytes(body.replace(b'"version": 1', b'"version": 7')[:30])
    (tmp_path / "baseline" / "marks" / "000000000008.json").write_bytes(b"")
    assert [r.version for r in snapshots.history(spark, root).collect()] == [1]
    assert snapshots.commit(table(("a", "refused"), ("c", "accepted")), root, "second") == 2
    assert [(r.version, r.note, r.rows) for r in snapshots.history(spark, root).orderBy("version").collect()] == [(1, "first\n“note”", 2), (2, "second", 2)]
    assert {tuple(r) for r in snapshots.changes(spark, root, 1, 2).collect()} == {("a", "accepted", "refused"), ("b", "refused", None), ("c", None, "accepted")}
    assert snapshots.latest(spark, root, 1).count() == 2
    # two writers of one number: one mark
    version, where, rows = snapshots.written(table(("x", "x")), root)
    snapshots.marked(spark, root, version, where, rows, "")
    with pytest.raises(snapshots.Conflict):
        snapshots.marked(spark, root, version, where, rows, "")


SCHEMA = "id long, text string, tags array<string>, _error string, _file string"


@pytest.fixture
def lines(spark):
    spark.dataSource.register(ndjson.Lines)
    return spark


def test_lines_of_ranges(lines, tmp_path):
    rng, want, body = random.Random(3), [], b""
    for k in range(400):
        row = {"id": k, "text": "é" * rng.randrange(120), "tags": ["a"] * rng.randrange(3)}
        want.append((k, row["text"]))
        body += json.dumps(row, ensure_ascii=False).encode() + rng.choice([b"\n", b"\n", b"\r\n", b"\n\n"])
    (tmp_path / "a.jsonl").write_bytes(body + b'{"id": 999, "text": "without an end"}')
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"{}")
    for size in (400, 5000, 10**7):
        got = lines.read.format("ndjson").schema(SCHEMA).option("rangeBytes", size).load(str(tmp_path))
        assert sorted((r.id, r.text) for r in got.collect()) == [*want, (999, "without an end")]


def test_every_range_has_the_lines_that_begin_in_it(tmp_path):
    rng = random.Random(5)
    for _ in range(60):
        body = "".join(rng.choice("ab\n") for _ in range(rng.randrange(40))).encode()
        path = tmp_path / "f"
        path.write_bytes(body)
        fs, file = ndjson._opened(str(path))
        for size in (1, 2, 3, 7):
            got = [x for a in range(0, len(body), size) for x in ndjson._lines(fs, ndjson.Bytes(file, a, min(a + size, len(body)), len(body)), 5)]
            whole = body.split(b"\n")
            whole = whole[:-1] if not whole[-1] else whole
            assert got == [None if len(x) > 5 else x for x in whole]


def test_bad_and_long_lines_are_told(lines, tmp_path):
    long = json.dumps({"id": 3, "text": "x" * 70_000})
    (tmp_path / "a.jsonl").write_text("\n".join(['{"id": 1, "text": "ok"}', "{broken", long, "[1]", '{"id": "no number"}', '{"id": 2}', '{"other": 1}']) + "\n")
    got = lines.read.format("ndjson").schema(SCHEMA).load(str(tmp_path)).collect()
    assert sorted(((r.id, r.text, r._error) for r in got), key=str) == sorted(
        [(1, "ok", None), (None, None, "no JSON of this schema"), (None, None, "longer than 64000 bytes"), (None, None, "no JSON object"), (None, None, "no JSON of this schema"), (2, None, None), (None, None, None)], key=str)
    assert {r._file.rsplit("/", 1)[-1] for r in got} == {"a.jsonl"}


def test_a_restart_within_a_line_loses_and_repeats_nothing(lines, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    rows = [json.dumps({"id": k, "text": f"row {k}"}) + "\n" for k in range(60)]
    whole = "".join(rows).encode()
    cuts = [0, 5, 100, 101, 333, 700, len(whole) - 3, len(whole)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        with open(source / "a.jsonl", "ab") as f:
            f.write(whole[a:b])
        if a == 333:
            (source / "b.jsonl").write_text('{"id": 100}\n{"id": 101')
        q = lines.readStream.format("ndjson").schema(SCHEMA).option("rangeBytes", 300).load(str(source)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
        if a == 101:
            assert sorted(r.id for r in lines.read.parquet(str(out)).collect()) == list(range(whole[:333].count(b"\n")))
    assert sorted(r.id for r in lines.read.parquet(str(out)).select(F.col("id")).collect()) == [*range(60), 100]
