"""Offsets of tokens and clauses, addresses, small report forms, and texts made to overflow patterns."""

import random

import pytest
from pyspark.sql import functions as F

from textgate.functions import masks
from textgate.functions import patterns as P
from textgate.operators import guards, places, reports, rules, segment


def test_tokens_and_clauses_with_offsets(spark):
    texts = ["It's a  test, isn't it?", "Cost 1.5 GB; fine: yes. a|b", "", None, " \u00a0", "😀 é_x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    rows = df.select("k", "t", places.token_spans(F.col("t"), True).alias("all"), places.token_spans(F.col("t")).alias("some"), P.tokens(F.col("t")).alias("plain"), places.clause_spans(F.col("t")).alias("c"), segment.clauses(F.col("t")).alias("p")).collect()
    for r in rows:
        if r.t is None:
            assert r["all"] is None and r.c is None
            continue
        assert "".join(x.text for x in r["all"]) == r.t and all(r.t[x.start : x.end] == x.text for x in r["all"])
        assert [x.text for x in r.some] == r.plain and all(not x.space for x in r.some)
        assert [x.text for x in r.c] == r.p and all(r.t[x.start : x.end] == x.text for x in r.c)
    df = spark.createDataFrame([("ab  \u00a0cd e \n", 2, 8), ("ab  ", 2, 4), ("abc", 0, 3)], "t string, a int, b int")
    assert [tuple(r[0]) for r in df.select(places.trimmed_span(F.col("t"), F.col("a"), F.col("b"))).collect()] == [("cd", 5, 7), ("", 4, 4), ("abc", 0, 3)]


def test_addresses(spark):
    text = 'x https://a.example/b?c\n<img src="http://localhost:8080/v1"> <a href=\'//cdn.example/x.js\'>\nfetch("HTTPS://c.example") @import "http://127.0.0.1/x" new URL(`http://d.example#e`) url(http://f.example)'
    df = spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string")
    got = {r.url: (r.line, r.column, r.host, r.position, r.loopback) for r in places.addresses(df).collect()}
    assert got == {
        "https://a.example/b?c": (1, 3, "a.example", "a literal in the built file", False),
        "http://localhost:8080/v1": (2, 11, "localhost:8080", "a src/href attribute", True),
        "href='//cdn.example/x.js'>": (2, 41, "(protocol-relative)", "a protocol-relative reference, which inherits https:// when served", False),
        "HTTPS://c.example": (3, 8, "c.example", "a fetch or request call", False),
        "http://127.0.0.1/x": (3, 37, "127.0.0.1", "a CSS @import", True),
        "http://d.example#e": (3, 66, "d.example", "a URL, socket or worker constructor", False),
        "http://f.example": (3, 91, "f.example", "a CSS url()", False),
    }


def test_small_forms(spark):
    one = lambda *cols: spark.range(1).select(*cols).first()
    assert tuple(one(*[reports.format_bytes(F.lit(n)) for n in (None, 0, 1500, 2_600_000, 3_456_000_000)])) == ("0 bytes", "0 bytes", "2 kB", "3 MB", "3.46 GB")
    assert tuple(one(P.overlapping(F.lit("aaaa"), F.lit("aa")), P.overlapping(F.lit("a\\Eb\\Eb"), F.lit("\\Eb")), P.overlapping(F.lit("a"), F.lit("")))) == (3, 2, 0)
    assert tuple(one(P.word_after(F.lit("The Cat sat."), F.lit("cat")), P.word_after(F.lit("cat"), F.lit("cat")), P.word_after(F.lit("dog"), F.lit("cat")))) == ("sat", None, None)
    entries = F.expr("array(named_struct('key', 'a', 'value', 1), named_struct('key', 'b', 'value', 2), named_struct('key', 'a', 'value', 3), named_struct('key', CAST(NULL AS STRING), 'value', 4))")
    assert one(reports.last_wins(entries))[0] == {"a": 3, "b": 2}
    terms = spark.createDataFrame([("a \\E b", "a \\E b", ["\\E"]), ("a \\E b", "a b", ["\\E"]), ("x.y", "xzy", ["x.y"])], "s string, c string, t array<string>")
    assert [r[0] for r in terms.select(guards.terms_changed(F.col("s"), F.col("c"), F.col("t"))).collect()] == [False, True, True]


def test_classes_and_places(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("abcdefgh"), rng.random() < 0.4) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, theme string, changed boolean").repartition(5)
    got = [(r.theme, r.total, r.changed) for r in reports.class_counts(df).orderBy("rank").collect()]
    themes = list(dict.fromkeys(t for _, t, _ in rows))
    share = lambda t: sum(c for _, x, c in rows if x == t) / sum(x == t for _, x, _ in rows)
    assert [g[0] for g in got] == sorted(themes, key=lambda t: (-share(t), themes.index(t)))
    lines = [r.line for r in reports.markdown_lines(reports.class_counts(df), {"changed": "Flagged", "theme": "Construction"}).orderBy("at").collect()]
    assert lines[:2] == ["| Flagged | Construction |", "|---|---|"] and lines[2] == f"| {got[0][2]} | {got[0][0]} |"
    placed = reports.placed(df, [F.desc("changed"), F.asc("id")]).orderBy("rank").collect()
    assert [(r["rank"], r.id) for r in placed] == [(k + 1, r[0]) for k, r in enumerate(sorted(rows, key=lambda r: (not r[2], r[0])))]


def test_paragraphs_of_rows_that_share_a_key(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "c\n\nd"), (1, "c\n\nd")], "doc_id long, text string")
    assert sorted(r.paragraph for r in segment.paragraphs(df).collect()) == ["a\nb", "c\n", "c\n", "d", "d"]


@pytest.mark.parametrize("what", ["repaired", "protected", "markup", "numbers", "masks"])
def test_long_repeats_overflow_nothing(spark, what):
    parts = ["/x", "C:\\x\\", "1.", "1,1:", "a.b@c.", "[[a ", "[a](", "`a", "$a$$", "<!-- ", "<script>", "~~~\n", "x_", "A-"]
    df = spark.createDataFrame([(p, part * 20_000) for p, part in enumerate(parts)], "k int, t string")
    if what == "repaired":
        out = rules.repaired(df, "t").select("k", F.length("replacement"))
    else:
        f = {"protected": guards.protected, "markup": guards.markup, "numbers": guards.numbers, "masks": masks.prose}[what]
        out = df.select("k", f(F.col("t")).cast("string"))
    assert len(out.collect()) == len(parts)


def test_alignment_of_long_lines_takes_little_memory():
    import tracemalloc

    rng = random.Random(2)
    words = [str(rng.randrange(2000)) for _ in range(6000)]
    tracemalloc.start()
    ops = guards._aligned(" ".join(words), "front " + " ".join(w for w in words if rng.random() > 0.01))
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
    assert ops[0][0] == "insert" and sum(o[0] == "equal" for o in ops) > 5800


def test_alignment_in_stretches_is_that_of_the_table(monkeypatch):
    rng, cases = random.Random(3), []
    for _ in range(300):
        cases.append(tuple(" ".join(rng.choice("abcdE") for _ in range(rng.randrange(12))) for _ in range(2)))
    whole = [guards._aligned(*c) for c in cases]
    monkeypatch.setattr(guards, "_SMALL", -1)
    assert [guards._aligned(*c) for c in cases] == whole
