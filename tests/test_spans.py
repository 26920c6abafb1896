"""Ranges, overlap, change sets and facets against plain versions."""

import random

from pyspark.sql import functions as F

from textgate.operators import facets, segment, spans


def test_what_is_no_prose():
    kinds = lambda t: [(t[a:b], k) for a, b, k in spans.not_prose(t)]
    assert kinds("---\ntitle: x\n---\nText `code` and ``a`b`` end") == [("---\ntitle: x\n---\n", "frontmatter"), ("`code`", "code"), ("``a`b``", "code")]
    assert kinds("a <!-- b `c` --> d %% e %% f $$x$$ g $y$ h <b class='z'>i</b>") == [("<!-- b `c` -->", "comment"), ("%% e %%", "comment"), ("$$x$$", "math"), ("$y$", "math"), ("<b class='z'>", "html"), ("</b>", "html")]
    assert kinds("a\n```js\nx = `1`\n```\nb") == [("```js\nx = `1`\n```\n", "code")]
    assert kinds("a\n~~~\nopen <b>") == [("~~~\nopen <b>", "code")]
    assert kinds("a <!-- open") == [("<!-- open", "comment")]
    assert kinds("it costs $5 and $6, 1 < 2, `open, %% open, $$ open") == []
    assert kinds("") == []


def test_ranges_take_time_in_proportion():
    for part in ("`", "`` ", "$a ", "<!-- ", "%%", "$$ ", "<a ", "```\n", "~~~~\nx\n~~~\n", "---\n", "`a` ", "$a$ ", "\n    ```"):
        text = part * 30_000
        found = list(spans.not_prose(text))
        assert all(a < b for a, b, _ in found) and all(x[1] <= y[0] for x, y in zip(found[:-1], found[1:], strict=True))


def _spans(rng, n, keys, wide):
    out = []
    for _ in range(n):
        a = rng.randrange(60)
        out.append((rng.choice(keys), a, a + rng.randrange(wide)))
    return out


def test_overlap_against_a_plain_search(spark):
    rng = random.Random(7)
    a, b = _spans(rng, 300, [0, 1, 2, 3, None], 8), _spans(rng, 40, [0, 1, 2, None], 12)
    left = spark.createDataFrame([(k, *r) for k, r in enumerate(a)], "n int, id int, start int, end int")
    right = spark.createDataFrame(b, "id int, start int, end int")
    want = [any(k is not None and k == x and max(s, p) < min(e, q) for x, p, q in b) for k, s, e in a]
    got = spans.touched(left, right, "id").orderBy("n").collect()
    assert [r.touched for r in got] == want and got[0].asDict().keys() == {"n", "id", "start", "end", "touched"}
    assert {r.n for r in spans.clear_of(left, right, "id").collect()} == {k for k, t in enumerate(want) if not t}
    assert spans.clear_of(left, right.where("false"), "id").count() == 300


def test_eligible_sentences_of_a_document_with_many_ranges(spark):
    body = "".join(f"Sentence number {k} stands here. `code {k}` is hidden in this one. " for k in range(10_000))
    docs = spark.createDataFrame([(1, body), (2, "Fine here. 12 + 12.\n\n```\nx.\n```\n\nNot finished"), (3, None), (4, "<!-- A. --> After it. Next.")], "doc_id long, text string")
    sents = segment.sentences(docs)
    got = spans.eligible(sents, spans.excluded_ranges(docs))
    assert got.columns == [*sents.columns, "left_out"]
    counts = {(r.doc_id, r.left_out): r["count"] for r in got.groupBy("doc_id", "left_out").count().collect()}
    assert counts[(1, None)] == counts[(1, "excluded")] == 10_000
    assert {r.sentence.strip(): r.left_out for r in got.where("doc_id = 2").collect()} == {"Fine here.": None, "12 + 12.": "no-letter", "```\nx.\n```": "excluded", "Not finished": "incomplete"}
    assert [r.left_out for r in got.where("doc_id = 4").orderBy("sent_idx").collect()][-1] is None


def _moved(text, edits, at, side):
    """A mark as a character of its own, carried through the edits by hand."""
    now, old = 0, 0
    for a, b, new in edits:
        if b > at or (b == at and side < 0 and a == b):
            if a <= at:
                return now + (at - old if a == at else (a - old) + (0 if side < 0 else len(new))), a < at < b
            break
        now += (a - old) + len(new)
        old = b
    return now + at - old, False


def test_offsets_through_change_sets(spark):
    rng, marks, changes = random.Random(11), [], []
    want = {}
    for doc in range(120):
        text = "x" * 40
        cuts = sorted(rng.sample(range(41), rng.choice([0, 2, 4, 8])))
        edits = []
        for a, b in zip(cuts[::2], cuts[1::2], strict=True):
            b = a if rng.random() < 0.3 else b
            edits.append((a, b, "y" * rng.randrange(4)))
        changes += [(doc, a, b, len(t)) for a, b, t in edits]
        for _ in range(25):
            at, side = rng.randrange(41), rng.choice([-1, 1])
            want[len(marks)] = _moved(text, edits, at, side)
            marks.append((len(marks), doc, at, side))
    rows = spark.createDataFrame(marks, "n int, id int, at int, side int").withColumn("now_", F.lit(1))
    got = spans.reanchored(rows, spark.createDataFrame(changes, "id int, start int, end int, size int"), "id").collect()
    assert {r.n: (r.now, r.deleted) for r in got} == want
    # two edits at one place: what is put in before what is replaced
    two = spark.createDataFrame([(1, 5, 5, 2), (1, 5, 8, 1)], "id int, start int, end int, size int")
    at = spark.createDataFrame([(1, 4, 1), (1, 5, -1), (1, 5, 1), (1, 6, -1), (1, 6, 1), (1, 8, -1), (1, 9, 1), (2, 3, 1)], "id int, at int, side int")
    assert sorted((r.id, r["at"], r.side, r.now, r.deleted) for r in spans.reanchored(at, two, "id").collect()) == [
        (1, 4, 1, 4, False), (1, 5, -1, 5, False), (1, 5, 1, 7, False), (1, 6, -1, 7, True), (1, 6, 1, 8, True), (1, 8, -1, 8, False), (1, 9, 1, 9, False), (2, 3, 1, 3, False)]


def test_facets_count_under_the_others_choices(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.choice([1, 2]), rng.choice(["Needle here", "hay", None])) for _ in range(200)]
    rows, names = spark.createDataFrame(data, "f string, g string, h int, body string"), ("f", "g", "h")
    for chosen, needle in (({}, ""), ({"f": "a"}, ""), ({"f": "a", "h": 2}, " needle "), ({"g": "x", "f": ""}, "HAY"), ({"f": "zzz"}, "")):
        passes = lambda r, skip=None: all(r[names.index(c)] == v for c, v in chosen.items() if v != "" and c != skip) and needle.strip().lower() in (r[3] or "").lower()  # noqa: E731, B023
        want = {}
        for k, c in enumerate(names):
            for r in data:
                if passes(r, c):
                    key = (c, None if r[k] is None else str(r[k]))
                    want[key] = want.get(key, 0) + 1
        want |= {("", "shown"): sum(passes(r) for r in data), ("", "all"): 200}
        assert {(r.facet, r.value): r.n for r in facets.faceted(rows, names, chosen, needle, ("body",)).collect()} == want
        assert facets.chosen_rows(rows, chosen, needle, ("body",)).count() == want[("", "shown")]
    assert {(r.facet, r.value): r.n for r in facets.faceted(rows.where("false"), names, {}).collect()} == {("", "shown"): 0, ("", "all"): 0}
