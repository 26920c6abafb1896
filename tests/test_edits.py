import random

from pyspark.sql import functions as F

from textgate.functions import masks, patterns
from textgate.operators import claims, explain, guards, markdown


def _explained(spark, *pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, s string, c string")
    df = df.withColumn("ops", guards.edit_ops(F.col("s"), F.col("c")))
    return [r[0] for r in df.select(explain.explained(F.col("ops"), F.col("s"), F.col("c")), "i").orderBy("i").collect()]


def test_explanations(spark):
    assert _explained(
        spark,
        ("It is a very nice day.", "It is a nice day."),
        ("It is very really good.", "It is really good."),
        ("on a quarterly basis we met", "quarterly we met"),
        ("He go to school", "He went to school"),
        ("They is here", "They are here"),
        ("It will effect us", "It will affect us"),
        ("We walked home", "We walked home,"),
        ("We saw cat", "We saw the cat"),
        ("on wednesday we left", "On Wednesday we left"),
        ("The end", "the end"),
        ("a b c", "a b c"),
        ("x1 a b c y1 d e f z1 g h i w1 j", "x2 a b c y2 d e f z2 g h i w2 j"),
        ("He walks home", "He walking home"),
    ) == [
        "Removes “very”.",
        "Removes “very”, which repeats the word beside it.",
        "Shortens “on a quarterly basis” to “quarterly”.",
        "Replaces “go” with “went”.",
        "Changes “is” to “are” to match the subject.",
        "Corrects “effect” to “affect”.",
        "Adds a comma.",
        "Adds the missing article “the”.",
        "Capitalizes “On” and “Wednesday”.",
        "Lowercases “the”.",
        "",
        "Replaces “x1” with “x2”, replaces “y1” with “y2”, replaces “z1” with “z2” and makes 1 further small changes.",
        "Changes “walks” to “walking”.",
    ]


def test_diff_parts_as_html(spark):
    df = spark.createDataFrame([("we met <b>, on monday", "we met <b>, Monday")], "s string, c string")
    df = df.withColumn("ops", guards.edit_ops(F.col("s"), F.col("c")))
    parts, line = df.select(explain.diff_parts(F.col("ops")), explain.inline_html(explain.diff_parts(F.col("ops")))).first()
    assert [(p["type"], p["text"]) for p in parts][-3:] == [("delete", "on"), ("delete", "monday"), ("insert", "Monday")]
    assert line.endswith('<span class="del">on</span> <span class="del">monday</span> <span class="ins">Monday</span>')
    assert "&lt;" in line and "<b>" not in line


def test_marks(spark):
    df = spark.createDataFrame([("one < two three\n", [("b", 6, 9), ("a", 0, 3), ("c", 8, 12)])], "t string, m array<struct<id:string,start:int,end:int>>")
    assert df.select(explain.marked_html(F.col("t"), F.col("m"))).first()[0] == '<mark data-id="a">one</mark> &lt; <mark data-id="b">two</mark> three\n​'


def test_projection(spark):
    cases = {
        "**The archive** is *copied weekly*.": ("The archive is copied weekly.", []),
        "- [ ] Use `a``b` and ``c`d``.": ("Use a``b and c`d.", ["a``b", "c`d"]),
        "See [[Sync Tool|the tool]] and [docs](http://x) ![[pic.png]].": ("See the tool and docs .", ["the tool", "docs"]),
        "> one\n> two _three_ api_key 3*4": ("one\ntwo three api_key 3*4", []),
        "a \\* b 3 * 4": ("a * b 3 * 4", []),
        "# ": ("# ", []),
        "": ("", []),
        "x\n```\ny": ("x\n```\ny", []),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "i int, t string")
    rows = df.withColumn("p", markdown.projection(F.col("t"))).orderBy("i").collect()
    for r, (text, (prose, terms)) in zip(rows, cases.items(), strict=False):
        assert (r.p["text"], r.p["terms"]) == (prose, terms)
        assert "```" in text or [text[i] for i in r.p["offsets"]] == list(prose)
    assert rows[0].p["complete"] and not rows[7].p["complete"]
    assert rows[-1].p is None or rows[-1].p["text"] is None


def test_source_edits_keep_markup(spark):
    cases = [
        ("**The archive** is is *copied weekly*.", "The archive is copied weekly.", "**The archive** is *copied weekly*."),
        ("We really use [[Sync Tool]] a lot.", "We use Sync Tool often.", "We use [[Sync Tool]] often."),
        ("> we went\n> home very late", "we went home late", "> we went > home late"),
        ("a \\* b", "a b", "a b"),
        ("on *wednesday* we left", "On Wednesday we left", "On *Wednesday* we left"),
        ("same", "same", "same"),
    ]
    df = spark.createDataFrame([(i, s, r) for i, (s, r, _) in enumerate(cases)], "i int, s string, r string")
    df = df.withColumn("e", markdown.source_edits(F.col("s"), F.col("r"))).withColumn("out", markdown.applied(F.col("s"), F.col("e")))
    assert [x.out for x in df.orderBy("i").collect()] == [out for *_, out in cases]


def test_edited_prose_is_the_replacement():
    rng = random.Random(5)
    words = ["the", "**big**", "*old*", "`run x`", "[a link](u)", "[[note|name]]", "cat", "sat,", "down", "api_key"]
    for _ in range(400):
        source = " ".join(rng.choices(words, k=rng.randint(1, 8)))
        kept, _, _ = markdown.flattened(source)
        left = "".join(source[a:b] for a, b in kept).split(" ")
        new = [w for w in left if rng.random() > 0.2]
        for _ in range(rng.randint(0, 2)):
            new.insert(rng.randint(0, len(new)), rng.choice(["dog", "ran", "up"]))
        # characters that were prose and stay, with what is put in; markup is left as it is
        out, at = "", 0
        for a, b, text in [*markdown._edits(source, " ".join(new)), (len(source), len(source), "")]:
            out += "".join(source[max(i, at) : min(j, a)] for i, j in kept if max(i, at) < min(j, a)) + text
            at = b
        assert out == " ".join(new)


def test_source_runs(spark):
    df = spark.createDataFrame([("a **b c** \\*d",)], "t string").withColumn("p", markdown.projection(F.col("t")))
    runs = lambda a, b: markdown.source_runs(F.col("p"), F.lit(a), F.lit(b))
    row = df.select("p.text", runs(0, 5), runs(5, 7), runs(3, 3), markdown.source_position(F.col("p"), F.lit(99))).first()
    assert row[0] == "a b c *d"
    assert [[tuple(r) for r in x] for x in row[1:4]] == [[(0, 2), (4, 7)], [(9, 12)], [(5, 5)]]
    assert row[4] == 13


def test_claims(spark):
    texts = [
        "This is a revolutionary tool!\nIt is not seamless.",
        "Setup takes 5 minutes. Setup takes 5 minutes if planned; setup is easy.",
        "Zero false positives on `bench/x.json`. Zero false positives.",
        "<!-- forbidden-phrases: allow marketing/boast — quoted -->\nA seamless flow.\nA seamless one.",
        "<!-- forbidden-phrases: allow marketing/boast -->\n<!-- forbidden-phrases: allow no/such: why -->",
        "`seamless` and\n```\nseamless\n```\n[x](http://seamless.io) ~~~",
        "A state\nof the art past perfect tense. A perfect day.",
        None,
        "",
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, line int")
    got = {}
    for r in claims.findings(df).collect():
        got.setdefault(r.doc_id, []).append((r.line, r.column, r.rule, r.text, r.evidence, r.waived))
    got = {k: sorted(v) for k, v in got.items()}
    assert got[0] == [(1, 11, "marketing/boast", "revolutionary", None, False), (1, 29, "marketing/exclamation", "!", None, False), (2, 11, "marketing/boast", "seamless", None, False)]
    assert got[1] == [(1, 1, "unsupported/install-time", "Setup", "5 minutes", False)]
    assert got[2] == [(1, 41, "absolute/false-positives", "Zero false positives", None, False)]
    assert got[3] == [(2, 3, "marketing/boast", "seamless", None, True), (3, 3, "marketing/boast", "seamless", None, False)]
    assert [(r[0], r[2]) for r in got[4]] == [(1, "waiver/no-reason"), (2, "waiver/unknown-rule")]
    assert got[6] == [(1, 3, "marketing/boast", "state\nof the art", None, False), (2, 34, "absolute/perfection", "perfect", None, False)]
    assert set(got) == {0, 1, 2, 3, 4, 6}


def test_fences_and_json_are_masked(spark):
    fenced = "a\n~~~ x\nb ```\n~~~~\nc\n```\nopen"
    deep = "```\n" + "line\n" * 20000 + "end"
    df = spark.createDataFrame([(fenced,), (deep,)], "t string")
    one, two = [r[0] for r in df.select(masks.prose(F.col("t"))).collect()]
    assert one.split() == ["a", "c"] and len(one) == len(fenced)
    assert not two.strip() and len(two) == len(deep)
    manifest = '{"name": "x", "description": "Say \\"hi\\" now", "n": 1}'
    assert spark.createDataFrame([(manifest,)], "t string").select(masks.prose(F.col("t"), "json")).first()[0].strip() == 'Say \\"hi\\" now'


def test_outcome_key(spark):
    def plain(text, seed):
        for b in text.encode("utf-16-be")[1::2] if text.isascii() else []:
            seed = ((seed ^ b) * 0x01000193) & 0xFFFFFFFF
        return f"{seed:08x}"

    df = spark.createDataFrame([('say "a"\n\x1f\\', ["b", "c"]), ("", [])], "s string, t array<string>")
    for row, text in zip(df.select(patterns.outcome_key(F.col("s"), F.col("t"))).collect(), ['["say \\"a\\"\\n\\u001f\\\\",["b","c"]]', '["",[]]'], strict=True):
        assert row[0] == plain(text, 0x811C9DC5) + plain(text, 0x01000193)
