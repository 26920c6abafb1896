import random
import re

from pyspark.sql import functions as F

from textgate.functions import contract, lexicons, masks, patterns, relations
from textgate.operators import gate, guards, rules, segment
from textgate.plans import catalogue


def _one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values[0]))]
    df = spark.createDataFrame([tuple(v) for v in values], ", ".join(f"{n} string" for n in names))
    return [r[0] for r in df.select(column(*[F.col(n) for n in names]).alias("x")).collect()]


def test_vocabulary_sizes():
    assert sum(len(p) for _, p in lexicons.GATE) == 102
    assert len(lexicons.GATE) == 12
    assert len(lexicons.RULES) == 78
    assert len(lexicons.REASONS) == 24


def test_segments(spark):
    texts = [
        'Hello there. It costs 3.14 dollars! See e.g. Dr. Smith (Fig. 2). "Done." Next one…  End',
        "# Head\nA line. More.\n\n- item one. two\n- item two\n> quote a\n> quote b\n\n```py\nx. y.\n```\nTail J. Doe came.",
        "",
        None,
        "1. First.\n1. Second",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = segment.sentences(df).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.sentence)
        assert texts[r.doc_id][r.start : r.end] == r.sentence
    assert got[0] == ["Hello there. ", "It costs 3.14 dollars! ", "See e.g. Dr. Smith (Fig. 2). ", '"Done." ', "Next one…  ", "End"]
    assert got[1] == ["# Head\n", "A line. ", "More.\n", "- item one. ", "two\n", "- item two\n", "> quote a\n> quote b\n", "```py\nx. y.\n```\n", "Tail J. Doe came."]
    assert got[4] == ["1. First.\n", "1. Second"]
    assert 2 not in got and 3 not in got


def test_boundaries_are_ascii(spark):
    assert _one(spark, lambda t: patterns.matches(t, r"\ba"), ("éa",), ("xa",), (" a",)) == [True, False, True]
    assert _one(spark, lambda t: patterns.matches(t, r"x\sy"), ("x y",)) == [True]


def test_gate(spark):
    got = _one(spark, lambda t: gate.first_hit(t)["name"], ("We met in order to plan.",), ("The end result was fine.",), ("Nothing odd.",), (None,))
    assert got == ["in order to/for", "end result", None, None]
    same = _one(spark, lambda t: gate.first_family(t).eqNullSafe(gate.first_hit(t)["family"]), ("It could possibly be prior to that.",), ("The man who is here.",), ("Fine.",))
    assert all(same)


def test_rules(spark):
    texts = [
        ("It should be noted that the team met in order to plan.", "The team met to plan."),
        ("This is in order to be put.", "This is in order to be put."),
        ("A large number of the users agreed prior to the vote.", "Many of the users agreed before the vote."),
        ("A large number of users agreed.", "Many users agreed."),
        ("It is able to run due to the fact that we fixed it.", "It can run because we fixed it."),
    ]
    assert _one(spark, rules.apply_rules, *[(t,) for t, _ in texts]) == [x for _, x in texts]
    assert _one(spark, rules.rules_fired, ("A large number of the users agreed prior to it.",)) == [["a large number of", "prior to"]]


def test_repair(spark):
    texts = ["we met on monday , in may  and left", "All is well.", "see https://a.b/x,y on monday ,ok", "eBay is up", "v2 ships ,now", "in `a ,b`  and c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r for r in rules.repaired(df, "t").collect()}
    assert [got[k].replacement for k in range(6)] == ["We met on Monday, in May and left", None, "See https://a.b/x,y on Monday, ok", None, "v2 ships, now", "In `a ,b` and c"]
    assert got[0].ids == ["space-before-punctuation", "repeated-space", "sentence-capitalisation", "proper-noun-capitalisation"]
    assert got[1].ids is None and got[4].repair_reason == "Removes a space before punctuation. Adds the missing space after punctuation."


def test_long_texts_are_cut(spark):
    fence, line = "```\n" + "x = 1. y\n" * 200_000, "Word one two three. " * 20_000
    quote = "> " + "q" * 5000 + "\n> end. Then.\n"
    df = spark.createDataFrame([(1, fence), (2, line), (3, quote)], "doc_id long, text string")
    n = {r.doc_id: r["count"] for r in segment.sentences(df).groupBy("doc_id").count().collect()}
    assert n == {1: 1, 2: 20_000, 3: 2}


def test_paragraphs_and_clauses(spark):
    df = spark.createDataFrame([(1, "a\nb\n\n \nc"), (2, ""), (3, None)], "doc_id long, text string")
    rows = [(r.start, r.end, r.paragraph) for r in segment.paragraphs(df).orderBy("start").collect()]
    assert rows == [(0, 4, "a\nb\n"), (7, 8, "c")]
    assert _one(spark, segment.clauses, ("Cost 1.5 GB; fine: yes. a|b",)) == [["Cost 1.5 GB", " fine", " yes", " a", "b"]]


def test_masks_keep_lengths(spark):
    text = "a <b>c</b> `x <y>` [l](u.v)\n```\ncode\n```\nend <!-- no\nte --> z"
    got = _one(spark, masks.prose, (text,))[0]
    assert len(got) == len(text) and got.count("\n") == text.count("\n")
    # a link's brackets stay, its target alone is masked
    assert got.split() == ["a", "c", "[l](", ")", "end", "z"]
    assert _one(spark, masks.is_loopback, ("localhost",), ("127.0.0.1",), ("127.999.1.1",), ("127.1",), ("x.localhost.com",)) == [True, True, False, False, False]
    assert _one(spark, masks.syntax_of, ("a/B.JSON",), ("x.htm",), ("readme",)) == ["json", "html", "markdown"]


def test_decisions(spark):
    good = '{"action":"rewrite","replacement":" a ","reason":"r"}'
    replies = [good, f"```json\n{good}\n```", '{"action":"rewrite","replacement":" ","reason":"r"}', '{"action":"go"}', "[1]", "no", "", None]
    got = _one(spark, contract.decision, *[(r,) for r in replies])
    assert [g.error for g in got] == [None, None, "empty replacement", "unknown action", "no object", "invalid JSON", "no content", "no content"]
    assert got[1].replacement == "a" and got[3].action is None
    assert _one(spark, contract.complete_json, ('{"action":"keep","replacement":"x","reason":"cut of',), ("",), ("{}",)) == ['{"action":"keep","replacement":"x","reason":""}', "", "{}"]
    assert _one(spark, contract.strip_thinking, ("<think>a{</think> {x}",), ("ok <think>tail",), ("<think>a {b}",)) == ["{x}", "ok", "<think>a {b}"]


def test_related_words(spark):
    same = [("decision", "decided"), ("met", "meeting"), ("run", "running"), ("ad", "ads"), ("affect", "effect"), ("compare", "comparison"), ("hope", "hoped")]
    other = [("hired", "fired"), ("car", "card"), ("wit", "witness"), ("man", "manager"), ("to", "tomorrow")]
    assert _one(spark, relations.related, *same) == [True] * len(same)
    assert _one(spark, relations.related, *other) == [False] * len(other)


def test_alignment_deletes_first():
    ops = guards._aligned("a b c c", "a x c")
    assert [(o[0], o[5]) for o in ops] == [("equal", 0), ("delete", 1), ("delete", 1), ("insert", 1), ("equal", 0)]
    assert [o[6] for o in guards._aligned("the the end", "the end")] == [False, True, False]


def test_alignment_is_longest(spark):
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        ops = guards._aligned(" ".join(a), " ".join(b))
        assert sum(o[0] == "equal" for o in ops) == best[-1][-1]
        assert [o[1] for o in ops if o[1] is not None] == a and [o[2] for o in ops if o[2] is not None] == b


def test_changed_ranges(spark):
    df = spark.createDataFrame([("We met on monday now.", "We met on Monday."), ("A b.", "A x b.")], "s string, c string").withColumn("ops", guards.edit_ops(F.col("s"), F.col("c")))
    got = [[(x.start, x.end) for x in r[0]] for r in df.select(guards.changed_ranges(F.col("s"), F.col("ops"))).collect()]
    assert got == [[(10, 20)], [(0, 1)]]


def test_verdicts(spark):
    pairs = [
        ("We saw 3 dogs.", "We saw 4 dogs.", "numbers-changed"),
        ("It is here.", "It is not here.", "negation-changed"),
        ("It may rain today.", "It rains today.", "certainty-changed"),
        ("All users agreed.", "Users agreed.", "quantifier-changed"),
        ("Cats and dogs came.", "Cats or dogs came.", "direction-changed"),
        ("Is it here?", "It is here.", "question-changed"),
        ("It is here.", "It is here!", "terminal-punctuation-changed"),
        ("Use API_V2 now.", "Use API now.", "protected-token-changed"),
        ("Dogs chase cats daily.", "Cats chase dogs daily.", "name-changed"),
        ("The dogs chase cats daily.", "The cats chase dogs daily.", "order-changed"),
        ("We looked at the affect of it.", "We looked at the effect of it.", None),
        ("They left.", "They left.", "unchanged"),
        ("They left.", None, "empty"),
        ("More than 5 people came.", "Up to 5 people came.", "quantifier-changed"),
        ("The report was sent.", "You sent the report.", "pronoun-changed"),
        ("Oslo is nice.", "Rome is nice.", "name-changed"),
        ("He works at home.", "He worked at home.", "tense-changed"),
        ("The **bold** one.", "The bold one.", "markup-changed"),
        ("We repaired the valve.", "We repaired the tiger.", "word-substituted"),
        ("The dog slept.", "The dog slept. It snored.", "multiple-sentences"),
        ("The dog slept on the rug.", "Dog slept on the rug.", "trivial-edit"),
        ("The probe was damaged by the storm.", "The probe damaged the storm.", "order-changed"),
        ("The buyer paid the seller's agent.", "The seller paid the buyer's agent.", "order-changed"),
        ("Nina noted the leak in the pump log.", "Nina noted the pump log leak.", "order-changed"),
        ("Tell us early, if it breaks we stop.", "Tell us early if it breaks, we stop.", "order-changed"),
        ("Send it by Monday.", "Send it before Monday.", "direction-changed"),
        ("They measured the bonding.", "They measured the bond.", "word-substituted"),
        ("Check the filter.", "Check the filters.", "word-substituted"),
        ("Did the crates clear customs?", "Did the crates be cleared customs?", "order-changed"),
        ("It isn't ready yet.", "It is not ready yet.", "trivial-edit"),
        ("We moved the crate.", "Sorry, that is against the rules.", "instruction-output"),
        ("Please note that the door is shut.", "The door is shut.", None),
        ("It could possibly fail here.", "It could fail here.", None),
        ("Due to the fact that it snowed, we stayed.", "Because it snowed, we stayed.", None),
        ("In place of the old pump we use a new one.", "We use a new one.", "content-dropped"),
        ("He did not fail to call.", "He did not call.", "negation-changed"),
        ("The crew of the ship were all very tired of it.", "Tired of it.", "quantifier-changed"),
    ]
    df = spark.createDataFrame([(k, s, c) for k, (s, c, _) in enumerate(pairs)], "id int, source string, candidate string")
    got = {r.id: r.reason for r in guards.validated(df).select("id", "reason").collect()}
    assert [(pairs[k], got[k]) for k in range(len(pairs)) if got[k] != pairs[k][2]] == []


def test_replies_are_checked(spark):
    rows = [("The cap fell off.", "The cap fell.", "keep", None, None), ("The cap fell off.", "The cap fell.", "rewrite", "It is already clear.", None), ("Set --force now please.", "Set it now.", "rewrite", None, ["--force"]), ("Set --force now.", "Please set --force.", "rewrite", None, ["--force"])]
    df = spark.createDataFrame(rows, "source string, candidate string, action string, why string, terms array<string>")
    got = [r.reason for r in guards.validated(df, terms="terms", action="action", stated="why").collect()]
    assert got[:3] == ["action-mismatch", "reason-contradicts-action", "protected-token-changed"] and got[3] != "protected-token-changed"


def test_deletion_policy(spark):
    pairs = [
        ("The tool is small and sturdy now.", "The tool is small now.", "refused", ["sturdy"]),
        ("They counted the boxes twice yesterday.", "They counted the boxes yesterday.", "refused", ["twice"]),
        ("Wait until the end of day tomorrow.", "Wait until tomorrow.", "refused", None),
        ("They shipped the parts in bulk.", "They shipped the parts.", "refused", ["bulk"]),
        ("They made a very careful measurement of the gap.", "They measured the gap.", "verifier", ["careful"]),
        ("The crew is able to repair it.", "The crew can repair it.", "accepted", []),
        ("They gave consideration to the plan.", "They considered the plan.", "accepted", []),
        ("Keep your own badge here.", "Keep your badge here.", "refused", []),
    ]
    df = spark.createDataFrame([(k, s, c) for k, (s, c, _, _) in enumerate(pairs)], "id int, source string, candidate string")
    got = {r.id: r for r in guards.bucketed(guards.validated(df)).collect()}
    assert [got[k].bucket for k in range(len(pairs))] == [p[2] for p in pairs]
    assert all(p[3] is None or got[k].lost == p[3] for k, p in enumerate(pairs))


def test_hash(spark):
    assert _one(spark, patterns.fnv1a, ("foobar",), ("",), ("a😀",)) == ["bf9cf968", "811c9dc5", _fnv("a😀")]


def _fnv(text):
    h = 0x811C9DC5
    data = text.encode("utf-16-be")
    for k in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[k : k + 2], "big")) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def test_screened_rows_have_the_first_family(spark):
    """Against every pattern tried in order: each phrase alone, and pairs of phrases of two families either way round."""
    phrases = [p for p in catalogue.SCREENED if p]
    texts = [*phrases, *(f"{a} there, {b}" for a in phrases for b in phrases), "We met friends.", "", None]
    rows = spark.createDataFrame([(k, t, "other") for k, t in enumerate(texts)], "id int, text string, word string")
    low = [None if t is None else t.lower() for t in texts]
    hit = lambda t: next((family for family, ps in lexicons.GATE for _, p in ps if re.search(p, t, re.ASCII)), None) if t else None
    want = {k: family for k, t in enumerate(low) if (family := hit(t))}
    assert set(want.values()) == set(gate.FAMILIES)
    assert {r.id: r.family for r in gate.screened(rows, "text").collect()} == want
    assert {r.id: r.f for r in rows.select("id", gate.first_family(F.col("text")).alias("f")).collect() if r.f} == want
    assert gate.screened(rows.limit(0), "text").count() == 0
