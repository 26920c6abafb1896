"""What keeps work in proportion to the input: plans without moved texts or repeated steps, and results that must not change with it."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from textgate.functions import lexicons, patterns, relations
from textgate.operators import claims, gate, guards, reports, rules, segment
from textgate.plans import catalogue
from textgate.streaming import identity


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_claims_are_found_without_moving_texts(spark):
    text = "<!-- forbidden-phrases: allow marketing/boast - quoted -->\nThis is a seamless tool.\n" + "Plain words; more.\n" * 50 + "It is a seamless tool."
    df = claims.findings(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    # rows of one line and rule meet once; nothing else is dealt out
    assert plan_of(df).count("Exchange hashpartitioning") == 1
    rows = df.orderBy("line").collect()
    assert [(r["line"], r["column"], r["rule"], r["waived"]) for r in rows] == [(2, 11, "marketing/boast", True), (53, 9, "marketing/boast", False)]


def test_phrases_of_rules_are_looked_for_once(spark):
    df = catalogue.queries()["clarity_rules_fire"](spark, "/root/testdata/sf0.001")
    # once in the step that hands them on, and in no filter that Spark puts before it
    assert plan_of(df).split("== Initial Plan ==")[-1].count("(?u)") == 1
    rows = spark.createDataFrame([("We met in order to talk, due to the fact that, in order to.",), ("Plain.",)], "s string").select(rules.rules_fired(F.col("s")).alias("r")).collect()
    assert [r["r"] for r in rows] == [[p for p, _, _ in rules.lexicons.RULES if p in ("in order to", "due to the fact that")], []]


def test_repairs_are_made_once(spark):
    plan = plan_of(catalogue.queries()["mechanics_repairs"](spark, "/root/testdata/sf0.001"))
    assert "size(ids" not in plan and "size(CASE" not in plan


def test_nearest_goes_through_a_group_once(spark):
    n = 40_000
    left = spark.range(n).select(F.lit(1).alias("key"), F.col("id").alias("at"), F.col("id").alias("l"))
    right = spark.range(n).select(F.lit(1).alias("key"), (F.col("id") * 3).alias("at"), F.col("id").alias("r"))
    found = reports.nearest(left, right, "key", "at", "l", "r")
    assert "currentrow$(), unboundedfollowing$()" not in plan_of(found)
    assert found.where(F.col("r") != F.round(F.col("l") / 3)).count() == 0


def test_a_document_is_cut_once_for_both_revisions(spark):
    df = catalogue.queries()["reconcile_identity"](spark, "/root/testdata/sf0.001")
    assert plan_of(df).split("== Initial Plan ==")[-1].count("pythonUDF") + plan_of(df).split("== Initial Plan ==")[-1].count("MapInArrow") == 2
    sents = spark.createDataFrame([(1, 0, "a", 0), (1, 1, "b", 1), (2, 0, "a", 0)], "doc_id long, sent_idx int, sentence string, start int")
    rows = identity.reconciled(sents, sents.where("sent_idx > 0").select("doc_id", (F.col("sent_idx") - 1).alias("sent_idx"), "sentence", "start")).collect()
    assert [(r["doc_id"], r["sent_idx"], r["was"], r["state"]) for r in rows] == [(1, 0, 1, "moved")]


def test_names_of_patterns_are_halved_for(spark):
    plan = plan_of(catalogue.queries()["gate_pattern_names"](spark, "/root/testdata/sf0.001"))
    assert "isnotnull(CASE" not in plan
    some = spark.createDataFrame([("They make a decision for the purpose of it.",), ("Plain.",)], "line string")
    first = some.select(gate.first_hit(F.col("line"))["name"].alias("n")).collect()
    assert [r["name"] for r in gate.screened(some, "line", "name").collect()] == [first[0]["n"]] and first[1]["n"] is None


def test_sentences_are_handed_on_in_small_batches(spark):
    docs = spark.range(300).repartition(1).select(F.col("id").alias("doc_id"), F.lit("One is here. Two is there.").alias("text"))

    # what leaves the cut is bounded by documents, whatever the batch it came in
    batch = docs.toArrow().to_batches()[0]
    assert [b.num_rows for b in segment._few(iter([batch]))] == [64, 64, 64, 64, 44]
    assert segment.sentences(docs).count() == 600


def test_words_that_a_list_lacks(spark):
    rng = random.Random(3)
    cases = [([rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(30)], [rng.choice("abcdefghijklmnopqrstuvwxyz"[::2]) for _ in range(n)]) for k in (3, 26) for n in (0, 5, 30)]
    cases.append(([str(k) for k in range(20_000)], ["x", *map(str, range(0, 20_000, 2))]))
    df = spark.createDataFrame(cases, "a array<string>, b array<string>")
    began = time.time()
    got = [r["n"] for r in df.select(relations.lacking(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == [sum(w not in set(b) for w in a) for a, b in cases] and time.time() - began < 20


def test_quantifiers_of_a_group_are_found_without_copies_of_copies(spark):
    df = spark.createDataFrame([("At least about ten, around the most of it, around ten.",), ("The least of it, about him.",)], "s string")
    sets = df.select(guards.quantifier_sets(F.col("s"))[3].alias("w"))
    assert plan_of(sets).count("array_remove") == 0
    assert [set(r["w"]) & {"about", "around", "least", "most"} for r in sets.collect()] == [{"about", "around", "least"}, set()]


def test_new_pronouns_are_looked_for_among_new_words(spark):
    df = spark.createDataFrame([("We go.", "We go."), ("We go.", "They go."), ("We go.", "We've gone."), ("A cat.", "It is a cat."), ("They go.", "They say you go.")], "s string, c string")
    changed = guards.pronouns_changed(F.col("s"), F.col("c"))
    assert [r["x"] for r in df.select(changed.alias("x")).collect()] == [False, True, False, False, True]
    assert plan_of(df.select(changed.alias("x"))).count("arrays_overlap") <= 2 * len(guards.lex.PRONOUNS)


def test_capital_of_an_opener_is_one_letter(spark):
    import duckdb

    letters = "aßäéœþſµαςᾳѐыա"
    df = spark.createDataFrame([(f"{c}bc, d",) for c in letters], "s string")
    got = [r["t"] for r in df.select(rules.capital_opener(F.col("s")).alias("t")).collect()]
    assert got == [duckdb.execute("select upper(?)", [c]).fetchall()[0][0] + "bc, d" for c in letters] and "ẞbc, d" in got


_PARTS = ("and we|or they|but it|then|to run|walking|singing|, and to|, and|, how|, to go|, of the|is|was written by the|there is|that|who|made|a decision|repeat|again|because|if|although|could go|we could"
          "|let me know what|is?|just to|arguably,|prior to|which are|has not been seen|.|!|,|;|é|İ|ſ|K|\u00a0|\u3000|\ufeff|\n|word|" + "x" * 35 + "|" + "ab " * 50).split("|")


def _mixed(spark):
    """Texts of parts of the patterns, and gaps as wide as a pattern allows and one wider, with what the plain expressions say."""
    rng = random.Random(7)
    texts = [rng.choice(["", " ", "\u00a0"]).join(rng.choice(_PARTS) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(40))) for _ in range(1500)]
    gaps = ["and we %s and they", "singing%s, and to run", ", to go%s, and to run", "let me know what%sis?", "we can go%s or they can", ", how it%s, and", "repeat%sagain", "because%sand if"]
    texts += [g % (" " + "é" * n + " ") for g in gaps for n in (0, 20, 22, 23, 24, 25, 55, 58, 59, 60, *range(150, 166))] + ["x" * n + "ing, and to run" for n in (38, 40, 41)]
    return spark.createDataFrame([(t,) for t in [*texts, *texts[:100], "", None]], "t string").repartition(3)


def test_families_are_found_by_one_scan_each(spark):
    plan = plan_of(catalogue.queries()["gate_families_by_language"](spark, "/root/testdata/sf0.001")).split("== Initial Plan ==")[-1]
    assert "RLIKE" not in plan and plan.count("ArrowEvalPython") == 1
    t = F.col("t")
    want = {family: patterns.matches(F.lower(t), patterns.any_of([p for _, p in ps]), False) for family, ps in lexicons.GATE}
    got = gate.family_hits(t)
    same = [F.count_if(got[f].eqNullSafe(want[f])) for f in gate.FAMILIES]
    df = _mixed(spark)
    row = df.agg(*same, *[F.count_if(got[f]) for f in gate.FAMILIES]).first()
    assert set(row[:12]) == {df.count()} and min(row[12:]) > 0
    assert df.where("t = ''").select(*gate.family_hits(t, ["expletive"]).values()).first()[0] is False


def test_first_hits_are_found_by_scans(spark):
    plan = plan_of(catalogue.queries()["gate_family_counts"](spark, "/root/testdata/sf0.001")).split("== Initial Plan ==")[-1]
    # the scan is made once: no filter below repeats it
    assert "RLIKE" not in plan and plan.count("ArrowEvalPython") == 1
    t = F.col("t")
    told = F.coalesce(*[F.when(patterns.matches(F.lower(t), p, False), F.lit(f"{family}/{name}")) for family, ps in lexicons.GATE for name, p in ps])
    df = _mixed(spark).withColumn("want", told)
    got = gate.first_hit(t)
    assert df.where(~F.concat_ws("/", got["family"], got["name"]).eqNullSafe(F.coalesce("want", F.lit("")))).count() == 0
    rows = gate.screened(gate.screened(df, "t"), "t", "name")
    assert rows.where(F.concat_ws("/", "family", "name") != F.col("want")).count() == 0 and rows.count() == df.where("want is not null").count() > 500


def test_ends_of_sentences_are_told_in_one_look():
    began = time.time()
    # marks that do not end the text were looked through anew from each of them
    assert not segment.completes("*" * 100_000 + "a") and segment.completes("a." + "*" * 100_000)
    assert time.time() - began < 2
    for word in ("Mr", "approx", "xapprox", "a.m", "é.g", "e.g", "e.G", "U", "u", "1", "at", "St", "_st", "dept", "adept", "İ"):
        known = word in ("Mr", "approx", "a.m", "e.g", "e.G", "U", "St", "_st", "dept", "İ")
        assert segment.completes(f"Of {word}.)") is not known
        text = f"Of {word}. Then"
        assert (text[list(segment.pieces(text))[-1][0] :] == "Then") is not known


def test_repairs_look_at_a_run_of_blanks_once(spark):
    # from each blank of a run its rest was looked through anew
    text = "a" + " " * 200_000 + "b , c" + "\t" * 200_000
    began = time.time()
    row = rules.repaired(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert time.time() - began < 10
    assert row["ids"] == ["space-before-punctuation", "repeated-space", "sentence-capitalisation"] and row["replacement"] == "A b, c" + "\t" * 200_000


def test_cheap_looks_leave_repairs_as_they_were(spark):
    odd = [
        (' ,a', ', a'), ('x  y', 'X y'), ('x \t,y', 'X, y'), ('1,2 3,a', '1,2 3, a'), ('a:b /c,d', 'A: b /c,d'),
        ('see a.md ,b', None), ('in may ,b', 'In May, b'), ('tuesday', 'Tuesday'), ('a\xa0b', 'A b'), ('\ufeffa  b', '\ufeffA b'),
        ('A\xa0 \u202fb', 'A b'), ('\u2003a,b', '\u2003A, b'), ('mail a.b@c.de  now', 'Mail a.b@c.de now'), ('a .b . c', 'A .b. c'), (',1', ', 1'),
        ('9,1;2', None), ('x\U0001f600  y', 'X\U0001f600 y'), ('a [[b  c]]  d', 'A [[b  c]] d'), ('$x  y$  z', '$x  y$ z'), ('HTTP://A  b', 'HTTP://A b'),
        ('', None), ('a  \xa0b', 'A b'), ('A\u2003  b', None), ('  \ue000  ,a', None), ('monday ,may', 'Monday, may'),
        ('on  may 3 ,b', 'On May 3, b'), ('d:\\x ,y  z', None), ('\U0001d44e  b', '\U0001d44e b'), ('A \U0001d44e  b ,c', 'A \U0001d44e b, c'), ('a ;\tb', 'A;\tb'),
        ('\u017fa  b', 'Sa b'), ('\x85 ,b', '\x85, b'), (None, None),
    ]
    rows = rules.repaired(spark.createDataFrame([(k, *o) for k, o in enumerate(odd)], "k int, t string, want string"), "t")
    assert [r["t"] for r in rows.collect() if r["replacement"] != r["want"]] == []
    ends = [("\u00a0a b\ufeff\n", "a b"), ("a \x85", "a \x85"), (" \t", "")]
    assert [r["want"] for r in spark.createDataFrame(ends, "t string, want string").withColumn("t", patterns.trimmed(F.col("t"))).collect() if r["t"] != r["want"]] == []


def test_a_second_sentence_ends_the_cutting(monkeypatch):
    met = []
    monkeypatch.setattr(segment, "completes", lambda s: met.append(s) or True)
    told = list(segment._several.func(iter([pa.array(["One. Two. Three. Four.", "One.", None, ""])])))
    assert told[0].to_pylist() == [True, False, None, False] and met == ["One. ", "Two. ", "One."]


def test_names_of_a_pair_are_made_once(spark):
    df = spark.createDataFrame([("We met Ann and Bob.", "We met Bob and Ann.", True), ("We met Ann.", "They met Ann.", False), ("We met Ann.", "We met ann.", False), ("No name.", "no name.", False), ("É is Ann.", "É is.", True)], "s string, c string, want boolean")
    changed = guards.names_changed(F.col("s"), F.col("c"))
    # the names of both sides were made anew for every word
    assert plan_of(df.select(changed)).count("array_union") <= 2
    assert df.where(changed != F.col("want")).count() == 0


def test_pairs_that_are_told_have_no_words_made(spark):
    rows = [("The same.", "The same.", "unchanged"), ("One thing.", "", "empty"), ("One thing is here.", "One is here. It is a thing.", "multiple-sentences"), ("One thing.", "As an AI I say no. It is so.", "instruction-output"), ("One thing.", "One thing!", "terminal-punctuation-changed")]
    df = guards.validated(spark.createDataFrame(rows, "source string, candidate string, want string"))
    assert [(r["want"], r["reason"]) for r in df.collect() if r["want"] != r["reason"]] == []


def test_signs_of_claims_leave_out_none(spark):
    said = """revolutionary;game changing;game-changer;seamlessly;blazingly;cutting edge;state of the art;world-class;effortless;magically;unleashed;supercharged;10 x;10-x;AI powered;so!;never wrong
    always right;always correct;100 % safe;always preserves;never changes your meaning;can't change your meaning;Flawless;INFALLIBLE;perfect;guarantees;guaranteed;guarantee that;zero false positives;no  false negatives
    installs;installation;set-up;set up;setup;provisioned;up and running;USPTO;tess;TSDR;trademark register;trademark database;register of trade marks;register of trademarks;apple silicon;metal;windows;two-core;2 core
    ſeamleſſ;ſet up;trademarK regiſter;flawleſſ;unleaſh;İnfallible;wındows;<!-- forbıdden-phraſeſ: allow x - y -->;plain;state;set"""
    df = spark.createDataFrame([(t.strip(),) for line in said.split("\n") for t in line.split(";")] + [(said,), (None,)], "t string").withColumn("low", claims._folded(F.col("t")))
    patterns_ = {rule: p for rule, p, _, _ in lexicons.CLAIMS} | {"waiver": lexicons.WAIVER}
    rows = df.select("t", claims._matched("t", patterns_).alias("every"), claims._matched("t", patterns_, folded="low").alias("called")).collect()
    assert [r["t"] for r in rows if r["every"] != r["called"]] == []
    assert {r["t"] for r in rows if not r["every"]} == {"plain", "state", "set", None}
    # each pattern was looked for seven times in every document
    assert plan_of(claims.findings(df.select(F.lit(1).alias("doc_id"), F.col("t").alias("text")))).split("== Initial Plan ==")[-1].count("revolutionary|") == 2


def test_rules_are_tried_only_where_a_phrase_begins_a_word(spark):
    # 78 replacements are made one after another where this holds
    rows = [("In order to see", True), ("(due to the fact that", True), ("Kin order to", True), ("éin order to", True), ("win order to", False), ("_in order to", False), ("plain", False)]
    df = spark.createDataFrame(rows, "t string, want boolean").withColumn("got", rules._fires(F.col("t")))
    assert [r["t"] for r in df.collect() if r["got"] != r["want"]] == []


def test_tenses_of_a_pair_are_made_once(spark):
    df = spark.createDataFrame([("It works.", "It worked.", True), ("It works.", "It will work.", True), ("It worked.", "So it worked.", False), ("They read it yesterday.", "They have read it.", True)], "s string, c string, want boolean")
    changed = guards.tense_changed(F.col("s"), guards.tense(F.col("s")), guards.tense(F.col("c")))
    # the words of each side, made anew wherever a tense was named before
    assert plan_of(df.select(changed.alias("x"))).count("regexp_extract_all") == 2
    assert [r["s"] for r in df.withColumn("got", changed).collect() if r["got"] != r["want"]] == []


def test_quantifiers_of_a_pair_are_made_once(spark):
    df = spark.createDataFrame([("All of it.", "Most of it.", True), ("All of it.", "All it is.", False), ("No rain.", "Rain.", True), ("Plain.", "Plain!", False)], "s string, c string, want boolean")
    changed = guards.quantifiers_changed(guards.quantifier_sets(F.col("s")), guards.quantifier_sets(F.col("c")))
    # the words of each side, made anew for each group and sense before
    assert plan_of(df.select(changed.alias("x"))).count("regexp_extract_all") == 2
    assert [r["s"] for r in df.withColumn("got", changed).collect() if r["got"] != r["want"]] == []


def test_hedges_of_a_pair_are_made_once(spark):
    df = spark.createDataFrame([("It may rain.", "It will rain.", True), ("Perhaps it may rain.", "Perhaps it rains.", False), ("It rains.", "It may rain.", True), ("Plain.", "Plain!", False)], "s string, c string, want boolean")
    changed = guards.certainty_changed(guards.hedge_words(F.col("s")), guards.hedge_words(F.col("c")))
    # the words of each side, made anew for each group of hedges before
    assert plan_of(df.select(changed.alias("x"))).count("regexp_extract_all") == 2
    assert [r["s"] for r in df.withColumn("got", changed).collect() if r["got"] != r["want"]] == []
