"""The composed analysis, stage by stage and in their order of precedence, with proposers and verifiers that are tables."""

import pytest
from pyspark.sql import functions as F

from textgate.operators import analysis

# (sentence, what the proposer says, what the verifier says) and what comes of it
KEEP, DOWN = {"action": "keep", "replacement": "", "reason": "fine"}, RuntimeError("no route")


def say(text, **more):
    return {"action": "rewrite", "replacement": text, "reason": "shorter", "latency": 7, **more}


GOLDEN = [
    # sentence, reply, verdict, options, (replacement, stages, gated, rejection, model_rejection, rejected_text, error kind)
    ("We met in order to talk.", say("We met to talk."), None, {}, ("We met to talk.", "model", False, None, None, None, None)),
    ("We met to talk.", KEEP, None, {}, (None, "", False, None, None, None, None)),
    ("We met to talk.", DOWN, None, {}, (None, "", False, None, None, None, "failed")),
    # the repair is what is left when the proposer keeps, fails or is refused
    ("we met ,  and talked.", KEEP, None, {}, ("We met, and talked.", "mechanics", False, None, None, None, None)),
    ("we met ,  and talked.", DOWN, None, {}, ("We met, and talked.", "mechanics", False, None, None, None, "failed")),
    ("we met 3 friends.", say("We met 4 friends."), None, {}, ("We met 3 friends.", "mechanics", False, None, "numbers-changed", "We met 4 friends.", None)),
    ("We met 3 friends.", say("We met 4 friends."), None, {}, (None, "", False, "numbers-changed", "numbers-changed", "We met 4 friends.", None)),
    # a repair of blanks alone cannot be shown
    ("We  met.", KEEP, None, {}, (None, "mechanics", False, None, None, None, None)),
    # a rewrite that undoes the repair lands on the sentence itself
    ("we met in order to talk.", say("we met in order to talk."), None, {}, ("We met in order to talk.", "mechanics", False, None, "unchanged", "we met in order to talk.", None)),
    # rules: shown when the proposer has nothing that passes, and superseded when it has
    ("We met in order to talk.", KEEP, None, {"with_rules": True}, ("We met to talk.", "rule", False, None, None, None, None)),
    ("We met in order to talk.", say("We met to talk at 9."), None, {"with_rules": True}, ("We met to talk.", "rule", False, None, "numbers-changed", "We met to talk at 9.", None)),
    ("We met in order to talk at this point in time.", say("We met to talk now."), None, {"with_rules": True}, ("We met to talk now.", "model", False, None, None, None, None)),
    ("See `in order to` here.", KEEP, None, {"with_rules": True}, (None, "", False, None, None, None, None)),
    # the gate: what it clears is never asked
    ("We met friends.", DOWN, None, {"with_gate": True}, (None, "", True, None, None, None, None)),
    ("We met for the purpose of talking.", say("We met for talking."), None, {"with_gate": True}, ("We met for talking.", "model", False, None, None, None, None)),
    # the verifier: asked where one content word is lost
    ("We met nice old friends there.", say("We met old friends there."), "show", {}, ("We met old friends there.", "model", False, None, None, None, None)),
    ("We met nice old friends there.", say("We met old friends there."), "hide", {}, (None, "", False, "verifier-hidden", "verifier-hidden", "We met old friends there.", None)),
    ("We met nice old friends there.", say("We met old friends there."), DOWN, {}, (None, "", False, "verifier-unavailable", "verifier-unavailable", "We met old friends there.", "verifier-unavailable")),
    ("We met nice old friends there.", say("We met old friends there."), "perhaps", {}, (None, "", False, "verifier-unavailable", "verifier-unavailable", "We met old friends there.", "verifier-unavailable")),
    ("We met nice old friends there.", say("We met old friends there."), "show", {"policy": "refuse"}, (None, "", False, "information-dropped", "information-dropped", "We met old friends there.", None)),
    ("We counted the coins twice there.", say("We counted the coins there."), "show", {}, (None, "", False, "information-dropped", "information-dropped", "We counted the coins there.", None)),
    # what the reply itself says
    ("We met in order to talk.", say(""), None, {}, (None, "", False, "empty", "empty", "", None)),
    ("We met in order to talk.", say("We met in order to talk."), None, {}, (None, "", False, "unchanged", "unchanged", "We met in order to talk.", None)),
    (None, KEEP, None, {}, (None, "", False, None, None, None, None)),
    ("", KEEP, None, {}, (None, "", False, None, None, None, None)),
]


def _table(cases):
    """A proposer and a verifier that look their answers up; plain data alone goes to the workers."""

    def propose(sentences):
        out = []
        for s in sentences:
            if cases[s][0] is None:
                raise RuntimeError("no route")
            out.append(cases[s][0])
        return out

    def verify(questions):
        out = []
        for s, replacement, lost in questions:
            if cases[s][1] is None or len(lost) != 1 or not replacement:
                raise RuntimeError("no route")
            out.append({"verdict": cases[s][1], "reason": f"says {cases[s][1]}"})
        return out

    return propose, verify


_VERBS = "met saw heard asked told knew liked called found joined sought hailed helped cheered fed taught paid led".split()


def _told(o):
    stage = "model" if o.stages.model else "rule" if o.stages.rule else "mechanics" if o.stages.mechanics else ""
    return (o.replacement, stage, o.gated, o.rejection, o.model_rejection, o.rejected_text, o.error and o.error.kind)


@pytest.mark.parametrize("options", [{}, {"with_rules": True}, {"with_gate": True}, {"policy": "refuse"}])
def test_golden_outcomes(spark, options):
    group, table, repaired = [], {}, {"we met ,  and talked.": "We met, and talked.", "we met 3 friends.": "We met 3 friends.", "We  met.": "We met.", "we met in order to talk.": "We met in order to talk.", None: ""}
    for k, (sentence, reply, verdict, _, want) in enumerate(c for c in GOLDEN if c[3] == options):
        # a verb of its own for each case, as a sentence has one reply a run
        own = lambda t, k=k: t.replace("met", _VERBS[k % len(_VERBS)]) if isinstance(t, str) else t
        reply = None if isinstance(reply, Exception) else {c: own(v) for c, v in reply.items()}
        table[own(repaired.get(sentence, sentence))] = (reply, None if isinstance(verdict, Exception) else verdict)
        group.append((own(sentence), (own(want[0]), *want[1:5], own(want[5]), want[6])))
    propose, verify = _table(table)
    rows = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(group)], "k long, sentence string").withColumn("reason", F.lit("mine")).withColumn("outcome_", F.lit(1)).repartition(2)
    out = analysis.analyzed(rows, propose, verify, **options)
    assert out.columns == ["k", "sentence", "reason", "outcome_", "outcome"]
    got = {r.k: r for r in out.collect()}
    assert [(got[k].sentence, _told(got[k].outcome)) for k in range(len(group))] == group


def test_only_rows_that_reach_a_stage_are_asked(spark, tmp_path):
    log = str(tmp_path / "asked")

    shorter = say("")

    def propose(sentences):
        with open(log, "a") as f:
            f.writelines(f"p {s}\n" for s in sentences)
        return [shorter | {"replacement": s.replace(" nice", "").replace(" in order to", " to")} for s in sentences]

    def verify(questions):
        with open(log, "a") as f:
            f.writelines(f"v {s}\n" for s, _, _ in questions)
        return [{"verdict": "show"} for _ in questions]

    texts = ["We met in order to talk.", "We met for the purpose of nice talks there.", "We met friends.", "Make sure to come."]
    rows = spark.createDataFrame([(t,) for t in texts], "sentence string").coalesce(1)
    out = {r.sentence: r.outcome for r in analysis.analyzed(rows, propose, verify, with_gate=True).collect()}
    asked = sorted(open(log).read().splitlines())
    reached = [t for t in texts if not out[t].gated]
    assert asked == sorted([f"p {t}" for t in reached] + ["v We met for the purpose of nice talks there."])
    assert out["We met friends."].gated and out["We met for the purpose of nice talks there."].lost == ["nice"]
    assert out["We met in order to talk."].latency == 7


def test_terms_explanations_and_no_proposer(spark):
    rows = spark.createDataFrame([("Run it with --force in order to win.", ["--force"]), ("it works.", None), ("Please note that we met.", [])], "sentence string, terms array<string>")
    silent = {r.sentence: r.outcome for r in analysis.analyzed(rows, with_rules=True, terms="terms").collect()}
    assert silent["Run it with --force in order to win."].replacement == "Run it with --force to win."
    assert silent["Run it with --force in order to win."].reason == "“In order to” says no more than “to”."
    assert silent["Please note that we met."].reason == "“Please note that” delays the point without adding to it."
    assert silent["it works."].replacement == "It works." and silent["it works."].reason
    shorter = say("")
    cut = lambda sentences: [shorter | {"replacement": s.replace("--force ", "")} for s in sentences]
    got = {r.sentence: r.outcome for r in analysis.analyzed(rows, cut, terms="terms").collect()}
    assert got["Run it with --force in order to win."].rejection == "protected-token-changed"


def test_replay_on_the_repaired_base(spark):
    pairs = [("we met 3 friends.", "We met 3 friends."), ("we met in order to talk.", "We met to talk."), ("we met nice old friends there.", "We met old friends there."), ("We met twice.", "We met."), (None, None)]
    rows = spark.createDataFrame(pairs, "source string, candidate string")
    got = {r.source: (r.bucket, r.reason, r.stage) for r in analysis.replayed(rows).collect()}
    assert got == {
        "we met 3 friends.": ("refused", "unchanged", "validator"),  # the repair had made it already
        "we met in order to talk.": ("accepted", "accepted", "validator"),
        "we met nice old friends there.": ("verifier", "verifier-decides", "deletion-policy"),
        "We met twice.": ("refused", "information-dropped", "deletion-policy"),
        None: ("refused", "empty", "validator"),
    }
    plain = {r.source: r.reason for r in analysis.replayed(rows, mechanics=False).collect()}
    assert plain["we met 3 friends."] != "unchanged"


def test_diagnosed(spark):
    pairs = [("We met twice there.", "We met there."), ("We met reliable and quick people.", "We met quick people."), ("We met nice old friends there.", "We met old friends there."), ("We met 3 friends.", "We met 4 friends.")]
    got = {r.source: (r.accepted, r.guards) for r in analysis.diagnosed(spark.createDataFrame(pairs, "source string, candidate string")).collect()}
    assert got["We met twice there."][1][0] == "count-lost"
    assert "conjunct-lost" in got["We met reliable and quick people."][1]
    assert got["We met nice old friends there."] == (True, []) and got["We met 3 friends."] == (False, [])
