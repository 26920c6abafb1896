"""The whole analysis of a sentence: repair, rules, screening, a proposer's rewrite, the guards, a verifier, and what to fall back to.

Proposer and verifier are functions on lists, called in Spark's Python workers with Arrow batches.
They get only the rows that reach them, and a call that raises is made again row by row, so that
one bad row costs itself alone.  No row is moved: the analysis is one pass without a shuffle.

* ``propose(sentences) -> [{"action", "replacement", "reason", "latency"}]``
* ``verify([(sentence, replacement, lost), ...]) -> [{"verdict", "reason", "kind"}]`` with "show", "hide" or "unavailable"
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textgate.functions import patterns as P
from textgate.operators import explain, gate, guards, rules

Proposer = Callable[[list[str]], list[dict[str, Any]]]
Verifier = Callable[[list[tuple[str, str, list[str]]]], list[dict[str, Any]]]

_REPLY = T.StructType([T.StructField(c, T.StringType()) for c in ("action", "replacement", "reason")] + [T.StructField("latency", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("kind", "message")])
_VERDICT = T.StructType([T.StructField(c, T.StringType()) for c in ("verdict", "reason", "kind")])
OUTCOME = (
    "struct<replacement:string,reason:string,model_reason:string,stages:struct<mechanics:boolean,rule:boolean,model:boolean>,gated:boolean,rejection:string,model_rejection:string,"
    "rejected_text:string,lost:array<string>,verifier_reason:string,latency:long,error:struct<kind:string,cause:string,message:string>>"
)


def _told(ask: Callable[[list], list[dict]], items: list, failed: Callable[[Exception], dict]) -> list[dict]:
    """An answer for each item; where the call raises, or gives another number of answers, each item is asked for alone."""
    if not items:
        return []
    try:
        out = list(ask(items))
        if len(out) != len(items):
            raise ValueError(f"{len(out)} answers to {len(items)} questions")
        return out
    except Exception as error:
        if len(items) == 1:
            return [failed(error)]
        return [one for item in items for one in _told(ask, [item], failed)]


def _frame(told: list[dict], at: list[int], size: int, schema: T.StructType) -> pd.DataFrame:
    rows: list[dict] = [{}] * size
    for k, reply in zip(at, told, strict=True):
        rows[k] = reply
    frame = pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype="Int64" if isinstance(f.dataType, T.LongType) else object) for f in schema.fields})
    return frame


def _proposed(propose: Proposer) -> Callable[[Column], Column]:
    @F.pandas_udf(_REPLY)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            at = [k for k, t in enumerate(texts) if t is not None]
            failed = lambda e: {"kind": getattr(e, "kind", "failed"), "message": str(e)}
            yield _frame(_told(propose, [texts.iloc[k] for k in at], failed), at, len(texts), _REPLY)

    return ask.asNondeterministic()


def _verified(verify: Verifier) -> Callable[[Column, Column, Column], Column]:
    @F.pandas_udf(_VERDICT)
    def ask(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, replacements, lost in batches:
            at = [k for k, t in enumerate(texts) if t is not None]
            failed = lambda e: {"verdict": "unavailable", "reason": str(e), "kind": getattr(e, "kind", None)}
            yield _frame(_told(verify, [(texts.iloc[k], replacements.iloc[k], list(lost.iloc[k])) for k in at], failed), at, len(texts), _VERDICT)

    return ask.asNondeterministic()


def unshowable(source: Column, replacement: Column) -> Column:
    """Why a replacement cannot be shown: it is what stands there, or changes nothing that could be marked; null if it can."""
    tokens = P.tokens(source)
    invisible = (tokens == P.tokens(replacement)) | (F.size(tokens) == 0)
    return F.when(P.trimmed(replacement) == P.trimmed(source), "unchanged").when(invisible, "invisible-edit")


def analyzed(
    df: DataFrame,
    propose: Proposer | None = None,
    verify: Verifier | None = None,
    text: str = "sentence",
    mechanics: bool = True,
    with_rules: bool = False,
    with_gate: bool = False,
    policy: str = "verify",
    terms: str | None = None,
    max_edit_ratio: float = 0.58,
) -> DataFrame:
    """Adds ``outcome``: what to offer for each sentence, by which stage, and why what was refused was refused.

    The proposer sees the repaired sentence, and its rewrite is judged against that; whether an offer can be
    shown is judged against the sentence as it stands.  A rewrite that passes is the offer.  Of what is left, a rule's
    rewrite goes before the repair.  ``rejection`` is null whenever something is offered, ``model_rejection`` is not.
    A verifier that cannot be reached refuses.  A null sentence counts as empty.  Extra columns stay as they are.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    if terms:
        rows = rows.withColumn("__terms", F.col(f"__row.{terms}"))
    was = F.col("__text")
    rows = rules.repaired(rows, "__text") if mechanics else rows.select("*", F.lit(None).cast("string").alias("replacement"), F.lit(None).cast("string").alias("repair_reason"))
    rows = rows.withColumn("__base", F.coalesce("replacement", "__text")).withColumnRenamed("replacement", "__repair").withColumnRenamed("repair_reason", "__repair_reason").drop("ids")
    base, repair = F.col("__base"), F.col("__repair")
    nothing = F.lit(None).cast("string")
    if with_rules:
        rows = rows.withColumn("__ruled", rules.apply_rules(base))
        ruled = F.col("__ruled")
        kept = ~guards.terms_changed(base, ruled, F.col("__terms")) if terms else F.lit(True)
        sound = F.when(ruled != base, rules.safe_rule(base, ruled) & kept & unshowable(was, ruled).isNull()).otherwise(False)
        rows = rows.withColumn("__rule_reason", F.when(sound, rules.rule_reason(base))).withColumn("__ruled", F.when(sound, ruled))
    else:
        rows = rows.withColumn("__ruled", nothing).withColumn("__rule_reason", nothing)
    asked = gate.any_hit(base) if with_gate else F.lit(True)
    rows = rows.withColumn("__gated", ~asked if propose else F.lit(False))
    reply = _proposed(propose)(F.when(~F.col("__gated"), base)) if propose else F.lit(None).cast(_REPLY)
    rows = rows.withColumn("__reply", reply)
    says = F.col("__reply")
    rewrites = F.coalesce(says["action"] == "rewrite", F.lit(False))
    # rows without a rewrite go through the guards as empty texts
    rows = rows.withColumn("__asked", F.when(rewrites, base)).withColumn("__said", F.when(rewrites, F.coalesce(says["replacement"], F.lit("")))).withColumn("__stated", F.coalesce(says["reason"], F.lit("")))
    rows = guards.validated(rows, "__asked", "__said", max_edit_ratio, terms="__terms" if terms else None, stated="__stated")
    rows = guards.bucketed(rows, "__asked", "__said", policy)
    new = P.trimmed(F.col("__said"))
    doubtful = rewrites & (F.col("bucket") == "verifier")
    verdict = _verified(verify)(F.when(doubtful, base), new, F.coalesce("lost", F.array().cast("array<string>"))) if verify else F.lit(None).cast(_VERDICT)
    rows = rows.withColumn("__verdict", verdict)
    heard = F.col("__verdict")
    unheard = doubtful & F.lit(bool(verify)) & ~F.coalesce(heard["verdict"].isin("show", "hide"), F.lit(False))
    refused = (
        F.when(~rewrites, nothing)
        .when(F.col("bucket") == "refused", F.col("reason"))
        .when(unheard, "verifier-unavailable")
        .when(heard["verdict"] == "hide", "verifier-hidden")
        .otherwise(unshowable(was, new))
    )
    rows = rows.withColumn("__refused", refused)
    model = rewrites & F.col("__refused").isNull()
    mechanical = repair.isNotNull() & unshowable(was, base).isNull()
    rows = rows.withColumn("__offer", F.when(model, new).when(F.col("__ruled").isNotNull(), F.col("__ruled")).when(mechanical, base))
    by_rule = ~model & F.col("__ruled").isNotNull()
    offer = F.col("__offer")
    rows = rows.withColumn("__by_rule", by_rule).withColumn("__model", model)
    rows = rows.withColumn("__steps", guards.edit_ops(F.when(offer.isNotNull() & ~F.col("__by_rule"), was), offer))
    told = explain.reason(F.col("__steps"), was, offer, F.col("__repair_reason"))
    failed = F.when(says["kind"].isNotNull(), F.struct(says["kind"].alias("kind"), nothing.alias("cause"), says["message"].alias("message"))).when(
        unheard, F.struct(F.lit("verifier-unavailable").alias("kind"), F.coalesce(heard["kind"], F.lit("transient")).alias("cause"), heard["reason"].alias("message"))
    )
    validator = F.col("__refused").isNotNull() & ~F.col("accepted")
    fields = {
        "replacement": offer,
        "reason": F.when(offer.isNull(), nothing).when(F.col("__by_rule"), F.col("__rule_reason")).otherwise(told),
        "model_reason": F.when(F.col("__model"), says["reason"]),
        "stages": F.struct(repair.isNotNull().alias("mechanics"), F.col("__by_rule").alias("rule"), F.col("__model").alias("model")),
        "gated": F.col("__gated"),
        "rejection": F.when(offer.isNull(), F.col("__refused")),
        "model_rejection": F.col("__refused"),
        "rejected_text": F.when(validator, F.col("__said")).when(F.col("__refused").isNotNull(), new),
        "lost": F.when(rewrites & (F.size("lost") > 0), F.col("lost")),
        "verifier_reason": F.when(unheard | (heard["verdict"] == "hide"), heard["reason"]),
        "latency": F.coalesce(says["latency"], F.lit(0)).cast("long"),
        "error": failed,
    }
    return rows.select("__row.*", F.struct(*[c.alias(name) for name, c in fields.items()]).cast(OUTCOME).alias("outcome"))


def replayed(pairs: DataFrame, source: str = "source", candidate: str = "candidate", mechanics: bool = True, policy: str = "verify", terms: str | None = None) -> DataFrame:
    """Recorded pairs as if a proposer had said the candidate: adds ``bucket``, ``reason``, ``stage`` and ``lost``.

    As in the analysis, the candidate is judged against the repaired source, unless ``mechanics`` is off: else the guards
    would be blamed or praised for what the repair did.  ``reason`` names the bucket where nothing was refused.
    """
    rows = pairs.select(F.struct(*[F.col(f"`{c}`") for c in pairs.columns]).alias("__row"), F.coalesce(F.col(source), F.lit("")).alias("__text"), F.coalesce(F.col(candidate), F.lit("")).alias("__said"))
    if terms:
        rows = rows.withColumn("__terms", F.col(f"__row.{terms}"))
    rows = rules.repaired(rows, "__text").withColumn("__base", F.coalesce("replacement", "__text")).drop("replacement", "ids", "repair_reason") if mechanics else rows.withColumn("__base", F.col("__text"))
    rows = guards.bucketed(guards.validated(rows, "__base", "__said", terms="__terms" if terms else None), "__base", "__said", policy)
    stage = F.when(F.col("accepted") & ((F.col("bucket") != "accepted") | (F.size("lost") > 0)), "deletion-policy").otherwise("validator")
    reason = F.when(F.col("bucket") == "refused", F.col("reason")).when(F.col("bucket") == "verifier", "verifier-decides").otherwise("accepted")
    return rows.select("__row.*", "bucket", reason.alias("reason"), stage.alias("stage"), "lost")


def diagnosed(pairs: DataFrame, source: str = "source", candidate: str = "candidate", policy: str = "verify") -> DataFrame:
    """Adds ``guards``: which parts of the deletion policy a pair sets off, in their order; empty for pairs that the guards before it refuse."""
    rows = pairs.select(F.struct(*[F.col(f"`{c}`") for c in pairs.columns]).alias("__row"), F.coalesce(F.col(source), F.lit("")).alias("__text"), F.coalesce(F.col(candidate), F.lit("")).alias("__said"))
    rows = guards.validated(rows, "__text", "__said")
    fired = [F.when(test, F.lit(name)) for name, test in guards.deletions(F.col("__text"), F.col("__said"), F.col("lost"), F.col("ops"), policy).items()]
    named = F.filter(F.array(*fired), lambda x: x.isNotNull())
    return rows.select("__row.*", "accepted", "reason", "lost", F.when(F.col("accepted"), named).otherwise(F.array().cast("array<string>")).alias("guards"))
