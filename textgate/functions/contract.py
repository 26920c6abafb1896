"""A model's reply as columns: leaked thinking taken out, cut JSON closed, the decision parsed and checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textgate.functions.patterns import trimmed

DECISION = "action string, replacement string, reason string"


def strip_thinking(content: Column) -> Column:
    """Without thinking blocks; one left open goes only if nothing like an answer is in it."""
    closed = F.regexp_replace(F.coalesce(content, F.lit("")), "(?is)<(think|thinking|reasoning)>.*?</\\1>\\s*", "")
    return trimmed(F.regexp_replace(closed, "(?is)<(?:think|thinking|reasoning)>[^{}]*\\z", ""))


def complete_json(content: Column) -> Column:
    """A reply that was stopped at its reason, closed; an empty one stays empty."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), "\\s+\\z", "")
    head = F.regexp_replace(F.regexp_replace(text, "(?s),\\s*\"reason\".*\\z", ""), "[,\\s]*\\z", "")
    return F.when(trimmed(text) == "", F.lit("")).when(text.endswith("}"), text).otherwise(F.concat(head, F.lit(',"reason":""}')))


def decision(content: Column) -> Column:
    """``action``, ``replacement``, ``reason`` and ``error`` (null for a sound reply)."""
    body = F.regexp_replace(F.regexp_replace(trimmed(F.coalesce(content, F.lit(""))), "(?i)^```(?:json)?\\s*", ""), "\\s*```$", "")
    parsed = F.from_json(body, DECISION)
    sound = F.get_json_object(body, "$").isNotNull()
    error = (
        F.when(body == "", "no content")
        .when(~sound, "invalid JSON")
        .when(~body.startswith("{"), "no object")
        .when(~F.coalesce(parsed["action"].isin("keep", "rewrite"), F.lit(False)), "unknown action")
        .when(parsed["replacement"].isNull(), "no replacement")
        .when(parsed["reason"].isNull(), "no reason")
        .when((parsed["action"] == "rewrite") & (trimmed(parsed["replacement"]) == ""), "empty replacement")
    )
    field = lambda name: F.when(error.isNull(), trimmed(parsed[name])).alias(name)
    return F.struct(field("action"), field("replacement"), field("reason"), error.alias("error"))
