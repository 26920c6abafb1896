"""Claims in prose: patterns with evidence in the same clause, guards that excuse them, and waivers by line.

A document's findings are rows.  Places come from running sums over the lengths between matches.  The
clause of a match is looked up where its text lies, so texts are never moved and only matches are.
A pattern is looked for only in documents that have one of its signs, and only documents with a
match or a waiver go further than that.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgate.functions import lexicons as lex
from textgate.functions import masks
from textgate.functions.patterns import PY_BLANK, java, listed, matches, trimmed
from textgate.operators.guards import bound

_CUT = re.compile(f"[\\n;|]|[.:?!](?=[{PY_BLANK}]|\\Z)")
#: Documents whose matches are handed on at once.
_AT_ONCE = 64

#: What a folded text must have, one of them, for a rule's pattern to be looked for.
SIGNS = {
    "marketing/boast": ["revolutionary", "game", "seamless", "blazing", "cutting", "state", "world", "effortless", "magical", "unleash", "supercharge"],
    "marketing/multiplier": ["10"],
    "marketing/ai-powered": ["powered"],
    "marketing/exclamation": ["!"],
    "absolute/never-wrong": ["never wrong", "always right", "always correct", "100", "always preserves", "your meaning"],
    "absolute/perfection": ["flawless", "infallible", "perfect"],
    "absolute/guarantee": ["guarantee"],
    "absolute/false-positives": ["false"],
    "unsupported/install-time": ["install", "set", "provision", "up and running"],
    "unsupported/register-search": ["uspto", "tess", "tsdr", "trademark", "register of trade"],
    "unsupported/platform-performance": ["silicon", "metal", "windows", "core"],
    "waiver": ["forbidden-phrases:"],
}


def _folded(text: Column) -> Column:
    """In lower case, with the letters that a search without case takes for ASCII ones."""
    return F.lower(F.when(text.rlike("[ſ\u212aıİ]"), F.translate(text, "ſ\u212aıİ", "skii")).otherwise(text))


def _matched(text: str, patterns: dict[str, str], fold: bool = True, folded: str | None = None) -> Column:
    """For each pattern with a match its rule, the step to the end of each match from the one before, and the matches.

    ``folded`` names the folded text, in which the signs of the rules are looked for first.
    """

    def told(hits: Column, rule: str, own: str) -> Column:
        # Spark's pieces are those between the matches, the last one has no match behind it
        steps = F.zip_with(F.split(text, own, -1), hits, lambda a, b: F.length(a) + F.length(b))
        return F.when(F.size(hits) > 0, F.struct(F.lit(rule).alias("rule"), F.slice(steps, F.lit(1), F.size(hits)).alias("steps"), hits.alias("hits")))

    one = []
    for rule, pattern in patterns.items():
        own = ("(?iu)" if fold else "") + java(pattern)
        here = bound(F.regexp_extract_all(text, F.lit(own), F.lit(0)), lambda hits: told(hits, rule, own))  # noqa: B023
        one.append(F.when(reduce(or_, [F.contains(F.col(folded), F.lit(s)) for s in SIGNS[rule]]), here) if folded else here)
    return F.array_compact(F.array(*one))


def occurrences(docs: DataFrame, key: str, text: str, patterns: dict[str, str], fold: bool = True) -> DataFrame:
    """``key``, ``rule``, ``start``, ``end`` and ``hit`` of every match of every pattern."""
    # an outer one, as Spark moves the test of an inner one below and matches once more for it
    rules = docs.select(key, F.explode_outer(_matched(text, patterns, fold)).alias("m")).where("m is not null")
    upto = Window.partitionBy(key, "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rules = rules.select(key, "m.rule", F.posexplode(F.arrays_zip("m.steps", "m.hits")).alias("k", "piece"))
    ends = rules.withColumn("end", F.sum("piece.steps").over(upto).cast("int"))
    return ends.select(key, "rule", (F.col("end") - F.length("piece.hits")).alias("start"), "end", F.col("piece.hits").alias("hit"))


def waivers(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Waiving comments: ``start``, ``end``, ``hit``, ``rules``, ``reason``, and a waiver/ rule as ``problem`` where it waives nothing."""
    rows = occurrences(docs, key, text, {"waiver": lex.WAIVER})
    return rows.select(key, "start", "end", *[c.alias(name) for name, c in _read_waiver("hit").items()])


def _read_waiver(hit: str) -> dict[str, Column]:
    """What a waiving comment says."""
    inner, body = F.regexp_extract(hit, "(?iu)" + java(lex.WAIVER), 1), java(lex.WAIVER_BODY)
    ids = F.filter(F.split(F.regexp_extract(inner, body, 1), f"[,{PY_BLANK}]+"), lambda r: r != "")
    unknown = F.array_except(ids, listed([rule for rule, *_ in lex.CLAIMS]))
    problem = F.when(~inner.rlike(body), "waiver/no-reason").when(F.size(unknown) > 0, "waiver/unknown-rule")
    said = F.when(~inner.rlike(body), trimmed(F.col(hit))).when(F.size(unknown) > 0, F.array_join(unknown, ", ")).otherwise(F.col(hit))
    return {"hit": said, "rules": ids, "reason": trimmed(F.regexp_extract(inner, body, 2)), "problem": problem, "more": F.regexp_count(hit, F.lit("\n"))}


def _clause_of_hits(text: str, masked: str, found: list[dict]) -> Iterator[tuple]:
    """Each match with its place, its clause in the masked text and in the text as it is, where that begins, and its line with its start."""
    starts, ends, lines = [0], [], [(1, 0)]
    for m in _CUT.finditer(masked):
        ends.append(m.start())
        starts.append(m.end())
        lines.append((lines[-1][0] + 1, m.end()) if m[0] == "\n" else lines[-1])
    ends.append(len(masked))
    for one in found:
        for end, hit in zip(itertools.accumulate(one["steps"]), one["hits"], strict=True):
            at = end - len(hit)
            k = bisect.bisect_right(starts, at) - 1
            yield at, end, one["rule"], hit, masked[starts[k] : ends[k]], text[starts[k] : ends[k]], starts[k], *lines[k]


def _in_clauses(found: DataFrame, key: str) -> DataFrame:
    """``key``, ``at``, ``end``, ``rule``, ``hit``, ``clause``, ``whole``, ``begins``, ``line`` and ``line_start`` of every match."""
    kinds = {"at": pa.int32(), "end": pa.int32(), "rule": pa.string(), "hit": pa.string(), "clause": pa.string(), "whole": pa.string(), "begins": pa.int32(), "line": pa.int32(), "line_start": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(first, _AT_ONCE)
                texts = (part.column(c) for c in ("text", "masked", "found"))
                rows = [(i, *hit) for i, one in enumerate(zip(*texts, strict=True)) for hit in _clause_of_hits(*(v.as_py() for v in one))]
                where, *columns = zip(*rows, strict=True) if rows else [()] * (len(kinds) + 1)
                yield pa.record_batch([part.column("key").take(pa.array(where, pa.int64())), *(pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True))], names=["key", *kinds])

    told = ", ".join(f"{name} {'string' if kind == pa.string() else 'int'}" for name, kind in kinds.items())
    return found.mapInArrow(run, f"key {found.schema['key'].dataType.simpleString()}, {told}").withColumnRenamed("key", key)


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", syntax: str = "markdown") -> DataFrame:
    """Claims, and waivers that waive nothing, one row each: ``key``, ``line``, ``column``, ``rule``, ``text``, ``evidence``, ``waived``, ``waiver``.

    A claim counts where what it needs stands in its clause and no guard excuses it; both look at the
    clause without the match.  A waiver covers its lines and the next one.  ``key`` must tell documents
    apart; null texts have no findings.
    """
    body = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.explode_outer(F.array(masks.prose(F.col(text), syntax))).alias("masked"))
    body = body.withColumn("low", _folded(F.col("masked"))).withColumn("text_low", F.when(F.contains("text", F.lit("<!--")), _folded(F.col("text"))))
    hits = F.concat(_matched("masked", {rule: pattern for rule, pattern, _, _ in lex.CLAIMS}, folded="low"), _matched("text", {"waiver": lex.WAIVER}, folded="text_low"))
    found = body.select("key", "text", "masked", F.explode_outer(F.array(hits)).alias("found")).where(F.size("found") > 0)
    rows = _in_clauses(found, key)
    said, waiver = _read_waiver("hit"), F.col("rule") == "waiver"
    read = {"rule": F.when(waiver, F.coalesce(said["problem"], F.lit("waiver"))).otherwise(F.col("rule")), "hit": F.when(waiver, said["hit"]).otherwise(F.col("hit")), "rules": F.when(waiver, said["rules"]), "reason": F.when(waiver, said["reason"]), "more": F.when(waiver, said["more"]).otherwise(0)}
    rows = rows.withColumns(read)

    start, end, size = F.col("at") - F.col("begins"), F.col("end") - F.col("begins"), F.lit(2**31 - 1)
    without = lambda side: F.concat(F.substring(F.col(side), F.lit(1), start), F.lit(" "), F.substring(F.col(side), end + 1, size))
    rows = rows.withColumn("masked", without("clause")).withColumn("whole", without("whole"))
    evidence, excused = F.lit(None).cast("string"), F.lit(False)
    for rule, _, needs, guards in lex.CLAIMS:
        mine = F.col("rule") == rule
        if needs:
            evidence = F.when(mine, F.regexp_extract("masked", "(?iu)(" + java(needs) + ")", 1)).otherwise(evidence)
        for guard in guards:
            excused = excused | (mine & matches(F.col("whole"), lex.CLAIM_GUARDS[guard]))
    rows = rows.withColumn("evidence", trimmed(evidence)).where(~excused & (F.col("evidence").isNull() | (F.col("evidence") != "")))

    # a waiver is one row for each rule and line that it covers, so that it meets its claims without a join
    number = F.col("line")
    lines = F.sequence(number, number + F.col("more") + 1)
    spot = lambda rule, line: F.struct(rule.alias("rule"), line.alias("line"))
    covered = F.flatten(F.transform("rules", lambda rule: F.transform(lines, lambda line: spot(rule, line))))
    rows = rows.withColumn("waives", F.col("rule") == "waiver").withColumn("spot", F.explode(F.when(F.col("waives"), covered).otherwise(F.array(spot(F.col("rule"), number)))))
    first = F.min(F.when(F.col("waives"), F.struct("at", "reason"))).over(Window.partitionBy(key, "spot.rule", "spot.line"))
    return (
        rows.withColumn("waiver", first)
        .where(~F.col("waives"))
        .select(
            key,
            number.alias("line"),
            (F.col("at") - F.col("line_start") + 1).alias("column"),
            "rule",
            F.col("hit").alias("text"),
            "evidence",
            F.col("waiver").isNotNull().alias("waived"),
            F.col("waiver.reason").alias("waiver"),
        )
    )
