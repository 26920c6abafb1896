"""What an edit does, in words: groups of changed steps, each described, and one sentence for them all.

Everything is a column over the steps of :func:`guards.edit_ops`; quoted spans are cut from the two texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textgate.functions import lexicons as lex
from textgate.functions.patterns import among
from textgate.operators.guards import bound

_PARTS = "array<struct<type:string,text:string>>"


def _of(steps: Column, kind: str, side: str) -> Column:
    return F.transform(F.filter(steps, lambda o: o["type"] == kind), lambda o: o[side])


def _cut(text: Column, steps: Column, start: str, end: str) -> Column:
    """The text from the first to the last of the steps that stand in it."""
    first, last = F.array_min(F.transform(steps, lambda o: o[start])), F.array_max(F.transform(steps, lambda o: o[end]))
    return F.coalesce(F.substring(text, first + 1, last - first), F.lit(""))


def _ends(ops: Column) -> Column:
    """First and last step of each group: changes with at most one equal step between them."""
    changed = F.filter(F.transform(ops, lambda o, i: F.when(o["type"] != "equal", i)), lambda i: i.isNotNull())

    def groups(at: Column) -> Column:
        first = F.filter(at, lambda i, k: (k == 0) | (i - F.get(at, k - 1) > 2))
        last = F.filter(at, lambda i, k: F.coalesce(F.get(at, k + 1) - i > 2, F.lit(True)))
        return F.zip_with(first, last, lambda i, j: F.struct(i.alias("first"), j.alias("last")))

    return bound(changed, groups)


def edit_groups(ops: Column, source: Column, candidate: Column, ends: Column | None = None) -> Column:
    """Changes with at most one equal step between them as one group, with their spans and the equal words beside; of all groups, or of those given by their ends."""

    def beside(i: Column) -> Column:
        step = F.when(i >= 0, F.get(ops, i))
        return F.coalesce(F.when(step["type"] == "equal", step["source"]), F.lit(""))

    def described(g: Column) -> Column:
        steps = F.slice(ops, g["first"] + 1, g["last"] - g["first"] + 1)
        return F.struct(
            _of(steps, "delete", "source").alias("removed"),
            _of(steps, "insert", "target").alias("added"),
            F.exists(steps, lambda o: o["type"] == "equal").alias("merged"),
            _cut(source, steps, "start", "end").alias("source_span"),
            _cut(candidate, steps, "target_start", "target_end").alias("target_span"),
            beside(g["first"] - 1).alias("before"),
            beside(g["last"] + 1).alias("after"),
        )

    return F.transform(_ends(ops) if ends is None else ends, described)


def recased(ops: Column) -> tuple[Column, Column]:
    """Words that are equal but for case: those that gain capitals or keep their number, and those that lose some."""
    capitals = lambda w: F.regexp_count(w, F.lit("\\p{Lu}"))
    pairs = F.filter(ops, lambda o: (o["type"] == "equal") & (o["source"] != o["target"]))
    up = F.filter(pairs, lambda o: capitals(o["target"]) >= capitals(o["source"]))
    down = F.filter(pairs, lambda o: capitals(o["target"]) < capitals(o["source"]))
    return F.transform(up, lambda o: o["target"]), F.transform(down, lambda o: o["target"])


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("“"), text, F.lit("”"))


def _from_to(verb: str, g: Column, link: str = " to ", tail: str = "") -> Column:
    return F.concat(F.lit(f"{verb} "), _quoted(g["source_span"]), F.lit(link), _quoted(g["target_span"]), F.lit(tail))


def describe_group(g: Column) -> Column:
    """One group in words."""
    removes, adds = F.concat(F.lit("removes "), _quoted(g["source_span"])), F.concat(F.lit("adds "), _quoted(g["target_span"]))
    shorter = F.length(g["target_span"]) < F.length(g["source_span"])
    n_out, n_in = F.size(g["removed"]), F.size(g["added"])
    was, now = F.lower(F.get(g["removed"], F.lit(0))), F.lower(F.get(g["added"], F.lit(0)))
    beside_one = among(F.lower(g["before"]), lex.INTENSIFIERS) | among(F.lower(g["after"]), lex.INTENSIFIERS)
    doubled = F.forall(g["removed"], lambda w: among(F.lower(w), lex.INTENSIFIERS)) & beside_one
    confused = among(F.concat_ws(":", was, now), lex.CONFUSABLES) | among(F.concat_ws(":", now, was), lex.CONFUSABLES)
    agreeing = among(was, lex.AGREEMENT) & among(now, lex.AGREEMENT)
    alike = was.startswith(now) | now.startswith(was) | (F.substring(was, 1, 4) == F.substring(now, 1, 4))
    single = (n_out == 1) & (n_in == 1)
    return (
        F.when(g["merged"] & (g["target_span"] == ""), removes)
        .when(g["merged"] & shorter, _from_to("shortens", g))
        .when(g["merged"], _from_to("changes", g))
        .when((n_in == 0) & doubled, F.concat(removes, F.lit(", which repeats the word beside it")))
        .when(n_in == 0, removes)
        .when((n_out == 0) & (n_in == 1) & (now == ","), "adds a comma")
        .when((n_out == 0) & (n_in == 1) & among(now, lex.ARTICLES), F.concat(F.lit("adds the missing article "), _quoted(g["target_span"])))
        .when(n_out == 0, adds)
        .when(single & confused, _from_to("corrects", g))
        .when(single & agreeing, _from_to("changes", g, tail=" to match the subject"))
        .when(single & alike, _from_to("changes", g))
        .when(~single & (n_out > n_in) & shorter, _from_to("shortens", g))
        .otherwise(_from_to("replaces", g, " with "))
    )


def listing(parts: Column) -> Column:
    """Parts with commas, and "and" before the last."""
    n = F.size(parts)
    return F.when(n < 2, F.array_join(parts, "")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.get(parts, n - 1)))


def explained(ops: Column, source: Column, candidate: Column) -> Column:
    """One sentence on an edit: its first three groups, words that change case, and how many groups are left; empty where nothing visible changes."""
    up, down = recased(ops)
    none = F.array().cast("array<string>")
    named = lambda verb, ws: bound(ws, lambda w: F.when(F.size(w) > 0, F.array(F.concat(F.lit(f"{verb} "), listing(F.transform(w, _quoted))))).otherwise(none))

    def told(ends: Column) -> Column:
        more = F.when(F.size(ends) > 3, F.array(F.format_string("makes %d further small changes", F.size(ends) - 3))).otherwise(none)
        groups = edit_groups(ops, source, candidate, F.slice(ends, F.lit(1), F.lit(3)))
        return F.concat(F.transform(groups, describe_group), named("capitalizes", up), named("lowercases", down), more)

    begun = lambda said: F.when(said == "", said).otherwise(F.concat(F.upper(F.substring(said, 1, 1)), F.substring(said, 2, 2**31 - 1), F.lit(".")))
    return bound(bound(bound(_ends(ops), told), listing), begun)


def reason(ops: Column, source: Column, candidate: Column, mechanical: Column) -> Column:
    """The explanation, or where there is none the reason of the mechanical repair."""
    return F.coalesce(F.nullif(explained(ops, source, candidate), F.lit("")), mechanical)


def diff_parts(ops: Column) -> Column:
    """Kept, deleted and inserted tokens in order; a word that changes case is deleted and inserted."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))

    def parts(o: Column) -> Column:
        both = F.array(part("delete", o["source"]), part("insert", o["target"]))
        one = F.array(F.struct(o["type"].alias("type"), F.when(o["type"] == "insert", o["target"]).otherwise(o["source"]).alias("text")))
        return F.when((o["type"] == "equal") & (o["source"] != o["target"]), both).otherwise(one)

    return F.flatten(F.transform(ops, parts)).cast(_PARTS)


def escaped(text: Column) -> Column:
    """Text as it may stand between tags."""
    for char, entity in {"&": "&amp;", "<": "&lt;", ">": "&gt;"}.items():
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def inline_html(parts: Column) -> Column:
    """The parts as one line of HTML: no blank before a closing mark, nor after an opening one or a hyphen."""
    spanned = lambda kind, p: F.concat(F.lit(f'<span class="{kind}">'), escaped(p["text"]), F.lit("</span>"))

    def piece(p: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)["text"]
        apart = (i > 0) & ~p["text"].rlike("^[,.;:!?)\\]}'’”\\-/]") & ~before.rlike("[-(\\[{'‘“/]$")
        body = F.when(p["type"] == "delete", spanned("del", p)).when(p["type"] == "insert", spanned("ins", p)).otherwise(escaped(p["text"]))
        return F.concat(F.when(apart, " ").otherwise(""), body)

    return F.array_join(F.transform(parts, piece), "")


def marked_html(text: Column, marks: Column) -> Column:
    """Text with its marks (id, start, end) in order of start; a mark that begins in the one before is left out."""
    cut = lambda start, end: escaped(F.substring(text, start + 1, end - start))
    state = lambda html, at: F.struct(html.alias("html"), at.alias("at"))

    def step(acc: Column, m: Column) -> Column:
        opened = F.concat(acc["html"], cut(acc["at"], m["start"]), F.lit('<mark data-id="'), m["id"].cast("string"), F.lit('">'), cut(m["start"], m["end"]), F.lit("</mark>"))
        return F.when(m["start"] < acc["at"], acc).otherwise(state(opened, m["end"]))

    by_start = F.array_sort(marks, lambda a, b: a["start"] - b["start"])
    done = F.aggregate(by_start, state(F.lit(""), F.lit(0)), step, lambda acc: F.concat(acc["html"], cut(acc["at"], F.length(text))))
    return F.concat(done, F.when(text.endswith("\n"), "\u200b").otherwise(""))
