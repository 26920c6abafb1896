"""Mechanical repairs and wordiness rules as chains of guarded replacements."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgate.functions import lexicons
from textgate.functions.patterns import FULL, SPACE, capitalised, java, listed
from textgate.operators.guards import bound, markup, protected

_EDGE, _GAP = "\\b", java("\\s+")
_OF_KEEPERS = lexicons.DETERMINER[:-1] + "|us|them|you|it|both|each)"
_PHRASES = [p for p, _, _ in lexicons.RULES]
#: What a text must have for an untouchable span to be looked for.
_CALL = "[@/\\\\`$\\[]|\\.(?i:csv|json|log|md|txt|ya?ml|pdf|js|py|sql|xml|html)"


def _by_first_letter() -> str:
    """The phrases as one alternation, longest first among those with one first letter, which alone can stand at one place."""
    tails: dict[str, list[str]] = {}
    for p in sorted(_PHRASES, key=lambda p: -len(p)):
        tails.setdefault(p[0], []).append(p[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in tails.items())


def _fires(sentence: Column) -> Column:
    """Some phrase of the rules begins a word of the sentence; a k before it may have been the sign of the kelvin, which is no word character."""
    return F.concat(F.lit(" "), F.lower(sentence)).rlike(f"[\\Wk](?:{_by_first_letter()})")


def apply_rules(sentence: Column) -> Column:
    """Drops opening frames, then applies every phrase rule in order; a capital first letter stays one."""
    frames = "|".join(lexicons.OPENERS)
    cut = F.regexp_replace(sentence, f"(?iu)^(?:{frames}){_GAP}(?={java(lexicons.OPENER_FOLLOWERS + _EDGE)})", "")
    out = start = F.when(cut != sentence, capitalised(cut)).otherwise(sentence)
    for phrase, replacement, lookahead in lexicons.RULES:
        block = {"in order to": lexicons.IN_ORDER_BLOCK, "in order for": lexicons.IN_ORDER_BLOCK, "with the exception of": lexicons.EXCEPTION_BLOCK}.get(phrase)
        before = f"(?<!{java(block)})" if block else ""
        forms = [(lookahead, replacement)]
        if phrase in ("a large number of", "the majority of"):
            keeper = r"\s+" + _OF_KEEPERS + r"\b"
            forms = [(f"(?={keeper})", f"{replacement} of"), ("", replacement)]
        for ahead, by in forms:
            for first, to in ((phrase[0].upper(), by[0].upper() + by[1:]), (phrase[0], by)):
                rest = java(_EDGE + first + "#" + _EDGE).replace("#", f"(?iu:{phrase[1:]})")
                out = F.regexp_replace(out, f"{before}(?<!\\p{{Pd}}){rest}(?!\\p{{Pd}})(?iu:{java(ahead)})", to)
    return F.when(_fires(sentence), out).otherwise(start)


def safe_rule(source: Column, ruled: Column) -> Column:
    """A rule's result may be shown: something changed, and markup and protected tokens are as before."""
    return (source != ruled) & (markup(source) == markup(ruled)) & (protected(source) == protected(ruled))


def rules_fired(sentence: Column) -> Column:
    """Phrases of the rules that stand in the sentence, in rule order.

    One scan finds the phrases; the few rules with a condition on what follows are looked at again.
    """
    every = _by_first_letter()
    seen = F.regexp_extract_all(F.lower(sentence), F.lit(f"(?u){java(_EDGE + 'x')[:-1]}(?<!\\p{{Pd}})(?:{every}){java('x' + _EDGE)[1:]}(?!\\p{{Pd}})"), F.lit(0))
    ahead = {p: a for p, _, a in lexicons.RULES if a}

    def fired(seen: Column) -> Column:
        kept = F.array_except(seen, listed(list(ahead)))
        checked = [F.when(F.array_contains(seen, p), F.when(sentence.rlike(f"(?iu){p}{java(a)}"), F.lit(p))) for p, a in ahead.items()]
        return F.array_intersect(listed(_PHRASES), F.concat(kept, F.array_compact(F.array(*checked))))

    return bound(seen, lambda s: F.when(F.size(s) > 0, fired(s)).otherwise(F.array().cast("array<string>")))


def _reason(phrase: str, replacement: str) -> str:
    told = "says no more than" if set(replacement.split()) <= set(phrase.split()) else "is a long way of saying"
    return lexicons.RULE_REASONS.get(phrase, f"“{phrase.capitalize()}” {told} “{replacement}”.")


def rule_ids(phrases: Column) -> Column:
    """The ids of rules, given by their phrases."""
    return F.transform(phrases, lambda p: F.replace(p, F.lit(" "), F.lit("-")))


def rule_reason(sentence: Column) -> Column:
    """Why the rules rewrite a sentence: the reason of the frame that is dropped, or else of the first phrase in rule order; null where none stands."""
    frames = "|".join(lexicons.OPENERS)
    frame = F.regexp_extract(sentence, f"(?iu)^({frames}){_GAP}(?={java(lexicons.OPENER_FOLLOWERS + _EDGE)})", 1)
    first = F.get(rules_fired(sentence), F.lit(0))
    reasons = F.create_map(*[F.lit(x) for p, by, _ in lexicons.RULES for x in (p, _reason(p, by))])
    lower = F.lower(frame)
    return F.when(frame != "", F.concat(F.lit("“"), F.upper(F.substring(lower, 1, 1)), F.substring(lower, 2, 2**31 - 1), F.lit(lexicons.FRAME_REASON))).otherwise(F.element_at(reasons, first))


def guard_tokens(text: Column) -> Column:
    """What a repair may not change: untouchable spans and protected tokens, sorted."""
    return F.sort_array(F.concat(F.transform(_untouchable(text), lambda t: F.trim(t)), protected(text)))


def _untouchable(text: Column) -> Column:
    return F.when(text.rlike(_CALL), F.regexp_extract_all(text, F.lit(java(lexicons.UNTOUCHABLE)), F.lit(0))).otherwise(F.array().cast("array<string>"))


def single_spaced(text: Column) -> Column:
    """Repeated blanks between words become one."""
    single = F.regexp_replace(text, f"[ \\t](?<={FULL}[ \\t])[ \\t]++(?={FULL})", " ")
    return F.when(text.contains("  ") | text.contains("\t"), single).otherwise(text)


#: Lower-case letters whose capital Java writes with two, and the one letter that Unicode has for it.
_PAIRED = {"ß": "ẞ"} | {c: c.title() for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > 1 and c.islower() and len(c.title()) == 1 and c.title() != c}
_SINGLE = ("".join(_PAIRED), "".join(_PAIRED.values()))


def capital_opener(text: Column) -> Column:
    """A capital first letter, unless the first word is an identifier or has a capital inside."""
    opener = F.regexp_replace(F.regexp_extract(text, f"^{SPACE}*({FULL}*)", 1), "[.!?…]+$", "")
    plain = text.rlike(f"^{SPACE}*\\p{{Ll}}(?!\\p{{L}}*\\p{{Lu}})") & ~opener.rlike("[./\\\\@_\ue000]|^\\p{L}+[0-9]")
    at = F.length(F.regexp_extract(text, f"^{SPACE}*", 0)) + 1
    begun = F.substring(text, at, F.lit(1))
    single = F.translate(begun, *_SINGLE)
    letter = F.when(single != begun, single).otherwise(F.upper(begun))
    return F.when(plain & (F.length(letter) == 1), F.concat(F.substring(text, F.lit(1), at - 1), letter, F.substring(text, at + 1, F.length(text)))).otherwise(text)


#: One of these stands in every name of a day or month.
_DATE_PARTS = ["day", "uary", "march", "april", "may", "june", "july", "august", "ember", "october"]


def _dates(text: Column) -> Column:
    out = text
    for name in lexicons.DAYS_AND_MONTHS:
        signal = "(?<=\\b(?i:on|in|by|since|until|before|after|during|from)\\s{1,4})" if name in lexicons.MONTH_OR_WORD else ""
        out = F.regexp_replace(out, f"{signal}(?<![A-Za-z0-9_]){name}(?![A-Za-z0-9_])", name.capitalize())
    some = reduce(or_, [text.contains(part) for part in _DATE_PARTS])
    return F.when(some, out).otherwise(text)


def _steps() -> list[tuple[str, str, object]]:
    space = f"(?<={FULL})[ \\t\\u00a0\\u202f]*[\\u00a0\\u202f][ \\t\\u00a0\\u202f]*(?={FULL})"
    before = "[ \\t](?<![ \\t]{2})[ \\t]*+([,;:!?]|\\.(?![A-Za-z0-9_/\\\\]))"
    after = "([,;:])(?:(?=\\p{L})|(?<![0-9][,;:])(?=[0-9]))"
    joined = lambda t: F.when(t.contains("\u00a0") | t.contains("\u202f"), F.regexp_replace(t, space, " ")).otherwise(t)
    return [
        ("non-breaking-space", "Replaces a non-breaking space with an ordinary space.", joined),
        ("space-before-punctuation", "Removes a space before punctuation.", lambda t: F.regexp_replace(t, before, "$1")),
        ("space-after-punctuation", "Adds the missing space after punctuation.", lambda t: F.regexp_replace(t, after, "$1 ")),
        ("repeated-space", "Removes a repeated space.", single_spaced),
        ("sentence-capitalisation", "Capitalizes the first word.", capital_opener),
        ("proper-noun-capitalisation", "Capitalizes a day or month name.", _dates),
    ]


def repaired(df: DataFrame, text: str) -> DataFrame:
    """Adds ``replacement`` (null where nothing changes or a guarded token would), ``ids`` and ``repair_reason``.

    Untouchable spans are held by one character of private use while the repairs run, so a repair
    works around them and never inside.  A text that has this character is left alone.
    """
    held = F.size("__spans") > 0
    out = df.withColumn("__spans", _untouchable(F.col(text)))
    out = out.withColumn("__0", F.when(held, F.regexp_replace(text, java(lexicons.UNTOUCHABLE), "\ue000")).otherwise(F.col(text)))
    steps = _steps()
    for k, (_, _, fix) in enumerate(steps):
        out = out.withColumn(f"__{k + 1}", fix(F.col(f"__{k}")))
    parts = F.split(F.col(f"__{len(steps)}"), "\ue000")
    whole = F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("a"), F.col("__spans").alias("b")), lambda p: F.array(p["a"], F.coalesce(p["b"], F.lit(""))))), "")
    out = out.withColumn("__whole", F.when(held, whole).otherwise(F.col(f"__{len(steps)}")))

    def told(which: int) -> Column:
        return F.filter(F.array(*[F.when(F.col(f"__{k}") != F.col(f"__{k + 1}"), F.lit(s[which])) for k, s in enumerate(steps)]), lambda x: x.isNotNull())

    changed = (F.col("__whole") != F.col(text)) & ~F.col(text).contains("\ue000")
    sound = F.when(changed, guard_tokens(F.col(text)) == guard_tokens(F.col("__whole"))).otherwise(False)
    out = out.withColumn("replacement", F.when(sound, F.col("__whole")))
    out = out.withColumn("ids", F.when(sound, told(0))).withColumn("repair_reason", F.when(sound, F.array_join(told(1), " ")))
    return out.drop("__spans", "__whole", *[f"__{k}" for k in range(len(steps) + 1)])
