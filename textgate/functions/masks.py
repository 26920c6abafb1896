"""Maskers that keep a text's length: what is masked becomes as many spaces, line ends stay."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMENT = "(?s)<!--.*?(?:-->|\\z)"
TAG = "</?[a-zA-Z][a-zA-Z0-9-]*(?:\\s[^<>]*)?/?>|<![^-][^>]*>"
#: Code on one line between runs of as many back-ticks.
CODE = "(?<!`)(`+)(?!`)[^\\n]+?(?<!`)\\1(?!`)"
#: A fence with at most three blanks before it, to a fence of its kind and length at least, or to the end.
FENCED = "(?msd)^ {0,3}(`{3,}|~{3,})[^\\n]*+(?:\\n.*?(?:^ {0,3}\\1(?:(?<=`)`*+|(?<=~)~*+)[ \\t]*$|\\z)|\\z)"
LINK = "(?<=\\]\\()\\s*+(?:<[^>]*>|[^)\\s]*)"
DEFINITION = "(?md)(?<=^ {0,3}\\[[^\\]\\n]{0,120}\\]:[ \\t]{0,8})[^\\s]+"
ADDRESS = "<(?:https?|mailto):[^>\\s]*>|(?:https?://|www\\.)[^\\s<>()\\[\\]\"'`]+"
SCRIPT = "(?is)<(script|style)\\b[^>]*>.*?(?:</\\1\\s*>|\\z)"
#: How a hit of these ends that is closed; one that is open to the text's end is found, so that the search is linear, and left as it is.
CLOSED = {COMMENT: "--", SCRIPT: "</(?i:script|style)\\s*"}
#: What a text must have, one of them, for a pattern to be looked for.
SIGNS = {COMMENT: ["<!--"], TAG: ["<"], CODE: ["`"], FENCED: ["```", "~~~"], LINK: ["]("], ADDRESS: ["http", "mailto:", "www."], SCRIPT: ["<"]}
DESCRIPTION = '(?s)^(.*?"description"\\s*:\\s*")((?:[^"\\\\]++|\\\\.)*+)'


def masked(text: Column, pattern: str) -> Column:
    """Each match of ``pattern`` replaced by spaces of its length."""
    blank = lambda hit: F.regexp_replace(hit, "[^\\n]", " ")
    if pattern in CLOSED:
        blank = lambda hit: F.when(hit.rlike(CLOSED[pattern] + ">\\z"), F.regexp_replace(hit, "[^\\n]", " ")).otherwise(hit)

    def blanked(t: Column) -> Column:
        hits = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        pieces = F.arrays_zip(F.split(t, pattern, -1).alias("a"), hits.alias("b"))
        out = F.array_join(F.transform(pieces, lambda p: F.concat(p["a"], F.coalesce(blank(p["b"]), F.lit("")))), "")
        signs = [t.contains(s) for s in SIGNS.get(pattern, ())]
        return F.when(reduce(or_, signs), out).otherwise(t) if signs else out

    # bound to a name, so that masks of masks do not repeat their input
    return F.get(F.transform(F.array(text), blanked), F.lit(0))


def prose(text: Column, syntax: str = "markdown") -> Column:
    """A document's prose with code, comments, tags and link targets masked; of JSON the first description alone stays."""
    if syntax == "json":
        blank = lambda part: F.regexp_replace(part, "[^\\n]", " ")
        head, told = F.regexp_extract(text, DESCRIPTION, 1), F.regexp_extract(text, DESCRIPTION, 2)
        rest = F.substring(text, F.length(head) + F.length(told) + 1, F.length(text))
        return F.concat(blank(head), told, blank(rest))
    steps = {"markdown": (FENCED, COMMENT, CODE, TAG, LINK), "html": (COMMENT, SCRIPT, TAG, LINK)}.get(syntax, ())
    for pattern in steps:
        text = masked(text, pattern)
    if steps:
        text = F.get(F.transform(F.array(text), lambda t: F.when(t.contains("]:"), masked(t, DEFINITION)).otherwise(t)), F.lit(0))
        text = masked(text, ADDRESS)
    return text


def syntax_of(path: Column) -> Column:
    """The syntax of a file by its ending."""
    low = F.lower(path)
    return F.when(low.endswith(".json"), "json").when(low.rlike("\\.html?$"), "html").otherwise("markdown")


def is_loopback(host: Column) -> Column:
    """The own machine by name or address; every octet is at most 255."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return F.lower(host).rlike(f"^(?:localhost|\\[?::1\\]?|127(?:\\.{octet}){{3}})$")
