"""Pattern columns with ASCII word boundaries and Unicode white space.

The rules were written for a dialect in which ``\\b``, ``\\w`` and ``\\d`` are ASCII and ``\\s`` is
Unicode.  Java differs in ``\\b`` and ``\\s``, so patterns go through :func:`java`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = "A-Za-z0-9_"
#: White space of the rules, inside a character class.
BLANK = "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: The same in Python's dialect.
PY_BLANK = BLANK
#: One such character, and one other, with the commonest told first.
SPACE, FULL = f"[[^!-~]&&[{BLANK}]]", f"[!-~[^{BLANK}]]"
_EDGES = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{BLANK}]", c))
_EDGE = f"(?:(?<![{_W}])(?=[{_W}])|(?<=[{_W}])(?![{_W}]))"


def java(pattern: str) -> str:
    """A pattern of the rules in Java's dialect."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            if two == "\\b" and not inside:
                after = pattern[i + 2 :].lstrip("(").removeprefix("?:").lstrip("(").removeprefix("?:")
                # where a letter must follow, or must have come, one look is enough
                if after[:1].isalpha():
                    out.append(f"(?<![{_W}])")
                elif out and out[-1].isalpha():
                    out.append(f"(?![{_W}])")
                else:
                    out.append(_EDGE)
            elif two == "\\s":
                out.append(BLANK if inside else SPACE)
            elif two == "\\S":
                out.append(f"[^{BLANK}]" if inside else FULL)
            else:
                out.append(two)
            i += 2
            continue
        inside = (inside or two[0] == "[") and two[0] != "]"
        out.append(two[0])
        i += 1
    return "".join(out)


def re2(pattern: str) -> str:
    """A pattern of the rules that looks neither ahead nor behind, in the dialect of Arrow's automata, where ``\\b`` is ASCII already."""
    blank, out, inside = re.sub(r"\\u(....)", r"\\x{\1}", BLANK), [], False
    for part in re.findall(r"\\?.", pattern, re.DOTALL):
        inside = (inside or part == "[") and part != "]"
        out.append({"\\s": blank if inside else f"[{blank}]", "\\S": f"[^{blank}]"}.get(part, part))
    return "".join(out)


def matches(text: Column, pattern: str, fold: bool = True) -> Column:
    return text.rlike(("(?iu)" if fold else "") + java(pattern))


def count(text: Column, pattern: str, fold: bool = True) -> Column:
    return F.regexp_count(text, F.lit(("(?iu)" if fold else "") + java(pattern)))


def found(text: Column, pattern: str) -> Column:
    """All matches, as an array."""
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))


def replaced(text: Column, pattern: str, by: str, fold: bool = True) -> Column:
    return F.regexp_replace(text, ("(?iu)" if fold else "") + java(pattern), by)


def any_word(words: list[str]) -> str:
    return r"\b(?:" + "|".join(map(re.escape, words)) + r")\b"


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(values: list[str]) -> Column:
    """A constant array, made in one call."""
    return F.expr(f"array({', '.join(map(_quoted, values))})")


def among(word: Column, values: list[str]) -> Column:
    """Whether a word is one of the values."""
    return F.array_contains(listed(values), word)


def mapped(pairs: dict[str, str]) -> Column:
    """A constant map, made in one call."""
    return F.expr(f"map({', '.join(f'{_quoted(k)}, {_quoted(v)}' for k, v in pairs.items())})")


def any_of(patterns: list[str]) -> str:
    """One alternation; patterns that begin with a word edge and a letter share the edge and their first letter."""
    edge: dict[str, list[str]] = {}
    rest = []
    for p in patterns:
        if p.startswith("\\b") and p[2:3].isalpha():
            edge.setdefault(p[2], []).append(p[3:])
        elif p.startswith("\\b("):
            edge.setdefault("", []).append(p[2:])
        else:
            rest.append(f"(?:{p})")
    groups = "|".join(f"{first}(?:{'|'.join(tails)})" for first, tails in edge.items())
    return "|".join([*([rf"\b(?:{groups})"] if edge else []), *rest])


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_EDGES))


def overlapping(text: Column, part: Column) -> Column:
    """How often ``part`` stands in the text, occurrences that overlap counted each; 0 for an empty part."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(F.length(part) > 0, F.regexp_count(text, quoted)).otherwise(0)


def word_after(text: Column, word: Column) -> Column:
    """The word, in lower case, that follows a word's first occurrence in the text; null where there is none."""
    ws = words(text)
    at = F.array_position(ws, F.lower(word)).cast("int")
    return F.when(at > 0, F.get(ws, at))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


#: White space, words with inner apostrophes, and runs of anything else.
TOKEN = f"[{BLANK}]+|[\\p{{L}}\\p{{N}}]+(?:['’]\\p{{L}}+)*|[^{BLANK}\\p{{L}}\\p{{N}}]+"


def tokens(text: Column, spaces: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN if spaces else TOKEN.split("+|", 1)[1]), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+(?:['’]\\p{L}+)*"), F.lit(0))


def fnv1a(text: Column, seed: int = 2166136261) -> Column:
    """32-bit FNV-1a over UTF-16 units, as eight hex digits; a code point beyond 65535 is two units."""

    def unit(four: Column) -> Column:
        return F.conv(four, 16, 10).cast("long")

    hexed = F.hex(F.encode(text, "UTF-16BE"))
    all_units = F.transform(F.sequence(F.lit(1), F.greatest(F.length(hexed), F.lit(4)), F.lit(4)), lambda i: unit(F.substring(hexed, i, F.lit(4))))
    step = F.aggregate(F.when(F.length(text) > 0, all_units).otherwise(F.array().cast("array<long>")), F.expr(f"{seed}L"), lambda h, u: (h.bitwiseXOR(u) * F.expr("16777619L")).bitwiseAND(F.expr("4294967295L")))
    return F.lower(F.lpad(F.hex(step), 8, "0"))


def outcome_key(sentence: Column, terms: Column) -> Column:
    """64 bits, as hex, of a sentence with its protected terms: two hashes of their JSON with different seeds."""
    body = F.concat(F.regexp_replace(F.to_json(F.array(sentence)), "\\]$", ","), F.to_json(terms), F.lit("]"))
    # control characters with a letter in their number are written in lower case
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        body = F.regexp_replace(body, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return F.concat(fnv1a(body), fnv1a(body, 16777619))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of ``k`` out of ``n``, clamped to [0, 1]; 0, 0 where n is 0."""
    m = F.greatest(n, F.lit(1)).cast("double")
    p, zz = k / m, z * z
    centre, spread = p + zz / (2 * m), z * F.sqrt(p * (1 - p) / m + zz / (4 * m * m))
    bottom = 1 + zz / m
    low, high = F.greatest(F.lit(0.0), (centre - spread) / bottom), F.least(F.lit(1.0), (centre + spread) / bottom)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)
