"""Meaning guards over (source, candidate) pairs: column expressions, and one Arrow function for the word alignment.

Each guard is a boolean column that is true when the candidate must be refused; ``validated``
evaluates them in a fixed order and reports the first.  Most guards read two arrays a side, its
tokens and its plain words, which are made once; a few regular expressions run only where a
plain word or character calls for them.  Words are aligned last, for pairs that are still open.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textgate.functions import lexicons as lex
from textgate.functions import relations as rel
from textgate.functions.patterns import PY_BLANK, among, any_word, capitalised, count, found, java, listed, mapped, matches, replaced, trimmed, words
from textgate.operators import segment

OPS = T.ArrayType(
    T.StructType(
        [
            *(T.StructField(name, T.StringType()) for name in ("type", "source", "target")),
            *(T.StructField(name, T.IntegerType()) for name in ("start", "end", "run")),
            T.StructField("twin", T.BooleanType()),
            *(T.StructField(name, T.IntegerType()) for name in ("target_start", "target_end")),
        ]
    )
)
_TOKEN = re.compile(f"[^\\W_]+(?:['’][^\\W\\d_]+)*|(?:[^\\w{PY_BLANK}]|_)+")


#: Cells up to which a table of lists is quicker than rows of numpy.
_SMALL = 4096


def _deletions(a: list[str], b: list[str]) -> Iterator[list[bool] | np.ndarray]:
    """For each word of ``a``, before which words of ``b`` the longest common subsequence of what is left stays as long without it.

    Rows of lengths are made from the last to the first and kept once in a stretch, and a stretch is made again
    when it is read: memory grows with the root of the table's size.
    """
    wide = len(b)
    if len(a) * wide <= _SMALL:
        best = [[0] * (wide + 1)]
        for x in reversed(a):
            below, row = best[-1], [0] * (wide + 1)
            for j in range(wide - 1, -1, -1):
                row[j] = below[j + 1] + 1 if x == b[j] else max(below[j], row[j + 1])
            best.append(row)
        for below, row in zip(best[-2::-1], best[::-1], strict=False):
            yield [below[j] >= row[j] for j in range(wide)]
        return
    number = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([number[w] for w in side], np.int32) for side in (a, b))

    def above(below: np.ndarray, i: int) -> np.ndarray:
        row = np.zeros(wide + 1, np.int32)
        row[:-1] = np.maximum.accumulate(np.where(y == x[i], below[1:] + 1, below[:-1])[::-1])[::-1]
        return row

    stretch = math.isqrt(len(a)) + 1
    row, kept = np.zeros(wide + 1, np.int32), {}
    for i in range(len(a) - 1, -1, -1):
        if (i + 1) % stretch == 0 or i == len(a) - 1:
            kept[i // stretch] = row
        row = above(row, i)
    for k in sorted(kept):
        first, below, bits = k * stretch, kept.pop(k), []
        for i in range(min(first + stretch, len(a)) - 1, first - 1, -1):
            row = above(below, i)
            bits.append(np.packbits(below[:-1] >= row[:-1]))
            below = row
        for packed in reversed(bits):
            yield np.unpackbits(packed, count=wide).view(bool)


def _held(a: list[str], b: list[str]) -> bool:
    """Whether ``a`` is a subsequence of ``b``."""
    ahead = iter(b)
    return all(x in ahead for x in a)


def _steps(a: list[str], b: list[str]) -> Iterator[tuple[str, int | None, int | None]]:
    """Longest common subsequence; a deletion goes before an insertion on ties.

    Words that the other side lacks lengthen nothing, so lengths are those of the words that both sides have.  Where what is
    left of one side is within the other, the places where the other still holds it tell enough; a table is made for the rest.
    """
    both = set(a) & set(b)
    x, y = [w for w in a if w in both], [w for w in b if w in both]
    # the last place of x from which it holds the rest of y
    last, k = [-1] * len(y), len(x)
    for q in range(len(y) - 1, -1, -1):
        k -= 1
        while k >= 0 and x[k] != y[q]:
            k -= 1
        if k < 0:
            break
        last[q] = k
    tall = wide = 0
    if x != y and (not y or last[0] < 0) and not _held(x, y):
        tall, wide = len(x), len(y)
        while tall and wide and x[tall - 1] == y[wide - 1]:
            tall, wide = tall - 1, wide - 1
    table = _deletions(x[:tall], y[:wide])
    j = p = q = 0
    for i, word in enumerate(a):
        if word in both:
            row = next(table) if p < tall else ()
            while j < len(b) and word != b[j] and not (row[q] if p < tall and q < wide else q == len(y) or last[q] > p):
                yield "insert", None, j
                q += b[j] in both
                j += 1
            p += 1
            if j < len(b) and word == b[j]:
                yield "equal", i, j
                q, j = q + 1, j + 1
                continue
        yield "delete", i, None
    for k in range(j, len(b)):
        yield "insert", None, k


def _aligned(source: str, candidate: str) -> list[tuple]:
    """Steps by lower-case token.

    Changed steps carry the number of their run; ``twin`` marks one whose neighbour is the same word.
    """
    left = list(_TOKEN.finditer(source))
    right = left if source == candidate else list(_TOKEN.finditer(candidate))
    a = [m[0].lower() for m in left]
    b = a if right is left else [m[0].lower() for m in right]
    head, shorter = 0, min(len(a), len(b))
    while head < shorter and a[head] == b[head]:
        head += 1
    out = [("equal", x[0], y[0], *x.span(), 0, False, *y.span()) for x, y in zip(left[:head], right[:head], strict=True)]
    steps = list(_steps(a[head:], b[head:]))
    key = [*a[max(head - 1, 0) : head], *(a[head + i] if i is not None else b[head + j] for _, i, j in steps)]
    first, run, before = len(key) - len(steps), 0, "equal"
    for k, (kind, i, j) in enumerate(steps, first):
        run += kind != "equal" and before == "equal"
        before = kind
        twin = kind != "equal" and key[k] in (*key[max(k - 1, 0) : k], *key[k + 1 : k + 2])
        x, y = left[head + i] if i is not None else None, right[head + j] if j is not None else None
        out.append((kind, x and x[0], y and y[0], *(x.span() if x else (None, None)), run if kind != "equal" else 0, twin, *(y.span() if y else (None, None))))
    return out


#: Pairs whose steps are handed on at once.
_AT_ONCE = 256
_STEP = pa.struct([(f.name, {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_()}[type(f.dataType)]) for f in OPS.elementType.fields])


def _step_lists(rows: list[list[tuple] | None]) -> pa.Array:
    ends = itertools.accumulate(len(r or ()) for r in rows)
    offsets = [0, *ends]
    columns = list(zip(*itertools.chain.from_iterable(r for r in rows if r), strict=True)) or [()] * len(_STEP)
    steps = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STEP, strict=True)], fields=list(_STEP))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps, mask=pa.array([r is None for r in rows], pa.bool_()))


@F.arrow_udf(OPS)
def _align(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in batches:
        parts = [_step_lists([])]
        for k in range(0, len(left), _AT_ONCE):
            sides = zip(left.slice(k, _AT_ONCE).to_pylist(), right.slice(k, _AT_ONCE).to_pylist(), strict=True)
            parts.append(_step_lists([None if a is None or b is None else _aligned(a, b) for a, b in sides]))
        yield pa.concat_arrays(parts)


# kept as a step of its own, so that it runs once and never inside another function
_align = _align.asNondeterministic()


def edit_ops(source: Column, candidate: Column) -> Column:
    """Equal, delete and insert steps over non-space tokens; null where a text is null."""
    return _align(source, candidate)


def _kind(ops: Column, kind: str) -> Column:
    return F.filter(ops, lambda o: o["type"] == kind)


def edit_ratio(ops: Column) -> Column:
    """Changed steps over the tokens of both sides."""
    changed = F.size(F.filter(ops, lambda o: o["type"] != "equal"))
    return changed / F.greatest(2 * F.size(ops) - changed, F.lit(1))


def changed_ranges(source: Column, ops: Column) -> Column:
    """(start, end) in the source of what changes; an insertion stands at its neighbour, ranges with blanks between are one.

    Tokens take in everything but blanks, so ranges are the unbroken runs of touched tokens of the source.
    """
    inserts = lambda i: F.coalesce(F.get(ops, i)["type"] == "insert", F.lit(False))
    recased = lambda o: (o["type"] == "equal") & (o["source"] != o["target"])
    marked = F.transform(ops, lambda o, i: F.struct(o["start"].alias("start"), o["end"].alias("end"), (recased(o) | (o["type"] == "delete") | inserts(i + 1)).alias("touched")))

    def runs(own: Column) -> Column:
        # what is inserted before all tokens stands at the first
        touched = lambda k: F.coalesce(F.get(own, k)["touched"] | ((k == 0) & inserts(F.lit(0))), F.lit(False))
        first = F.filter(own, lambda o, k: touched(k) & ((k == 0) | ~touched(k - 1)))
        last = F.filter(own, lambda o, k: touched(k) & ~touched(k + 1))
        return F.zip_with(first, last, lambda x, y: F.struct(x["start"].alias("start"), y["end"].alias("end")))

    return bound(F.filter(marked, lambda o: o["start"].isNotNull()), runs)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often and deep inside functions it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# ---- words of a side


def plain_words(lower: Column) -> Column:
    """Runs of ASCII word characters: what a word between word edges can be."""
    return F.regexp_extract_all(lower, F.lit("[a-z0-9_]+"), F.lit(0))


def expanded(text: Column) -> Column:
    """Auxiliaries with a contracted "not" written out."""
    out = text
    for short, long in lex.CONTRACTED.items():
        out = replaced(out, rf"\b{short.replace(chr(39), '[' + chr(39) + '’]')}\b", long)
    out = replaced(out, rf"\b({'|'.join(lex.CONTRACTED_STEMS)})n['’]t\b", "$1 not")
    return F.when(text.rlike("(?i)n['’]t|cannot"), out).otherwise(text)


_BASES = {k: v.split()[0] for k, v in lex.CONTRACTED.items()} | {f"{s}n't": s for s in lex.CONTRACTED_STEMS}


def base_word(word: Column) -> Column:
    """A lower-case word without what an apostrophe adds."""
    plain = F.translate(word, "’", "'")
    known = F.element_at(mapped(_BASES), plain)
    rest = F.regexp_replace(F.regexp_replace(plain, "'(?:re|s|ve|ll|d|m|t)$", ""), "n'$", "")
    return F.when(plain.contains("'") | (plain == "cannot"), F.coalesce(known, rest)).otherwise(plain)


def is_content(word: Column) -> Column:
    """A word with a letter that is no function word; ``word`` in lower case."""
    return word.rlike("\\p{L}") & ~among(base_word(word), lex.FUNCTION_WORDS)


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _only(ws: Column, values: list[str]) -> Column:
    """The words that are among ``values``, in order, with repeats."""
    return F.filter(ws, lambda w: among(w, values))


def _if(test: Column, then: Column) -> Column:
    """``then`` where ``test``, an empty array elsewhere."""
    return F.when(test, then).otherwise(F.array().cast("array<string>"))


# ---- single guards, on texts


def numbers(text: Column) -> Column:
    return _if(text.rlike("[0-9]"), F.transform(found(text, lex.NUMBER), lambda n: F.replace(F.lower(n), F.lit("−"), F.lit("-"))))


#: What a text must have for a class of protected tokens to be looked for.
_CALLS = ["[$€£¥₹]", "[$€£¥₹]", "(?i)https?:", "@", "/", ":\\\\", "(?i)\\.(?:csv|json|log|md|txt|ya?ml|pdf|js|py|sql|xml|html)", "[A-Z]{2}|_", "[A-Za-z][0-9]", "[0-9]:", "\\[[0-9]", "[0-9]"]
#: What a text must have for any of them.
_CALL = "[$€£¥₹@/_0-9]|[A-Z]{2}|:\\\\|(?i:https?:|\\.(?:csv|json|log|md|txt|ya?ml|pdf|js|py|sql|xml|html))"


def protected(text: Column) -> Column:
    """Tokens to keep as written, class by class."""
    every = F.concat(*[_if(text.rlike(call), F.transform(found(text, p), lambda t: F.trim(t))) for call, p in zip(_CALLS, lex.PROTECTED, strict=True)])
    return _if(text.rlike(_CALL), every)


def terms_changed(source: Column, candidate: Column, terms: Column) -> Column:
    """A caller's term occurs a different number of times."""

    def times(text: Column, term: Column) -> Column:
        edged = term.rlike("^[\\p{L}\\p{N}_]") & term.rlike("[\\p{L}\\p{N}_]$")
        quoted = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        return F.size(F.split(text, F.when(edged, F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted, F.lit("(?![A-Za-z0-9_])"))).otherwise(quoted)))

    return F.exists(F.coalesce(terms, F.array().cast("array<string>")), lambda t: (F.length(t) > 0) & (times(source, t) != times(candidate, t)))


def markup(text: Column) -> Column:
    every = F.regexp_extract_all(text, F.lit("(?m)" + java(lex.MARKUP)), F.lit(0))
    return _if(text.rlike("[`$|\\[#*~=_>+-]|[0-9][.)]"), F.filter(F.transform(every, lambda m: trimmed(m)), lambda m: m != ""))


_OPENERS = sorted({*lex.FUNCTION_WORDS, *lex.OPENING_ADVERBS, *lex.OPENING_WORDS, *(w for g in (*lex.PRONOUNS, *lex.QUANTIFIERS, *lex.CONNECTIVES, *lex.DIRECTIONS) for w in g if w not in ("lot", "lots", "plenty", "majority", "number", "solely", "exclusively", "merely", "exactly"))})


def names(text: Column) -> Column:
    """Capitalised words in lower case, but for number words and an opening word that is no name."""
    every = found(text, r"(?=\p{Lu})\b\p{Lu}[\p{L}’']*\b")
    opener = F.regexp_extract(text, f"^[^\\p{{L}}\\p{{N}}]*({java(chr(92) + 'b')}\\p{{Lu}}[\\p{{L}}’']*)", 1)
    behind = lambda ws: F.when(among(base_word(F.lower(opener)), _OPENERS), F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0)))).otherwise(ws)
    every = bound(every, behind)
    return _if(text.rlike("\\p{Lu}"), F.filter(F.transform(every, lambda w: F.lower(w)), lambda w: ~among(w, lex.NUMBER_WORDS)))


def names_changed(source: Column, candidate: Column) -> Column:
    """Names of both sides do not stand in one order."""

    def told(text: Column, every: Column) -> Column:
        low = F.transform(found(text, r"(?=\p{L})\b[\p{L}][\p{L}’']*\b"), lambda w: F.lower(w))
        return F.filter(low, lambda w: F.array_contains(every, w))

    # made once a pair, not once a word
    return bound(F.array_union(names(source), names(candidate)), lambda every: F.when(F.size(every) > 0, told(source, every) != told(candidate, every)).otherwise(False))


def hedge_words(text: Column) -> Column:
    """Plain words without softeners and stacked evidential verbs, auxiliaries written out."""
    calm = F.when(text.rlike("(?i)would|seem|appear"), replaced(replaced(text, lex.EVIDENTIAL, ""), lex.SOFT_WOULD, "")).otherwise(text)
    return plain_words(F.lower(expanded(calm)))


def members(text: Column, group: list[str]) -> Column:
    """Members of a word group that stand in the text."""
    return F.array_sort(F.array_intersect(plain_words(F.lower(text)), listed(group)))


def certainty_changed(a: Column, b: Column) -> Column:
    """From hedge words: a group's distinct members rise, or all of them go and are no stack reduced."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda v: _certainty_changed(v["a"], v["b"]))


def _certainty_changed(a: Column, b: Column) -> Column:
    hedges = [w for k in lex.EPISTEMIC for w in lex.CERTAINTY[k]]
    mine, kept = F.array_intersect(a, listed(hedges)), F.array_intersect(b, listed(hedges))
    # of two hedges on one claim the later one may go
    reduced = (F.size(F.array_except(mine, kept)) > 0) & F.array_contains(kept, F.get(mine, F.lit(0)))
    parts = []
    for k, group in enumerate(lex.CERTAINTY):
        x, y = (F.size(F.array_intersect(side, listed(group))) for side in (a, b))
        gone = (x > 0) & (y == 0)
        parts.append((y > x) | (gone & ~F.coalesce(reduced, F.lit(False)) if k in lex.EPISTEMIC else gone))
    some = F.arrays_overlap(F.array_union(a, b), listed([w for g in lex.CERTAINTY for w in g]))
    return F.when(some, _any(parts)).otherwise(False)


def quantifier_sets(text: Column) -> Column:
    """Per group the members present, with narrow senses of no, most, least, about and around."""
    lower = F.lower(text)
    lower = F.when(lower.contains("just"), replaced(lower, lex.SOFT_JUST, "", False)).otherwise(lower)
    return bound(lower, lambda text: bound(plain_words(text), lambda ws: _quantifiers(text, ws)))


def _quantifiers(lower: Column, ws: Column) -> Column:
    sets = []
    for k, group in enumerate(lex.QUANTIFIERS):
        have = F.array_intersect(ws, listed(group))
        narrow, broad = {0: ["no"], 3: ["about", "around", "least", "most"]}.get(k, []), []
        for w in narrow:
            if w == "no":
                sense = matches(lower, lex.NARROW_NO, False)
            elif w in ("most", "least"):
                sense = matches(lower, rf"\bat\s+{w}\b", False)
            else:
                sense = matches(lower, rf"\b{w}\s+{lex.QUANTITY}\b|\b{lex.QUANTITY}\s+{w}\b", False)
            broad.append(F.when(F.array_contains(ws, w) & ~sense, F.lit(w)))
        sets.append(F.array_sort(F.array_except(have, F.array_compact(F.array(*broad))) if broad else have))
    return F.array(*sets)


def quantifiers_changed(left: Column, right: Column) -> Column:
    """From quantifier sets: a group emptied, or a member new, unless a vague word stands for a phrase such as "a number of"."""
    return bound(F.struct(left.alias("a"), right.alias("b")), lambda v: _quantifiers_changed(v["a"], v["b"]))


def _quantifiers_changed(left: Column, right: Column) -> Column:
    parts = []
    for k in range(len(lex.QUANTIFIERS)):
        a, b = F.get(left, F.lit(k)), F.get(right, F.lit(k))
        new = F.array_except(b, a)
        if k == 1:
            traded = F.exists(F.array_except(a, b), lambda w: among(w, lex.PERIPHRASTIC))
            new = F.when(traded, F.array_except(new, listed(lex.VAGUE))).otherwise(new)
        parts.append(((F.size(a) > 0) & (F.size(b) == 0)) | (F.size(new) > 0))
    return _any(parts)


def bounds(lower: Column) -> Column:
    """Phrases such as "more than" that bound a quantity, sorted."""
    every = F.regexp_extract_all(lower, F.lit(java(rf"\b(more than|fewer than|less than|up to)\s+{lex.QUANTITY}")), F.lit(1))
    denied = F.regexp_extract_all(lower, F.lit(java(rf"\b(no (?:more|fewer|less) than)\s+{lex.QUANTITY}")), F.lit(1))
    return _if(lower.contains(" than ") | lower.contains("up to "), F.array_sort(F.concat(every, denied)))


def negations(text: Column) -> Column:
    """Words of denial, less those that are mere spelling."""
    lower = F.lower(text)
    said = F.size(_only(plain_words(lower), lex.NEGATIONS)) + F.when(lower.rlike("n['’]t"), count(lower, r"n['’]t\b", False)).otherwise(0)
    return said - F.when(lower.contains("not"), count(lower, "|".join(lex.NOT_AS_SPELLING), False)).otherwise(0)


def connective_lost(a: Column, b: Column) -> Column:
    """From plain words."""
    return _any([F.size(F.array_intersect(b, listed(g))) < F.size(F.array_intersect(a, listed(g))) for g in lex.CONNECTIVES])


def direction_changed(source: Column, candidate: Column, a: Column, b: Column) -> Column:
    """A new member of a contrast group where the source has another member; ``a`` and ``b`` are plain words of the lower texts."""

    def present(text: Column, ws: Column, group: list[str]) -> Column:
        have = F.array_intersect(ws, listed(group))
        for w, sense in (("once", lex.NARROW_ONCE), ("while", lex.NARROW_WHILE)):
            if w in group:
                have = F.when(F.array_contains(have, w) & ~matches(text, sense, False), F.array_remove(have, w)).otherwise(have)
        return have

    parts = []
    for group in lex.DIRECTIONS:
        had, has = present(source, a, group), present(candidate, b, group)
        if "on" in group:
            for w in group:  # a particle of a phrasal verb is no direction
                free = matches(candidate, rf"(?<!\b(?:{lex.PHRASAL_HOSTS})\s{{1,3}})\b{w}\b", False)
                has = F.when(F.array_contains(has, w) & ~free, F.array_remove(has, w)).otherwise(has)
        parts.append((F.size(had) > 0) & (F.size(F.array_except(has, had)) > 0))
    return _any(parts)


_TIME = rf"(?:\d[\d:]*(?:\.\d+)?|(?:{'|'.join(lex.TIMES)})(?![\p{{L}}\p{{N}}:]))"


def deadline_moved(source: Column, candidate: Column, a: Column, b: Column) -> Column:
    """The same time behind another preposition."""

    def told(lower: Column) -> Column:
        pattern = java(rf"\b({'|'.join(lex.DEADLINE_PREPOSITIONS)})\s+({_TIME})")
        return F.arrays_zip(*[F.regexp_extract_all(lower, F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "by"), (2, "at"))])

    was = told(source)
    other = F.exists(told(candidate), lambda c: F.coalesce(F.get(F.reverse(F.filter(was, lambda x: x["at"] == c["at"])), F.lit(0))["by"] != c["by"], F.lit(False)))
    both = F.arrays_overlap(a, listed(lex.DEADLINE_PREPOSITIONS)) & F.arrays_overlap(b, listed(lex.DEADLINE_PREPOSITIONS))
    return F.when(both, other).otherwise(False)


def tense(text: Column) -> Column:
    """(past, future, perfect) as a struct of booleans.

    Adverbs and negators do not govern a participle, so they are taken out of the line of words;
    what is left is read with one look back.
    """
    low = F.regexp_extract_all(F.lower(expanded(text)), F.lit(java(r"\b[\p{L}’']+\b")), F.lit(0))
    line = F.filter(low, lambda w: ~(w.rlike("ly$") | among(w, [*lex.INTENSIFIERS, "not", "never"])))
    line = F.concat(F.lit(" "), F.array_join(line, " "))
    line = F.regexp_replace(line, f" (?:{'|'.join(lex.AUXILIARIES)})$", "")
    irregular = f"(?:{'|'.join(lex.PAST_IRREGULAR)}|(?:{'|'.join(lex.VERB_PREFIXES)})?(?:{'|'.join(lex.IRREGULAR_ENDINGS)}))"
    participle = f"(?:{'|'.join(lex.PAST_PARTICIPLES)})"
    end, free = "(?= |$)", f"(?<! (?:{'|'.join(lex.PRESENT_BE)}))"
    regular = f"(?!(?:{'|'.join(lex.NOT_PAST_ED)}){end})[\\p{{L}}’']*ed"

    def told(line: Column) -> Column:
        past = line.rlike(f"{free} (?:{irregular}|{regular}){end}") | line.rlike(f" (?:{'|'.join(lex.PERFECT)}) {participle}{end}")
        perfect = line.rlike(f" (?:{'|'.join(lex.PERFECT)}) (?:[\\p{{L}}’']*(?:ed|en)|{'|'.join(lex.PAST_IRREGULAR)}|{participle}){end}")
        return F.struct(past.alias("past"), line.rlike(f" (?:will|shall){end}").alias("future"), perfect.alias("perfect"))

    return bound(line, told)


def tense_changed(source: Column, a: Column, b: Column) -> Column:
    """From tenses, unless the source names a past moment, or its verb does not tell, and the past is supplied."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda v: _tense_changed(source, v["a"], v["b"]))


def _tense_changed(source: Column, a: Column, b: Column) -> Column:
    undecided = matches(source, lex.PAST_EVIDENCE) | matches(source, any_word(lex.INVARIANT_PAST))
    repaired = ~a["past"] & b["past"] & (a["future"] == b["future"]) & (a["perfect"] == b["perfect"]) & undecided
    return (a != b) & ~repaired


def pronoun_families(text: Column) -> Column:
    return _families(words(text))


def _families(ws: Column) -> Column:
    base = F.transform(ws, lambda w: F.when(w.rlike("['’]"), F.regexp_replace(w, "['’](?:re|s|ve|ll|d|m)$", "")).otherwise(w))
    some = lambda b: F.array_compact(F.array(*[F.when(F.arrays_overlap(b, listed(g)), F.lit(k)) for k, g in enumerate(lex.PRONOUNS)]))
    return bound(base, some)


def pronouns_changed(source: Column, candidate: Column) -> Column:
    """A family the source lacks, but for "it": one of a word that the source lacks."""
    sides = F.struct(words(source).alias("s"), words(candidate).alias("c"))

    def changed(v: Column) -> Column:
        met = lambda new: F.size(F.array_remove(new, len(lex.PRONOUNS) - 1)) > 0
        told = lambda new: F.when(met(new), met(F.array_except(new, _families(v["s"])))).otherwise(False)
        return bound(F.array_except(v["c"], v["s"]), lambda ws: F.when(F.size(ws) > 0, bound(_families(ws), told)).otherwise(False))

    return F.when(source == candidate, False).otherwise(bound(sides, changed))


def terminal(text: Column) -> Column:
    return F.regexp_extract(trimmed(text), "([.!?…]+)[\"'’”)\\]}]*$", 1)


def order_changed(source: Column, candidate: Column) -> Column:
    """The same words in another order; articles do not count unless the candidate has more of them."""
    return _permuted(words(source), words(candidate))


def _permuted(left: Column, right: Column) -> Column:
    articles = ["a", "an", "the"]

    def bag(ws: Column) -> Column:
        return F.filter(ws, lambda w: ~w.isin(articles))

    more = F.size(_only(right, articles)) > F.size(_only(left, articles))
    return ~more & (F.size(bag(left)) > 0) & (bag(left) != bag(right)) & (F.array_sort(bag(left)) == F.array_sort(bag(right)))


def subordinator_moved(source: Column, candidate: Column, a: Column, b: Column) -> Column:
    """A comma that stood before a subordinator is gone from there, and there are as many commas."""

    def led(lower: Column) -> Column:
        return F.regexp_extract_all(lower, F.lit(java(rf",\s*({'|'.join(lex.SUBORDINATORS)})\b")), F.lit(1))

    def commas(text: Column) -> Column:
        return F.length(text) - F.length(F.translate(text, ",", ""))

    once = lambda ws, w: F.size(F.filter(ws, lambda x: x == w)) == 1
    moved = F.exists(F.array_except(led(source), led(candidate)), lambda w: once(a, w) & once(b, w))
    return F.when(source.contains(",") & (commas(candidate) >= commas(source)), moved).otherwise(False)


def adjunct_compounded(left: Column, right: Column) -> Column:
    """From words: a verb's object and the phrase of place behind it have become one compound."""
    function, determiner = "|".join(lex.FUNCTION_WORDS), "|".join(lex.NOUN_DETERMINERS)
    word = f"(?!(?:{function})[ \n])(?=\\S*\\p{{L}})\\S+"
    phrase = f" {word}(?: (?:{determiner}))+ ({word}) ({'|'.join(lex.ADJUNCT_PREPOSITIONS)})(?: (?:{determiner}))* ({word}(?: {word})*+)[^\n]*\n(?![^\n]* \\1 \\2 )[^\n]* \\3 \\1 "
    line = F.concat(F.lit(" "), F.array_join(left, " "), F.lit(" \n "), F.array_join(right, " "), F.lit(" "))
    return F.when(F.arrays_overlap(left, listed(lex.ADJUNCT_PREPOSITIONS)), line.rlike(phrase)).otherwise(False)


def roles_flipped(source: Column, candidate: Column, left: Column, right: Column) -> Column:
    """From content words: a passive turned active, or the other way round, with its parties in the same order."""
    by = F.lower(source).contains(" by ") != F.lower(candidate).contains(" by ")
    voiced = matches(source, lex.PASSIVE) != matches(candidate, lex.PASSIVE)
    mine, theirs = F.filter(left, lambda w: F.array_contains(right, w)), F.filter(right, lambda w: F.array_contains(left, w))
    flipped = voiced & ~matches(source, lex.EXPLETIVE_PASSIVE) & (F.size(mine) >= 2) & (mine == theirs)
    return F.when(by | (F.lower(source).contains(" by ") & F.lower(candidate).contains(" by ")), flipped).otherwise(False)


def scope_dropped(source: Column, candidate: Column) -> Column:
    """Fewer of a word that fixes the scope of a claim."""
    a, b = plain_words(F.lower(source)), plain_words(F.lower(candidate))
    times = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    return _any([times(b, w) < times(a, w) for w in lex.SCOPE])


def confusable_swap(left: Column, right: Column) -> Column:
    """From tokens: one word for another of a confusable pair, and nothing else."""
    differ = F.filter(F.arrays_zip(left.alias("x"), right.alias("y")), lambda p: p["x"] != p["y"])
    pair = F.concat_ws(":", F.get(differ, F.lit(0))["x"], F.get(differ, F.lit(0))["y"])
    return F.when(F.size(left) == F.size(right), (F.size(differ) == 1) & among(pair, rel.PAIRS)).otherwise(False)


def refusal_prose(candidate: Column, left: Column, right: Column) -> Column:
    """From content words: a reply about the request instead of a rewrite."""
    return F.when(matches(candidate, lex.REFUSAL), (F.size(left) > 0) & ~F.arrays_overlap(left, right)).otherwise(False)


# ---- guards on aligned steps


def _texts(ops: Column, kind: str) -> Column:
    """(word, run) of the deleted or inserted steps, in lower case."""
    side = "source" if kind == "delete" else "target"
    return F.transform(_kind(ops, kind), lambda o: F.struct(F.lower(o[side]).alias("w"), o["run"].alias("run")))


def _words_of(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["w"])


def nouns_swapped(ops: Column) -> Column:
    """Two spans of content words, each in the other's place."""
    changed = F.filter(ops, lambda o: o["type"] != "equal")
    told = F.transform(changed, lambda o: F.concat(F.substring(o["type"], 1, 1), F.regexp_replace(F.lower(F.coalesce(o["source"], o["target"])), "['’]s$", ""), F.lit("\n")))
    line = F.array_join(told, "")
    one, two = "((?:d[^\n]*\n)+)", "((?:i[^\n]*\n)+)"

    def swapped(order: str, kinds: tuple[int, int, int, int]) -> Column:
        part = [F.regexp_replace(F.regexp_extract(line, f"^{order}$", k), "(?m)^[di]", "") for k in kinds]
        return line.rlike(f"^{order}$") & (part[0] != part[1]) & (part[0] == part[3]) & (part[1] == part[2])

    content = ~F.exists(changed, lambda o: ~is_content(F.lower(F.coalesce(o["source"], o["target"]))))
    return content & (swapped(one + two + one + two, (1, 3, 2, 4)) | swapped(two + one + two + one, (2, 4, 1, 3)))


_RESPELL = lex.RESPELLED | {k: v for k, v in lex.CONTRACTED.items() if k != "ain't"} | {f"{s}n't": f"{s} not" for s in lex.CONTRACTED_STEMS}


def trivial(ops: Column) -> Column:
    """One article taken out, or a contraction written out, and nothing else."""
    sides = F.struct(_texts(ops, "delete").alias("deleted"), _texts(ops, "insert").alias("inserted"))
    longhand = mapped(_RESPELL)
    spelled = lambda ws: F.array_join(F.transform(ws, lambda w: F.coalesce(F.element_at(longhand, F.translate(w, "’", "'")), w)), " ")

    def worth(v: Column, run: Column) -> Column:
        out, into = (_words_of(F.filter(x, lambda p: p["run"] == run)) for x in (v["deleted"], v["inserted"]))
        twin = F.exists(ops, lambda o: (o["run"] == run) & (o["type"] == "delete") & o["twin"])
        article = (F.size(into) == 0) & ~F.exists(out, lambda w: ~w.isin("a", "an", "the"))
        same = (F.size(into) > 0) & (F.size(out) > 0) & (spelled(out) == spelled(into)) & (F.length(F.array_join(into, " ")) >= F.length(F.array_join(out, " ")))
        return F.when(twin, "substantive").when(article, "article").when(same, "respelling").otherwise("substantive")

    runs = F.array_distinct(F.transform(F.filter(ops, lambda o: o["run"] > 0), lambda o: o["run"]))
    kinds = bound(sides, lambda v: F.transform(runs, lambda run: worth(v, run)))
    return bound(kinds, lambda k: (k == listed(["article"])) | (F.array_contains(k, "respelling") & ~F.array_contains(k, "substantive")))


def unsourced_word(ops: Column, prose: Column) -> Column:
    """A new content word that no word of the source's own prose accounts for."""
    gone = F.exists(_words_of(_texts(ops, "delete")), lambda w: among(w, lex.PERIPHRASTIC))
    new = F.filter(_words_of(_texts(ops, "insert")), is_content)
    known = F.struct(F.filter(words(prose), is_content).alias("own"), plain_words(F.lower(prose)).alias("said"), gone.alias("gone"))

    def unsourced(v: Column) -> Column:
        sourced = lambda w: among(w, lex.REDUCTIONS) | F.array_contains(v["own"], w) | F.array_contains(v["said"], w) | (v["gone"] & among(w, lex.VAGUE)) | F.exists(v["own"], lambda x: rel.related(x, w))
        return F.exists(new, lambda w: ~sourced(w))

    return bound(known, unsourced)


def _lone(ops: Column) -> tuple[Column, Column, Column]:
    """Whether one word is swapped for another and nothing else, and both."""
    out, into = _words_of(_texts(ops, "delete")), _words_of(_texts(ops, "insert"))
    return (F.size(out) == 1) & (F.size(into) == 1), F.get(out, F.lit(0)), F.get(into, F.lit(0))


def number_of_noun(ops: Column) -> Column:
    """A noun behind a determiner put into the plural or singular, and nothing else."""
    alone, before, after = _lone(ops)

    def plural(one: Column, more: Column) -> Column:
        regular = (F.concat(one, F.lit("s")) == more) | (F.concat(one, F.lit("es")) == more)
        return regular | (one.endswith("y") & (F.regexp_replace(one, "y$", "ies") == more)) | (one.rlike("fe?$") & (F.regexp_replace(one, "fe?$", "ves") == more))

    place = F.array_position(F.transform(ops, lambda o: o["type"]), "delete").cast("int")
    ahead = F.filter(F.slice(ops, F.lit(1), F.greatest(place - 1, F.lit(0))), lambda o: o["source"].isNotNull() & o["source"].rlike("\\p{L}"))
    behind = F.lower(F.get(F.reverse(ahead), F.lit(0))["source"])
    return F.coalesce(alone & (plural(before, after) | plural(after, before)) & among(behind, lex.NUMBER_NEUTRAL), F.lit(False))


def derived_word(ops: Column, source: Column, candidate: Column) -> Column:
    """A word swapped for one derived from it, and nothing else."""
    alone, before, after = _lone(ops)
    short, long = (F.when((F.length(before) <= F.length(after)) == first, before).otherwise(after) for first in (True, False))
    tail = F.substring(long, F.length(short) + 1, F.length(long))
    progressive = (tail == "ing") & F.rlike(F.lower(F.concat_ws(" ", source, candidate)), F.concat(F.lit(f"\\b(?:{'|'.join(lex.BE_FORMS)})\\s+\\Q"), long, F.lit("\\E\\b")))
    pair = among(F.concat_ws(":", before, after), rel.PAIRS)
    return F.coalesce(alone & (before != after) & ~pair & F.startswith(long, short) & among(tail, lex.DERIVATIONS) & ~progressive, F.lit(False))


def topic_objectified(ops: Column) -> Column:
    """A nominal's topic became the object of a verb of ruling."""
    out, into = _texts(ops, "delete"), _texts(ops, "insert")
    in_run = lambda ps, p: F.filter(ps, lambda q: q["run"] == p["run"])
    topic = lambda ps: F.exists(ps, lambda q: among(q["w"], lex.TOPIC_PREPOSITIONS))
    noun = lambda p: F.exists(in_run(out, p), lambda q: (q["w"] != p["w"]) & q["w"].rlike(lex.NOMINAL_TAIL) & rel.related(q["w"], p["w"]))
    return F.exists(into, lambda p: among(p["w"], lex.RULING_VERBS) & topic(in_run(out, p)) & ~topic(in_run(into, p)) & noun(p))


_PARTNERS = {}
for _x, _y in (p.split(":") for p in lex.CONFUSABLES):
    if _x not in lex.FUNCTION_WORDS and _y not in lex.FUNCTION_WORDS:
        _PARTNERS.setdefault(_x, []).append(_y)
        _PARTNERS.setdefault(_y, []).append(_x)


def confusable_derived(ops: Column, content: Column) -> Column:
    """A confusable word replaced by one built on its spelling, where neither it nor its partner stays."""
    out, into = _texts(ops, "delete"), _texts(ops, "insert")
    partner = lambda w: F.element_at(F.create_map(*[x for k, v in _PARTNERS.items() for x in (F.lit(k), listed(v))]), w)

    def built(p: Column) -> Column:
        stays = F.exists(content, lambda c: rel.related(c, p["w"]) | F.exists(partner(p["w"]), lambda q: rel.related(c, q)))
        longer = F.exists(into, lambda q: (q["run"] == p["run"]) & (F.length(q["w"]) > F.length(p["w"])) & F.startswith(q["w"], p["w"]))
        return among(p["w"], list(_PARTNERS)) & longer & ~F.coalesce(stays, F.lit(False))

    return F.exists(out, built)


def passive_introduced(ops: Column) -> Column:
    """An auxiliary and a participle put in for a verb of the same run."""
    out, into = _texts(ops, "delete"), _texts(ops, "insert")
    following = F.transform(into, lambda p, i: F.struct(p["w"].alias("be"), F.get(into, i + 1)["w"].alias("w"), p["run"].alias("run"), (F.get(into, i + 1)["run"] == p["run"]).alias("near")))
    verb = lambda p: F.exists(out, lambda q: (q["run"] == p["run"]) & ~among(q["w"], lex.BE_FORMS) & rel.related(q["w"], p["w"]))
    return F.exists(following, lambda p: F.coalesce(p["near"], F.lit(False)) & among(p["be"], lex.BE_FORMS) & p["w"].rlike("(?:ed|en)$") & verb(p))


_CARRIED = [f"{k}:{w}" for k, v in lex.CARRIERS.items() for w in v.split()]
_EPISTEMIC = [w for k in lex.EPISTEMIC for w in lex.CERTAINTY[k]]
_CONNECTIVES = [w for g in lex.CONNECTIVES for w in g]


def lost_words(ops: Column, source: Column, candidate: Column) -> Column:
    """Deleted content words that nothing kept or put in their place accounts for."""
    texts = F.struct(F.filter(words(source), is_content).alias("before"), F.filter(words(candidate), is_content).alias("after"), F.filter(_texts(ops, "delete"), lambda p: is_content(p["w"])).alias("out"), _texts(ops, "insert").alias("into"))
    line = plain_words(F.lower(source))
    pairs = F.zip_with(line, F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    padding = F.when(matches(source, lex.FILLERS), plain_words(F.lower(F.array_join(F.regexp_extract_all(source, F.lit("(?i)" + java(lex.FILLERS)), F.lit(0)), " ")))).otherwise(F.array().cast("array<string>"))
    hedged = F.arrays_overlap(hedge_words(candidate), listed(_EPISTEMIC))
    failing = lambda ws: F.size(_only(ws, lex.FAILURES))
    same = F.struct(pairs.alias("pairs"), padding.alias("padding"), hedged.alias("hedged"))

    def told(v: Column, u: Column) -> Column:
        before, after, out, into = (v[n] for n in ("before", "after", "out", "into"))
        again = F.exists(after, lambda w: w.rlike(lex.REPETITION))
        fails = failing(after) < failing(before)
        pairs, padding, hedged = (u[n] for n in ("pairs", "padding", "hedged"))

        def lost(p: Column) -> Column:
            mine = lambda ps: F.filter(ps, lambda q: q["run"] == p["run"])
            noun = lambda q: q["w"].rlike(lex.NOMINAL_TAIL) | F.arrays_overlap(pairs, F.transform(listed(["of", "into", "regarding", "concerning"]), lambda o: F.concat_ws(" ", q["w"], o)))
            unpacked = F.exists(mine(into), lambda i: is_content(i["w"]) & F.exists(mine(out), lambda q: rel.related(q["w"], i["w"]) & noun(q)))
            stands = F.exists(after, lambda w: rel.related(w, p["w"]))
            as_many = F.size(F.filter(after, lambda w: rel.related(w, p["w"]))) >= F.size(F.filter(before, lambda w: rel.related(w, p["w"])))
            free = (
                among(p["w"], [*lex.INTENSIFIERS, *lex.STOCK_NOUNS])
                | F.array_contains(padding, p["w"])
                | (among(p["w"], [*lex.LIGHT_VERBS, *lex.LIGHT_PARTICLES]) & unpacked)
                | (hedged & among(p["w"], _EPISTEMIC))
                | F.when(p["w"].isin("back", "again"), again).otherwise(
                    among(p["w"], lex.REDUNDANT)
                    | F.exists(mine(into), lambda i: among(F.concat_ws(":", i["w"], p["w"]), _CARRIED))
                    | (stands & (among(p["w"], _CONNECTIVES) | as_many | F.exists(mine(into), lambda i: among(i["w"], lex.PRO_FORMS))))
                )
            )
            inverts = fails & F.exists(mine(out), lambda q: among(q["w"], lex.FAILURES))
            return inverts | ~free

        return _words_of(F.filter(out, lost))

    empty = F.array().cast("array<string>")
    return bound(texts, lambda v: F.when(F.size(v["out"]) > 0, bound(same, lambda u: told(v, u))).otherwise(empty))


def conjunct_dropped(source: Column, candidate: Column, lost: Column) -> Column:
    """A lost word was half of a coordination that is gone."""
    joints = lambda text: F.size(_only(plain_words(F.lower(text)), ["and", "or"]))
    near = lambda w: F.rlike(F.lower(source), F.concat(F.lit("\\b(?:and|or)\\s+(?:\\S+\\s+){0,2}\\Q"), w, F.lit("\\E\\b|\\b\\Q"), w, F.lit("\\E\\s+(?:\\S+\\s+){0,2}(?:and|or)\\b")))
    return (F.size(lost) > 0) & ~matches(source, lex.FIXED_PAIRS) & (joints(candidate) < joints(source)) & F.exists(lost, near)


def repeat_dropped(source: Column, candidate: Column, lost: Column) -> Column:
    """A lost word that the source has several times and the candidate fewer."""
    times = lambda text, w: F.size(F.filter(words(text), lambda x: x == w))
    return F.exists(lost, lambda w: (times(source, w) > 1) & (times(candidate, w) < times(source, w)))


def deadline_narrowed(source: Column, candidate: Column, lost: Column) -> Column:
    """A lost word stood between a deadline's preposition and its time, and the time stays."""

    def phrases(text: Column) -> Column:
        pattern = java(rf"\b(?:{'|'.join(lex.DEADLINE_PREPOSITIONS)})\s+((?:[^\s.]+\s+){{0,4}}?{_TIME})")
        return F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)), lambda p: F.split(p, "\\s+"))

    last = lambda p: F.element_at(p, -1)
    shorter = lambda p: F.exists(phrases(candidate), lambda q: (last(q) == last(p)) & (F.size(q) < F.size(p)))
    return F.exists(lost, lambda w: F.exists(phrases(source), lambda p: F.array_contains(p, w) & shorter(p)))


def tail_deleted(ops: Column) -> Column:
    """The sentence's end is deleted, and a content word with it."""
    letter = lambda o: F.when(o["type"] == "insert", "i").when(o["type"] == "equal", F.when(o["target"].rlike("[\\p{L}\\p{N}]"), "w").otherwise("p")).when(is_content(F.lower(o["source"])), "D").otherwise("d")
    return F.array_join(F.transform(ops, letter), "").rlike("D[dD]*[ip]*$")


# ---- the cascade


def validated(pairs: DataFrame, source: str = "source", candidate: str = "candidate", max_edit_ratio: float = 0.58, terms: str | None = None, action: str | None = None, stated: str | None = None) -> DataFrame:
    """Adds ``ops``, ``lost``, ``ratio``, ``reason`` (null if accepted) and ``accepted``.

    ``terms`` names a column of terms that must stay, ``action`` one that must hold "rewrite", and
    ``stated`` one with the reply's own reason.  Null texts count as empty.  Pairs that a guard
    without alignment refuses have no ``ops``, ``lost`` and ``ratio``.
    """
    s, c = trimmed(F.coalesce(F.col(source), F.lit(""))), trimmed(F.coalesce(F.col(candidate), F.lit("")))
    df = pairs.withColumn("__whole", s).withColumn("__c", c)
    rest = trimmed(replaced(F.col("__whole"), lex.ATTENTION, ""))
    framed = matches(F.col("__whole"), lex.ATTENTION) & (rest != "")
    c, nothing = F.col("__c"), F.lit(None).cast("string")
    plain: list[tuple[str | None, Column]] = [
        ("action-mismatch", F.coalesce(F.col(action), F.lit("")) != "rewrite") if action else ("action-mismatch", F.lit(False)),
        ("empty", c == ""),
        ("unchanged", c == F.col("__whole")),
    ]
    # each look is for the rows that those before have left open: most pairs are told by the first two
    df = df.withColumn("__told", _first(plain, nothing))
    df = df.withColumn("__framed", F.when(F.col("__told").isNull(), framed))
    df = df.withColumn("__s", F.when(F.col("__framed"), capitalised(rest)).otherwise(F.col("__whole")))
    two = c.rlike("[.!?…][\"'’”)\\]}*~`_]*[^\\p{L}\\p{N}]+[\\p{L}\\p{N}\"“‘(*_]") | c.contains("\n")
    # rows wait beside Python: what the guards need of the words is made behind this step and left before the next
    df = df.withColumn("__several", segment.several_sentences(F.when(F.col("__told").isNull() & two, c)))
    narrow = df.columns
    content = lambda text: F.filter(words(text), is_content)
    formal: list[tuple[str | None, Column]] = [
        ("instruction-output", matches(c, lex.INSTRUCTION_OUTPUT[4:]) | refusal_prose(c, content(F.col("__s")), content(c))),
        ("reason-contradicts-action", F.coalesce(matches(F.col(stated), lex.KEEP_REASON), F.lit(False)) if stated else F.lit(False)),
        ("multiple-sentences", F.coalesce(F.col("__several"), F.lit(False))),
    ]
    df = df.withColumn("__formal", F.when(F.col("__told").isNull(), _first(formal, nothing)).otherwise(F.col("__told")))
    for side in "sc":
        text = F.when(F.col("__formal").isNull(), F.col(f"__{side}"))
        low = F.lower(text)
        df = df.withColumn(f"__{side}low", low).withColumn(f"__{side}words", words(text)).withColumn(f"__{side}plain", plain_words(F.col(f"__{side}low")))
        df = df.withColumn(f"__{side}content", F.filter(F.col(f"__{side}words"), is_content))
    s, c, low, clow, left, right, a, b, mine, theirs = (F.col("__" + n) for n in ("s", "c", "slow", "clow", "swords", "cwords", "splain", "cplain", "scontent", "ccontent"))
    net = F.size(mine) - F.size(theirs)
    blanks = lambda text: F.lower(replaced(trimmed(text), r"\s+", " "))
    early: list[tuple[str | None, Column]] = [
        (None, F.col("__framed") & (blanks(s) == blanks(c))),
        ("numbers-changed", numbers(s) != numbers(c)),
        ("protected-token-changed", protected(s) != protected(c)),
        *([("protected-token-changed", terms_changed(s, c, F.col(terms)))] if terms else []),
        ("markup-changed", markup(s) != markup(c)),
        (None, confusable_swap(left, right)),
        ("name-changed", names_changed(s, c)),
        ("certainty-changed", certainty_changed(hedge_words(s), hedge_words(c))),
        ("quantifier-changed", quantifiers_changed(quantifier_sets(s), quantifier_sets(c)) | (bounds(low) != bounds(clow)) | (F.array_sort(_only(a, lex.ORDINALS)) != F.array_sort(_only(b, lex.ORDINALS)))),
        ("negation-changed", negations(s) != negations(c)),
        ("content-dropped", (net > 3) | ((net >= 3) & (2 * net >= F.size(mine))) | connective_lost(a, b)),
        ("direction-changed", direction_changed(low, clow, a, b) | deadline_moved(low, clow, a, b)),
        ("tense-changed", tense_changed(s, tense(s), tense(c))),
        ("question-changed", F.contains(terminal(s), F.lit("?")) != F.contains(terminal(c), F.lit("?"))),
        ("terminal-punctuation-changed", (terminal(s) != "") & (terminal(s) != terminal(c))),
        ("order-changed", _permuted(left, right) | subordinator_moved(low, clow, a, b) | adjunct_compounded(left, right) | roles_flipped(s, c, mine, theirs)),
    ]
    df = df.withColumn("__early", F.when(F.col("__formal").isNull(), _first(early, F.lit("open"))).otherwise(F.col("__formal"))).select(*narrow, "__early")
    open_ = F.col("__early") == "open"
    df = df.withColumn("ops", edit_ops(F.when(open_ | F.col("__early").isNull(), s), F.when(open_ | F.col("__early").isNull(), c)))
    df = df.withColumn("ratio", F.when(F.col("ops").isNotNull(), edit_ratio(F.col("ops"))))
    ops = F.col("ops")
    prose = F.aggregate(protected(s), s, lambda text, token: F.replace(text, token, F.lit(" ")))
    late: list[tuple[str | None, Column]] = [
        ("order-changed", nouns_swapped(ops)),
        ("trivial-edit", trivial(ops)),
        ("excessive-edit", F.col("ratio") > max_edit_ratio),
        ("word-substituted", unsourced_word(ops, prose)),
        ("word-substituted", number_of_noun(ops)),
        ("word-substituted", derived_word(ops, s, c)),
        ("word-substituted", topic_objectified(ops)),
        ("word-substituted", confusable_derived(ops, F.filter(words(c), is_content))),
        ("order-changed", passive_introduced(ops)),
        ("pronoun-changed", pronouns_changed(s, c)),
        ("negation-changed", F.size(_only(plain_words(F.lower(s)), lex.FAILURES)) != F.size(_only(plain_words(F.lower(c)), lex.FAILURES))),
    ]
    df = df.withColumn("reason", F.when(open_, _first(late, F.lit(None).cast("string"))).otherwise(F.col("__early")))
    df = df.withColumn("accepted", F.col("reason").isNull())
    df = df.withColumn("lost", F.when(F.col("accepted"), lost_words(ops, s, c)))
    return df.drop(*(n for n in df.columns if n.startswith("__") and n not in pairs.columns))


def _first(guards: list[tuple[str | None, Column]], otherwise: Column) -> Column:
    out = F.when(guards[0][1], F.lit(guards[0][0]))
    for name, test in guards[1:]:
        out = out.when(test, F.lit(name).cast("string"))
    return out.otherwise(otherwise)


def deletions(s: Column, c: Column, lost: Column, ops: Column, policy: str = "verify") -> dict[str, Column]:
    """What a verifier could not judge, by name, in the order of the policy: each true where a pair is refused outright for it."""
    some = lambda test: F.when(F.size(lost) > 0, test).otherwise(False)
    return {
        "count-lost": some(F.arrays_overlap(lost, listed(lex.NEVER_VERIFY))),
        "conjunct-lost": some(conjunct_dropped(s, c, lost)),
        "repeat-lost": some(repeat_dropped(s, c, lost)),
        "deadline-lost": some(deadline_narrowed(s, c, lost)),
        "scope-lost": scope_dropped(s, c),
        "many-lost": F.size(lost) > (0 if policy == "refuse" else 1),
        "tail-lost": F.when(F.size(lost) == 1, tail_deleted(ops)).otherwise(False),
    }


def bucketed(verdicts: DataFrame, source: str = "source", candidate: str = "candidate", policy: str = "verify") -> DataFrame:
    """Adds ``bucket``: refused, verifier (one content word lost) or accepted.

    What a verifier could not judge is refused outright: lost counts of times, conjuncts, repeated
    words, narrowed deadlines, scope words, sentence ends, and two or more words; with policy
    "refuse" any lost word.
    """
    s, c, lost = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(candidate), F.lit("")), F.col("lost")
    outright = _any(list(deletions(s, c, lost, F.col("ops"), policy).values()))
    dropped = F.when(F.col("accepted"), outright).otherwise(False)
    df = verdicts.withColumn("__dropped", dropped)
    bucket = F.when(~F.col("accepted") | F.col("__dropped"), "refused").when(F.size(lost) == 1, "verifier").otherwise("accepted")
    return df.withColumn("bucket", bucket).withColumn("reason", F.when(F.col("__dropped"), "information-dropped").otherwise(F.col("reason"))).drop("__dropped")
