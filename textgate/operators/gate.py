"""Screening of sentences by families of surface patterns.

Texts are scanned by Arrow's automata, batch by batch: a scan costs the same for every character, however many patterns it looks for.
A bounded gap (``[^.?!]{0,160}``) multiplies the states of an automaton, so that a scan without the bounds goes first, and the
patterns as they stand are looked for only in what it has found.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textgate.functions.lexicons import GATE
from textgate.functions.patterns import any_of, listed, matches, re2

FAMILIES = [family for family, _ in GATE]
_PATTERNS = {family: [p for _, p in patterns] for family, patterns in GATE}
_EVERY = any_of([p for patterns in _PATTERNS.values() for p in patterns])
_BOUND = re.compile(r"\{(\d+),\d\d+\}")


def any_hit(text: Column) -> Column:
    """Whether some pattern matches, as an expression without Python; slower than the scans."""
    return matches(F.lower(text), _EVERY, False)


@cache
def _dialect(pattern: str) -> tuple[str, str]:
    exact = re2(pattern)
    return _BOUND.sub(r"{\1,}", exact), exact


def _scanned(low: pa.Array, pattern: str) -> np.ndarray:
    """Whether the pattern matches each text; false for null."""
    loose, exact = _dialect(pattern)
    hit = pc.fill_null(pc.match_substring_regex(low, loose), False).to_numpy(zero_copy_only=False)
    if loose != exact and hit.any():
        hit = hit.copy()
        at = np.flatnonzero(hit)
        hit[at] = pc.match_substring_regex(low.take(pa.array(at)), exact).to_numpy(zero_copy_only=False)
    return hit


def _search(low: pa.Array, rows: np.ndarray, groups: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the rows that some group matches, with the number of the first that does; rows leave when theirs is found."""
    found, numbers = [rows[:0]], [rows[:0]]
    for k, pattern in enumerate(groups):
        if not len(rows):
            break
        hit = _scanned(low.take(pa.array(rows)), pattern)
        found.append(rows[hit])
        numbers.append(np.full(int(hit.sum()), k))
        rows = rows[~hit]
    return np.concatenate(found), np.concatenate(numbers)


def _first(low: pa.Array) -> pa.Array:
    """The number, in table order, of the first pattern that matches, or null."""
    out = np.full(len(low), -1, np.int32)
    some = np.flatnonzero(_scanned(low, _EVERY))
    rows, families = _search(low, some, [any_of(patterns) for patterns in _PATTERNS.values()])
    before = 0
    for k, patterns in enumerate(_PATTERNS.values()):
        # the patterns of a family are told apart only where that family is the first
        mine, numbers = _search(low, rows[families == k], patterns)
        out[mine] = before + numbers
        before += len(patterns)
    return pa.array(out, mask=out < 0)


_first_number = F.arrow_udf(_first, T.IntegerType())
#: The same for use in a step of its own, which Spark neither repeats nor moves into a filter below.
_first_number_once = F.arrow_udf(_first, T.IntegerType()).asNondeterministic()


def _told(number: Column, by: str) -> Column:
    """The family, or the name, of the pattern of this number."""
    return F.get(listed([family if by == "family" else name for family, patterns in GATE for name, _ in patterns]), number)


def first_hit(text: Column) -> Column:
    """``family`` and ``name`` of the first pattern in table order that matches, or null."""
    number = _first_number(F.lower(text))
    return F.when(number.isNotNull(), F.struct(_told(number, "family").alias("family"), _told(number, "name").alias("name")))


def first_family(text: Column) -> Column:
    """The family of the first hit alone."""
    return _told(_first_number(F.lower(text)), "family")


def family_hits(text: Column, families: list[str] = FAMILIES) -> dict[str, Column]:
    """Whether each of the families matches, null for null: one bit a family, all made in one step."""
    patterns = [any_of(_PATTERNS[family]) for family in families]

    def bits(low: pa.Array) -> pa.Array:
        out = np.zeros(len(low), np.int64)
        for k, pattern in enumerate(patterns):
            out |= _scanned(low, pattern).astype(np.int64) << k
        return pa.array(out, mask=low.is_null().to_numpy(zero_copy_only=False))

    found = F.arrow_udf(bits, T.LongType())(F.lower(text))
    return {family: found.bitwiseAND(F.lit(1 << k)) != 0 for k, family in enumerate(families)}


def screened(rows: DataFrame, text: str, by: str = "family") -> DataFrame:
    """The rows in whose text some pattern matches, with the ``family`` or ``name`` of the first hit."""
    found = rows.withColumn("__first", _first_number_once(F.lower(F.col(text)))).where(F.col("__first").isNotNull())
    return found.withColumn(by, _told(F.col("__first"), by)).drop("__first")
