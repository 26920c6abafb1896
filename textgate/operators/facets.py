"""Filters with counts: how many rows pass, and what each facet offers under the choices made in the others."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen_rows(rows: DataFrame, chosen: Mapping[str, object], needle: str = "", searched: tuple[str, ...] = ()) -> DataFrame:
    """Rows with every chosen value that have the needle, in any case, in one of the searched columns; an empty choice is none."""
    return rows.where(_all([*(_picked(c, v) for c, v in chosen.items() if v not in (None, "")), _found(needle, searched)]))


def faceted(rows: DataFrame, facets: tuple[str, ...], chosen: Mapping[str, object], needle: str = "", searched: tuple[str, ...] = ()) -> DataFrame:
    """``facet``, ``value`` and ``n``: for each facet its values with the rows that pass the search and all other facets' choices.

    The row of facet "" with value "shown" has the rows that pass all, that with "all" every row: "n of m".  Rows are read once: each
    gives one row a facet it counts for, and these are added up before they are shuffled.  A null value is a value; a facet's own choice does
    not narrow it, and a value that no row has is not listed.
    """
    found = _found(needle, searched)
    picked = {c: _picked(c, chosen[c]) if chosen.get(c) not in (None, "") else F.lit(True) for c in facets}
    strange = [c for c in chosen if c not in facets]
    if strange:
        raise ValueError(f"chosen but no facets: {', '.join(strange)}")
    entry = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value"))
    each = [F.when(_all([found, *(p for d, p in picked.items() if d != c)]), entry(c, F.col(c))) for c in facets]
    shown = F.when(_all([found, *picked.values()]), entry("", F.lit("shown")))
    told = F.filter(F.array(*each, shown, entry("", F.lit("all"))), lambda e: e.isNotNull())
    counts = rows.select(F.explode(told).alias("e")).groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))
    # "0 of 0" is told as well
    both = rows.sparkSession.createDataFrame([("", "shown", 0), ("", "all", 0)], "facet string, value string, n long")
    return counts.unionByName(both).groupBy("facet", "value").agg(F.sum("n").alias("n"))


def _picked(column: str, value: object) -> Column:
    return F.col(column).eqNullSafe(F.lit(value))


def _found(needle: str, searched: tuple[str, ...]) -> Column:
    low = needle.strip().lower()
    if not low:
        return F.lit(True)
    return F.coalesce(F.greatest(F.lit(False), *[F.coalesce(F.lower(F.col(c).cast("string")).contains(low), F.lit(False)) for c in searched]), F.lit(False))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out
