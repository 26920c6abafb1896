"""When one word is a form of another, as column expressions over lower-case words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textgate.functions import lexicons as lex
from textgate.functions.patterns import among, mapped


def lacking(words: Column, other: Column) -> Column:
    """How many of the words, repeats counted, the other list does not have.

    The distinct ones are found by hash; where they are many, both lists are sorted and read once, so that no word is looked for in a long list.
    """

    def sorted_count(missing: Column) -> Column:
        told = lambda ws, side: F.transform(ws, lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))
        state = lambda last, n: F.struct(last.alias("last"), n.alias("n"))
        step = lambda acc, x: F.when(x["side"] == 0, state(x["w"], acc["n"])).otherwise(state(acc["last"], acc["n"] + F.coalesce(x["w"] == acc["last"], F.lit(False)).cast("int")))
        return F.aggregate(F.array_sort(F.concat(told(missing, 0), told(words, 1))), state(F.lit(None).cast("string"), F.lit(0)), step, lambda acc: acc["n"])

    few = lambda missing: F.size(F.filter(words, lambda w: F.array_contains(missing, w)))
    chosen = lambda missing: F.when(F.size(missing) == 0, 0).when(F.size(missing) <= 8, few(missing)).otherwise(sorted_count(missing))
    return F.get(F.transform(F.array(F.array_except(words, other)), chosen), F.lit(0))


#: Confusable pairs in both orders.
PAIRS = [*lex.CONFUSABLES, *(":".join(reversed(p.split(":"))) for p in lex.CONFUSABLES)]
_LEMMA = {form: row.split()[0] for row in lex.LEMMAS for form in row.split()}
_TAILS = "|".join(lex.INFLECTIONS)


def stem(word: Column) -> Column:
    """The word without up to two endings; three letters always stay."""
    for _ in range(2):
        word = F.regexp_replace(word, f"^(.{{3,}}?)(?:{'|'.join(lex.SUFFIXES)})$", "$1")
    return word


def inflection_of(shorter: Column, longer: Column) -> Column:
    """Whether ``longer``, which begins with ``shorter``, is an inflected form of it."""
    tail, n = F.substring(longer, F.length(shorter) + 1, F.length(longer)), F.length(shorter)
    listed = (n >= 3) & tail.rlike(f"^(?:{_TAILS})$") & ~((tail == "d") & ~shorter.endswith("e")) & ~((tail == "ness") & (n < 4))
    doubled = (n >= 3) & (F.substring(tail, 1, 1) == F.substring(shorter, -1, 1)) & tail.rlike(f"^.(?:{_TAILS})$")
    return ((n >= 2) & tail.isin("s", "es")) | listed | doubled


def same_stem(a: Column, b: Column) -> Column:
    """Equal stems, or stems that differ in their last two letters at most."""
    x, y = stem(a), stem(b)
    most = F.greatest(F.length(x), F.length(y))
    need = F.greatest(most - 2, F.lit(4))
    long_enough = F.least(F.length(x), F.length(y)) >= need
    return (x == y) | (long_enough & (F.substring(x, F.lit(1), need) == F.substring(y, F.lit(1), need)))


def related(left: Column, right: Column) -> Column:
    """Equal, confusable, of one lemma, inflected one from the other, or of one stem."""
    a, b = F.translate(left, "'’", ""), F.translate(right, "'’", "")
    lemma = mapped(_LEMMA)
    kin = F.coalesce(F.element_at(lemma, a) == F.element_at(lemma, b), F.lit(False))
    short, long = (F.when((F.length(a) <= F.length(b)) == first, a).otherwise(b) for first in (True, False))
    return (a == b) | among(F.concat_ws(":", a, b), PAIRS) | (F.startswith(long, short) & inflection_of(short, long)) | same_stem(a, b) | kin
