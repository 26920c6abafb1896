"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's histograms of character classes and of common words are compared with fixed
references of four languages; the Jensen-Shannon distance to the nearest language decides.
The limit for words falls with the length as sampling noise does.  Two plain rules come
first: very short texts and texts whose words mostly stand in repeated eight-word windows
fail whatever their histograms.  It is one pass without a shuffle.

Defined cases: a null text counts as empty and fails as too short; rows are judged one by
one, so repeated rows and ties get equal verdicts; an empty table gives an empty result.
Other columns are neither read nor changed, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common words by language, with their usual share of a text's words in thousandths.
COMMON_WORDS: dict[str, dict[str, int]] = {
    "de": {"der": 34, "die": 32, "und": 27, "in": 18, "den": 14, "von": 11, "zu": 11, "das": 10, "mit": 9, "sich": 8, "des": 8, "auf": 7},
    "en": {"the": 60, "of": 32, "and": 28, "to": 25, "in": 21, "a": 21, "is": 11, "that": 11, "for": 9, "it": 9, "was": 8, "with": 7},
    "es": {"de": 56, "la": 36, "que": 29, "el": 29, "en": 26, "y": 25, "a": 20, "los": 17, "se": 13, "del": 12, "las": 11, "un": 10},
    "fr": {"de": 53, "la": 30, "le": 24, "et": 22, "les": 20, "des": 18, "en": 15, "un": 12, "du": 12, "que": 11, "une": 11, "est": 10},
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
SPACE = "[\\x20\\x09-\\x0D]+"
# Character classes, each counted in what the ones before leave, and their usual share of a
# text's characters in thousandths; letters in lower case and all else are the rest.
CLASSES = {"symbol": "[#*$%&|<>@^~=+/\\\\{}\\[\\]_]+", "upper": "\\p{Lu}+", "mark": "[.,;:'()\\-!?0-9]+"}
USUAL_CLASSES = {"symbol": 3, "upper": 32, "mark": 45}
REFERENCES = {
    lang: {
        "classes": [*(n / 1000 for n in USUAL_CLASSES.values()), 1 - sum(USUAL_CLASSES.values()) / 1000],
        "common": [*(words.get(w, 0) / 1000 for w in VOCABULARY), 1 - sum(words.values()) / 1000],
    }
    for lang, words in COMMON_WORDS.items()
}


@dataclass(frozen=True)
class Rules:
    """Limits; a distance is the square root of a divergence in bits, between 0 and 1."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_class_distance: float = 0.2
    # clean prose of n words has a word distance of sqrt(usual_word_distance ** 2 + word_noise / n) at the median
    usual_word_distance: float = 0.08
    word_noise: float = 2.6
    max_word_excess: float = 0.13


def histograms(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns as ``keep_i``, then ``body``, ``words``, ``word_chars``, ``n_symbols``, ``classes`` and ``common`` counts."""
    kept = [f"keep_{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.coalesce(F.col(text), F.lit("")).alias("body"))
    df = df.withColumn("words", F.array_remove(F.split("body", SPACE), ""))
    df = df.withColumn("rest_", F.array_join("words", "")).withColumn("left_", F.length("rest_"))
    df = df.withColumn("word_chars", F.col("left_").cast("long"))
    df = df.withColumn("n_symbols", (F.col("left_") - F.length(F.regexp_replace("rest_", "[#*$%&|<>]+", ""))).cast("long"))
    rest, left, counts = "rest_", "left_", []
    for name, pattern in CLASSES.items():
        df = df.withColumn(f"rest_{name}", F.regexp_replace(rest, pattern, "")).withColumn(f"left_{name}", F.length(f"rest_{name}"))
        df = df.withColumn(f"n_{name}", F.col(left) - F.col(f"left_{name}"))
        rest, left = f"rest_{name}", f"left_{name}"
        counts.append(f"n_{name}")
    df = df.withColumn("found", F.filter("words", lambda w: w.isin([*VOCABULARY, *(w.capitalize() for w in VOCABULARY)])))
    each = F.transform(F.array(*[F.lit(w) for w in VOCABULARY]), lambda w: (F.size("found") - F.size(F.array_remove(F.array_remove("found", w), F.initcap(w)))).cast("double"))
    return df.select(
        *kept,
        "body",
        "words",
        "word_chars",
        "n_symbols",
        F.array(*[F.col(c).cast("double") for c in counts], F.col(left).cast("double")).alias("classes"),
        F.concat(each, F.array((F.size("words") - F.size("found")).cast("double"))).alias("common"),
    )


def js_distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance in bits between two histograms."""

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def both(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return term(p, m) + term(q, m)

    parts = F.zip_with(shares, F.array(*[F.lit(q) for q in reference]), both)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in 8-word windows that occur twice or more in ``words``.

    Hashes of 1, 2, 4 and 8 words are each made from the ones before.  Where a hash occurs
    twice, sorting (hash, place) pairs brings equal windows together: n log n at worst.
    """

    def joined(column: str, step: int) -> Column:
        n = F.greatest(F.size(column) - step, F.lit(0))
        return F.zip_with(F.slice(column, F.lit(1), n), F.slice(column, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("h2", joined("h1", 1)).withColumn("h4", joined("h2", 2)).withColumn("h8", joined("h4", 4))
    df = df.withColumn("pairs", F.when(F.size(F.array_distinct("h8")) < F.size("h8"), F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    n = F.greatest(F.size("pairs") - 1, F.lit(0))
    df = df.withColumn("same", F.zip_with(F.slice("pairs", F.lit(1), n), F.slice("pairs", F.lit(2), n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
    df = df.withColumn("places", F.sort_array(F.array_distinct(F.flatten(F.filter("same", lambda x: x.isNotNull())))))
    steps = F.zip_with("places", F.slice("places", F.lit(2), F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(8)), F.lit(8)))
    return df.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("long"))


def measures(docs: DataFrame, rules: Rules = Rules(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns (as given) followed by all counts, distances and verdicts."""
    df = with_repeats(histograms(docs, text, keep)).withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn("lines", F.filter(F.split("body", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    for column, name in (("classes", "class_distance"), ("common", "word_distance")):
        total = F.greatest(F.aggregate(F.col(column), F.lit(0.0), lambda a, b: a + b), F.lit(1.0))
        df = df.withColumn(f"total_{column}", total).withColumn(column, F.transform(column, lambda x: x / F.col(f"total_{column}")))
        own = {tuple(r[column]) for r in REFERENCES.values()}
        df = df.withColumn(name, F.array_min(F.array(*[js_distance(F.col(column), list(r)) for r in sorted(own)])))
    df = df.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
    usual = F.sqrt(F.lit(rules.usual_word_distance**2) + F.lit(rules.word_noise) / F.greatest(F.col("n_words"), F.lit(1)))
    odd = (F.col("class_distance") > rules.max_class_distance) | (F.col("word_distance") > usual + rules.max_word_excess)
    df = df.withColumn("kept", ~F.col("base_failed") & ~odd)
    # a filter on a measure would be moved down to the texts and compute all it rests on there again, once for
    # each use; one on what is exploded stays above
    whole = F.struct(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], *RESULT)
    return df.select(F.explode_outer(F.array(whole)).alias("one")).select("one.*")


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its id, the base counts, both distances and the verdict."""
    return measures(docs, rules, text, (doc_id,))


def keep_good(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The documents, columns unchanged, that ``quality_rules`` keeps."""
    whole = docs.select(F.struct("*").alias("row"))
    judged = measures(whole.select("row", F.col(f"row.{text}").alias("text")), rules, "text", ("row",))
    return judged.where("kept").select("row.*")
