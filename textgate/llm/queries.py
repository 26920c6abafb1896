"""The ``opN_`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.llm import chat, classifier, decontamination, fuzzy, lm, minhash, mixing, pieces, pii, quality_rules, search, substrings, tokens
from textgate.sources import tables

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from a model of the labelled ones that are not held out."""
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = classifier.fit(docs, labels.where(~classifier.held_out("doc_id")))
    return classifier.score(docs, model)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under a public vocabulary."""
    import public_tokenizers

    return tokens.token_counts(_documents(spark, sf_dir), str(public_tokenizers.path(tokens.TOKENIZER)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the windows that an earlier one has."""
    return substrings.remove_repeats(_documents(spark, sf_dir)).drop("kept_text")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.personal_data(_documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contaminated(_documents(spark, sf_dir), benchmark).drop("hamming")


def op6_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations."""
    return chat.preferences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents."""
    return lm.scores(_documents(spark, sf_dir))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    return mixing.mixed(_documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality_rules.quality_rules(_documents(spark, sf_dir))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search.ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components they make."""
    return fuzzy.similar(_documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle forms of all documents."""
    return pieces.fill_in_middle(_documents(spark, sf_dir)).drop("output")


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_personal_data": op4_personal_data,
    "op5_decontamination": op5_decontamination,
    "op6_chat_preferences": op6_chat_preferences,
    "op7_lm_scores": op7_lm_scores,
    "op8_mix_sources": op8_mix_sources,
    "op9_quality_rules": op9_quality_rules,
    "op10_minhash": op10_minhash,
    "op11_ranked_search": op11_ranked_search,
    "op12_simhash": op12_simhash,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": substrings.ORACLE,
    "op5_decontamination": decontamination.ORACLE,
    "op6_chat_preferences": chat.ORACLE,
    "op10_minhash": minhash.ORACLE,
    "op11_ranked_search": search.ORACLE,
    "op13_fill_in_middle": pieces.ORACLE,
}
