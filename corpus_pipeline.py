"""From raw documents to a training mix: five stages, each one operator of ``textgate.llm``.

Each stage takes all that its predecessor kept, and its decisions take effect: documents that
fail the quality rules go, one document of each near-duplicate group stays, documents that hold
a benchmark item go, personal data is masked, and the mix keeps the words it takes: each
document's text becomes its chosen stretches, with the number of words in ``taken``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textgate.llm import decontamination, minhash, mixing, pii, quality_rules
from textgate.llm._store import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_words(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmarks),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage_{name}")
    return docs


#: SimHash, MinHash and the seeded choice of blocks have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
