"""Readers for the tables, corpora and reports, and writers for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "schemaVersion int, name string, rows array<struct<id:string,partition:string,kind:string,issueClass:string,source:string,expectedAction:string,preserve:array<string>,notes:string>>"
REPORT_ROW = "id string, issueClass string, source string, expectedAction string, action string, replacement string, reason string, surfaced boolean, rejection string, modelRejection string, rejectedText string, milliseconds long"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that lies in fewer files than there are cores, dealt to all cores; larger tables as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON corpora, one envelope a file."""
    files = spark.read.option("multiLine", True).schema(CORPUS).json(path)
    return files.select(F.col("name").alias("corpus"), F.explode("rows").alias("r")).select("corpus", "r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines; broken lines are left out."""
    return spark.read.option("mode", "DROPMALFORMED").schema(schema).json(path)


def files_with_digest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, length and SHA-256 of each file below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
