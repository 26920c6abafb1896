"""Versioned tables with an append-only history: data first, then a mark that alone makes a version count.

A version's rows lie in a folder of their own; its mark is one small file, made only where none of
that number is, whose last line is a digest of the rest.  A reader trusts the highest whole mark: a writer that
dies before the mark, or within it, leaves the version before in force, and the folder it left is nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "version long, folder string, note string, rows long, at timestamp, digest string"


class Conflict(RuntimeError):
    """Another writer made the version first."""


def _file_system(spark: SparkSession, path: str) -> Any:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def history(spark: SparkSession, root: str) -> DataFrame:
    """All versions that count, one row each: ``version``, ``folder``, ``note``, ``rows`` and ``at``."""
    files, where = _file_system(spark, f"{root}/marks")
    if not files.exists(where) or not files.listStatus(where):
        return spark.createDataFrame([], ENTRY).drop("digest")
    lines = spark.read.text(f"{root}/marks", wholetext=True)
    body, digest = (F.get(F.split("value", "\n"), F.lit(k)) for k in (0, 1))
    whole = lines.where(F.sha2(body, 256).eqNullSafe(digest)).select(F.from_json(body, ENTRY).alias("e"))
    return whole.select("e.*").drop("digest")


def latest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of the given one."""
    known = history(spark, root)
    found = (known.where(F.col("version") == version) if version is not None else known.orderBy(F.desc("version"))).limit(1).collect()
    if not found:
        raise FileNotFoundError(f"no version {'' if version is None else version} of {root}")
    return spark.read.parquet(f"{root}/{found[0]['folder']}")


def written(df: DataFrame, root: str) -> tuple[int, str, int]:
    """Writes the rows of what would be the next version; without a mark it does not count."""
    spark = df.sparkSession
    version = (history(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    folder = f"version={version}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{root}/{folder}")
    return version, folder, spark.read.parquet(f"{root}/{folder}").count()


def marked(spark: SparkSession, root: str, version: int, folder: str, rows: int, note: str) -> None:
    """Makes a written version count; raises ``Conflict`` if another writer has made that number."""
    at = spark.sql("SELECT CAST(now() AS STRING)").first()[0]
    body = json.dumps({"version": version, "folder": folder, "note": note, "rows": rows, "at": at})
    files, where = _file_system(spark, f"{root}/marks/{version:012d}.json")
    try:
        out = files.create(where, False)
    except Exception as error:
        raise Conflict(f"version {version} of {root} is there") from error
    out.write(f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}\n".encode())
    out.close()


def commit(df: DataFrame, root: str, note: str = "") -> int:
    """Writes a version and makes it count; its number."""
    version, folder, rows = written(df, root)
    marked(df.sparkSession, root, version, folder, rows, note)
    return version


def changes(spark: SparkSession, root: str, old: int, new: int, key: str = "key", value: str = "bucket") -> DataFrame:
    """Keys whose value differs between two versions, with ``was`` and ``now``; null where a version lacks the key."""
    a, b = (latest(spark, root, v).select(key, F.col(value).alias(name)) for v, name in ((old, "was"), (new, "now")))
    return a.join(b, key, "full").where(~F.col("was").eqNullSafe(F.col("now")))
