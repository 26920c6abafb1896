"""Tables written to the shared folder, so that a lost executor costs no earlier work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, as in tests, a temporary one.

    A cluster has no temporary folder that all its machines see: there the setting is needed.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Store:
    """Tables of one job; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}  # with the table, so that its id is not given out again

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet to the shared folder and reads it back."""
        path = f"{shared_dir(self.spark)}/textgate/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables of this store; every table made from them must have been written before."""
        for df in tables:
            self._remove(self.paths.pop(id(df))[1])

    def clear(self) -> None:
        """Removes all tables of this store that are still there."""
        while self.paths:
            self._remove(self.paths.popitem()[1][1])

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back."""
    return Store(df.sparkSession).put(df, name)
