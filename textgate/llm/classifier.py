"""Quality scores by histogram gradient-boosted trees over document statistics.

Training reads at most ``max_rows`` labelled rows, those with the smallest hash of their id,
so the sample does not depend on the layout of the data and its size is bounded; only their
statistics reach the driver.  Scoring is one pass over all texts without a shuffle.

Defined cases: a null text counts as empty and is scored like one; rows without a label, a
null label or a null id train nothing; repeated labels train once for each label row; with no
labels, or only one kind, every score is the smoothed prior; an empty table gives an empty
result.  Ids, sources, languages and labels are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgate.llm import _words, features
from textgate.llm.boosting import Boosting, Forest, train

MAX_TRAINING_ROWS = 40_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, cfg: Boosting = Boosting(), max_rows: int = MAX_TRAINING_ROWS, text: str = "text", doc_id: str = "doc_id") -> Forest:
    """``labels`` has ``doc_id`` and ``label`` (0 or 1)."""
    some = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", "label")
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    # at most max_rows pairs of numbers: a fixed bound, so a broadcast
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _words.slices(batch):
                x = features.statistics(part.column("text"))
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), rows], names=["doc_id", "label", "x"])

    # an id may stand in several rows, so the bound is set once more on what reaches the driver
    measured = texts.mapInArrow(run, "doc_id long, label int, x array<double>")
    table = measured.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(max_rows).toArrow()
    x = np.array(table.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(features.NAMES))
    y = table.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y, table.column("doc_id").to_numpy()))
    return train(x[order], y[order], cfg)


def score(docs: DataFrame, model: Forest, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            for part in _words.slices(batch):
                p = forest.predict(features.statistics(part.column("text")))
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    df = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
