"""Stable sentence ids across revisions of a document, in batch and as a stream."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Row = tuple[int, str, int]
#: Documents whose rows are handed on at once.
_AT_ONCE = 64


def matched(before: list[Row], after: list[Row]) -> list[tuple[int, int | None, str]]:
    """For each (index, text, start) of ``after``: its index, the index it had, and kept, moved, changed or new.

    Equal texts go to the nearest unused start; what is left takes the id at its own index if
    that is free.  Where a text stood several times and a copy went away, survivors get new ids.
    """
    by_text: dict[str, list[tuple[int, int]]] = {}
    for k, text, start in before:
        by_text.setdefault(text, []).append((start, k))
    copies = {text: len(rows) for text, rows in by_text.items()}
    free = {text: sorted(rows) for text, rows in by_text.items()}
    used: set[int] = set()
    found: dict[int, int] = {}
    for k, text, start in after:
        able = free.get(text)
        if able:
            at = bisect.bisect_left(able, (start, -1))
            # the nearest start is one of the two neighbours; the earlier one on ties
            best = min((c for c in (at - 1, at) if 0 <= c < len(able)), key=lambda c: (abs(able[c][0] - start), c))
            found[k] = able.pop(best)[1]
            used.add(found[k])
    known, changed = {r[0] for r in before}, set()
    for k, _, _ in after:
        if k not in found and k in known and k not in used:
            used.add(k)
            found[k] = k
            changed.add(k)
    gone = {t for t, rows in by_text.items() if copies[t] > 1 and any(k not in used for _, k in rows)}
    out: list[tuple[int, int | None, str]] = []
    for k, text, _ in after:
        old = found.get(k)
        if old is None or (k not in changed and text in gone):
            out.append((k, None, "new"))
        else:
            out.append((k, old, "changed" if k in changed else "kept" if old == k else "moved"))
    return out


def reconciled(before: DataFrame, after: DataFrame) -> DataFrame:
    """``doc_id``, ``sent_idx``, ``was`` and ``state`` of each sentence of ``after``; both sides hold one revision a document."""

    columns = ["doc_id", "sent_idx", "sentence", "start"]
    return matched_sides(before.select(*columns, F.lit(0).alias("side")).unionByName(after.select(*columns, F.lit(1).alias("side"))))


def matched_sides(both: DataFrame) -> DataFrame:
    """The same from rows of both revisions with their ``side``, 0 before and 1 after; texts travel as digests."""
    row = F.struct("sent_idx", F.md5("sentence").alias("sentence"), "start", "side")
    docs = both.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _AT_ONCE):
                part, told = batch.slice(first, _AT_ONCE), []
                for i, rows in enumerate(part.column("rows").to_pylist()):
                    sides = ([(r["sent_idx"], r["sentence"], r["start"]) for r in rows if r["side"] == k] for k in (0, 1))
                    told += [(i, *one) for one in matched(*sides)]
                where, index, was, state = zip(*told, strict=True) if told else [()] * 4
                yield pa.record_batch([part.column("doc_id").take(pa.array(where, pa.int64())), pa.array(index, pa.int32()), pa.array(was, pa.int32()), pa.array(state, pa.string())], names=["doc_id", "sent_idx", "was", "state"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sent_idx int, was int, state string")


def tracked(revisions: DataFrame) -> DataFrame:
    """A stream of ``doc_id, rev, sentences array<string>`` as ``doc_id, rev, sent_idx, id, sentence``.

    State per document: the newest revision's sentences with their ids, and the next id.  An
    older revision than the newest is late and is dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rev, fresh, texts, ids = state.get if state.exists else (-1, 0, [], [])
        rows = pd.concat(list(batches)).sort_values("rev")
        for r in rows.itertuples():
            if r.rev <= rev:
                continue
            now = list(r.sentences)

            def placed(values: list[str]) -> list[Row]:
                at, out = 0, []
                for k, v in enumerate(values):
                    out.append((k, v, at))
                    at += len(v)
                return out

            mine = []
            for _, was, _ in matched(placed(list(texts)), placed(now)):
                if was is None:
                    mine.append(fresh)
                    fresh += 1
                else:
                    mine.append(ids[was])
            rev, texts, ids = int(r.rev), now, mine
            yield pd.DataFrame({"doc_id": key[0], "rev": rev, "sent_idx": range(len(now)), "id": mine, "sentence": now})
        state.update((rev, fresh, list(texts), [int(i) for i in ids]))

    out = "doc_id long, rev long, sent_idx int, id long, sentence string"
    kept = "rev long, fresh long, texts array<string>, ids array<long>"
    return revisions.groupBy("doc_id").applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)


def debounced(edits: DataFrame, delay: str = "140 milliseconds") -> DataFrame:
    """The last edit of each sentence once it has rested: a session window that closes after ``delay``."""
    quiet = F.session_window("ts", delay)
    return edits.withWatermark("ts", delay).groupBy("doc_id", "sent_idx", quiet).agg(F.max_by("text", "ts").alias("text"), F.max("ts").alias("ts"))
