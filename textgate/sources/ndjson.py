"""JSON Lines from growing files, in batch and as a stream: format ``ndjson``.

    spark.dataSource.register(ndjson.Lines)
    spark.readStream.format("ndjson").schema("id long, text string, ...").load(folder)

A stream's offset is the byte after the last whole line of each file, so a line that is still being written waits, and a
restart in the middle of one loses and repeats nothing.  Files are cut into ranges of bytes; a range has the lines that begin in
it.  Columns ``_error`` and ``_file``, where the schema asks for them, tell lines that are no JSON object or longer than
``limit`` bytes (64,000; their other columns are null) and where a line is from.  Any file system that pyarrow opens will do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

LIMIT = 64_000
RANGE = 32 << 20
_BLOCK = 1 << 20


@dataclass
class Bytes(InputPartition):
    """Lines of a file that begin at ``start`` or later and before ``end``; all of them are whole by ``until``."""

    file: str
    start: int
    end: int
    until: int


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    fs, root = _opened(path)
    info = fs.get_file_info(root)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else []
    plain = [f for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
    return {f.path: f.size for f in sorted(plain, key=lambda f: f.path)}


def _whole(fs: pafs.FileSystem, file: str, start: int, size: int) -> int:
    """The byte after the last line end between ``start`` and ``size``, read backwards."""
    with fs.open_input_file(file) as f:
        at = size
        while at > start:
            low = max(start, at - _BLOCK)
            f.seek(low)
            cut = f.read(at - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
    return start


def _lines(fs: pafs.FileSystem, part: Bytes, limit: int) -> Iterator[bytes | None]:
    """The lines of a range; None for one beyond the limit, of which no more than a block is held."""
    with fs.open_input_file(part.file) as f:
        f.seek(max(part.start - 1, 0))
        skipping = part.start > 0 and f.read(1) != b"\n"  # a line of the range before ends in this one
        f.seek(part.start)
        at = begun = part.start
        held, long = b"", False
        while at < part.until and (block := f.read(min(_BLOCK, part.until - at))):
            done = 0
            while (cut := block.find(b"\n", done)) >= 0:
                if not skipping:
                    yield None if long or len(held) + cut - done > limit else held + block[done:cut]
                held, long, skipping = b"", False, False
                done = cut + 1
                begun = at + done
                if begun >= part.end:
                    return
            at += len(block)
            if long or len(held) + len(block) - done > limit:
                held, long = b"", True
            elif not skipping:
                held += block[done:]
        if (held or long) and not skipping:
            yield None if long else held


class _Reading:
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.limit, self.range = int(options.get("limit", LIMIT)), int(options.get("rangebytes", options.get("rangeBytes", RANGE)))

    def ranges(self, file: str, start: int, until: int) -> list[Bytes]:
        return [Bytes(file, a, min(a + self.range, until), until) for a in range(start, until, self.range)]

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        arrow = to_arrow_schema(self.schema)
        rows: list[dict[str, Any]] = []
        for line in _lines(fs, partition, self.limit):
            if line is not None and not line.strip():
                continue
            row: dict[str, Any] = {"_file": partition.file}
            try:
                if line is None:
                    raise ValueError(f"longer than {self.limit} bytes")
                body = json.loads(line)
                if not isinstance(body, dict):
                    raise ValueError("no JSON object")
                pa.array([{k: body.get(k) for k in arrow.names if k in body}], pa.struct([arrow.field(k) for k in arrow.names if k in body]))
                row |= {k: body.get(k) for k in arrow.names if k in body}
            except (ValueError, TypeError, pa.ArrowInvalid, pa.ArrowTypeError) as error:
                row["_error"] = str(error) if line is None or str(error) == "no JSON object" else "no JSON of this schema"
            rows.append(row)
            if len(rows) == 2048:
                yield pa.RecordBatch.from_pylist(rows, arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Bytes]:
        return [p for file, size in _files(self.path).items() for p in self.ranges(file, 0, size)]


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict[str, int]:  # noqa: N802
        return {}

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        """Ends of whole lines; looked for from the ends of the last call on."""
        fs, _ = _opened(self.path)
        known = getattr(self, "known", {})
        self.known = {file: _whole(fs, file, known.get(file, 0), size) for file, size in _files(self.path).items()}
        return self.known

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Bytes]:
        return [p for file, until in end.items() for p in self.ranges(file, start.get(file, 0), until)]

    def commit(self, end: dict[str, int]) -> None:
        pass


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ndjson"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> _Batch:
        return _Batch(schema, self.options)

    def streamReader(self, schema: StructType) -> _Stream:  # noqa: N802
        return _Stream(schema, self.options)
