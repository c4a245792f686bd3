"""Data sources: line files read by ranges of bytes, and traces that are appended whole or not at all."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

LINES = "path string, line_no long, value string"
#: Bytes of a range, rows of a batch, bytes that one task reads in one or many ranges, and bytes that opening a file counts as.
RANGE_BYTES, BATCH_ROWS, TASK_BYTES, OPEN_BYTES = 32 << 20, 2000, 32 << 20, 64 << 10


def _files(path: str):
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    local = re.sub(r"^file:(//)?(?=/)", "", path)
    return (LocalFileSystem(), local) if local.startswith("/") else FileSystem.from_uri(path)


@dataclass
class FileRange:
    path: str
    start: int
    end: int


@dataclass
class Stretches(InputPartition):
    """Stretches of files that one task reads, range by range."""

    parts: list[FileRange]


class LineReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, size: int):
        self.path, self.suffix, self.size = path, suffix, size

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _files(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
        files = [f for f in found if f.type == FileType.File and f.path.endswith(self.suffix) and not re.match(r"[_.]", f.base_name)]
        long = max(1, TASK_BYTES // self.size) * self.size
        tasks: list[Stretches] = []
        room = 0
        for f in sorted(files, key=lambda f: f.path):
            for a in range(0, f.size, long):
                part = FileRange(f.path, a, min(a + long, f.size))
                cost = part.end - a + OPEN_BYTES
                if not tasks or cost > room:
                    tasks.append(Stretches([]))
                    room = TASK_BYTES + OPEN_BYTES
                tasks[-1].parts.append(part)
                room -= cost
        return tasks or [Stretches([])]

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        """The lines of the ranges that the task's stretches are made of."""
        fs, _ = _files(self.path)
        rows: list[tuple[str, int, str]] = []
        for part in partition.parts:
            with fs.open_input_file(part.path) as f:
                for start in range(part.start, part.end, self.size):
                    for at, line in _lines(f, start, min(start + self.size, part.end)):
                        rows.append((part.path, at, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")))
                        if len(rows) == BATCH_ROWS:
                            yield _batch(rows)
                            rows = []
        if rows:
            yield _batch(rows)


def _lines(f: pa.NativeFile, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in a range, with their places: a range that doesn't begin a file starts after the line it falls into."""
    if at:
        f.seek(at - 1)
        at += len(_line(f)) - 1
    else:
        f.seek(0)
    while at < end and (line := _line(f)):
        yield at, line
        at += len(line)


def _line(f: pa.NativeFile, step: int = 1 << 12) -> bytes:
    """The rest of the line at the file's place, which moves behind it."""
    start, parts = f.tell(), []
    while part := f.read(step):
        end = part.find(b"\n")
        if end >= 0:
            parts.append(part[: end + 1])
            break
        parts.append(part)
    line = b"".join(parts)
    f.seek(start + len(line))
    return line


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "line_no", "value"])


class TranscriptLines(DataSource):
    """Lines of the files under a path: path, line_no (the byte at which a line begins, so in order), value. Options: path, suffix (default .jsonl), bytes (of a range)."""

    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        return LineReader(o["path"], o.get("suffix", ".jsonl"), int(o.get("bytes", RANGE_BYTES)))


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class TraceWriter(DataSourceWriter):
    """Tasks write files aside; the commit moves them under their names and then writes one list of them, in place at once. Readers only look at lists: what isn't listed doesn't exist."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        fs, root = _files(self.path)
        name = f"{self.job}-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}.jsonl"
        fs.create_dir(f"{root}/_aside-{self.job}", recursive=True)
        rows = 0
        with fs.open_output_stream(f"{root}/_aside-{self.job}/{name}") as f:
            for row in iterator:
                f.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode() + b"\n")
                rows += 1
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _files(self.path)
        fs.create_dir(f"{root}/files", recursive=True)
        fs.create_dir(f"{root}/lists", recursive=True)
        names = sorted(m.name for m in messages if m and m.rows)
        for n in names:
            fs.move(f"{root}/_aside-{self.job}/{n}", f"{root}/files/{n}")
        old = [] if not self.overwrite else [f.path for f in fs.get_file_info(_selector(f"{root}/lists"))]
        aside = f"{root}/_aside-{self.job}/list"
        fs.create_dir(f"{root}/_aside-{self.job}", recursive=True)
        with fs.open_output_stream(aside) as f:
            f.write(json.dumps({"files": names, "replaces": [os.path.basename(o) for o in old]}).encode())
        fs.move(aside, f"{root}/lists/{self.job}")
        self._clean(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _files(self.path)
        self._clean(fs, root)

    def _clean(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/_aside-{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{root}/_aside-{self.job}")


def _selector(root: str):
    from pyarrow.fs import FileSelector

    return FileSelector(root, allow_not_found=True)


class Trace(DataSource):
    """A trace: rows as JSON lines, appended (or, with overwrite, replacing all before) in one step. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "trace"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TraceWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TranscriptLines)
    spark.dataSource.register(Trace)


def read_trace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed writes."""
    fs, root = _files(path)
    lists = {os.path.basename(f.path): json.loads(fs.open_input_stream(f.path).read()) for f in fs.get_file_info(_selector(f"{root}/lists"))}
    gone = {n for entry in lists.values() for n in entry["replaces"]}
    files = sorted(f for name, entry in lists.items() if name not in gone for f in entry["files"])
    base = path.rstrip("/")
    return spark.read.schema(schema).json([f"{base}/files/{f}" for f in files]) if files else spark.createDataFrame([], schema)
