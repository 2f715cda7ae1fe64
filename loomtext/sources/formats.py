"""Rank and merge files by format name: spark.read.format("token_ranks") and spark.read.format("merge_json")."""

from __future__ import annotations

import base64
import binascii
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a file that a task reads, unless the option `split` says otherwise.
SPLIT = 1 << 20


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path)


@dataclass
class Span(InputPartition):
    """The lines of a file that begin from byte `start` until `end`."""

    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class _Reader(DataSourceReader):
    """Plans spans of files and turns a span's bytes into rows; a folder is all its files that aren't hidden."""

    splits = True

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("split", SPLIT))
        if self.size < 1:
            raise ValueError("split must be positive")

    def partitions(self) -> list[Span]:
        files, path = _opened(self.path)
        found = files.get_file_info(path)
        if found.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        whole = [found] if found.is_file else [f for f in files.get_file_info(pyarrow.fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "._"]
        spans = []
        for f in sorted(whole, key=lambda f: f.path):
            size = self.size if self.splits else max(1, f.size)
            spans += [Span(f.path, i, min(i + size, f.size)) for i in range(0, f.size, size)]
        return spans

    def read(self, partition: Span | None) -> Iterator[tuple]:
        if partition is None:  # there was nothing to plan
            return
        files, _ = _opened(self.path)
        with files.open_input_file(partition.file) as file:
            yield from self.rows(partition, io.BufferedReader(file))


class RankReader(_Reader):
    def rows(self, span: Span, file: io.BufferedReader) -> Iterator[tuple]:
        file.seek(max(0, span.start - 1))
        if span.start:
            file.readline()  # the end of the line before, or of the one in which the span begins
        while (at := file.tell()) < span.end and (line := file.readline()):
            if not line.strip():
                continue
            try:
                word, rank = line.split()
                yield int(rank), base64.b64decode(word, validate=True)
            except (ValueError, binascii.Error) as error:
                raise ValueError(f"{span.file}, byte {at}: {line[:80]!r} isn't base64 and a rank") from error


class MergeReader(_Reader):
    """An object can't be cut, so a file is one span; a vocabulary bounds it."""

    splits = False

    def rows(self, span: Span, file: io.BufferedReader) -> Iterator[tuple]:
        try:
            entries = json.loads(file.read(), object_pairs_hook=list)
        except ValueError as error:
            raise ValueError(f"{span.file}: {error}") from error
        if not isinstance(entries, list) or any(not isinstance(e, tuple) for e in entries):
            raise ValueError(f"{span.file} isn't an object")
        for i, (key, new) in enumerate(entries):
            try:
                a, b = map(int, key.split(","))
                yield int(new) - 256, a, b, int(new)
            except (ValueError, TypeError) as error:
                raise ValueError(f"{span.file}, entry {i}: {key!r}: {new!r} isn't a pair of ids and an id") from error


class _Writer(DataSourceWriter):
    """A file for each task that has rows, written aside and moved into the folder when all are there. What is aside is
    deleted then or when the job fails; a task that is still running after that leaves a hidden file, which isn't read."""

    def __init__(self, options: dict, overwrite: bool, suffix: str):
        self.path, self.overwrite, self.suffix = options["path"], overwrite, suffix
        self.aside = f"_aside-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        files, path = _opened(self.path)
        name, chunks = f"part-{uuid.uuid4().hex}{self.suffix}", self.chunks(rows)
        if (first := next(chunks, None)) is None:
            return Written(None)
        files.create_dir(f"{path}/{self.aside}")
        with files.open_output_stream(f"{path}/{self.aside}/{name}") as out:
            out.write(first)
            for chunk in chunks:
                out.write(chunk)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = _opened(self.path)
        files.create_dir(path)
        old = [f.path for f in files.get_file_info(pyarrow.fs.FileSelector(path)) if f.is_file] if self.overwrite else []
        for m in messages:
            if m is not None and m.file:
                files.move(f"{path}/{self.aside}/{m.file}", f"{path}/{m.file}")
        for f in old:
            files.delete_file(f)
        self.abort(messages)
        files.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        files, path = _opened(self.path)
        if files.get_file_info(f"{path}/{self.aside}").type == pyarrow.fs.FileType.Directory:
            files.delete_dir(f"{path}/{self.aside}")


class RankWriter(_Writer):
    def chunks(self, rows: Iterator[Row]) -> Iterator[bytes]:
        for row in rows:
            if row["id"] is None or row["bytes"] is None:
                raise ValueError(f"{row} has no id or no bytes")
            yield base64.b64encode(row["bytes"]) + b" %d\n" % row["id"]


class MergeWriter(_Writer):
    def chunks(self, rows: Iterator[Row]) -> Iterator[bytes]:
        entries = sorted((row["id"], row["a"], row["b"]) for row in rows)
        if entries:
            yield json.dumps({f"{a},{b}": new for new, a, b in entries}, separators=(",", ":")).encode()


class TokenRanks(DataSource):
    """(id, bytes) of lines of base64 and rank. Files are cut into spans of `split` bytes; a line that is neither raises
    with its file and byte."""

    @classmethod
    def name(cls) -> str:
        return "token_ranks"

    def schema(self) -> str:
        return "id int, bytes binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RankReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RankWriter(self.options, overwrite, ".tiktoken")


class MergeJson(DataSource):
    """(rank, a, b, id) of objects {"a,b": id}. An entry that isn't one raises with its file and number."""

    @classmethod
    def name(cls) -> str:
        return "merge_json"

    def schema(self) -> str:
        return "rank int, a int, b int, id int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MergeReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MergeWriter(self.options, overwrite, ".json")


def register(spark: SparkSession) -> None:
    """Both formats for the session's readers and writers."""
    spark.dataSource.register(TokenRanks)
    spark.dataSource.register(MergeJson)
