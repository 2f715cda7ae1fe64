"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by offset index.

write_archives   writes each task's records into files that are one gzip stream over the whole file.
normalise        inflates such a file once, as a stream, writes every record as a gzip member of its own, and
                 beside it an index file: one line "offset length record-id" for each member.
read_records     reads archives back, each member by its place in the index.

Files go to a folder that driver and executors share, by any file system that pyarrow opens. A file's name holds
its task attempt, and only files in the written manifest count, so tasks may fail and run again.

Defined cases: null html is an empty payload; payloads below MIN_REVISIT bytes are always responses. A null page_id
is written as 'null': such a record is a revisit if its payload has a numbered one. Rows that repeat the smallest page_id are all
responses. A null url becomes urn:page:<id>; line ends and spaces in urls are percent-encoded. Repeated rows are
records each. An empty table gives no archive and an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import fresh_path, matched, pinned

MIN_REVISIT = 100
ROLL_BYTES = 32 << 20
_READ = 1 << 20
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def resolve(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, first): first is the page_id of the response that a revisit refers to, else null.

    Copies don't meet with their html: digests that repeat come to the rows, by broadcast while they are few.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"))
    sized = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    repeated = sized.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = matched(rows, repeated, "digest", "page_id", "url")
    return joined.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    urn = f"urn:page:{'null' if page_id is None else page_id}"
    target = "".join(c if "!" <= c else f"%{ord(c):02X}" for c in url) if url else urn
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if first is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return {k.lower(): v for k, v in pairs}


def records_of(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a stream of uncompressed WARC bytes; holds one record at a time."""
    held = bytearray()
    need, head = None, {}
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = parse_head(bytes(held[:end]))
                need = end + 4 + int(head["content-length"]) + 4
            if len(held) < need:
                break
            yield head, bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"{len(held)} bytes after the last whole record")


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in pieces of bounded size."""
    stream = zlib.decompressobj(31)
    while data := source.read(_READ):
        while data:
            yield stream.decompress(data, _READ)
            if stream.eof:
                data, stream = stream.unused_data, zlib.decompressobj(31)
            else:
                data = stream.unconsumed_tail
    yield stream.flush()


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_archives(records: DataFrame, folder: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Manifest of the monolithic archives of resolve()'s rows; about `roll` bytes each before compression."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().taskAttemptId():012d}"
        out, count, size, number = None, 0, 0, 0
        for batch in batches:
            for page_id, url, html, digest, first in zip(batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["first"]):
                if out is None:
                    path = f"{root}/{name}-{number:05d}.warc.gz"
                    raw = files.open_output_stream(path, compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6, mtime=0)
                data = record(None if pd.isna(page_id) else int(page_id), url, (html or "").encode(), digest, None if pd.isna(first) else int(first))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= roll:
                    out.close()
                    raw.close()
                    yield pd.DataFrame({"path": [f"{name}-{number:05d}.warc.gz"], "records": [count], "bytes": [size]})
                    out, count, size, number = None, 0, 0, number + 1
        if out is not None:
            out.close()
            raw.close()
            yield pd.DataFrame({"path": [f"{name}-{number:05d}.warc.gz"], "records": [count], "bytes": [size]})

    rows = records.select("page_id", "url", "html", "digest", "first").withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("page_id", "first")})
    return pinned(rows.mapInPandas(write, MANIFEST), "manifest")


def normalise(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """Manifest of archives with a member for each record; `<path>.idx` beside each is its offset index."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _open(source)
        sink, goal = _open(target)
        sink.create_dir(goal, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch["path"]:
                name, offset, lines, size = f"{attempt:012d}-{path}", 0, [], 0
                with files.open_input_stream(f"{root}/{path}", compression=None) as data, sink.open_output_stream(f"{goal}/{name}", compression=None) as out:
                    for head, whole in records_of(inflated(data)):
                        member = gzip.compress(whole, 6, mtime=0)
                        out.write(member)
                        lines.append(f"{offset} {len(member)} {head['warc-record-id']}\n")
                        offset, size = offset + len(member), size + len(whole)
                with sink.open_output_stream(f"{goal}/{name}.idx", compression=None) as index:
                    index.write("".join(lines).encode())
                yield pd.DataFrame({"path": [name], "records": [len(lines)], "bytes": [size]})

    return pinned(_one_each(manifest).mapInPandas(rewrite, MANIFEST), "manifest")


def _one_each(manifest: DataFrame) -> DataFrame:
    """The manifest dealt out over many partitions: an archive is the unit of work."""
    width = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.repartition(max(width, min(100_000, manifest.count())), "path")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """RECORD rows of normalised archives: a response's digest is that of its payload as read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _open(folder)
        for batch in batches:
            for path in batch["path"]:
                with files.open_input_stream(f"{root}/{path}.idx", compression=None) as index:
                    places = index.read().decode().splitlines()
                rows, held = [], 0
                with files.open_input_file(f"{root}/{path}") as data:
                    for line in places:
                        offset, length, _ = line.split(" ", 2)
                        data.seek(int(offset))
                        rows.append(parsed(gzip.decompress(data.read(int(length)))))
                        held += len(rows[-1][-1] or b"")
                        if held >= 4 * _READ or len(rows) >= 5000:
                            yield _frame(rows)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows)

    return _one_each(manifest).mapInPandas(read, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def parsed(whole: bytes) -> tuple:
    head_end = whole.index(b"\r\n\r\n")
    head = parse_head(whole[:head_end])
    block = whole[head_end + 4 : -4]
    http_end = block.index(b"\r\n\r\n")
    length = int(parse_head(block[:http_end])["content-length"])
    number = lambda urn: None if (n := urn.strip("<>").rsplit(":", 1)[1]) == "null" else int(n)
    page_id, url = number(head["warc-record-id"]), head["warc-target-uri"]
    if head["warc-type"] == "revisit":
        return page_id, url, "revisit", number(head["warc-refers-to"]), length, head["warc-payload-digest"].removeprefix("sha256:"), None
    payload = block[http_end + 4 :]
    return page_id, url, "response", None, len(payload), hashlib.sha256(payload).hexdigest(), payload


def roundtrip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """All pages written, normalised and read back: RECORD rows."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    monolithic = write_archives(resolve(pages), f"{folder}/monolithic")
    return read_records(normalise(monolithic, f"{folder}/monolithic", f"{folder}/records"), f"{folder}/records")
