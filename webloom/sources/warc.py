"""WARC files: scan, random reads by pointer, parsing, and writing with sealed shards.

A scan has one task for each file; a member's place in the file comes with each record, so that read_records() can
fetch single ones later. Gzip members and plain files are both read. Paths may be URIs of any file system that the
executors share.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from webloom.sources import files

HEADERS = "array<struct<k:string,v:string>>"
SCHEMA = f"path string, offset bigint, length bigint, headers {HEADERS}, body binary"
READ = 1 << 20
ENDINGS = (".warc", ".warc.gz")


def parse_record(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and body of one uncompressed record; ValueError for another version or a short body."""
    if not raw.startswith(b"WARC/1."):
        raise ValueError("not a WARC 1 record")
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("record without end of headers")
    headers = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if colon:
            headers.append((k.strip(), v.strip()))
    size = next((v for k, v in headers if k.lower() == "content-length"), None)
    if size is None or not size.isdigit() or len(rest) < int(size):
        raise ValueError("body shorter than announced")
    return headers, rest[: int(size)]


def members(path: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member, or of each record of a plain file. A torn last member ends the scan."""
    with files.open_input(path) as f:
        if f.read(2) != b"\x1f\x8b":
            f.seek(0)
            yield from _plain(f.read())
            return
        f.seek(0)
        offset, held = 0, b""
        while True:
            inflate, out, length = zlib.decompressobj(31), [], 0
            while not inflate.eof:
                held = held or f.read(READ)
                if not held:
                    return
                out.append(inflate.decompress(held))
                length += len(held) - len(inflate.unused_data)
                held = inflate.unused_data if inflate.eof else b""
            yield offset, length, b"".join(out)
            offset += length


def _plain(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    at = 0
    while at < len(data):
        headers_end = data.find(b"\r\n\r\n", at)
        if headers_end < 0:
            return
        size = next((int(v) for k, _, v in (x.partition(b":") for x in data[at:headers_end].split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()), 0)
        end = headers_end + 4 + size
        yield at, end - at, data[at:end]
        at = end
        while data[at : at + 2] == b"\r\n":
            at += 2


def discover(path: str) -> list[str]:
    """The .warc and .warc.gz files under a path, sorted."""
    return [p for p, _ in files.listed(path, ENDINGS)]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in discover(self.path)]

    def read(self, partition: Any) -> Iterator[tuple]:
        for offset, length, raw in members(partition.path):
            headers, body = parse_record(raw)
            yield partition.path, offset, length, [{"k": k, "v": v} for k, v in headers], body


class _Committed(WriterCommitMessage):
    def __init__(self, temporary: str, rows: int):
        self.temporary, self.rows = temporary, rows


class _Writer(DataSourceWriter):
    """One shard for each task; a shard takes its final name only when the whole write commits.

    Names go on from the highest number there and end in the write's own id, so that no write replaces another's shards.
    An overwriting write removes the shards that were there once its own are."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex[:8]

    def write(self, rows: Iterator[Any]) -> WriterCommitMessage:
        temporary, n = f"{self.path}/.{uuid.uuid4().hex}.part", 0
        with files.open_output(temporary) as f:
            for row in rows:
                f.write(member([(h["k"], h["v"]) for h in row["headers"]], bytes(row["body"])))
                n += 1
        files.synced(temporary)
        return _Committed(temporary, n)

    def commit(self, messages: list) -> None:
        there = discover(self.path)
        numbers = [int(m[1]) for m in (re.search(r"shard-(\d+)[^/]*$", p) for p in there) if m]
        i = max(numbers, default=-1) + 1
        for m in messages:
            if m and m.rows:
                files.move(m.temporary, f"{self.path}/shard-{i:05d}-{self.job}.warc.gz")
                i += 1
            elif m:
                files.remove(m.temporary)
        for old in there if self.overwrite else []:
            files.remove(old)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m:
                files.remove(m.temporary)


class WarcSource(DataSource):
    """spark.read.format("warc").load(path), and df.select("headers", "body").write.format("warc").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).load()


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    df.sparkSession.dataSource.register(WarcSource)
    df.select("headers", "body").write.format("warc").option("path", path).mode(mode).save()


def member(headers: list[tuple[str, str]], body: bytes) -> bytes:
    kept = [(k, v) for k, v in headers if k.lower() != "content-length"] + [("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in kept) + "\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", mtime=0)


def response(url: str, date: str, status: int, http_headers: list[tuple[str, str]], payload: bytes, truncated: bool = False) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and body of a response record."""
    block = f"HTTP/1.1 {status}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in http_headers).encode() + b"\r\n" + payload
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, url + date)}>"
    headers = [("WARC-Type", "response"), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Record-ID", record_id)]
    headers += [("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()), ("Content-Type", "application/http; msgtype=response")]
    return headers + ([("WARC-Truncated", "length")] if truncated else []), block


def header(name: str, headers: str = "headers") -> Column:
    return F.get(F.filter(headers, lambda h: F.lower(h["k"]) == name.lower()), F.lit(0))["v"]


def target_uri(headers: str = "headers") -> Column:
    return F.regexp_replace(header("WARC-Target-URI", headers), r"^<|>$", "")


def split_http(df: DataFrame) -> DataFrame:
    """With status, http_head and payload of records whose body is an HTTP response; null elsewhere."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [split_block(bytes(x)) for x in b["body"]]
            yield b.assign(status=pd.array([r and r[0] for r in rows], "Int32"), http_head=[r and r[1] for r in rows], payload=[r and r[2] for r in rows])

    return df.mapInPandas(run, f"{SCHEMA}, status int, http_head string, payload binary")


def split_block(block: bytes) -> tuple[int, str, bytes] | None:
    head, gap, payload = block.partition(b"\r\n\r\n")
    first = head.split(b"\r\n", 1)[0].split(b" ")
    if not gap or not head.startswith(b"HTTP/") or len(first) < 2 or not first[1].isdigit():
        return None
    return int(first[1]), head.decode("latin-1"), payload


def read_records(pointers: DataFrame) -> DataFrame:
    """The records at (path, offset, length): files side by side, each read in the order of its offsets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: tuple[str, Any] | None = None
        for b in batches:
            out = []
            for path, offset, length in zip(b["path"], b["offset"], b["length"]):
                if not opened or opened[0] != path:
                    if opened:
                        opened[1].close()
                    opened = (path, files.open_input(path))
                opened[1].seek(offset)
                raw = opened[1].read(length)
                headers, body = parse_record(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                out.append((path, offset, length, [{"k": k, "v": v} for k, v in headers], body))
            yield pd.DataFrame(out, columns=["path", "offset", "length", "headers", "body"])
        if opened:
            opened[1].close()

    return pointers.select("path", "offset", "length").repartition("path").sortWithinPartitions("path", "offset").mapInPandas(run, SCHEMA)


def seal(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, digest) of whole shard files, digested on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                h, size = hashlib.sha256(), 0
                with files.open_input(p) as f:
                    while part := f.read(READ):
                        h.update(part)
                        size += len(part)
                rows.append((p, size, h.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "bytes", "digest"])

    found = discover(path)
    return spark.createDataFrame([(p,) for p in found], "path string").repartition(max(1, len(found))).mapInPandas(run, "path string, bytes bigint, digest string")


def append(path: str, records: list[tuple[list[tuple[str, str]], bytes]]) -> list[tuple[int, int]]:
    """Adds members to a shard, new or not, after its last whole one; their (offset, length)."""
    there = bool(files.listed(path, ENDINGS))
    data = files.read(path)[: truncate_torn(path)] if there else b""
    places = []
    for headers, body in records:
        one = member(headers, body)
        places.append((len(data), len(one)))
        data += one
    files.replace(path, data)
    return places


def truncate_torn(path: str) -> int:
    """Cuts a plain or gzip shard back to the end of its last whole member; the length kept."""
    end = 0
    for offset, length, _ in members(path):
        end = offset + length
    if files.listed(path, ENDINGS)[0][1] > end:
        with files.open_input(path) as f:
            files.replace(path, f.read(end))
    return end
