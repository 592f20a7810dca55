"""WARC files as a DataFrame: a Python data source, one input partition a file.

Fields follow the record parser of the reference: keys are case-sensitive, the last of
repeated headers wins, only blanks before a value go, lines without a colon are
passed over, and a record without headers ends the scan. A short read ends the file; the
cut record is delivered with what is there and ``truncated`` true, if asked for.

Local paths and ``file:`` URIs are streamed by the data source; paths of other file
systems are read through Spark's own ``binaryFile``.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, ordinal long, id string, url string, type string, headers map<string,string>, content_length long, content binary, truncated boolean"
_ARROW = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("id", pa.string()), ("url", pa.string()), ("type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("content_length", pa.int64()), ("content", pa.binary()), ("truncated", pa.bool_())])
#: Records and bytes of content of one Arrow batch, at most (one record may be larger).
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def parse(stream, response_only: bool = False, with_content: bool = True) -> Iterator[tuple]:
    """``ordinal, id, url, type, headers, content_length, content, truncated`` of each record."""
    ordinal = 0
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while True:
            line = stream.readline()
            if not line or not line.rstrip(b"\r\n"):
                break
            name, colon, value = line.rstrip(b"\r\n").partition(b":")
            if colon:
                headers[name.decode("utf-8", "replace")] = value.lstrip(b" ").decode("utf-8", "replace")
        if not headers:
            return
        raw = headers.get("Content-Length", "0").strip()
        digits = raw.lstrip("+")
        if not digits[:1].isdigit():
            raise ValueError(f"Content-Length {raw!r} is no number")
        size = int("".join(_leading_digits(digits)))
        kind = headers.get("WARC-Type", "")
        content = stream.read(size) if size else b""
        cut = len(content) < size
        if not response_only or kind == "response":
            yield ordinal, headers.get("WARC-Record-ID", ""), headers.get("WARC-Target-URI", ""), kind, headers, size, content if with_content else None, cut
        ordinal += 1
        if cut:
            return


def _leading_digits(text: str) -> Iterator[str]:
    for ch in text:
        if not ch.isdigit():
            return
        yield ch


def open_any(path: str):
    """A file, through gzip if its first bytes say so (concatenated members too)."""
    raw = open(path, "rb")
    magic = raw.read(2)
    raw.seek(0)
    return gzip.open(raw, "rb") if magic == b"\x1f\x8b" else raw


def batches(path: str, records: Iterable[tuple], keep_cut: bool) -> Iterator[pa.RecordBatch]:
    """Records of one file as Arrow batches; nothing but the batch at hand is held."""
    rows: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
        rows.clear()
        return made

    for ordinal, rid, url, kind, headers, length, content, cut in records:
        if cut and not keep_cut:
            break
        rows.append((path, ordinal, rid, url, kind, list(headers.items()), length, content, cut))
        size += len(content or b"")
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield flush()
            size = 0
    if rows:
        yield flush()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], options: dict[str, str]):
        self.paths = paths
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.response_only, self.content, self.keep_cut = flag("responseOnly", "false"), flag("content", "true"), flag("keepTruncated", "false")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open_any(partition.path) as f:
            yield from batches(partition.path, parse(f, self.response_only, self.content), self.keep_cut)


def local(path: str) -> str | None:
    """The path of a local file or ``file:`` URI; None for one of another file system."""
    parts = urlsplit(path)
    if len(parts.scheme) < 2:
        return path
    return unquote(parts.path) if parts.scheme == "file" else None


class WarcSource(DataSource):
    """``spark.read.format("warc")`` with options ``responseOnly``, ``content`` (false leaves it null) and ``keepTruncated``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        given = self.options.get("path", "")
        wanted = [local(g) for g in given.split(",")]
        if None in wanted:
            raise ValueError(f"{given!r} is not local: read_warc reads it through Spark's file systems")
        paths = sorted(p for g in wanted for p in (glob.glob(os.path.join(g, "*")) if os.path.isdir(g) else glob.glob(g)))
        if not paths:
            raise FileNotFoundError(f"no WARC file at {given!r}")
        return _Reader(paths, self.options)


def read_warc(spark: SparkSession, path: str, response_only: bool = False, content: bool = True, keep_truncated: bool = False) -> DataFrame:
    """Records of WARC files (plain or gzip) of any file system Spark reaches. A path that matches nothing raises."""
    if any(local(p) is None for p in path.split(",")):
        return read_warc_binary(spark, path, response_only, content, keep_truncated)
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("responseOnly", response_only).option("content", content).option("keepTruncated", keep_truncated).load(path)


def read_warc_binary(spark: SparkSession, path: str, response_only: bool = False, content: bool = True, keep_truncated: bool = False) -> DataFrame:
    """The same records through ``binaryFile``: for object stores that only Spark's own file systems reach.

    A file as it is stored is held in memory once, its records are streamed; so it suits segments of up to about a GB.
    """

    def run(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_buffer()
                raw = pa.BufferReader(data)
                stream = gzip.open(raw, "rb") if data[:2].to_pybytes() == b"\x1f\x8b" else io.BufferedReader(raw)
                yield from batches(batch.column(0)[i].as_py(), parse(stream, response_only, content), keep_truncated)

    return spark.read.format("binaryFile").load(path.split(",")).select("path", "content").mapInArrow(run, SCHEMA)


def write_warc(records: DataFrame, folder: str) -> list[str]:
    """One plain WARC file a ``path`` of the records, in the order of ``ordinal``, in a folder that all executors share; the files.

    A file's records go through one task, as a file is one sequence; nothing but the record at hand is held.
    """
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, made = None, None, []
        for batch in given:
            for path, rid, url, kind, content in zip(*(batch.column(i) for i in range(5)), strict=True):
                if path.as_py() != at:
                    if out:
                        out.close()
                    at = path.as_py()
                    made.append(os.path.join(folder, at.replace("/", "_")))
                    out = open(made[-1], "wb")
                body = content.as_py() or b""
                fields = [("WARC-Type", kind.as_py()), ("WARC-Record-ID", rid.as_py()), ("WARC-Target-URI", url.as_py()), ("Content-Length", str(len(body)))]
                out.write(b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n" + body + b"\r\n\r\n")
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"file": pa.array(made, pa.string())})

    os.makedirs(folder, exist_ok=True)
    rows = records.select("path", "id", "url", "type", "content", "ordinal").repartition("path").sortWithinPartitions("path", "ordinal").drop("ordinal")
    return sorted(r[0] for r in rows.mapInArrow(run, "file string").collect())
