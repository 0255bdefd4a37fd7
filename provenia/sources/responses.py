"""Recorded HTTP responses as a data source: archives of JSON lines, a folder for each host.

An archive is a tree ``host=<name>/*.json`` (or ``.json.gz``), a line for each response:
url, status, content_type, body, error. The source reads what a query asks for: a filter
on hosts reaches it, and files of other hosts are neither listed nor opened. Files without
compression are read in parts, a line by the part that it begins in, so a large file has
many tasks; of a file no more than a block and a line is held.

What went wrong is a row, not the end of the job: a status of 400 or more, a recorded
failure and a line that is no response have the reason in `error`.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

NAME = "recorded_responses"
SHAPE = "host string, url string, status int, content_type string, body string, error string, sha256 string"
_ARROW = pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.string()) for f in SHAPE.split(", ")])
#: Bytes of a part of a file and of a block that is read; rows of a batch.
PART, BLOCK, ROWS = 32 << 20, 1 << 20, 256


class _Part(InputPartition):
    def __init__(self, host: str, file: str, start: int, end: int | None):
        self.host, self.file, self.start, self.end = host, file, start, end


def _lines(blocks: Iterable[bytes], start: int, end: int | None) -> Iterator[bytes]:
    """The lines that begin from start on and before end, of blocks that begin one byte before start (but at 0)."""
    held, at = b"", max(0, start - 1)  # at: where held begins
    skip = start > 0
    for block in blocks:
        held += block
        while (k := held.find(b"\n")) >= 0:
            line, held, begin, at = held[:k], held[k + 1 :], at, at + k + 1
            if skip:  # the end of a line that another part has
                skip = False
            elif end is None or begin < end:
                yield line
            if end is not None and at >= end:
                return
    if held and not skip:
        yield held


def _row(host: str, line: bytes) -> tuple:
    try:
        r = json.loads(line)
        status, body = r.get("status"), r.get("body")
        if not isinstance(r["url"], str) or not isinstance(body, str | None) or not (status is None or type(status) is int and abs(status) < 1 << 31):
            raise ValueError
    except (ValueError, KeyError, AttributeError, TypeError):
        return host, None, None, None, None, f"no response: {line[:80].decode('utf-8', 'replace')}", None
    error = r.get("error") or (f"HTTP {status}" if status is not None and status >= 400 else "no status" if status is None else None)
    kind = r.get("content_type")
    return host, r["url"], status, None if kind is None else str(kind), body, None if error is None else str(error), hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest() if body is not None else None


class ResponseReader(DataSourceReader):
    def __init__(self, path: str, part: int):
        self.path, self.part = path, part
        self.hosts: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo | EqualNullSafe) else set(f.value) if isinstance(f, In) else None
            if names is None or f.attribute != ("host",):
                yield f
            else:
                self.hosts = names if self.hosts is None else self.hosts & names

    def partitions(self) -> list[_Part]:
        files, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        out = []
        for folder in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            host = unquote(folder.base_name.removeprefix("host="))
            if folder.type != fs.FileType.Directory or not folder.base_name.startswith("host=") or self.hosts is not None and host not in self.hosts:
                continue
            for f in sorted(files.get_file_info(fs.FileSelector(folder.path, recursive=True)), key=lambda f: f.path):
                if f.type != fs.FileType.File or f.base_name.startswith((".", "_")) or not f.base_name.endswith((".json", ".json.gz")) or not f.size:
                    continue
                starts = [0] if f.base_name.endswith(".gz") else range(0, f.size, self.part)
                out += [_Part(host, f.path, s, None if s + self.part >= f.size or f.base_name.endswith(".gz") else s + self.part) for s in starts]
        return out or [_Part("", "", 0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        rows = []
        with files.open_input_file(partition.file) as f:
            for line in _lines(self._blocks(f, partition), partition.start, partition.end):
                if line.strip():
                    rows.append(_row(partition.host, line))
                if len(rows) >= ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _blocks(f, partition: _Part) -> Iterator[bytes]:
        f.seek(max(0, partition.start - 1))
        packed = partition.file.endswith(".gz")
        inflate = zlib.decompressobj(31)
        while block := f.read(BLOCK):
            while packed and block:  # members one after another are one file
                yield inflate.decompress(block)
                block = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
            if not packed:
                yield block

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class ResponseSource(DataSource):
    """Options: path, and bytes of a part (part)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> ResponseReader:
        return ResponseReader(self.options["path"], int(self.options.get("part", PART)))


def responses(spark: SparkSession, path: str, part: int = PART) -> DataFrame:
    """The responses recorded below path, a folder that executors reach by a URI which pyarrow opens.

    sha256 is that of the body in UTF-8. Filters on host by equality or a list choose what
    is read at all.
    """
    spark.dataSource.register(ResponseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("part", part).load(path)


def record(rows: DataFrame, path: str) -> None:
    """Add responses (url, status, content_type, body, error) to the archive at path, each under its host."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows.select("url", "status", "content_type", "body", "error", host.alias("host")).write.mode("append").partitionBy("host").json(path)


def fresh(found: DataFrame, cache: DataFrame) -> DataFrame:
    """The responses without an error whose text the cache (url, sha256) has not: those to be read again."""
    good = found.where(F.col("error").isNull() & F.col("sha256").isNotNull())
    return good.join(cache.select("url", "sha256"), ["url", "sha256"], "left_anti").select(found.columns)
