"""WARC archives written and read as tables of chunks.

Writing: each row becomes one WARC record, a row of Spark's text sink, whose line
separator completes the record's closing CRLF CRLF; so any file system Spark writes to
will do, and a lost task is written again.

Reading: Spark's text source hands over lines, long ones in pieces of SEGMENT bytes, and
a state machine in each task turns them into rows (record, chunk number) of at most
SEGMENT payload bytes, with the digest of the payload so far. It never holds more of a
record than one chunk, whatever the record's length and whoever wrote the archive; what
is held whole is a line, by Spark's line reader. Records of several segments (type
"continuation") are read as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenia.llm.common import cut, join_splittable, scratch_dir, table

#: Bytes of a chunk, bytes from which equal payloads are stored once, rows of twice-found digests that are broadcast.
SEGMENT, DEDUPE, BROADCAST_ROWS = 1 << 20, 100, 200_000
#: The date that records carry; the tables have none.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"
#: Rows of a batch that Python returns; bytes of a header line at most.
_ROWS, _HEADER = 2000, 1 << 16
#: Files that Spark never cuts.
_WHOLE = r"(?i)\.(?:gz|gzip|bz2|zst|deflate|snappy|lz4)$"
CHUNKS = "record_id string, page_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, chunk_no long, chunk_bytes long, running_digest string, is_last boolean, data binary"


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(_CRLF))


def _clean(c: Column) -> Column:
    """A header value: control characters are percent-encoded, null is empty."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(c.cast("string"), "\r", "%0D"), "\n", "%0A"), F.lit(""))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), _clean(page), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, body, digest, refers_to (null: the record holds its payload).

    Of rows with equal payloads of DEDUPE bytes or more that with the smallest id is kept
    whole, as are repeated rows with that id; a null id is never referred to. A null
    payload is an empty one. No pages give no records.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    found = rows.where(F.length("body") >= DEDUPE).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    twice = cut(found.where("n > 1").select("digest", "first_id"), narrow=True)
    joined = rows.join(F.broadcast(twice), "digest", "left") if twice.count() <= BROADCAST_ROWS else join_splittable(rows, twice, "digest")
    repeat = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "body", "digest", F.when(repeat, F.col("first_id")).alias("refers_to"))


def write(found: DataFrame, path: str) -> None:
    """Archives of the rows of records(), one record each, as gzip files below path."""
    revisit = F.col("refers_to").isNotNull()
    size = F.length("body")
    none = F.lit("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), size, F.lit(_CRLF * 2))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(_CRLF)),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", DATE),
        _line("WARC-Target-URI", _clean(F.col("url"))),
        _line("X-Page-Id", _clean(F.col("page_id"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _record_id(F.col("refers_to"))), _line("WARC-Profile", PROFILE))).otherwise(none),
        _line("Content-Type", "application/http; msgtype=response"),
    )
    part = F.when(revisit, F.lit(b"")).otherwise(F.col("body"))
    length = F.octet_length(http) + F.length(part)
    text = F.concat(F.concat(head, _line("Content-Length", length.cast("string")), F.lit(_CRLF), http).cast("binary"), part, F.lit(_CRLF).cast("binary"))
    found.select(text.cast("string").alias("value")).write.option("lineSep", _CRLF).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


class Reader:
    """Lines in, or pieces of them, chunk rows out. Raises ValueError where an archive is broken.

    A payload's bytes are held up to `segment`; with keep false only their number is.
    """

    def __init__(self, keep: bool, segment: int = SEGMENT):
        self.keep, self.segment = keep, segment
        self.state, self.text, self.head, self.open = "start", b"", {}, None

    def feed(self, data: bytes, ended: bool = True) -> list[dict]:
        """The chunks that a piece of a line completes; ended: the line ends after it, with a line feed."""
        if self.state == "block":
            return self._block(data + b"\n" if ended else data)
        self.text += data
        if len(self.text) > _HEADER:
            raise ValueError(f"header line of more than {_HEADER} bytes")
        if not ended:
            return []
        line, self.text = self.text.removesuffix(b"\r"), b""
        if self.state == "start":
            if line:
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"not a record: {line[:40]!r}")
                self.head, self.state = {}, "head"
            return []
        if line:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.head[name.strip().lower()] = value.strip()
            return []
        return self._begin()

    def _begin(self) -> list[dict]:
        h = self.head
        self.left = int(h["content-length"])
        self.http = h.get("content-type", "").startswith("application/http")
        self.state, self.line = "block", b""
        kind = h["warc-type"]
        if kind == "continuation":
            if self.open is None or self.open["record_id"] != h["warc-segment-origin-id"] or self.open["segment"] + 1 != int(h["warc-segment-number"]):
                raise ValueError(f"segment out of order: {h['warc-record-id']}")
            self.open["segment"] += 1
            self.final = "warc-segment-total-length" in h
        else:
            if self.open is not None:
                raise ValueError(f"last segment missing: {self.open['record_id']}")
            refers = h.get("warc-refers-to")
            self.open = {"record_id": h["warc-record-id"], "page_id": h.get("x-page-id") or None, "record_type": kind, "refers_to": refers and refers.removeprefix("<urn:page:").rstrip(">"), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:"), "segment": 1}
            self.digest, self.chunk, self.bytes, self.stated = hashlib.sha256(), 0, 0, None
            self.held, self.parts = 0, []
            self.final = "warc-segment-number" not in h
        return [] if self.left else self._end()

    def _block(self, data: bytes) -> list[dict]:
        body, rest = data[: self.left], data[self.left :]
        self.left -= len(body)
        if self.http:
            # The header of the HTTP message ends at its first empty line.
            self.line += body
            if len(self.line) > _HEADER:
                raise ValueError(f"header line of more than {_HEADER} bytes")
            if self.line.endswith(b"\n"):
                line, self.line = self.line.rstrip(b"\r\n"), b""
                if line.lower().startswith(b"content-length:"):
                    self.stated = int(line.split(b":")[1])
                self.http = bool(line)
            out = []
        else:
            out = self._payload(body)
        if not self.left:
            if rest.strip(b"\r\n"):
                raise ValueError(f"block longer than stated: {self.open['record_id']}")
            out += self._end()
        return out

    def _payload(self, data: bytes) -> list[dict]:
        out = []
        while data:
            if self.held == self.segment:
                out.append(self._chunk(False))
            part = data[: self.segment - self.held]
            data = data[len(part) :]
            self.digest.update(part)
            self.bytes += len(part)
            self.held += len(part)
            if self.keep:
                self.parts.append(part)
        return out

    def _chunk(self, last: bool) -> dict:
        o = self.open
        row = {k: o[k] for k in ("record_id", "page_id", "record_type", "refers_to", "payload_digest")}
        row |= {"payload_bytes": None, "chunk_no": self.chunk, "chunk_bytes": self.held, "running_digest": self.digest.hexdigest(), "is_last": last, "data": b"".join(self.parts) if self.keep else None}
        self.chunk, self.held, self.parts = self.chunk + 1, 0, []
        return row

    def _end(self) -> list[dict]:
        self.state = "start"
        if not self.final:
            return []
        o, row = self.open, self._chunk(True)
        row["payload_bytes"] = self.stated if o["record_type"] == "revisit" else self.bytes
        stated = o["payload_digest"]
        # Digests of other algorithms name theirs and are passed on as they are.
        if o["record_type"] != "revisit" and stated and ":" not in stated and stated != row["running_digest"]:
            raise ValueError(f"payload differs from its digest: {o['record_id']}")
        self.open = None
        return [row]

    def finish(self) -> None:
        if self.state != "start" or self.open is not None or self.text.strip():
            raise ValueError("archive ends within a record")


def _lines(spark: SparkSession, path: str, segment: int) -> DataFrame:
    """(value, ended): the lines of archives in order, in pieces of at most `segment` bytes.

    Spark cuts large files without compression in splits, so the lines of such files are
    dealt by file and sorted by place; compressed ones come in order as they are.
    """
    lines = spark.read.schema("value string").option("lineSep", "\n").text(path)
    of = F.col("value").cast("binary")
    names = spark.read.format("binaryFile").load(path).select("path")
    if not names.where(~F.col("path").rlike(_WHOLE)).isEmpty():
        placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
        lines = placed.repartition("file").sortWithinPartitions("file", "block", "place").select("value")
    long = F.length(of) > segment
    pieces = F.when(~long, F.array(F.struct(of.alias("value"), F.lit(True).alias("ended")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.length(of) - 1) / segment).cast("int")), lambda k: F.struct(F.substring(of, k * segment + 1, F.lit(segment)).alias("value"), (k == F.floor((F.length(of) - 1) / segment)).alias("ended")))
    )
    return lines.select(F.explode(pieces).alias("x")).select("x.value", "x.ended")


def read(spark: SparkSession, path: str, keep: bool = True, segment: int = SEGMENT) -> DataFrame:
    """The chunk table of the archives below path: rows of at most `segment` payload bytes, in order.

    running_digest is the SHA-256 of the payload up to and with the chunk; payload_bytes is
    set on the last chunk. Without keep, data is null. An empty folder gives no rows; a
    record without payload gives one empty chunk. An archive that is cut short, or a
    payload that differs from its stated SHA-256, raises an error.
    """
    schema = StructType.fromDDL(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        reader, rows, held = Reader(keep, segment), [], 0
        kind = to_arrow_schema(schema)
        for batch in batches:
            for line, ended in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in reader.feed(line, ended):
                    rows.append(row)
                    held += row["chunk_bytes"] if keep else 0
                    if len(rows) >= _ROWS or held >= 8 * segment:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, held = [], 0
        reader.finish()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)

    return _lines(spark, path, segment).mapInArrow(run, schema)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read back from archives of pages."""
    path = scratch_dir(spark)
    write(records(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    last = read(spark, path, keep=False).where("is_last")
    return last.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(h)) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM d
"""
