import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from provenia.llm import warc as W


def corpus():
    rng = random.Random(17)
    bits = ["<p>", "\r\n", "\n", "\r", "é", "日", "WARC/1.1\r\n", "\r\n\r\n", "x" * 30, "Content-Length: 5"]
    texts = ["", None, "a" * 99, "a" * 99, "b" * 100, "b" * 100, "b" * 100, "\r\n", "\r", "end\r", "end\r\n", "\n\r\n\r"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += texts[20:30]
    rows = [(i * 2, f"http://h/{i}\r\nX: y" if i % 7 else None, t, "k") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + rows[:1] + [(None, "u", "n" * 200, "k"), (None, "u", "n" * 200, "k")]


def expected(rows):
    first = {}
    for i, _, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, _, t, _ in rows:
        b = (t or "").encode()
        again = len(b) >= 100 and (t or "") in first and i != first[t or ""]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[t or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [1 << 20, 50])
def test_round_trip(spark, tmp_path, segment, monkeypatch):
    rows = corpus()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    if segment == 50:
        monkeypatch.setattr(W, "BROADCAST_ROWS", -1)
    W.write(W.records(pages), str(tmp_path / "w"))
    chunks = W.read(spark, str(tmp_path / "w"), segment=segment).collect()
    last = [(int(r.page_id) if r.page_id else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in chunks if r.is_last]
    assert sorted(last, key=str) == expected(rows)
    assert all(len(r.data) == r.chunk_bytes <= segment and (r.is_last or r.chunk_bytes == segment) for r in chunks)
    whole = {}
    for r in chunks:
        if r.page_id and r.record_type == "response" and r.page_id != str(rows[0][0]):
            whole.setdefault(r.page_id, {})[r.chunk_no] = bytes(r.data)
    text = {str(i): (t or "").encode() for i, _, t, _ in rows}
    assert all(b"".join(parts[k] for k in sorted(parts)) == text[i] for i, parts in whole.items())
    for r in chunks:
        if r.page_id and r.record_type == "response":
            assert r.running_digest == hashlib.sha256(text[r.page_id][: r.chunk_no * segment + r.chunk_bytes]).hexdigest()


def foreign(payload, kind="resource", name="<urn:uuid:1>", more=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n{more}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def test_long_records_of_others_are_read_in_chunks():
    """100 MB in one record: what the reader holds never exceeds two chunks."""
    import tracemalloc

    size, piece = 100 << 20, bytes(range(32, 96)) * (1 << 14)
    reader, seen, digest = W.Reader(True), 0, hashlib.sha256()
    for line in foreign(b"").replace(b"Content-Length: 0", f"Content-Length: {size}".encode()).split(b"\r\n")[:-4]:
        reader.feed(line + b"\r")
    reader.feed(b"\r")
    tracemalloc.start()
    for _ in range(size // len(piece)):
        digest.update(piece)
        for row in reader.feed(piece, False):
            seen += len(row["data"])
            assert row["chunk_bytes"] <= W.SEGMENT
            last = row
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    reader.feed(b"\r"), reader.feed(b"\r"), reader.finish()
    assert seen == size and last["is_last"] and last["payload_bytes"] == size and last["running_digest"] == digest.hexdigest()
    assert peak < 5 * W.SEGMENT


def test_archives_of_others(spark, tmp_path):
    """Uncompressed files that Spark cuts, other digests, segmented records, an HTTP message with a long body."""
    rng = random.Random(18)
    data = {}
    for n in range(4):
        out = b""
        for k in range(60):
            body = bytes(rng.choice(b"ab\n\r c") for _ in range(rng.randint(0, 3000)))
            data[f"<{n}:{k}>"] = body
            out += foreign(body, name=f"<{n}:{k}>", more="WARC-Payload-Digest: sha1:ABC\r\n")
        (tmp_path / "w").mkdir(exist_ok=True)
        (tmp_path / "w" / f"{n}.warc").write_bytes(out)
    body = b"z" * 500_000
    data["<seg>"] = body + b"\n12"
    http = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n"
    parts = foreign(http + body, "response", "<seg>", "Content-Type: application/http; msgtype=response\r\nWARC-Segment-Number: 1\r\n")
    parts += foreign(b"\n12", "continuation", "<seg:2>", "WARC-Segment-Number: 2\r\nWARC-Segment-Origin-ID: <seg>\r\nWARC-Segment-Total-Length: 500003\r\n")
    (tmp_path / "w" / "x.warc.gz").write_bytes(gzip.compress(parts))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        chunks = W.read(spark, str(tmp_path / "w"), segment=1000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in sorted(chunks, key=lambda r: r.chunk_no):
        got[r.record_id] = got.get(r.record_id, b"") + bytes(r.data)
    assert got == data
    assert {r.payload_digest for r in chunks} == {"sha1:ABC", ""}
    assert all(r.payload_bytes == len(data[r.record_id]) and r.running_digest == hashlib.sha256(data[r.record_id]).hexdigest() for r in chunks if r.is_last)


def test_files_are_plain_archives(spark, tmp_path):
    W.write(W.records(spark.createDataFrame([(1, "http://h/", "hello")], "page_id long, url string, html string")), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").iterdir() if p.name.endswith(".gz"))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\nhello\r\n\r\n")
    head, _, rest = data.partition(b"\r\n\r\n")
    assert int(head.split(b"Content-Length: ")[1]) == len(rest) - 4


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        W.Reader(True).feed(b"HTTP/1.1\r")
    reader = W.Reader(True)
    for line in (b"WARC/1.1", b"WARC-Type: response", b"WARC-Record-ID: <a>", b"WARC-Payload-Digest: sha256:00", b"Content-Length: 3", b""):
        reader.feed(line)
    with pytest.raises(ValueError):
        reader.feed(b"abc")
    reader = W.Reader(True)
    for line in (b"WARC/1.1", b"WARC-Type: response", b"WARC-Record-ID: <a>", b"Content-Length: 3", b""):
        reader.feed(line)
    with pytest.raises(ValueError):
        reader.feed(b"abcd\r")
    reader = W.Reader(True)
    reader.feed(b"WARC/1.1")
    with pytest.raises(ValueError):
        reader.finish()


def test_empty_and_hot(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    W.write(W.records(pages), str(tmp_path / "e"))
    assert W.read(spark, str(tmp_path / "e")).count() == 0
    hot = spark.range(1500).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "h" * 500).otherwise(F.concat(F.lit("p" * 100), F.col("id"))).alias("html"))
    W.write(W.records(hot), str(tmp_path / "h"))
    got = W.read(spark, str(tmp_path / "h"), keep=False).groupBy("record_type").count().collect()
    assert {r[0]: r[1] for r in got} == {"revisit": 499, "response": 1001}
