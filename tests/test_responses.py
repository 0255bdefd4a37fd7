"""Recorded responses: rows of all lines whatever the parts, errors as rows, files of other hosts left alone."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from provenia.sources import responses as R


@pytest.mark.parametrize("ending", ["", "\n"])
def test_each_line_is_in_one_part(ending):
    lines = [b"a", b"", b"bcd" * 9, b"e", b"\xc3\xa9", b"f" * 30]
    data = b"\n".join(lines) + ending.encode()
    for part in range(1, len(data) + 2):
        got = []
        for s in range(0, len(data), part):
            blocks = [data[k : k + 5] for k in range(max(0, s - 1), len(data), 5)]
            got += R._lines(blocks, s, s + part if s + part < len(data) else None)
        assert got == lines, part


def test_rows_errors_and_hosts(spark, tmp_path):
    root = tmp_path / "archive"
    good = {"url": "http://a.example/é", "status": 200, "content_type": "text/html", "body": "tëxt\n" * 50, "error": None}
    lines = [good, {"url": "http://a.example/2", "status": 404, "body": "gone"}, {"url": "http://a.example/3", "error": "timed out"}, {"url": "http://a.example/4"}, [1], {"url": 5}, {"url": "x", "status": "200"}]
    for host in ("a.example", "b.example"):
        (root / f"host={host}").mkdir(parents=True)
        (root / f"host={host}" / "one.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n\n{broken\n")
    packed = (json.dumps(good | {"url": "http://a.example/gz"}) + "\n").encode()
    (root / "host=a.example" / "two.json.gz").write_bytes(gzip.compress(packed) + gzip.compress(packed))
    (root / "host=a.example" / "_SUCCESS").write_text("")
    for part in (R.PART, 37):
        got = R.responses(spark, str(root), part)
        rows = got.where("host = 'a.example'").collect()
        sha = hashlib.sha256(good["body"].encode()).hexdigest()
        assert sorted((r.url or "", r.status, r.error, r.sha256 == sha) for r in rows if r.error is None) == [("http://a.example/gz", 200, None, True)] * 2 + [("http://a.example/é", 200, None, True)]
        errors = sorted(r.error for r in rows if r.error)
        assert errors == ["HTTP 404", "no response: [1]", 'no response: {"url": "x", "status": "200"}', 'no response: {"url": 5}', "no response: {broken", "no status", "timed out"]
    whole = R.responses(spark, str(root))
    assert whole.count() == 18 and whole.where(F.col("host").isin("b.example", "c.example") & F.col("url").isNotNull()).rdd.getNumPartitions() == 1
    assert whole.where("host = 'nowhere'").count() == 0 and R.responses(spark, str(tmp_path / "none")).count() == 0
    (root / "host=b.example" / "two.json.gz").write_bytes(b"no archive")  # what a filter leaves out is not opened
    assert whole.where("host IN ('a.example', 'z')").count() == 10


def test_recorded_and_known_before(spark, tmp_path):
    rows = spark.createDataFrame([("https://X.example:8080/p?q", 200, "text/html", "<p>one", None), ("https://y.example", 200, None, "two", None), ("https://y.example/3", 500, None, None, "bad")], "url string, status int, content_type string, body string, error string")
    R.record(rows, str(tmp_path / "a"))
    got = R.responses(spark, (tmp_path / "a").as_uri())
    assert sorted((r.host, r.url, r.body) for r in got.collect()) == [("x.example:8080", "https://X.example:8080/p?q", "<p>one"), ("y.example", "https://y.example", "two"), ("y.example", "https://y.example/3", None)]
    cache = spark.createDataFrame([("https://y.example", hashlib.sha256(b"two").hexdigest()), ("https://X.example:8080/p?q", "old")], "url string, sha256 string")
    assert [r.url for r in R.fresh(got, cache).collect()] == ["https://X.example:8080/p?q"]
