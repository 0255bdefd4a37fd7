import hashlib
import random
import re

from pyspark.sql import functions as F

from provenia.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m, t):
    digits = re.sub("[^0-9]", "", m[0])
    if kind == "ip":
        return all(int(p) <= 255 for p in m[0].split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "iban":
        alone = not re.match("[A-Za-z0-9]", t[m.end() : m.end() + 1]) and not re.match("[A-Za-z0-9]", t[max(0, m.start() - 1) : m.start()])
        return alone and int("".join(str(int(c, 36)) for c in m[0][4:] + m[0][:4])) % 97 == 1
    return True


def slow_spans(t):
    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(P.KINDS) for m in re.finditer(PLAIN[kind], t) if valid(kind, m, t)]
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def texts():
    rng = random.Random(18)
    parts = ["a@b.c", "_d@e.f", "x.y+z@mail-1.example.com", "@", ".", "10.0.0.1", "0010.255.256.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "49927398716", "378282246310005", "+1 (377) 555-0271", "+44 20 7946 0958", "+1", "(", " ", "  ", "-", "\n", "é", "\U0001f600", "GB82WEST12345698765432", "DE89370400440532013000", "XDE89370400440532013000", "AB12", "7", "42", "tel", "card", "+"]
    out = ["", "a@b.c_d@e.f", "GB82WEST12345698765432 and DE89370400440532013001", "9" * 400, "1-" * 300, "a" * 3000 + "@", "+" + "1 " * 40]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(250)]
    return out


def test_spans_match_plain_patterns(spark, monkeypatch):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(9999, None, "x"), (0, "", "x"), (None, "a@b.c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)
    for summed in (256, 2):
        monkeypatch.setattr(P, "SUMMED", summed)
        got = P.personal_data(docs).collect()
        assert len(got) == len(rows)
        text = {i: t or "" for i, t, _ in rows}
        for r in got:
            assert [(x.kind, x.s, x.e) for x in r.found] == slow_spans(text[r.doc_id]), repr(text[r.doc_id])
            assert all(x.m == text[r.doc_id][x.s : x.e] and x.score in {P.PRIOR[x.kind] + d for d in (-P.STEP, 0, P.STEP)} for x in r.found)


def test_query_columns(spark, tmp_path):
    t = "mail a@b.c or 10.0.0.1, card 4111 1111 1111 1111"
    spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    a, b = P.op4_pii(spark, str(tmp_path)).orderBy("doc_id").collect()
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in slow_spans(t))
    assert (a.n_email, a.n_ip, a.n_card, a.n_phone, a.spans) == (1, 1, 1, 0, joined)
    assert a.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    assert b.spans == "" and b.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_context_moves_the_score(spark):
    rows = [("order 4111 1111 1111 1111",), ("4111 1111 1111 1111",), ("my visa card 4111 1111 1111 1111",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(P.spans(F.col("t"))[0]["score"]).collect()]
    assert got[0] < got[1] < got[2]


def test_context_decides_about_added_spans(spark):
    iban, cases = "GB82WEST12345698765432", {"": True, "my account": True, "IBAN key": True, "serial": False, "Schlüssel": False, "la CLÉ": False, "clave:": False, "keyed": True, "serial bank": True}
    rows = [(f"{words} {iban}", f"{words} [IBAN]" if found else f"{words} {iban}") for words, found in cases.items()]
    df = spark.createDataFrame(rows, "t string, want string").select("want", P.redact(F.col("t")).alias("got"), F.size(P.spans(F.col("t"))).alias("n"))
    for r in df.collect():
        assert r.got == r.want and r.n == ("[" in r.want)


def test_sql_finds_the_same(spark, tmp_path):
    import duckdb

    docs = [(i, t) for i, t in enumerate(texts())] + [(9000, "clave GB82WEST12345698765432"), (9001, None), (9002, "Überweisung GB82WEST12345698765432 ÜBERWEISUNG")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op4_pii(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(P.OP4_SQL).fetchall()
    columns = [d[0] for d in con.description]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want)


def test_redaction(spark):
    rows = [("a@b.c\nx +1 (377) 555-0271 y\n\n10.0.0.1",), (None,), ("",), ("nothing 12 here",), ("call +44 20 7946 0958, 4111111111111111",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(P.redact(F.col("t"))).collect()]
    assert got == ["[EMAIL]\nx [PHONE] y\n\n[IP]", None, "", "nothing 12 here", "call [PHONE], [CARD]"]


def test_redaction_of_cards_digit_by_digit(spark):
    rows = [(sep.join("4111111111111111"),) for sep in " -"]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(P.redact(F.col("t"))).collect()] == ["[CARD]", "[CARD]"]


def test_redaction_whatever_the_context(spark):
    rows = [("version 10.0.0.1",), ("plus +1 (377) 555-0271",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(P.redact(F.col("t"))).collect()] == ["version [IP]", "plus [PHONE]"]


def test_empty_table(spark):
    assert P.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
