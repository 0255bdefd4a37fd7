import random
import re

import pytest
from pyspark.sql import functions as F

from provenia.functions import text as T
from provenia.functions import values as V
from provenia.operators import confidence, gate, joins


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_format_g_is_c_s(spark):
    rng = random.Random(1)
    xs = [0.0, 50.0, 1234567.0, 1.234e-5, 0.1, 100000.0, 999999.5, -1.5, 2.5e-4, 95611.45, 74492.65, -0.1234565, 1e22, 1e-300, 123456.5, 123457.5, 2.5, 1e15, 13090450.0, 13090550.0, 1309045.0, 233284500.0, 1.234565e21, 9.999995e9]
    xs += [round(rng.uniform(-1e9, 1e9), -2) + 50 for _ in range(300)] + [float(rng.randint(100000, 999999) * 10 + 5) * 10**rng.randint(0, 12) for _ in range(300)]
    xs += [round(rng.uniform(-1e5, 1e5), rng.randint(0, 6)) for _ in range(500)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9) for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", T.format_g(F.col("x")).alias("g")).collect()
    assert [r.g for r in got] == ["%g" % r.x for r in got]
    assert one(spark, T.format_g(F.lit(None).cast("double"))) is None


def test_offsets_match_re(spark):
    rng = random.Random(2)
    for pattern in (r"[a-z]+", r"\d+", "ab|a"):
        texts = ["".join(rng.choice("ab1 é😀") for _ in range(rng.randint(0, 30))) for _ in range(80)]
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.find_all(F.col("t"), pattern).alias("h")).collect()
        for r in got:
            assert [(h.s, h.e, h.m) for h in r.h] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r.t)]


@pytest.mark.parametrize(
    ("text", "quote", "at"),
    [("a Hello  World", "hello world", 2), ("abc", "b", 1), ("abc", "z", -1), ("", "", -1), ("x (a+b) y", "(A+B)", 2), ("é É", "É", 2), (r"a\E b", r"\E b", 1), ("a b", "a b", 0)],
)
def test_find_quote(spark, text, quote, at):
    assert one(spark, T.find_quote(F.lit(text), F.lit(quote))) == at


@pytest.mark.parametrize(
    ("text", "start", "end", "quote", "mode", "moved"),
    [
        ("the value is 5 V", 4, 9, "value", "exact", 4),
        ("the  value is", 0, 10, "the value", "normalized", 0),
        ("the value is 5 V", 0, 5, "value", "relocated", 4),
        ("the value is 5 V", 4, 9, "invented", "not_found", 4),
        ("the value", 0, 3, "  ", "not_found", 0),
        (None, 0, 3, "the", "not_found", 0),
    ],
)
def test_match_ladder(spark, text, start, end, quote, mode, moved):
    v = one(spark, gate.verify_span(F.lit(text).cast("string"), F.lit(start), F.lit(end), F.lit(quote)))
    assert (v.mode, v.start, v.verified) == (mode, moved, mode != "not_found")


def test_unknown_documents_drop_their_candidates(spark):
    pages = F.array(F.struct(F.lit(1).alias("page"), F.lit(0).alias("char_start"), F.lit(99).alias("char_end")))
    docs = spark.createDataFrame([("d", "one two")], "doc_id string, text string").withColumn("pages", pages)
    claims = spark.createDataFrame([("d", 0, 3, "one"), ("e", 0, 3, "one"), ("d", 0, 3, "six")], "doc_id string, start int, end int, quote string")
    kept, dropped = gate.verify_all(claims, docs)
    assert kept.count() == 1 and dropped.count() == 2 and kept.first().match.page == 1


def test_pages(spark):
    pages = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(a).alias("char_start"), F.lit(b).alias("char_end")) for p, a, b in ((1, 0, 5), (2, 5, 9))])
    assert [one(spark, T.page_for_offset(pages, F.lit(i))) for i in (0, 5, 50)] == [1, 2, 2]
    assert one(spark, T.page_text(F.lit("abcdefghi"), pages, F.lit(2))) == "fghi" and one(spark, T.page_text(F.lit("abc"), pages, F.lit(7))) == ""
    assert one(spark, T.window(F.lit("abcdef"), F.lit(1), 2, 2)) == "abc"


def test_html(spark):
    html = "<p>a&nbsp;b &amp; c</p><script>x</script>\n\n \n<STYLE a>y</STYLE><b>d</b>"
    assert one(spark, T.strip_html(F.lit(html))) == "a b & c \n d"


@pytest.mark.parametrize(
    ("raw", "unit", "hint", "num", "error"),
    [("100mA", "A", "", 0.1, ""), ("1.5A", "A", "", 1.5, ""), ("Up to 100 mA", "A", "", 0.1, ""), ("1.25V", "A", "", None, "unit 'V' not compatible with 'A'"), ("−65", "degC", "°C", -65.0, ""), ("212", "degC", "°F", 100.0, ""), ("1,000", "V", "", 1.0, ""), ("none", "V", "", None, "no number in 'none'"), ("", "V", "", None, "empty"), ("5", None, "", 5.0, "")],
)
def test_numbers(spark, raw, unit, hint, num, error):
    v = one(spark, V.normalize_value(F.lit(raw), F.lit("number"), F.lit(unit).cast("string"), F.array().cast("array<string>"), F.lit(hint)))
    assert (v.num, v.error) == (num, error)


def test_strict_units(spark):
    v = one(spark, V.normalize_value(F.lit("5"), F.lit("number"), F.lit("V"), F.array().cast("array<string>"), F.lit(""), strict=True))
    assert v.num is None and "not compatible" in v.error


def test_words(spark):
    flags = {"Yes": True, "non-compliant": False, "is not compliant": True, "RoHS": None or False, "halogen-free": False, "zz": None}
    flags["RoHS"] = None
    assert {k: one(spark, V.to_bool(F.lit(k))) for k in flags} == flags
    members = F.array(F.lit("THROUGH_HOLE"), F.lit("SURFACE_MOUNT"))
    assert [one(spark, V.canon_enum(F.lit(x), members)) for x in ("through hole", "Surface", "axial")] == ["THROUGH_HOLE", "SURFACE_MOUNT", None]
    text = one(spark, V.normalize_value(F.lit("  DO-41 ;"), F.lit("string"), F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit("")))
    assert text.str == "DO-41"


def test_asof(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "i int, k string, o int")
    right = spark.createDataFrame([("a", 3, 30.0), ("a", 5, 50.0), ("a", 6, 60.0), ("b", 10, 1.0)], "k string, o int, v double")
    got = {r.i: r.v for r in joins.asof(left, right, ["k"], "o", "v").collect()}
    assert got == {1: 50.0, 2: None, 3: None}


def test_thresholds(spark):
    rows = [(0.91234, 1), (0.91236, 1), (0.5, 0), (0.2, 1), (0.95, 0)]
    s = spark.createDataFrame(rows, "p double, y int")

    def slow(target):
        ts = sorted({round(p, 4) for p, _ in rows} | {0.0, 1.0})
        ok = [t for t in ts if any(p >= t for p, _ in rows) and sum(y for p, y in rows if p >= t) / sum(p >= t for p, _ in rows) >= target]
        return min(ok) if ok else 1.01

    for target in (0.5, 0.6, 0.66, 0.9):
        assert confidence.pick_threshold(s, target) == slow(target)
    assert confidence.pick_threshold(s.limit(0), 0.9) == 0.9
    curve = confidence.risk_coverage(s, 11).orderBy("t").collect()
    assert [(round(r.t, 6), r.coverage) for r in curve] == [(round(k / 10, 6), sum(p >= k / 10 for p, _ in rows) / 5) for k in range(11)]


def test_models_are_saved_and_checked(spark, tmp_path):
    m = confidence.Model(general=0.8, trained=True, metrics={"n": 3})
    confidence.save_model(spark, m, str(tmp_path / "m"))
    assert confidence.load_model(spark, str(tmp_path / "m")) == m
    assert confidence.load_model(spark, str(tmp_path / "none")) == confidence.Model()
    confidence.save_model(spark, m._replace(weights=m.weights[:-1]), str(tmp_path / "short"))
    assert "does not match" in confidence.load_model(spark, str(tmp_path / "short")).metrics["note"]
    spark.createDataFrame([('{"features": ["a"]}',)], "value string").write.text(str(tmp_path / "stale"))
    assert "stale" in confidence.load_model(spark, str(tmp_path / "stale")).metrics["note"]


def test_prior_has_a_weight_for_each_feature():
    assert len(confidence.FEATURE_COLUMNS) == len(confidence.PRIOR_WEIGHTS) == len(confidence.FEATURES)


def test_asof_with_buckets_gives_the_same(spark):
    rng = random.Random(31)
    left = [(i, rng.choice("ab"), rng.choice([None, *range(40)])) for i in range(200)]
    right = [(rng.choice("abc"), rng.randrange(40), rng.choice([None, 1, 2, 3, 4])) for _ in range(60)]
    one, two = spark.createDataFrame(left, "i int, k string, o int"), spark.createDataFrame(right, "k string, o int, v int")
    want = {i: max(((o2, v) for k2, o2, v in right if k2 == k and v is not None and o is not None and o2 <= o), default=(None, None))[1] for i, k, o in left}
    for bucket in (None, lambda o: F.floor(o / 7)):
        assert {r.i: r.v for r in joins.asof(one, two, ["k"], "o", "v", bucket).collect()} == want
