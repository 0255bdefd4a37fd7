"""Operators on text over the texts, words and numbers at hand, each with SQL that works on the same text or on the values it was written from."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenia.functions import text as T
from provenia.functions import values as V
from provenia.operators import arbitrate as A
from provenia.operators import delivery as D
from provenia.operators import gate, generators, ledger, rules, sections
from provenia.plans.queries import query, t
from provenia.sources import corpus, responses, sinks
from provenia.sources import reference as R
from provenia.sources.scratch import scratch_dir


def _values(rows) -> str:
    """Rows of a VALUES list."""
    show = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def _spec(**fields):
    """A spec struct; what is not named is null."""
    kinds = {"attribute": "string", "dtype": "string", "unit": "string", "members": "array<string>", "aliases": "array<string>", "table_aliases": "array<string>", "low": "double", "high": "double", "range_end": "string"}
    made = lambda v: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
    return F.struct(*[made(fields.get(k)).cast(kind).alias(k) for k, kind in kinds.items()])


_NONE = "array<string>"

# --- sections ---------------------------------------------------------------------------------

_HEADING = [("A", "F", "Absolute Maximum Ratings"), ("A", "O", "Electrical characteristics"), ("N", "F", "Recommended  operating conditions"), ("N", "O", "Thermal information"), ("R", "F", "Mechanical data"), ("R", "O", "Ordering information ........ 12")]
_SECTION_SQL = f"""
WITH RECURSIVE t AS (SELECT l_orderkey AS k, string_agg(heading || chr(10) || repeat('z ', l_quantity::INT) || chr(10), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS t
  FROM lineitem JOIN (VALUES {_values(_HEADING)}) h(f, s, heading) ON l_returnflag = f AND l_linestatus = s GROUP BY 1),
m AS (SELECT k, t, string_split_regex(t, '(?i)(?:absolute\\s+maximum\\s+ratings|electrical\\s+characteristics|recommended\\s+operating\\s+conditions|thermal\\s+information|mechanical\\s+data|ordering\\s+information)') AS p,
  regexp_extract_all(t, '(?i)(?:absolute\\s+maximum\\s+ratings|electrical\\s+characteristics|recommended\\s+operating\\s+conditions|thermal\\s+information|mechanical\\s+data|ordering\\s+information)') AS h FROM t),
a AS (SELECT k, t, h[i] AS w, (list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[:i-1], lambda x: length(x))), 0))::BIGINT AS off FROM (SELECT *, unnest(generate_series(1, len(h))) AS i FROM m)),
b AS (SELECT k, off, CASE left(lower(w), 2) WHEN 'ab' THEN 'ABS_MAX' WHEN 'el' THEN 'ELEC_CHAR' WHEN 're' THEN 'RECOMMENDED' WHEN 'th' THEN 'THERMAL' ELSE 'MECHANICAL' END AS key FROM a WHERE NOT regexp_matches(substr(t, off + length(w) + 1, 70), '\\.{{3,}}')),
c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY off) AS rn FROM b WHERE NOT (key = 'ELEC_CHAR' AND EXISTS (SELECT 1 FROM b x WHERE x.k = b.k AND x.key = 'ABS_MAX' AND b.off - x.off BETWEEN 0 AND 60))),
f AS (SELECT k, rn, off, key, off AS last_off, key AS last_key, true AS kept FROM c WHERE rn = 1
  UNION ALL SELECT c.k, c.rn, c.off, c.key, if(c.key = last_key AND c.off - last_off < 40, last_off, c.off), if(c.key = last_key AND c.off - last_off < 40, last_key, c.key), NOT (c.key = last_key AND c.off - last_off < 40) FROM f JOIN c ON c.k = f.k AND c.rn = f.rn + 1),
g AS (SELECT * FROM f WHERE kept)
SELECT t.k AS order_key, (SELECT count(*) FROM g WHERE g.k = t.k)::INT AS n_marks, coalesce((SELECT arg_max(key, off) FROM g WHERE g.k = t.k AND off <= length(t) // 2), 'OTHER') AS middle_section, coalesce((SELECT arg_max(key, off) FROM g WHERE g.k = t.k), 'OTHER') AS last_section,
  coalesce((SELECT count(*) FROM g WHERE g.k = t.k AND key = 'ABS_MAX'), 0)::INT AS n_ratings FROM t
"""


@query(_SECTION_SQL)
def section_lookup(spark, d):
    """Headings in texts of unequal length: contents lines, headings that belong to others and repeats don't count; which section lies where."""
    heading = F.create_map(*[F.lit(x) for f, s, h in _HEADING for x in (f + s, h)])
    line = F.concat(F.element_at(heading, F.concat("l_returnflag", "l_linestatus")), F.lit("\n"), F.repeat(F.lit("z "), F.col("l_quantity").cast("int")), F.lit("\n"))
    rows = t(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", line.alias("line")).alias("x"))
    docs = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "").alias("text"))
    marks = docs.select(F.col("l_orderkey").alias("order_key"), F.length("text").alias("n"), sections.section_marks(F.col("text")).alias("marks"))
    count = F.coalesce(F.try_element_at(sections.section_summary(F.col("marks")), F.lit("ABS_MAX")), F.lit(0))
    return marks.select("order_key", F.size("marks").alias("n_marks"), sections.section_at(F.col("marks"), F.floor(F.col("n") / 2)).alias("middle_section"), sections.section_at(F.col("marks"), F.col("n")).alias("last_section"), count.alias("n_ratings"))


@query(r"""
SELECT conv_id, turn, len(regexp_extract_all(substr(text, greatest(mid - 300, 0) + 1, mid + 300 - greatest(mid - 300, 0)), '[A-Za-z][A-Za-z ,.\-]{4,44}\(\s*(?:V|A|mA|μA|uA|pF|nF|W|mW|°C|s|ms|μs|Hz)\s*\)')) >= 2 AS plot
FROM (SELECT conv_id, turn, length(text) // 2 AS mid, regexp_replace(text, '\. ', ' (V) ', 'g') AS text FROM conversations)
""")
def plot_regions(spark, d):
    """Whether two or more axis labels lie around the middle of a text; labels stand where sentences end."""
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.floor(F.length("text") / 2).cast("int").alias("at"), F.regexp_replace("text", r"\. ", " (V) ").alias("text"))
    return rows.select("conv_id", "turn", sections.is_graph_region(F.col("text"), F.col("at")).alias("plot"))


# --- generators -------------------------------------------------------------------------------

_ALIASES = ("version", "with", "que")
_UNIT_SQL = r"(?:°\s?[CF]|[munpkKM]?(?:A|V|W|F|s|Hz)|Ω|ohm|dB|%|℃)"


@query(rf"""
WITH h AS (SELECT doc_id, text, a.no, a.w, string_split(lower(text), a.w) AS p FROM documents, (VALUES {_values([(k, w) for k, w in enumerate(_ALIASES)])}) a(no, w)),
s AS (SELECT doc_id, text, no, w, (list_sum(list_transform(p[:i], lambda x: length(x))) + (i - 1) * length(w))::BIGINT AS s FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS i FROM h)),
n AS (SELECT doc_id, no, s, w, substr(text, s + 1, length(w)) AS hit, substr(text, s + length(w) + 1, 130) AS near FROM s),
m AS (SELECT *, string_split_regex(near, '[-+]?[0-9]+(?:[.,][0-9]+)?') AS p, regexp_extract_all(near, '[-+]?[0-9]+(?:[.,][0-9]+)?') AS m FROM n),
v AS (SELECT *, list_filter(generate_series(1, len(m)), lambda i: NOT regexp_matches(left(p[i + 1], 12), '^(?i)\s*{_UNIT_SQL}\p{{L}}'))[1] AS i FROM m),
r AS (SELECT doc_id, no, s, m[i] || regexp_extract(left(p[i + 1], 12), '^(?i)\s*{_UNIT_SQL}', 0) AS raw, hit || array_to_string(list_transform(generate_series(1, i), lambda j: p[j] || m[j]), '') || regexp_extract(left(p[i + 1], 12), '^(?i)\s*{_UNIT_SQL}', 0) AS quote FROM v WHERE i IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) ORDER BY no, s) AS same FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no, s) AS k FROM q WHERE same = 1)
SELECT doc_id, string_agg(raw, '|' ORDER BY no, s) AS found, count(*)::INT AS n, min(s)::INT AS first_start FROM o WHERE k <= 8 GROUP BY doc_id
""")
def inline_value(spark, d):
    """The first number within 130 characters after each place of some words, in whole texts; each quote once, eight at most."""
    spec = _spec(attribute="x", dtype="number", members=(), aliases=_ALIASES)
    found = generators.inline_spec(F.col("text"), F.lit("X"), spec, F.array().cast(_NONE), F.array().cast(_NONE))
    rows = t(spark, d, "documents").select("doc_id", T.let(found, lambda c: c).alias("c")).where(F.size("c") > 0)
    return rows.select("doc_id", F.array_join(F.transform("c", lambda c: c["raw"]), "|").alias("found"), F.size("c").alias("n"), F.array_min(F.transform("c", lambda c: c["start"])).alias("first_start"))


_RANGES = """
WITH x AS (SELECT c_custkey, -(c_acctbal / 100)::INT AS a, 6 * c_nationkey AS b, c_mktsegment AS seg FROM customer),
r AS (SELECT c_custkey, 1 AS no, a AS low, b AS high, seg NOT IN ('HOUSEHOLD', 'MACHINERY') AS fits, 1 AS units FROM x UNION ALL SELECT c_custkey, 2, a + 10, b - 20, true, 2 FROM x),
g AS (SELECT *, 1 + 0.5 * (units + (high - low >= 50)::INT) AS prec FROM r WHERE fits AND low < high AND low BETWEEN -90 AND 50),
w AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY prec DESC, no) AS rn FROM g)
SELECT x.c_custkey, (w.c_custkey IS NOT NULL)::INT AS n, low::DOUBLE AS low, prec::DOUBLE AS precision FROM x LEFT JOIN w ON w.c_custkey = x.c_custkey AND rn = 1
"""


@query(_RANGES)
def range_value(spark, d):
    """The low end of the better of two ranges: with its unit stated, of the right kind, in order and plausible."""
    a, b = -F.round(F.col("c_acctbal") / 100).cast("int"), 6 * F.col("c_nationkey")
    shown = lambda x: F.replace(x.cast("string"), F.lit("-"), F.lit("−"))
    unit = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "").when(F.col("c_mktsegment") == "MACHINERY", " V").otherwise(" °C")
    text = F.concat(F.lit("Storage Temperature "), shown(a), F.lit(" to "), shown(b), unit, F.lit("; else storage temperature "), (a + 10).cast("string"), F.lit(" °C to "), (b - 20).cast("string"), F.lit(" °C."))
    spec = _spec(range_end="min", aliases=("storage temperature",), unit="degC", low=-90.0, high=50.0)
    c = generators.range_end(text, F.lit("X"), spec, F.array(), F.array().cast(_NONE))
    got = t(spark, d, "customer").select("c_custkey", T.let(c, lambda x: x).alias("c"))
    return got.select("c_custkey", F.size("c").alias("n"), V.minus(F.try_element_at("c", F.lit(1))["raw"]).cast("double").alias("low"), F.try_element_at("c", F.lit(1))["precision"].alias("precision"))


_TABLE = "WITH x AS (SELECT l_orderkey AS o, l_partkey AS part, sum(l_quantity)::INT AS q, max(l_extendedprice) AS e, max(l_discount) AS f FROM lineitem GROUP BY ALL), n AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY o ORDER BY part) AS pos, first_value(q) OVER (PARTITION BY o ORDER BY part) AS q1, max(f) OVER w AS shared FROM x WINDOW w AS (PARTITION BY o))"


@query(_TABLE + """
SELECT o, part, 'QTY' AS attribute, q::DOUBLE AS value, (pos - 1)::INT AS column_index, 3.0::DOUBLE AS precision FROM n WHERE n > 1 AND q <= 45
UNION ALL SELECT o, part, 'PRICE', e, (pos - 1)::INT, 3.0 FROM n WHERE n > 1
UNION ALL SELECT o, part, 'FEW', q1, -1, 1.2 FROM n WHERE n = 2
UNION ALL SELECT o, part, 'ONE', shared, -1, 1.2 FROM n WHERE n > 1
""")
def series_table(spark, d):
    """Series tables of orders and the parts in them: each part's own column, a value for all, and rows with too few values."""
    each = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").cast("int").alias("q"), F.max("l_extendedprice").alias("e"), F.max("l_discount").alias("f"))
    docs = each.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("part", "q", "e"))).alias("of"), F.max("f").alias("f"))
    of, name = F.col("of"), lambda x: F.concat(F.lit("P"), x["part"].cast("string"), F.lit("E"))
    cells = lambda f, xs: F.array_join(F.transform(xs, lambda x: F.translate(x[f].cast("decimal(18,2)").cast("string"), ".", ",") if f == "e" else x[f].cast("string")), " ")
    text = F.concat(F.lit("Parameter\t"), F.array_join(F.transform(of, name), " | "), F.lit(" Unit\nQTY "), cells("q", of), F.lit(" V\nPRICE |"), cells("e", of), F.lit("\nEND\nFEW "), cells("q", F.slice(of, 1, F.size(of) - 1)), F.lit(" A\nONE "), F.col("f").cast("string"), F.lit(" %\n"))
    spec = F.explode(F.array(*[_spec(attribute=a, dtype="number", table_aliases=(a,), high=45.0 if a == "QTY" else None) for a in ("QTY", "PRICE", "FEW", "ONE")])).alias("spec")
    tables = docs.where(F.size("of") > 1).select("o", "of", text.alias("text"), F.transform(of, name).alias("siblings"))
    work = tables.withColumn("headers", generators.series_headers(F.col("text"), F.col("siblings"))).select("*", spec)
    # A table's rows are read once for all of its parts.
    columns = generators.table_columns(F.col("text"), F.col("spec"), F.col("siblings"), F.col("headers"))
    own = F.transform(columns, lambda cs, k: F.transform(cs, lambda c: F.struct(F.get("of", k)["part"].alias("part"), c["raw"].alias("raw"), c["column_index"].alias("column_index"), c["precision"].alias("precision"))))
    rows = work.select("o", "spec.attribute", F.explode(F.flatten(own)).alias("c"))
    return rows.select("o", "c.part", "attribute", F.col("c.raw").cast("double").alias("value"), "c.column_index", "c.precision")


@query("SELECT conv_id, turn, CASE WHEN role <> 'system' THEN role = 'assistant' END AS found, CASE WHEN role <> 'system' THEN role END AS value, CASE WHEN role <> 'system' THEN text END AS quote FROM conversations")
def parse_response(spark, d):
    """Replies that carry whole texts: the first tool call gives them back; a reply without one gives nothing."""
    call = lambda found, value, quote: F.struct(F.struct(F.struct(found.alias("found"), value.alias("value"), quote.alias("quote")).alias("input")).alias("toolUse"))
    some = F.array(call(F.col("role") == "assistant", F.col("role"), F.col("text")), call(F.lit(True), F.lit("later"), F.lit("later")))
    reply = lambda content: F.to_json(F.struct(F.struct(F.struct(content.alias("content")).alias("message")).alias("output")))
    raw = F.when(F.col("role") == "system", reply(F.array(F.struct(F.col("text"))))).otherwise(reply(some))
    return t(spark, d, "conversations").select("conv_id", "turn", T.let(generators.parse_response(raw), lambda r: r).alias("r")).select("conv_id", "turn", "r.found", "r.value", "r.quote")


_SEEN = ("thatin", "orantion")


@query(f"""
WITH h AS (SELECT doc_id, text, a.no, a.w, string_split(lower(text), a.w) AS p FROM documents, (VALUES {_values([(k, w) for k, w in enumerate(_SEEN)])}) a(no, w)),
s AS (SELECT doc_id, text, no, w, (list_sum(list_transform(p[:i], lambda x: length(x))) + (i - 1) * length(w))::BIGINT AS s FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS i FROM h)),
b AS (SELECT *, greatest(s - 400, 0) AS w0, least(length(text), s + length(w) + 700) AS w1 FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, w0 // 500 ORDER BY no, s) AS same FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no, s) - 1 AS window_no FROM f WHERE same = 1)
SELECT doc_id, window_no::INT AS window_no, w0::INT AS window_start, sha256(substr(text, w0 + 1, w1 - w0)) AS window_sha256 FROM o WHERE window_no < 3
""")
def model_windows(spark, d):
    """Regions of whole texts around some words that a model would be shown: one for each 500 characters, three at most."""
    spec = F.array(_spec(attribute="x", aliases=_SEEN))
    work = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sku"), "doc_id", "text", spec.alias("specs"))
    return generators.llm_windows(work).select("doc_id", "window_no", "window_start", F.sha2("window", 256).alias("window_sha256"))


# --- values -----------------------------------------------------------------------------------

_STATED = [("1-URGENT", "mA", 0.001), ("2-HIGH", "kA", 1000.0), ("3-MEDIUM", " A", 1.0), ("4-NOT SPECIFIED", " V", None), ("5-LOW", "", 1.0)]


@query(f"""
SELECT o_orderkey, round(o_totalprice * scale, 6) AS num, CASE WHEN scale IS NULL THEN '' ELSE printf('%g', round(o_totalprice * scale, 6)) || ' A' END AS display, CASE WHEN scale IS NULL THEN 'unit ''V'' not compatible with ''A''' ELSE '' END AS error
FROM orders JOIN (VALUES {_values(_STATED)}) u(p, unit, scale) ON o_orderpriority = p
""")
def normalize_number(spark, d):
    """Amounts in words with several units and decimal commas, as one unit."""
    unit = F.element_at(F.create_map(*[F.lit(x) for p, u, _ in _STATED for x in (p, u)]), F.col("o_orderpriority"))
    shown = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    raw = F.concat(F.lit("  about "), F.when(F.col("o_orderstatus") == "P", F.translate(shown, ".", ",")).otherwise(shown), unit)
    v = V.normalize_value(raw, F.lit("number"), F.lit("A"), F.array().cast(_NONE), F.lit(""))
    return t(spark, d, "orders").select("o_orderkey", T.let(v, lambda x: x).alias("v")).select("o_orderkey", "v.num", "v.display", "v.error")


_TRUE = ["yes", "true", "compliant", "rohs-compliant", "rohs compliant", "lead free", "lead-free", "pb-free", "pb free", "halogen free", "y", "adjustable"]
_FALSE = ["no", "false", "non-compliant", "not compliant", "n", "fixed"]
_NOUNS = ("WIDGET", "ANVIL", "GEAR", "OLD_RING", "ROD")


@query(f"""
WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS word FROM conversations UNION SELECT DISTINCT p_name FROM part),
x AS (SELECT word, lower(trim(word)) AS l, trim(regexp_replace(lower(trim(word)), '[^a-z0-9]+', '_', 'g'), '_') AS e FROM w)
SELECT word, CASE WHEN list_contains({_TRUE}, l) THEN true WHEN list_contains({_FALSE}, l) THEN false WHEN len(list_filter({_TRUE}, lambda t: strpos(l, t) > 0)) > 0 THEN true WHEN len(list_filter({_FALSE}, lambda t: strpos(l, t) > 0)) > 0 THEN false END AS flag,
  coalesce(list_filter({list(_NOUNS)}, lambda v: lower(v) = e)[1], list_filter({list(_NOUNS)}, lambda v: strpos(e, lower(v)) > 0 OR strpos(lower(v), e) > 0)[1]) AS member FROM x
""")
def flags_and_members(spark, d):
    """Every word of the conversations and every part's name as a boolean and as a member of a closed list."""
    words = t(spark, d, "conversations").select(F.explode(F.split("text", r"\s+")).alias("word")).union(t(spark, d, "part").select("p_name")).distinct()
    return words.select("word", V.to_bool(F.col("word")).alias("flag"), V.canon_enum(F.col("word"), F.array(*map(F.lit, _NOUNS))).alias("member"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, abs(l_extendedprice - round(l_extendedprice, -3)) <= 0.02 * greatest(1, abs(round(l_extendedprice, -3))) AS number_ok,
  starts_with(upper(p_brand), 'BRAND#' || p_size) OR starts_with('BRAND#' || p_size, upper(p_brand)) AS text_ok, (l_returnflag = 'R') = (l_linestatus = 'F') AS flag_ok FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def label_match(spark, d):
    """Numbers within 2 %, texts as prefixes without blanks and case, flags by truth."""
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    none = {"num": F.lit(None).cast("double"), "str": F.lit(None).cast("string"), "flag": F.lit(None).cast("boolean")}
    one = lambda **k: F.array(F.struct(*[(none | k)[f].alias(f) for f in none]))
    price = F.col("l_extendedprice")
    number = V.label_matches(price, none["str"], none["flag"], one(num=F.round(price, -3)))
    text = V.label_matches(none["num"], F.col("p_brand"), none["flag"], one(str=F.concat(F.lit("brand # "), "p_size")))
    flag = V.label_matches(none["num"], none["str"], F.col("l_returnflag") == "R", one(flag=F.col("l_linestatus") == "F"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", number.alias("number_ok"), text.alias("text_ok"), flag.alias("flag_ok"))


# --- delivery ---------------------------------------------------------------------------------

_KINDS = ("24 in dishwasher", "stacked  laundry   center", "gas dryer", "Dryer vent", "top load WASHER", "dishwashers", "cooktop", "gas range cooktop", "charcoal grill", "ranger hat", "OTR microwave", "chest freezer", "freezer refrigerator", "bottom fridge", "wash basin", "washer dryer laundrycenter", "range-hood", "hinge")
_MAKERS = ("Kitchen  Aid", "SQ", "ge", "General Electric", "CAFÉ", "cafe", "MAYTAG", "Whirlpool", "LGX", "LG", "Speed   Queen", "Frigidaire", "Orange", "KitchenAid", "GEAR")
_PHRASES = [(k + 1, f"{_MAKERS[k % len(_MAKERS)]} {_KINDS[k % len(_KINDS)]}" if k % 4 else f"{_KINDS[k % len(_KINDS)]} by {_MAKERS[(k * 7) % len(_MAKERS)]}") for k in range(50)]
_LOWER_ALIASES = [(k, v) for k, v in R.BRAND_ALIASES.items()]


def _named(spark, d):
    """part with a phrase of its size."""
    phrases = spark.createDataFrame(_PHRASES, "size int, phrase string")
    return t(spark, d, "part").join(F.broadcast(phrases), F.col("p_size") == F.col("size")).withColumn("desc", F.concat_ws(" ", "p_name", "phrase"))


_NAMED = f"n AS (SELECT p.*, p_name || ' ' || phrase AS d FROM part p JOIN (VALUES {_values(_PHRASES)}) f(size, phrase) ON p_size = size)"


@query(f"WITH {_NAMED} SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(d, '(?i){c[1]}') THEN '{c[0]}'" for c in R.CATEGORIES) + " END AS category FROM n")
def classify(spark, d):
    """Ordered patterns: the first that matches names the category."""
    return _named(spark, d).select("p_partkey", D.classify(F.col("desc")).alias("category"))


@query(rf"""WITH {_NAMED}, b AS (SELECT p_partkey, upper(regexp_replace(regexp_extract(d, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(Kitchen\s*Aid|Speed\s*Queen|Frigidaire|Whirlpool|Maytag|Café|Cafe|GE|LG|SQ)(?:$|[^\p{{L}}\p{{N}}_])', 1), '\s+', ' ', 'g')) AS k FROM n),
k AS (SELECT p_partkey, a.v AS brand_key FROM b LEFT JOIN (VALUES {_values(_LOWER_ALIASES)}) a(k, v) ON a.k = b.k)
SELECT p_partkey, brand_key, m.d AS brand_display FROM k LEFT JOIN (VALUES {_values([(b[0], b[1]) for b in R.BRANDS])}) m(k, d) ON brand_key = m.k""")
def brand_resolve(spark, d):
    """The leftmost brand of a description, by any of its names, and how it is displayed."""
    keyed = _named(spark, d).select("p_partkey", D.brand_key(F.col("desc")).alias("brand_key"))
    return keyed.join(F.broadcast(R.brands(spark)), "brand_key", "left").select("p_partkey", "brand_key", "brand_display")


_SPELT = [(k, u) for k, u in enumerate([*R.UOM, "furlong", "Volts.", " AMPS ", "Hours...", "sq ft", "dba ", "", "KW-HR"])]


@query(rf"""
WITH n AS (SELECT p_partkey, u.raw, p_size || CASE p_type WHEN 'SMALL' THEN '-1/4' WHEN 'LARGE' THEN ' 1/2 ' WHEN 'PROMO' THEN '.5' ELSE '' END || CASE p_brand WHEN 'Brand#1' THEN ' inches' WHEN 'Brand#2' THEN '' WHEN 'Brand#3' THEN ' x 5 in' ELSE ' IN' END AS said FROM part JOIN (VALUES {_values(_SPELT)}) u(k, raw) ON p_size - 1 = u.k),
k AS (SELECT *, regexp_replace(lower(trim(raw)), '\.+$', '') AS key, trim(regexp_extract(said, '(?i)^([-0-9/. ]+)\s*in(?:$|[^\p{{L}}\p{{N}}_])', 1)) AS v FROM n)
SELECT p_partkey, coalesce(m.v, trim(raw)) AS unit, m.v IS NOT NULL AS known, CASE WHEN k.v <> '' THEN k.v ELSE trim(said) END AS value, CASE WHEN k.v <> '' THEN 'in' ELSE '' END AS uom FROM k LEFT JOIN (VALUES {_values(R.UOM.items())}) m(k, v) ON m.k = k.key
""")
def uom(spark, d):
    """Spellings of units as delivered, and values parted from the expected unit."""
    spelt = spark.createDataFrame(_SPELT, "k int, raw string")
    tail = F.when(F.col("p_type") == "SMALL", "-1/4").when(F.col("p_type") == "LARGE", " 1/2 ").when(F.col("p_type") == "PROMO", ".5").otherwise("")
    unit = F.when(F.col("p_brand") == "Brand#1", " inches").when(F.col("p_brand") == "Brand#2", "").when(F.col("p_brand") == "Brand#3", " x 5 in").otherwise(" IN")
    rows = t(spark, d, "part").join(F.broadcast(spelt), F.col("p_size") - 1 == F.col("k"))
    done = rows.select("p_partkey", D.normalize_uom(F.col("raw")).alias("u"), D.split_value_unit(F.concat("p_size", tail, unit), F.lit("in")).alias("v"))
    return done.select("p_partkey", "u.unit", "u.known", "v.value", "v.uom")


@query(f"""
SELECT p_partkey, url_pos, url FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY no) - 1 AS url_pos, url FROM (
  SELECT p_partkey, 0 AS no, s.u || p_partkey AS url FROM part JOIN (VALUES {_values([(k, b[0], b[3]) for k, b in enumerate(R.BRANDS)])}) b(k, key, domain) ON p_size % 8 = b.k JOIN (VALUES {_values(R.SUPPORT_SEARCH.items())}) s(key, u) ON s.key = b.key
  UNION ALL SELECT p_partkey, 1, 'https://' || domain || '/en/p/owner-center/product-support/' || p_partkey FROM part JOIN (VALUES {_values([(k, b[3]) for k, b in enumerate(R.BRANDS)])}) b(k, domain) ON p_size % 8 = b.k
  UNION ALL SELECT p_partkey, 2, 'https://' || domain || '/search?q=' || p_partkey FROM part JOIN (VALUES {_values([(k, b[3]) for k, b in enumerate(R.BRANDS)])}) b(k, domain) ON p_size % 8 = b.k))
""")
def candidate_urls(spark, d):
    """Where to look for each part, in order."""
    keys = F.array(*[F.lit(b[0]) for b in R.BRANDS])
    rows = t(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("mpn"), F.element_at(keys, (F.col("p_size") % 8 + 1).cast("int")).alias("brand_key")).join(F.broadcast(R.brands(spark)), "brand_key")
    return corpus.candidate_urls(rows, R.SUPPORT_SEARCH).select("p_partkey", F.col("url_pos").cast("long").alias("url_pos"), "url")


@query(r"""
WITH u AS (SELECT page_id, url, string_split(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '.') AS l, regexp_extract(url, '^https?://[^/]+/([^/]*)', 1) AS mpn FROM pages),
b AS (SELECT l[-2] || '.' || l[-3] AS k, l[-3] AS token, min(page_id) AS id FROM u WHERE l[-1] = 'net' GROUP BY ALL),
e AS (SELECT mpn, page_id, url, unnest(l[:len(l) - 1]) AS token, unnest(generate_series(1, len(l) - 1)) AS pos FROM u),
h AS (SELECT mpn, page_id, pos, e.url, b.token FROM e JOIN b USING (token))
SELECT mpn, arg_min(token, (page_id, pos)) AS brand_key, arg_min(url, (page_id, pos)) AS url FROM h GROUP BY mpn
""")
def domain_search(spark, d):
    """The first search result, plain or wrapped in a redirect, on a known maker's domain, regional ones included."""
    labels = F.split(corpus.host(F.col("url")), r"\.")
    rows = t(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://[^/]+/([^/]*)", 1).alias("mpn"), labels.alias("l"))
    makers = rows.where(F.element_at("l", -1) == "net").select(F.element_at("l", -3).alias("brand_key")).distinct().select("brand_key", F.concat("brand_key", F.lit(".net")).alias("domain"))
    href = F.when(F.col("url").startswith("https"), F.concat(F.lit("//go.example/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))).otherwise(F.col("url"))
    return corpus.brand_of_results(rows.select("mpn", F.col("page_id").alias("rank"), href.alias("href")), makers)


@query(r"""
WITH w AS (SELECT doc_id, string_split_regex(trim(text), '\s+') AS w FROM documents),
x AS (SELECT doc_id, regexp_replace(lower(coalesce(w[1], '')), '[^a-z]', '', 'g') AS p, regexp_replace(lower(coalesce(if(len(w) > 60, w[2], upper(w[1]) || ' Inc'), '')), '[^a-z]', '', 'g') AS b FROM w)
SELECT doc_id, CASE WHEN p <> '' AND b <> '' AND (starts_with(p, left(b, 6)) OR starts_with(b, left(p, 6))) THEN 'MFR_DATASHEET' ELSE 'AUTHORIZED_DIST' END AS authority, CASE WHEN p <> '' AND b <> '' AND (starts_with(p, left(b, 6)) OR starts_with(b, left(p, 6))) THEN 1.0::DOUBLE ELSE 0.4 END AS weight FROM x
""")
def brand_authority(spark, d):
    """A document's first word as publisher, its second or the first in capitals as brand: whether either begins with the other's letters."""
    w = F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+")
    # Letter by letter: what is two letters in capitals (ß) stays as it is, as in SQL.
    loud = F.array_join(F.transform(F.split(w[0], ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")
    rows = t(spark, d, "documents").select("doc_id", F.lit("MFR_DATASHEET").alias("authority"), w[0].alias("publisher"), F.when(F.size(w) > 60, F.try_element_at(w, F.lit(2))).otherwise(F.concat(loud, F.lit(" Inc"))).alias("brand"))
    return A.brand_authority(rows).select("doc_id", "authority", A.tier_weight(A.authority_tier(F.col("authority"))).alias("weight"))


# --- documents and files ----------------------------------------------------------------------


@query("SELECT doc_id, lang <> 'de' AND source <> 'src1' AS from_cache, sha256(CASE WHEN source = 'src1' THEN text || ' more' ELSE text END) AS text_sha256 FROM documents")
def text_cache(spark, d):
    """Texts by digest: those of one language were never decoded, those of one source have changed since; only these are decoded."""
    docs = t(spark, d, "documents").select("doc_id", "text", "lang", "source")
    path = scratch_dir(spark)
    known = docs.where("lang <> 'de'").withColumn("sha256", F.sha2("text", 256)).select("doc_id", "sha256", "text")
    corpus.write_text_cache(known, path)
    now = docs.select("doc_id", F.when(F.col("source") == "src1", F.concat("text", F.lit(" more"))).otherwise(F.col("text")).alias("text")).withColumn("sha256", F.sha2("text", 256))
    got = corpus.through_cache(now.select("doc_id", "sha256"), now.select("doc_id", "sha256", "text"), path)
    return got.select("doc_id", "from_cache", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'src1'")
def stale_cache(spark, d):
    """Documents for which the cache has no text of the same digest."""
    docs = t(spark, d, "documents")
    cache = docs.where("lang <> 'de'").select("doc_id", F.sha2("text", 256).alias("sha256"))
    now = docs.select("doc_id", F.sha2(F.when(F.col("source") == "src1", F.concat("text", F.lit(" more"))).otherwise(F.col("text")), 256).alias("sha256"))
    return corpus.stale(now, cache).select("doc_id")


@query(r"""
WITH r AS (SELECT page_id, html, upper(split_part(split_part(url, '/', 3), '.', 1)) AS term, CASE WHEN url LIKE 'https://m.%' THEN 404 ELSE 200 END AS status, url LIKE '%.com/%' AS pdf, url LIKE '%ref=%' AS failed FROM pages)
SELECT page_id, status, NOT failed AND status < 400 AND NOT pdf AS ok, CASE WHEN failed THEN 'timed out' WHEN status >= 400 THEN 'HTTP 404' WHEN pdf THEN 'PDF asset (not text-extracted)' ELSE '' END AS reason,
  NOT failed AND status < 400 AND NOT pdf AND (strpos(upper(html), term) > 0 OR regexp_matches(html, '(?i)\b(voltage|amperage|dimensions|specifications|dBA|cu\.?\s*ft)\b')) AS content FROM r
""")
def page_fetch(spark, d):
    """Recorded responses: failures, status, kind and content of pages served as text."""
    url = F.col("url")
    rows = t(spark, d, "pages").select("page_id", "url", F.col("html").alias("body"), F.when(url.like("https://m.%"), 404).otherwise(200).alias("status"), F.when(url.like("%.com/%"), "application/pdf").otherwise("text/plain").alias("content_type"), F.when(url.like("%ref=%"), "timed out").otherwise("").alias("error"))
    term = F.split(F.split("url", "/")[2], r"\.")[0]
    return corpus.fetched_pages(rows).select("page_id", "status", "ok", "reason", (F.col("ok") & corpus.has_content(F.col("text"), term)).alias("content"))


@query(r"SELECT doc_id, sha256(text) AS sha256, 'https://x/' || source AS url, '2024-01-01' AS fetched_at FROM documents")
def lock_file(spark, d):
    """The lock written as JSON lines and read again."""
    path = scratch_dir(spark)
    sinks.write_lock(t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.concat(F.lit("https://x/"), "source").alias("url"), F.lit("2024-01-01").alias("fetched_at")), path)
    return spark.read.schema("doc_id long, sha256 string, url string, fetched_at string").json(path)


@query("SELECT conv_id::VARCHAR AS mpn, CASE WHEN role = 'user' THEN 'REVIEW' ELSE 'AUTO_PUBLISH' END AS decision, (turn / 8.0)::DOUBLE AS confidence, text || ' | \"' || role || '\", a' AS reasons FROM conversations")
def review_log(spark, d):
    """The review log as CSV, with quotes, commas and line breaks in its texts, and read again."""
    path = scratch_dir(spark)
    rows = t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("Mfg_Part_Num"), F.when(F.col("role") == "user", "REVIEW").otherwise("AUTO_PUBLISH").alias("decision"), (F.col("turn") / 8).alias("confidence"), F.array("text", F.concat(F.lit('"'), "role", F.lit('", a'))).alias("reasons"))
    sinks.write_review_log(rows, path)
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("mpn string, decision string, confidence double, reasons string").csv(path)


@query(f"WITH {_NAMED} SELECT p_partkey::VARCHAR AS \"Mfg_Part_Num\", d AS \"Part_Desc\", CASE p_type WHEN 'SMALL' THEN 'Excluded Inc' WHEN 'LARGE' THEN NULL ELSE p_brand END AS \"Part_Manuf\" FROM n WHERE p_type <> 'SMALL'")
def catalog_file(spark, d):
    """The catalog as a CSV file, read without a maker that is left out."""
    path = scratch_dir(spark)
    maker = F.when(F.col("p_type") == "SMALL", "Excluded Inc").when(F.col("p_type") != "LARGE", F.col("p_brand"))
    _named(spark, d).select(F.col("p_partkey").cast("string").alias("Mfg_Part_Num"), F.col("desc").alias("Part_Desc"), maker.alias("Part_Manuf")).write.option("header", True).option("escape", '"').csv(path)
    return corpus.catalog_rows(spark, path, ("Excluded Inc",))


@query("""
SELECT p_partkey::VARCHAR AS sku, p_name AS attribute, CASE p_partkey % 3 WHEN 2 THEN 0 ELSE 1 END AS n, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE p_size END::DOUBLE AS largest, p_partkey % 3 = 1 AND p_type = 'PROMO' AS any_promo, '' AS reason FROM part WHERE p_partkey % 50 <> 7
UNION ALL SELECT '', '', 0, NULL, false, CASE WHEN p_partkey % 100 = 7 THEN 'no JSON' ELSE 'no sku' END FROM part WHERE p_partkey % 50 = 7
""")
def gold_file(spark, d):
    """Labels as lines of JSON, a record for each part: one value or a list, numbers, texts and flags; broken records as errors."""
    path = scratch_dir(spark)
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    listed = F.concat(F.lit("["), size, F.lit(","), (F.col("p_type") == "PROMO").cast("string"), F.lit(',"text"]'))
    value = F.when(key % 3 == 0, size).when(key % 3 == 1, listed).otherwise(F.concat(F.lit('"size '), size, F.lit('"')))
    labels = F.concat(F.lit('"labels":{"'), "p_name", F.lit('":'), value, F.lit("}}"))
    line = F.concat(F.lit('{"sku":"'), key, F.lit('",'), labels)
    broken = F.when(key % 100 == 7, F.left(line, F.length(line) - 3)).otherwise(F.concat(F.lit("{"), labels))
    t(spark, d, "part").select(F.when(key % 50 == 7, broken).otherwise(line).alias("value")).write.text(path)
    number = F.filter("accepted", lambda a: a["num"].isNotNull())
    flagged = F.exists("accepted", lambda a: F.coalesce(a["flag"], F.lit(False)))
    read = corpus.gold_labels(spark, path).select("sku", "attribute", F.size(number).alias("n"), F.array_max(F.transform(number, lambda a: a["num"])).alias("largest"), flagged.alias("any_promo"), F.lit("").alias("reason"))
    nothing = F.lit("")
    return read.unionByName(corpus.gold_errors(spark, path).select(nothing.alias("sku"), nothing.alias("attribute"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("largest"), F.lit(False).alias("any_promo"), "reason"))


@query(r"""
WITH p AS (SELECT page_id, url, html, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages)
SELECT page_id::VARCHAR AS page_id, host, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 404 ELSE 200 END::INT AS status, CASE WHEN page_id % 11 = 0 THEN 'timed out' WHEN page_id % 7 = 0 THEN 'HTTP 404' END AS error, sha256(html) AS sha256,
  page_id % 11 <> 0 AND page_id % 7 <> 0 AND page_id % 2 = 0 AS fresh
FROM p WHERE host IN (SELECT min(host) FROM p UNION SELECT max(host) FROM p UNION SELECT arg_max(host, length(html)) FROM p)
""")
def recorded_pages(spark, d):
    """Pages recorded as an archive of responses: three hosts are read back, no file of another, and those that the cache lacks marked."""
    path = scratch_dir(spark)
    page = F.col("page_id")
    lost, gone = page % 11 == 0, page % 7 == 0
    made = t(spark, d, "pages").select(page, F.concat("url", F.lit("#"), page).alias("url"), F.when(lost, None).when(gone, 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"), F.when(lost, "timed out").alias("error"))
    responses.record(made, path)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    hosts = t(spark, d, "pages").select(host.alias("h"), F.length("html").alias("n")).agg(F.min("h"), F.max("h"), F.max_by("h", "n")).first()
    found = responses.responses(spark, path).where(F.col("host").isin(*hosts))
    number = F.element_at(F.split("url", "#"), -1)
    cache = found.where(number.cast("long") % 2 == 1).select("url", "sha256")
    new = responses.fresh(found, cache).select("url", F.lit(True).alias("new"))
    return found.join(new, "url", "left").select(number.alias("page_id"), "host", "status", "error", "sha256", F.coalesce("new", F.lit(False)).alias("fresh"))


# --- evidence ---------------------------------------------------------------------------------


@query("""
WITH q AS (SELECT conv_id, turn, text, (turn * 3) % 7 AS s FROM conversations), c AS (SELECT conv_id, turn, text, s, least(s + 40, length(text)) AS e, CASE role WHEN 'system' THEN NULL WHEN 'user' THEN substr(text, s + 1, 40) ELSE 'zq ' || substr(text, s + 1, 40) END AS quote, role FROM q JOIN conversations USING (conv_id, turn, text))
SELECT conv_id, turn, role = 'user' AND length(trim(quote)) > 0 AS verified FROM c
""")
def verify_all(spark, d):
    """Claims on texts: those that the text has pass, invented ones and those of unknown documents don't."""
    rows = t(spark, d, "conversations").withColumns({"doc_id": F.concat_ws("/", "conv_id", "turn"), "s": (F.col("turn") * 3 % 7).cast("int")})
    docs = rows.where("role <> 'system'").select("doc_id", "text", F.array(F.struct(F.lit(1).alias("page"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"))).alias("pages"))
    part = F.substring("text", F.col("s") + 1, F.lit(40))
    claims = rows.select("conv_id", "turn", "doc_id", F.col("s").alias("start"), F.least(F.col("s") + 40, F.length("text")).alias("end"), F.when(F.col("role") == "user", part).otherwise(F.concat(F.lit("zq "), part)).alias("quote"))
    passed, failed = gate.verify_all(claims, docs)
    return passed.select("conv_id", "turn", F.lit(True).alias("verified")).unionByName(failed.select("conv_id", "turn", F.lit(False).alias("verified")))


@query("""
SELECT conv_id, turn, length(text) // 2 AS at, substr(text, greatest(length(text) // 2 - 240, 0) + 1, length(text) // 2 + 240 - greatest(length(text) // 2 - 240, 0)) AS near,
  strpos(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'que') > 0 OR strpos(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'of the') > 0 AS has_words FROM conversations
""")
def text_windows(spark, d):
    """What lies around the middle of a text, and whether it has some words with any white space between them."""
    at = F.floor(F.length("text") / 2).cast("int")
    has = T.contains_quote(F.col("text"), F.lit("QUE")) | T.contains_quote(F.col("text"), F.lit("Of  the"))
    return t(spark, d, "conversations").select("conv_id", "turn", at.cast("long").alias("at"), T.window(F.col("text"), at).alias("near"), has.alias("has_words"))


@query("SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, -1, '' FROM conversations GROUP BY conv_id")
def page_texts(spark, d):
    """The text of each page out of the joined text; a page that is not there is empty."""
    pages = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    docs = corpus.document_text(pages).select(F.col("doc_id").alias("conv_id"), "text", "pages", F.explode(F.concat(F.transform("pages", lambda p: p["page"]), F.array(F.lit(-1)))).alias("turn"))
    return docs.select("conv_id", "turn", T.page_text(F.col("text"), F.col("pages"), F.col("turn")).alias("text"))


# --- rules, log, rows -------------------------------------------------------------------------

_LIMITS = [(s[0], s[8], s[9]) for s in R.CLASSES["RECTIFIER_DIODE"] if s[8] is not None]
_WIDE = "w AS (SELECT p_partkey AS sku, p_retailprice AS reverse_voltage_max, p_size * 3.0 AS forward_current_avg, p_size / 10.0 AS forward_voltage_max, p_retailprice / p_size AS surge_current_max, p_size * 2 - 40.0 AS operating_temp_min, 60.0 - p_size AS operating_temp_max FROM part)"


def _diodes(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    of = {"reverse_voltage_max": price, "forward_current_avg": size * 3.0, "forward_voltage_max": size / 10.0, "surge_current_max": price / size, "operating_temp_min": size * 2 - 40.0, "operating_temp_max": 60.0 - size}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), v.cast("double").alias("value_num")) for k, v in of.items()]))
    return t(spark, d, "part").select(F.col("p_partkey").alias("sku"), F.lit("RECTIFIER_DIODE").alias("class_key"), each.alias("x")).select("sku", "class_key", "x.*")


@query(f"""WITH {_WIDE}, v AS (UNPIVOT w ON COLUMNS(* EXCLUDE (sku)) INTO NAME attribute VALUE v) SELECT sku, attribute, '[error] ' || printf('%g', v) || ' outside plausible range [' || printf('%g', low) || ', ' || printf('%g', high) || ']' AS message
FROM v JOIN (VALUES {_values([(a, float(lo), float(hi)) for a, lo, hi in _LIMITS])}) l(attribute, low, high) USING (attribute) WHERE v < low OR v > high""")
def range_violations(spark, d):
    """Numbers outside their attribute's bounds."""
    return rules.range_violations(_diodes(spark, d))


@query(f"WITH {_WIDE} " + " UNION ALL ".join(f"SELECT sku, '{o}' AS attribute, '[{r[5]}] {r[4]}' AS message FROM w WHERE NOT ({r[3]})" for r in R.RULES if r[0] == "RECTIFIER_DIODE" for o in r[2]))
def rule_set(spark, d):
    """The engine's own rules: each violation on every operand."""
    return rules.violations(_diodes(spark, d))


@query("SELECT event_id AS id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_newest(spark, d):
    """The newest two hundred events of all parts."""
    rows = t(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").cast("string").alias("sku"))
    return ledger.newest(rows).select("id", "ts")


@query("""
SELECT user_id::VARCHAR AS sku, 'a' || event_id % 3 AS attribute, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN value END) AS largest FROM events
WHERE event_type IN ('click', 'error') OR event_type = 'purchase' AND value >= 10 GROUP BY ALL
""")
def record_review(spark, d):
    """Reviews as audit events; a correction to nothing is refused; the log is appended to and read again."""
    kind = F.col("event_type")
    action = F.when(kind == "click", "ACCEPT").when(kind == "error", "REJECT").when(kind == "purchase", "CORRECT").otherwise(kind)
    value = F.when(F.col("value") >= 10, F.col("value").cast("string")).otherwise("  ")
    reviews = t(spark, d, "events").select("ts", F.col("user_id").cast("string").alias("sku"), F.concat(F.lit("a"), F.col("event_id") % 3).alias("attribute"), action.alias("action"), F.lit("x").alias("actor"), value.alias("corrected_value"), F.lit("n").alias("note"))
    path = scratch_dir(spark)
    sinks.append_audit(ledger.review_rows(reviews.where("action <> 'CORRECT'")), path)
    sinks.append_audit(ledger.review_rows(reviews.where("action = 'CORRECT'")), path)
    got = spark.read.parquet(path)
    said = F.when(F.col("action") == "CORRECT", F.get_json_object("detail", "$.corrected_value").cast("double"))
    return got.groupBy("sku", "attribute").agg(F.count("*").alias("n"), F.max(said).alias("largest"))
