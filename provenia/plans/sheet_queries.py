"""The datasheet engine end to end, over sheets written from the table of parts, with SQL on the table itself.

Each part stands in two sheets: one of its brand and size, and a rival's of its name and
size. A sheet of several parts is a series table, one of a single part is prose. The
operators read the values back from the texts; the SQL never sees a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.operators import generators
from provenia.plans import datasheet, evaluate
from provenia.plans.queries import query, t
from provenia.sources import corpus
from provenia.sources.scratch import scratch_dir

_FILLER = "These parts are made for general use and are kept dry; see the last page for the terms of sale and supply. "
#: Values of a part: x has a row for each part and sheet, pos is its place among the n parts of the sheet.
_X = """
p AS (SELECT p_partkey AS sku, p_type, p_size, '1N' || (10000 + p_partkey % 90000) || chr((65 + p_partkey // 90000 % 26)::INT) AS mpn, CASE WHEN p_type = 'ECONOMY' THEN 'Bolt' ELSE 'Acme' END AS brand,
  floor(10 * sqrt(p_retailprice))::INT AS v, p_size + floor(sqrt(p_retailprice))::INT AS s, -(p_size + 20) AS lo, 5 * p_size AS hi, p_brand, p_name FROM part),
y AS (SELECT *, 'A ' || p_brand || ' ' || p_size AS doc, 0 AS doc_pos FROM p UNION ALL SELECT * REPLACE (v + CASE WHEN p_type = 'PROMO' THEN 5 ELSE 0 END AS v), 'B ' || p_name || ' ' || p_size, 1 FROM p),
x AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n, row_number() OVER (PARTITION BY doc ORDER BY sku) AS pos FROM y)
"""
_CANDIDATES = """
cand AS (
  SELECT sku, doc, doc_pos, brand, 'reverse_voltage_max' AS attribute, if(n > 1, 'table_column', 'inline_spec') AS extractor, v::DOUBLE AS num, NULL AS str, if(n > 1, 3.0::DOUBLE, 1.0) AS prec, if(n > 1, pos - 1, -1) AS col, 2 AS page, true AS good, v || ' V' AS display FROM x
  UNION ALL SELECT sku, doc, doc_pos, brand, 'surge_current_max', if(n > 1, 'table_column', 'inline_spec'), s, NULL, if(n > 1, 3.0, 1.0), if(n > 1, pos - 1, -1), 2, true, s || ' A' FROM x
  UNION ALL SELECT sku, doc, doc_pos, brand, 'operating_temp_min', if(n > 1, 'table_column', 'range'), lo, NULL, if(n > 1, 1.2, if(hi - lo >= 50, 2.0, 1.5)), -1, 2, true, lo || ' degC' FROM x
  UNION ALL SELECT sku, doc, doc_pos, brand, 'operating_temp_max', if(hi >= 25, 'range', 'inline_spec'), hi, NULL, if(hi < 25, 1.0, if(hi - lo >= 50, 2.0, 1.5)), -1, 2, hi >= 25, hi || ' degC' FROM x
  UNION ALL SELECT sku, doc, doc_pos, brand, 'package', 'inline_spec', NULL, 'DO-' || (200 + p_size) || 'AL', 1.0, -1, 1, true, 'DO-' || (200 + p_size) || 'AL' FROM x)
"""
#: Arbitration of live candidates: one for each sheet here, so a cell's factor is 1 + log2(2) / 2.
_WON = """
live AS (SELECT *, coalesce(printf('%g', num), str) AS vkey, CASE WHEN doc_pos = 0 AND brand = 'Acme' THEN 1.0::DOUBLE ELSE 0.4 END AS weight FROM cand WHERE good),
clus AS (SELECT sku, attribute, vkey, round(sum(prec * weight * 1.5), 9) AS score, count(*) AS agree, max_by(prec, (prec, -doc_pos)) AS prec, max_by(weight, (prec, -doc_pos)) AS weight, max_by(col, (prec, -doc_pos)) AS col, max_by(display, (prec, -doc_pos)) AS display FROM live GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY sku, attribute ORDER BY score DESC, vkey) AS rn, count(*) OVER (PARTITION BY sku, attribute) AS k FROM clus),
won AS (SELECT sku, attribute, vkey, agree, k, prec, weight, col, display FROM rk WHERE rn = 1),
dec AS (SELECT *, 1 / (1 + exp(-(-1.9 + 1.6 * prec / 3 + 2.2 + 1.5 * least(agree, 4) / 4 - 2.6 * (k > 1)::INT - 0.9 * least(k - 1, 4) / 4.0 + 1.0 * weight + 1.3 * (col >= 0)::INT + 0.6 + 1.1))) AS p,
  attribute IN ('reverse_voltage_max', 'surge_current_max') AS safety FROM won),
fin AS (SELECT *, CASE WHEN p < 0.25 THEN 'REJECT' WHEN p >= if(safety, 0.97, 0.9) AND k = 1 THEN 'AUTO_PUBLISH' ELSE 'REVIEW' END AS decision FROM dec)
"""


def sheets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(skus, manifest, docs) of the two kinds of sheets."""
    key, size, root = F.col("p_partkey"), F.col("p_size"), F.floor(F.sqrt("p_retailprice")).cast("int")
    part = t(spark, d, "part").select(
        key.alias("sku"), "p_type", size, F.concat(F.lit("1N"), 10000 + key % 90000, F.char(65 + F.floor(key / 90000) % 26)).alias("mpn"), F.when(F.col("p_type") == "ECONOMY", "Bolt").otherwise("Acme").alias("brand"),
        F.floor(10 * F.sqrt("p_retailprice")).cast("int").alias("v"), (size + root).alias("s"), F.concat_ws(" ", F.lit("A"), "p_brand", size).alias("a"), F.concat_ws(" ", F.lit("B"), "p_name", size).alias("b"),
    )
    skus = part.select("sku", "mpn", "brand", F.lit("RECTIFIER_DIODE").alias("product_class"))
    kind = F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("v").alias("v")), F.struct(F.col("b").alias("doc_id"), (F.col("v") + F.when(F.col("p_type") == "PROMO", 5).otherwise(0)).alias("v"))))
    each = part.select("sku", "mpn", "p_size", "s", kind.alias("k")).select("k.doc_id", "k.v", "sku", "mpn", "s", "p_size")
    row = each.groupBy("doc_id", "p_size").agg(F.array_sort(F.collect_list(F.struct("sku", "mpn", "v", "s"))).alias("of"))
    cells = lambda f: F.array_join(F.transform("of", lambda x: x[f].cast("string")), " ")
    first = F.concat(F.lit("FEATURES\nCase: DO-"), 200 + size, F.lit(f"AL style. {_FILLER}\n"))
    second = F.concat(
        F.lit("MAXIMUM RATINGS (TA = 25)\nPARAMETER "), cells("mpn"), F.lit(" UNIT\nVRRM "), cells("v"), F.lit(" V\nIFSM "), cells("s"), F.lit(f" A\n{_FILLER}\nTJ -"), size + 20, F.lit(" to "), 5 * size,
        F.lit(" °C\nELECTRICAL CHARACTERISTICS\nVF as noted: about one volt\n"),
    )
    pages = row.select("doc_id", F.posexplode(F.array(first, second)).alias("page", "text")).withColumn("page", F.col("page") + 1)
    rival = F.col("doc_id").startswith("B")
    manifest = row.select("doc_id", rival.cast("int").alias("doc_pos"), F.lit("u").alias("url"), F.when(rival, "Bolt Devices").otherwise("Acme Semiconductors").alias("publisher"), F.when(rival, "AUTHORIZED_DIST").otherwise("MFR_DATASHEET").alias("authority"), F.transform("of", lambda x: x["mpn"]).alias("covers"))
    return skus, manifest, corpus.document_text(pages)


def _work(spark, d):
    return datasheet.work(*sheets(spark, d))


@query(f"WITH {_X}, {_CANDIDATES} SELECT sku, doc AS doc_id, attribute, extractor, num AS value_num, str AS value_str, round(prec, 6) AS precision, col::INT AS column_index, page, good AS usable, good AS verified_and_clean FROM cand")
def extract_from_doc(spark, d):
    """The panel over every part and sheet: what comes after a clean candidate is left out."""
    found = generators.candidates(_work(spark, d))
    return found.select("sku", "doc_id", "attribute", "extractor", "value_num", "value_str", F.round("precision", 6).alias("precision"), "column_index", "page", generators.usable().alias("usable"), generators.live().alias("verified_and_clean"))


@query(f"WITH {_X}, {_CANDIDATES}, {_WON} SELECT sku, attribute, vkey AS value, agree::INT AS agreeing_sources, k > 1 AS conflicting, display, round(p, 4) AS confidence, decision FROM fin")
def enrich(spark, d):
    """Generate, gate, arbitrate, check, score and decide; attributes that have a value."""
    decided = datasheet.enrich(*sheets(spark, d), path=scratch_dir(spark)).decided.where("verified")
    from provenia.functions.values import value_key

    return decided.select("sku", "attribute", value_key(F.col("value_num"), F.col("value_str"), F.col("value_flag")).alias("value"), "agreeing_sources", "conflicting", "display", "confidence", "decision")


@query(f"WITH {_X}, {_CANDIDATES}, {_WON} SELECT sku, attribute, vkey AS value, agree::INT AS agreeing_sources, k > 1 AS conflicting, display, round(p, 4) AS confidence, decision, if(p_size % 3 = 2, 1, 2)::BIGINT AS version FROM fin JOIN p USING (sku)")
def enrich_changed(spark, d):
    """A store of sheets, of which some are then changed and others added: only their parts are decided again."""
    from provenia.functions.values import value_key
    from provenia.plans import incremental

    skus, manifest, docs = sheets(spark, d)
    size = F.element_at(F.split("doc_id", " "), -1).cast("int")
    sha = lambda rows: rows.select("doc_id", F.sha2("text", 256).alias("sha256"))
    old = docs.where(size % 3 != 0).withColumn("text", F.when(size % 3 == 1, F.regexp_replace("text", "VRRM ", "VRRM 9")).otherwise(F.col("text")))
    path = scratch_dir(spark)
    incremental.update(path, skus, manifest.where(size % 3 != 0), old, sha(old))
    incremental.update(path, skus, manifest, docs, sha(docs))
    rows = incremental.decided(spark, path).where("verified")
    return rows.select("sku", "attribute", value_key(F.col("value_num"), F.col("value_str"), F.col("value_flag")).alias("value"), "agreeing_sources", "conflicting", "display", "confidence", "decision", "version")


@query(f"WITH {_X}, {_CANDIDATES}, {_WON}, every AS (SELECT sku, attribute, count(DISTINCT doc) AS docs, count(*) AS n FROM cand GROUP BY ALL) SELECT e.sku, e.attribute, docs::INT AS total_sources, n AS n_candidates, CASE WHEN w.sku IS NULL THEN 'no candidate survived the evidence gate' WHEN k > 1 THEN 'cross-document conflict: ' || k || ' distinct values across ' || docs || ' sources' WHEN agree > 1 THEN agree || ' independent sources agree' END AS first_reason FROM every e LEFT JOIN won w ON e.sku = w.sku AND e.attribute = w.attribute")
def resolve_reasons(spark, d):
    """How many sources spoke, and the first reason that arbitration gives."""
    from provenia.operators import arbitrate

    skus, manifest, docs = sheets(spark, d)
    path = scratch_dir(spark)
    generators.candidates(datasheet.work(skus, manifest, docs)).write.parquet(path)
    found = spark.read.parquet(path).join(skus.select("sku", "brand"), "sku")
    return arbitrate.resolve(arbitrate.brand_authority(found)).select("sku", "attribute", "total_sources", "n_candidates", F.try_element_at("reasons", F.lit(1)).alias("first_reason"))


_NAIVE = """
z AS (SELECT *, first_value(v) OVER (PARTITION BY doc ORDER BY pos DESC) AS v_last, first_value(s) OVER (PARTITION BY doc ORDER BY pos DESC) AS s_last FROM x),
naive AS (SELECT sku, u.attribute, CASE u.attribute WHEN 'reverse_voltage_max' THEN v_last WHEN 'surge_current_max' THEN s_last WHEN 'package' THEN NULL ELSE hi END::DOUBLE AS value_num, CASE u.attribute WHEN 'package' THEN 'DO-' || (200 + p_size) || 'AL' END AS value_str
  FROM z, (VALUES ('reverse_voltage_max'), ('surge_current_max'), ('operating_temp_min'), ('operating_temp_max'), ('package')) u(attribute) WHERE doc_pos = 0)
"""


@query(f"WITH {_X}, {_NAIVE} SELECT *, 1.0::DOUBLE AS confidence, 'AUTO_PUBLISH' AS decision FROM naive")
def naive_arm(spark, d):
    """The first inline hit of each attribute, published unseen: in a series table the last part's value."""
    return generators.naive(_work(spark, d)).select("sku", "attribute", "value_num", "value_str", "confidence", "decision")


def _gold(spark, d):
    skus, _, _ = sheets(spark, d)
    part = t(spark, d, "part")
    size, root = F.col("p_size"), F.floor(F.sqrt("p_retailprice")).cast("int")
    true = {"reverse_voltage_max": F.floor(10 * F.sqrt("p_retailprice")), "surge_current_max": size + root, "operating_temp_min": -(size + 20), "operating_temp_max": 5 * size}
    each = part.select(F.col("p_partkey").alias("sku"), F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), v.cast("double").alias("n")) for k, v in true.items()])).alias("g"))
    none = F.lit(None)
    return each.select("sku", "g.attribute", F.array(F.struct(F.col("g.n").alias("num"), none.cast("string").alias("str"), none.cast("boolean").alias("flag"))).alias("accepted"))


_GOLD = "gold AS (SELECT sku, u.attribute, CASE u.attribute WHEN 'reverse_voltage_max' THEN v WHEN 'surge_current_max' THEN s WHEN 'operating_temp_min' THEN lo ELSE hi END::DOUBLE AS want FROM p, (VALUES ('reverse_voltage_max'), ('surge_current_max'), ('operating_temp_min'), ('operating_temp_max')) u(attribute))"
_METRICS = """
SELECT '{arm}' AS arm, round(count(*) / (SELECT count(*) FROM gold), 4) AS coverage, count(*) AS attributes_valued, round(avg(ok::INT), 4) AS accuracy_all_emitted, count(*) FILTER (pub) AS auto_published, round(count(*) FILTER (pub AND ok) / count(*) FILTER (pub), 4) AS precision_on_published,
  round(count(*) FILTER (pub AND ok AND safety) / nullif(count(*) FILTER (pub AND safety), 0), 4) AS safety_precision_on_published, count(*) FILTER (pub AND NOT ok) AS wrong_values_published, count(*) FILTER (decision = 'REVIEW') AS queued_for_review FROM g
"""
_ARM = "arm coverage attributes_valued accuracy_all_emitted auto_published precision_on_published safety_precision_on_published wrong_values_published queued_for_review".split()


@query(f"WITH {_X}, {_NAIVE}, {_GOLD}, g AS (SELECT *, abs(value_num - want) <= 0.02 * greatest(1, abs(want)) AS ok, true AS pub, attribute IN ('reverse_voltage_max', 'surge_current_max') AS safety, 'AUTO_PUBLISH' AS decision FROM naive JOIN gold USING (sku, attribute))" + _METRICS.format(arm="naive"))
def arm_metrics_naive(spark, d):
    """Grading of the arm that trusts everything."""
    gold = _gold(spark, d)
    graded = evaluate.grade(generators.naive(_work(spark, d)).withColumn("safety", F.col("attribute").isin("reverse_voltage_max", "surge_current_max")), gold)
    return evaluate.arm_metrics(graded, gold, "naive").select(*_ARM)


@query(f"WITH {_X}, {_CANDIDATES}, {_WON}, {_GOLD}, g AS (SELECT *, abs(vkey::DOUBLE - want) <= 0.02 * greatest(1, abs(want)) AS ok, decision = 'AUTO_PUBLISH' AS pub FROM fin JOIN gold USING (sku, attribute))" + _METRICS.format(arm="full"))
def arm_metrics_full(spark, d):
    """Grading of the whole engine: coverage, precision on what is published, burden of review."""
    gold = _gold(spark, d)
    graded = evaluate.grade(datasheet.enrich(*sheets(spark, d), path=scratch_dir(spark)).decided.where("verified"), gold)
    return evaluate.arm_metrics(graded, gold, "full").select(*_ARM)


@query(f"WITH {_X}, {_NAIVE}, {_GOLD} SELECT sku, attribute, value_num, want FROM naive JOIN gold USING (sku, attribute) WHERE NOT abs(value_num - want) <= 0.02 * greatest(1, abs(want)) ORDER BY sku, attribute LIMIT 40")
def published_errors(spark, d):
    """Wrong values that were published, forty at most."""
    graded = evaluate.grade(generators.naive(_work(spark, d)), _gold(spark, d))
    return evaluate.published_errors(graded).join(_gold(spark, d), ["sku", "attribute"]).select("sku", "attribute", "value_num", F.col("accepted")[0]["num"].alias("want"))


@query(f"WITH {_X} SELECT sku, 'Bolt Devices datasheet used as cross-reference only (Acme is the SKU brand)' AS note FROM p WHERE brand = 'Acme' UNION ALL SELECT sku, 'Acme Semiconductors datasheet used as cross-reference only (Bolt is the SKU brand)' FROM p WHERE brand = 'Bolt' UNION ALL SELECT sku, 'no evidence found for: forward_current_avg, forward_voltage_max, mounting_type, rohs_compliant' FROM p")
def enrich_notes(spark, d):
    """Notes on each part: documents of other brands, attributes without evidence."""
    return datasheet.enrich(*sheets(spark, d), path=scratch_dir(spark)).notes


def _responses(docs):
    """Two samples that agree and one that found nothing; of rivals' sheets the quote is invented."""
    said = F.concat(F.lit("1."), F.element_at(F.split("doc_id", " "), -1), F.lit(" V"))
    quote = F.when(F.col("doc_id").startswith("B"), "one volt, invented").otherwise("about one  VOLT")
    one = lambda k, found, value: F.struct(F.lit(0).alias("window_no"), F.lit(k).alias("sample_no"), F.lit(found).alias("found"), value.alias("value"), quote.alias("quote"))
    return docs.select("doc_id", F.lit("forward_voltage_max").alias("attribute"), F.explode(F.array(one(0, True, said), one(1, True, said), one(2, False, said))).alias("r")).select("doc_id", "attribute", "r.*")


@query(f"WITH {_X} SELECT sku, doc AS doc_id, ('1.' || p_size)::DOUBLE AS value_num, 0.667::DOUBLE AS self_consistency, round(1.4 + 0.8 * 2 / 3, 6) AS precision, doc_pos = 0 AS verified, if(doc_pos = 0, 'relocated', 'not_found') AS match_mode, if(doc_pos = 0, 'ELEC_CHAR', 'OTHER') AS section FROM x")
def llm_extract(spark, d):
    """Candidates from recorded model replies: agreement of samples, quotes looked up in the text."""
    skus, manifest, docs = sheets(spark, d)
    found = generators.candidates(datasheet.work(skus, manifest, docs), ("llm",), _responses(docs))
    section = F.when(F.col("verified"), F.col("section")).otherwise("OTHER")
    return found.select("sku", "doc_id", "value_num", "self_consistency", F.round("precision", 6).alias("precision"), "verified", "match_mode", section.alias("section"))


@query(f"WITH {_X} SELECT sku, doc AS doc_id, 'Part number: ' || mpn AS part_line, coalesce((SELECT string_agg(o.mpn, ', ' ORDER BY o.sku) FROM x o WHERE o.doc = e.doc AND o.sku <> e.sku), 'none') AS others FROM x e")
def llm_prompts(spark, d):
    """The question put to a model for each part and sheet: its part number and the others of the sheet."""
    work = _work(spark, d)
    windows = generators.llm_windows(work).where("attribute = 'forward_voltage_max'")
    lines = F.split("prompt", "\n")
    return generators.prompts(windows, work).select("sku", "doc_id", lines[0].alias("part_line"), F.regexp_replace(lines[1], "^Other part numbers covered by this document: ", "").alias("others"))
