"""Provenance rules, grading files, records and the batch over the tables at hand, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenia.operators import confidence, delivery, generators, ledger, prefilter, publish, rules
from provenia.plans import appliance, datasheet, evaluate
from provenia.plans.delivery_queries import _KEYED
from provenia.plans.queries import ORACLES, _SCORED, _decided, _scored, query, t
from provenia.plans.sheet_queries import _CANDIDATES, _WON, _X, sheets
from provenia.plans.text_queries import _WIDE, _diodes, _named
from provenia.sources import corpus, sinks
from provenia.sources import reference as R
from provenia.sources.scratch import scratch_dir

_PAD = "All that is said here holds at a room's warmth, and what is not said here can be asked for by letter. "


@query("""
WITH x AS (SELECT l_orderkey AS k, l_returnflag AS f, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos FROM lineitem),
u AS (SELECT k, q, min(pos) AS pos, arg_min(f, pos) AS f FROM x GROUP BY k, q), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS rn FROM u),
c AS (SELECT *, CASE f WHEN 'A' THEN 'ABS_MAX' WHEN 'N' THEN 'ELEC_CHAR' ELSE 'MECHANICAL' END AS section FROM r WHERE rn <= 8)
SELECT k AS sku, 'output current ' || q || ' mA' AS quote, section, CASE WHEN section = 'ABS_MAX' THEN '' ELSE 'section ' || section || ' has no authority over output_current_max (expected ABS_MAX/FEATURES/RECOMMENDED)' END AS dropped_reason,
  CASE WHEN q < 10 THEN printf('%g', q / 1000.0) || ' A outside plausible range' ELSE '' END AS normalize_error, q >= 10 AS usable, q >= 10 AND section = 'ABS_MAX' AS live FROM c
""")
def drop_reasons(spark, d):
    """Values under headings that have or lack authority, in and out of their plausible range."""
    heading = F.when(F.col("l_returnflag") == "A", "Absolute Maximum Ratings").when(F.col("l_returnflag") == "N", "Electrical characteristics").otherwise("Mechanical data")
    line = F.concat(heading, F.lit(f"\n{_PAD}\noutput current "), F.col("l_quantity").cast("int"), F.lit(f" mA\n{_PAD}\n"))
    x = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", line.alias("line"))
    docs = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda x: x["line"]), "").alias("text"))
    docs = docs.withColumn("pages", F.array(F.struct(F.lit(1).alias("page"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"))))
    mpn = F.concat(F.lit("LM"), F.col("doc_id").cast("string"))
    skus = docs.select(F.col("doc_id").alias("sku"), mpn.alias("mpn"), F.lit("Acme").alias("brand"), F.lit("LINEAR_REGULATOR").alias("product_class"))
    manifest = docs.select("doc_id", F.lit(0).alias("doc_pos"), F.lit("Acme").alias("publisher"), F.lit("MFR_DATASHEET").alias("authority"), F.array(mpn).alias("covers"))
    found = generators.candidates(datasheet.work(skus, manifest, docs), ("inline_spec",)).where("attribute = 'output_current_max'")
    return found.select("sku", "quote", "section", "dropped_reason", "normalize_error", generators.usable().alias("usable"), generators.live().alias("live"))


@query(f"""WITH {_WIDE}, v AS (UNPIVOT w ON COLUMNS(* EXCLUDE (sku)) INTO NAME attribute VALUE v),
b AS ({" UNION ALL ".join(f"SELECT sku, '{o}' AS attribute, '[{r[5]}] {r[4]}' AS message FROM w WHERE NOT ({r[3]})" for r in R.RULES if r[0] == "RECTIFIER_DIODE" for o in r[2])}
  UNION ALL SELECT sku, attribute, 'outside' FROM v JOIN (VALUES {", ".join(f"('{s[0]}', {float(s[8])}, {float(s[9])})" for s in R.CLASSES["RECTIFIER_DIODE"] if s[8] is not None)}) l(attribute, low, high) USING (attribute) WHERE v < low OR v > high),
m AS (SELECT sku, attribute, count(*) AS n, count(*) FILTER (starts_with(message, '[error]') OR message = 'outside') AS errors FROM b GROUP BY ALL)
SELECT sku, attribute, coalesce(n, 0)::INT AS violations, coalesce(errors, 0)::INT AS errors, CASE WHEN n > 0 THEN n || ' plausibility rule violation(s)' ELSE '' END AS reason FROM v LEFT JOIN m USING (sku, attribute)""")
def rule_merge(spark, d):
    """Every attribute with its violations of rules and of bounds, and the reason they give."""
    values = _diodes(spark, d)
    resolved = values.select("sku", "attribute", "value_num", F.array().cast("array<string>").alias("reasons"))
    done = rules.apply_rules(resolved, values.select("sku", "class_key").distinct())
    errors = F.filter("rule_violations", lambda v: v.startswith("[error]"))
    return done.select("sku", "attribute", F.size("rule_violations").alias("violations"), F.size(errors).alias("errors"), F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit("")).alias("reason"))


@query(f"WITH {_X}, {_CANDIDATES}, {_WON}, every AS (SELECT sku, attribute, count(*) AS n FROM cand GROUP BY ALL) SELECT e.sku, e.attribute, n AS candidate_count, coalesce(f.decision, 'REVIEW') AS decision, f.vkey IS NOT NULL AS has_value, 0 AS quarantined, 0 AS rejected FROM every e LEFT JOIN fin f ON f.sku = e.sku AND f.attribute = e.attribute WHERE f.sku IS NOT NULL")
def record_detail(spark, d):
    """Attributes of records with the number of their candidates, who quarantined and why they were dropped."""
    out = datasheet.enrich(*sheets(spark, d), path=scratch_dir(spark))
    rows = publish.record_detail(out.decided.where("verified"), out.candidates)
    return rows.select("sku", "attribute", "candidate_count", "decision", (F.coalesce(F.col("value_num").cast("string"), F.col("value_str")).isNotNull()).alias("has_value"), F.size("quarantined").alias("quarantined"), F.size("rejected_provenance").alias("rejected"))


@query(f"""WITH {_X}, {_CANDIDATES}, {_WON}, pub AS (SELECT * FROM fin WHERE decision = 'AUTO_PUBLISH'), held AS (SELECT sku, string_agg(attribute, ',' ORDER BY attribute) AS names FROM fin WHERE decision <> 'AUTO_PUBLISH' GROUP BY sku)
SELECT p.sku, brand || ' ' || mpn AS name, coalesce((SELECT count(*) FROM pub WHERE pub.sku = p.sku), 0) AS properties, (SELECT vkey FROM pub WHERE pub.sku = p.sku AND attribute = 'surge_current_max') AS surge_value, (SELECT display FROM pub WHERE pub.sku = p.sku AND attribute = 'package') AS package_display,
  (SELECT round(p, 4) FROM pub WHERE pub.sku = p.sku AND attribute = 'package') AS package_confidence, coalesce(held.names, '') AS withheld, round(100 * (0.6 * coalesce((SELECT count(*) FROM pub WHERE pub.sku = p.sku), 0) / 9 + if((SELECT count(*) FROM pub WHERE pub.sku = p.sku) > 0, 0.4, 0)), 1)::DOUBLE AS score FROM p LEFT JOIN held ON held.sku = p.sku""")
def publish_answer(spark, d):
    """The whole answer for a record: payload, linked data and readiness, read field by field."""
    skus, manifest, docs = sheets(spark, d)
    decided = datasheet.enrich(skus, manifest, docs, path=scratch_dir(spark)).decided.where("verified")
    specs = R.attribute_specs(spark)
    expected = skus.join(F.broadcast(specs), F.col("product_class") == F.col("class_key")).select("sku", "attribute")
    sources = corpus.docs_for_part(skus, manifest).select("sku", "doc_id").join(manifest.select("doc_id", "publisher", "url"), "doc_id").withColumn("sha256", F.sha2("doc_id", 256))
    out = publish.answer(skus.withColumn("description", F.lit("d")), decided, sources, expected)
    get = lambda c, path: F.get_json_object(c, path)
    held = F.array_join(F.from_json(get("payload", "$.withheld_for_review"), "array<string>"), ",")
    return out.select(
        "sku", get("json_ld", "$.name").alias("name"), F.json_array_length(get("json_ld", "$.additionalProperty")).cast("long").alias("properties"), F.regexp_replace(get("payload", "$.published_attributes.surge_current_max.value"), r"\.0$", "").alias("surge_value"),
        get("payload", "$.published_attributes.package.display").alias("package_display"), get("payload", "$.published_attributes.package.confidence").cast("double").alias("package_confidence"), held.alias("withheld"), get("readiness", "$.score").cast("double").alias("score"),
    )


@query(f"WITH {_X}, {_CANDIDATES}, {_WON} SELECT sku, attribute, decision AS action, round(p, 4) AS confidence, display AS value FROM fin")
def audit_rows(spark, d):
    """A run's decisions as audit events."""
    decided = datasheet.enrich(*sheets(spark, d), path=scratch_dir(spark)).decided.where("verified")
    rows = ledger.audit_rows(decided, "pipeline", "2024-01-01 00:00:00")
    return rows.select("sku", "attribute", "action", F.get_json_object("detail", "$.confidence").cast("double").alias("confidence"), F.get_json_object("detail", "$.value").alias("value"))


@query(f"""WITH {_SCORED}, t AS (SELECT DISTINCT round(p, 4) AS t FROM s UNION SELECT unnest([0.0, 1.0])), v AS (SELECT t, (SELECT avg(y) FROM s WHERE p >= t) AS prec FROM t),
m AS (SELECT coalesce(min(t) FILTER (prec >= 0.6), 1.01)::DOUBLE AS general, coalesce(min(t) FILTER (prec >= 0.8), 1.01)::DOUBLE AS safety FROM v)
SELECT unnest({list(R.FEATURES)}) AS feature, unnest({list(R.PRIOR_WEIGHTS)})::DOUBLE AS weight, general, safety, false AS trained, (SELECT count(*) FROM s WHERE p >= general) AS published FROM m""")
def model_file(spark, d):
    """A scoring model whose floors come from scored rows, written as JSON, read again and held against these rows; its weights, the heaviest first."""
    path, rows = scratch_dir(spark), _scored(spark, d)
    floor = lambda target: float(confidence.pick_threshold(rows, target))
    confidence.save_model(spark, confidence.Model(general=floor(0.6), safety=floor(0.8)), path)
    model = confidence.load_model(spark, path)
    published = rows.where(F.col("p") >= model.general).count()
    return evaluate.feature_weights(model, spark).select("feature", "weight", F.lit(model.general).alias("general"), F.lit(model.safety).alias("safety"), F.lit(model.trained).alias("trained"), F.lit(published).cast("long").alias("published"))


@query("SELECT p_brand AS arm, count(*) AS n, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY p_brand")
def metrics_file(spark, d):
    """Metrics written as JSON lines and read again."""
    path = scratch_dir(spark)
    sinks.write_metrics(t(spark, d, "part").groupBy(F.col("p_brand").alias("arm")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean")), path)
    return spark.read.schema("arm string, n long, mean double").json(path)


@query(f"""WITH {_KEYED}, r AS (SELECT *, CASE WHEN category IS NULL THEN NULL ELSE round(0.4 * CASE WHEN brand_ok THEN 1.0 WHEN brand IS NOT NULL THEN 0.6 ELSE 0.0 END + 0.3 * (brand IS NOT NULL AND p_size > 25)::INT, 3) END AS c FROM f WHERE category IS NOT NULL AND p_type <> 'SMALL')
SELECT CASE WHEN c >= 0.75 THEN 'AUTO_PUBLISH' ELSE 'REVIEW' END AS decision, count(*) AS n FROM r GROUP BY 1""")
def batch_main(spark, d):
    """The batch from a catalog file to delivered files and the counts by decision."""
    source, out = scratch_dir(spark), scratch_dir(spark)
    rows = _named(spark, d)
    maker = F.when(F.col("p_type") == "SMALL", "Excluded Inc").otherwise(F.col("p_brand"))
    none = F.lit(None).cast("string")
    rows.select(F.col("p_partkey").cast("string").alias("Mfg_Part_Num"), F.col("desc").alias("Part_Desc"), F.lit("x").alias("E1_Brand"), none.alias("Unilog_Brand"), none.alias("DIB_Brand"), maker.alias("Part_Manuf")).write.option("header", True).option("escape", '"').csv(source)
    text = F.concat(F.lit("specifications of "), "p_partkey", F.lit(" "), F.repeat(F.lit("and so on "), F.lit(30)))
    fetched = rows.where("p_size > 25").select(F.col("p_partkey").cast("string").alias("mpn"), F.lit(0).alias("url_pos"), F.lit("https://x").alias("url"), F.lit(200).alias("status"), F.lit("text/plain").alias("content_type"), text.alias("body"), F.lit("").alias("error"))
    said = spark.createDataFrame([], "mpn string, label string, found boolean, value string, quote string")
    return appliance.run_batch(spark, source, out, fetched, said, None, ("Excluded Inc",))


@query(rf"WITH {_KEYED} SELECT p_partkey::VARCHAR AS mpn, CASE category WHEN 'DISHWASHER' THEN {len(R.DELIVERED['DISHWASHER'])} WHEN 'WASHER' THEN {len(R.DELIVERED['WASHER'])} ELSE {len(R.DELIVERED['DRYER'])} END AS asked, 12000 AS shown FROM f WHERE category IN ('DISHWASHER', 'WASHER', 'DRYER')")
def page_prompts(spark, d):
    """What a model is asked of each page: one question for each attribute of its category, on the page's first 12,000 characters."""
    rows = _named(spark, d)
    pages = rows.select(F.col("p_partkey").cast("string").alias("mpn"), delivery.classify(F.col("desc")).alias("category"), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(3000)).alias("text"))
    return delivery.page_prompts(pages).groupBy("mpn").agg(F.count("*").cast("int").alias("asked"), F.max(F.length("shown")).alias("shown"))


@query("SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS word FROM documents) WHERE word IN (SELECT unnest(string_split_regex(text, '\\s+')) FROM benchmark) AND length(word) > 9")
def known_words(spark, d):
    """Long words of documents that a list of known ones has: sifted by bitmaps of these, then joined."""
    words = lambda name, *keys: t(spark, d, name).select(*keys, F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word")).where(F.length("word") > 9)
    return prefilter.known_only(words("documents", "doc_id"), words("benchmark"), "word")


@query(f"SELECT '1.0' AS version, false AS calibrated, 0.9::DOUBLE AS threshold_general, (SELECT count(*) FROM documents) AS documents, c.* FROM ({ORACLES['catalog_health']}) c")
def health(spark, d):
    """One row on the state of the engine: version, thresholds, documents, and what was decided over the whole catalog."""
    decided = _decided(spark, d).withColumn("quote", F.when(F.col("sku") % 5 != 0, "q"))
    return publish.health(decided, t(spark, d, "events"), t(spark, d, "documents"), confidence.Model(), "1.0").drop("threshold_safety", "reject_below")
