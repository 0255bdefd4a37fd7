import json

import pytest
from pyspark.sql import functions as F

from provenia.operators import confidence, generators, ledger, publish, sections
from provenia.plans import datasheet, evaluate
from provenia.sources import corpus
from tests import sheets


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("made")

    def kept(name, df):
        df.write.parquet(str(root / name))
        return spark.read.parquet(str(root / name))

    skus, manifest, pages = sheets.tables(spark)
    docs = corpus.document_text(pages.repartition(5))
    out = datasheet.enrich(skus, manifest, docs, path=str(root / "found"))
    return skus, manifest, docs, kept("candidates", out.candidates), kept("decided", out.decided), kept("notes", out.notes)


def value(decided, sku, attribute):
    rows = decided.where((F.col("sku") == sku) & (F.col("attribute") == attribute)).collect()
    return rows[0] if rows else None


def test_pages_join_to_the_text(made):
    _, _, docs, *_ = made
    got = {r.doc_id: r for r in docs.collect()}
    assert {d: r.text for d, r in got.items()} == sheets.TEXTS
    assert all(r.text[p.char_start : p.char_end] for r in got.values() for p in r.pages)


def test_own_column_of_a_series_table(made):
    decided = made[4]
    for sku, volts, column in (("S1", 50.0, 0), ("S3", 200.0, 2)):
        r = value(decided, sku, "reverse_voltage_max")
        assert (r.value_num, r.unit, r.column_index, r.column_of, r.extractor) == (volts, "V", column, 4, "table_column")
        assert sheets.SERIES[r.start : r.end] == r.quote and r.verified and r.match_mode == "exact"


def test_one_value_for_all_columns_counts_less(made):
    rows = made[3].where("sku = 'S1' AND doc_id = 'acme' AND attribute = 'forward_current_avg' AND extractor = 'table_column'").collect()
    assert [(r.value_num, r.precision, r.column_index) for r in rows] == [(1.0, 1.2, -1)]


def test_rows_with_some_values_are_not_read(spark):
    text = "A1 B2 C3\nVR 10 20 V\n"
    spec = F.struct(F.lit("number").alias("dtype"), F.array(F.lit("VR")).alias("table_aliases"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    got = spark.range(1).select(generators.table_column(F.lit(text), F.lit("B2"), spec, F.array(*map(F.lit, ("A1", "B2", "C3"))), F.array()).alias("c")).first().c
    assert got == []


def test_ranges_need_their_unit(made):
    low, high = value(made[4], "S1", "operating_temp_min"), value(made[4], "S1", "operating_temp_max")
    assert (low.value_num, high.value_num, low.unit) == (-65.0, 150.0, "degC")
    assert sheets.SERIES[low.focus_start :].startswith("-65") and sheets.SERIES[high.focus_start :].startswith("+150")


def test_range_without_unit_is_nothing(spark):
    spec = F.struct(F.lit("min").alias("range_end"), F.array(F.lit("temperature")).alias("aliases"), F.lit("degC").alias("unit"), F.lit(-100.0).alias("low"), F.lit(50.0).alias("high"))
    for text, n in (("temperature 12 to 45", 0), ("temperature −65 to +150 °C", 1), ("temperature 45 to 12 °C", 0)):
        got = spark.range(1).select(generators.range_end(F.lit(text), F.lit("X"), spec, F.array(), F.array().cast("array<string>")).alias("c")).first().c
        assert len(got) == n


def test_section_has_authority(made):
    rows = made[3].where("sku = 'S1' AND attribute = 'forward_current_avg' AND raw LIKE '77%'").collect()
    assert all("has no authority" in r.dropped_reason for r in rows)
    assert value(made[4], "S1", "forward_voltage_max").value_num == 1.1


def test_sibling_in_prose_is_quarantined(made):
    r = value(made[4], "R1", "output_current_max")
    assert r.value_num == 0.1
    rows = made[3].where("sku = 'R1' AND attribute = 'output_current_max' AND value_num = 1.5").collect()
    assert rows and all(x.contaminated_by == "LM9317" for x in rows)


def test_plots_are_no_ratings(made):
    rows = made[3].where("sku = 'P1' AND attribute = 'forward_current_avg'").collect()
    assert rows and all(r.from_graph and r.dropped_reason for r in rows)
    assert value(made[4], "P1", "forward_current_avg").value_num is None


def test_identifiers_are_not_values(spark):
    spec = F.struct(F.lit("number").alias("dtype"), F.lit("A").alias("unit"), F.lit("x").alias("attribute"), F.array().cast("array<string>").alias("members"))
    got = [spark.range(1).select(generators.value_in(F.lit(t), spec).alias("v")).first().v for t in ("DO-204AL", "LM317A", "rated 204AL", "use 1.5 A max", "2,5A")]
    assert [g and g.raw for g in got] == [None, None, None, "1.5 A", "2,5A"]


def test_suffix_is_the_same_part(spark):
    q = lambda t: spark.range(1).select(generators.contamination(F.lit(t), F.lit("LM317L"), F.array(F.lit("LM317"), F.lit("LM317L")))).first()[0]
    assert (q("LM317LIDR"), q("LM317 here"), q("LM317L")) == ("", "LM317", "")


def test_vendors_conflict_and_the_brand_wins(made):
    a, b = value(made[4], "S1", "reverse_voltage_max"), value(made[4], "S4", "reverse_voltage_max")
    assert (a.value_num, b.value_num) == (50.0, 60.0)
    assert a.conflicting and a.decision == "REVIEW" and a.conflict_values == ["60 V"]
    assert any("cross-document conflict" in x for x in a.reasons)


def test_invariants(made):
    decided = made[4]
    assert decided.where("decision = 'AUTO_PUBLISH' AND (conflicting OR NOT verified OR value_num IS NULL AND value_str IS NULL AND value_flag IS NULL)").count() == 0
    assert decided.where("size(reasons) = 0").count() == 0
    assert decided.where("decision = 'AUTO_PUBLISH' AND exists(rule_violations, v -> startswith(v, '[error]'))").count() == 0
    assert made[3].where("verified AND match_mode = 'not_found'").count() == 0


def test_notes(made):
    got = {(r.sku, r.note) for r in made[5].collect()}
    assert ("X1", "no source document covers NE99999") in got
    assert ("S1", "Bolt Devices datasheet used as cross-reference only (Acme is the SKU brand)") in got
    assert any(s == "P1" and n.startswith("no evidence found for: reverse_voltage_max") for s, n in got)


def test_same_after_repartition(spark, made, tmp_path):
    skus, manifest, docs, *_ = made
    again = datasheet.enrich(skus.repartition(3), manifest.repartition(7), docs.repartition(7), path=str(tmp_path / "found")).decided
    columns = ["sku", "attribute", "value_num", "value_str", "start", "decision", "confidence", "reasons"]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(again) == key(made[4])


def test_sections(spark):
    marks = [(m.off, m.key) for m in spark.range(1).select(sections.section_marks(F.lit(sheets.CONTENTS)).alias("m")).first().m]
    text = sheets.CONTENTS
    assert marks == [(text.index("Maximum Ratings and"), "ABS_MAX")] or marks[0] == (text.index("Maximum Ratings and"), "ABS_MAX")
    assert all(k != "ELEC_CHAR" or o - marks[0][0] > 60 for o, k in marks)
    at = spark.range(1).select(sections.section_at(sections.section_marks(F.lit(text)), F.lit(3)).alias("a"), sections.section_at(sections.section_marks(F.lit(text)), F.lit(len(text))).alias("b"), sections.section_summary(sections.section_marks(F.lit(text))).alias("s")).first()
    assert at.a == "OTHER" and at.b in ("ABS_MAX", "ELEC_CHAR") and sum(at.s.values()) == len(marks)


def test_model_responses(spark, made):
    skus, manifest, docs, *_ = made
    say = lambda n, value, quote, found=True: ("lm", "dropout_voltage_typ", 0, n, found, value, quote)
    text = sheets.PROSE + "\nThe dropout voltage is about 1.2 V at full load."
    own = docs.where("doc_id <> 'lm'").unionByName(spark.createDataFrame([("lm", text)], "doc_id string, text string").withColumn("pages", F.array(F.struct(F.lit(1).alias("page"), F.lit(0).alias("char_start"), F.lit(10_000).alias("char_end")))))
    schema = "doc_id string, attribute string, window_no int, sample_no int, found boolean, value string, quote string"

    def run(*rows):
        out = datasheet.enrich(skus, manifest, own, spark.createDataFrame(list(rows), schema), panel=("llm",))
        return out.candidates.where("attribute = 'dropout_voltage_typ'").collect()

    good = run(say(0, "1.2 V", "about 1.2 V"), say(1, "1.2 V", "about  1.2 v"), say(2, "9 V", "full load"))
    assert [(r.value_num, r.self_consistency, r.verified, round(r.precision, 3)) for r in good] == [(1.2, 0.667, True, 1.933)]
    assert not run(say(0, "3 V", "dropout of 3 V, invented"))[0].verified
    assert run(say(0, "1.2 V", "about 1.2 V", False)) == []
    three = run(say(0, "1 V", "about 1.2 V"), say(1, "2 V", "about 1.2 V"), say(2, "3 V", "about 1.2 V"))
    assert three[0].value_num == 1.0 and three[0].self_consistency == 0.333


def test_publishing(made):
    skus, manifest, _, candidates, decided, _ = made
    forced = decided.withColumn("decision", F.when(F.col("value_num").isNotNull() & ~F.col("conflicting"), "AUTO_PUBLISH").otherwise("REVIEW"))
    sources = corpus.docs_for_part(skus, manifest).select("sku", "doc_id").join(manifest.select("doc_id", "publisher", "url"), "doc_id").withColumn("sha256", F.sha2("doc_id", 256))
    p = {r.sku: json.loads(r.payload) for r in publish.commerce_payload(skus, forced, sources).collect()}
    assert "reverse_voltage_max" in p["S1"]["withheld_for_review"] and p["S1"]["published_attributes"]["operating_temp_min"]["value"] == "-65.0"
    assert len(p["S1"]["sources"]) == 2 and all(len(s["sha256"]) == 16 for s in p["S1"]["sources"])
    ld = {r.sku: json.loads(r.json_ld) for r in publish.json_ld(skus, forced).collect()}
    assert ld["S1"]["@type"] == "Product" and ld["X1"]["additionalProperty"] == []
    assert {x["name"] for x in ld["S1"]["additionalProperty"]} == set(p["S1"]["published_attributes"])
    from provenia.sources.reference import attribute_specs

    expected = skus.join(attribute_specs(skus.sparkSession), F.col("product_class") == F.col("class_key")).select("sku", "attribute")
    ready = {r.sku: r for r in publish.readiness(forced, expected).collect()}
    assert ready["X1"].score == 0 and len(ready["X1"].gaps) == 9 and 0 < ready["S1"].score < 100
    audit = ledger.audit_rows(forced, "pipeline", "2024-01-01 00:00:00")
    health = publish.catalog_health(forced, audit).first()
    assert health.attributes == decided.count() == health.audit_events
    detail = publish.record_detail(decided, candidates).where("sku = 'R1' AND attribute = 'output_current_max'").first()
    assert detail.quarantined == ["LM9317"] * len(detail.quarantined) and detail.candidate_count >= 2
    assert publish.summary(decided).first().records == 5


def test_prompts(made):
    skus, manifest, docs, *_ = made
    work = datasheet.work_rows(skus, manifest, docs).where("sku = 'S1' AND doc_id = 'acme'")
    rows = generators.prompts(generators.llm_windows(work), work).where("attribute = 'forward_voltage_max'").collect()
    assert 0 < len(rows) <= 3
    assert rows[0].prompt.startswith("Part number: 1N7001\nOther part numbers covered by this document: 1N7002, 1N7003, 1N7004\nAttribute wanted: forward_voltage_max (") and rows[0].window in rows[0].prompt


def test_naive_arm_trusts_everything(made):
    skus, manifest, docs, *_ = made
    rows = generators.naive(datasheet.work_rows(skus, manifest, docs))
    assert rows.where("decision <> 'AUTO_PUBLISH' OR confidence <> 1.0").count() == 0
    assert rows.where("sku = 'S1' AND attribute = 'forward_voltage_max'").first().value_num == 1.1


def test_grading_and_refit(spark, made):
    decided = made[4]
    gold = spark.createDataFrame([("S1", "reverse_voltage_max", 50.0), ("S1", "forward_voltage_max", 1.0), ("S3", "reverse_voltage_max", 200.0), ("S1", "surge_current_max", 31.0), ("ZZ", "none", 1.0)], "sku string, attribute string, n double").select("sku", "attribute", F.array(F.struct(F.col("n").alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("boolean").alias("flag"))).alias("accepted"))
    graded = evaluate.grade(decided, gold)
    assert {(r.sku, r.attribute): r.correct for r in graded.collect()} == {("S1", "reverse_voltage_max"): True, ("S1", "forward_voltage_max"): False, ("S3", "reverse_voltage_max"): True, ("S1", "surge_current_max"): False}
    m = evaluate.arm_metrics(graded, gold, "full").first()
    assert (m.attributes_labelled, m.attributes_valued, m.coverage) == (5, 4, 0.8)
    model, again = evaluate.refit(graded)
    assert model.trained and model.safety >= max(model.general, 0.60)
    assert again.where("decision = 'REJECT'").count() == 0
    one, _ = confidence.fit(graded.where("correct").withColumns({"row_id": F.col("sku"), "y": F.lit(1)}))
    assert not one.trained and one.weights == confidence.PRIOR_WEIGHTS
