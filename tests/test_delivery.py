import csv

import pytest
from pyspark.sql import functions as F

from provenia.operators import delivery as D
from provenia.sources import corpus, reference, sinks

# Two delivered rows and their texts, byte for byte.
A = {
    "brand_display": "FRIGIDAIRE®", "manufacturer_name": "Rheem Manufacturing", "mpn": "PDSH4816AF", "product_name": "Dishwasher", "with_feature": "CleanBoost™",
    "attrs": {"Series": ("Professional Series", ""), "Number of Wash Cycles": ("5", ""), "Voltage Rating": ("120", "V"), "Amperage Rating": ("15", "A"), "Mounting Type": ("Leg", ""), "Size": ("24 in W x 24-1/4 in D", ""), "Depth With Door Open": ("50-1/4", "in"), "Minimum Height": ("8-1/2 in Upper Rack, 11-1/4 in Lower Rack", ""), "Maximum Height": ("10-3/8 in Upper Rack, 13-1/4 in Lower Rack", ""), "Sound Level": ("47", "dBA"), "Material": ("Stainless Steel", ""), "Additional Information": ("240 kW-hr Annual Energy, 1 to 12 hr Delay Start Hours", "")},
}
B = {
    "brand_display": "Whirlpool®", "manufacturer_name": "Whirlpool Corporation", "mpn": "WDTS7024RZ", "product_name": "Dishwasher", "with_feature": "",
    "attrs": {"Series": ("Eco Series", ""), "Voltage Rating": ("120", "V"), "Amperage Rating": ("10", "A"), "Mounting Type": ("Built-in", ""), "Size": ("33-7/16 in H x 23-7/8 in W x 22-5/8 in D", ""), "Depth With Door Open": ("50-3/16", "in"), "Minimum Height": ("33-7/16", "in"), "Sound Level": ("41", "dBA"), "Material": ("Stainless Steel", ""), "Color": ("Stainless Steel", ""), "Additional Information": ("Folding Tines, Leak Detection System", "")},
}
WANT = {
    "PDSH4816AF": {
        "INVOICE_DESC": "DISHWASHER LEG 5 SST 120V 15A 50-1/4IN",
        "MOBILE_DESC": "Rheem Manufacturing FRIGIDAIRE, Dishwasher, Professional Series, PDSH4816AF",
        "SHORT_DESC": "FRIGIDAIRE® Professional Series PDSH4816AF Dishwasher With CleanBoost™, Leg Mounting, 5-Wash Cycle, Stainless Steel",
        "RETAIL_DESC": "Professional Series Dishwasher, Leg Mounting, 5-Wash Cycle, Stainless Steel",
        "LONG_DESC1": "FRIGIDAIRE® Dishwasher With CleanBoost™, Professional Series, 5 Wash Cycles, 120 V, 15 A, Leg Mounting, 24 in W x 24-1/4 in D, 50-1/4 in Depth With Door Open, 8-1/2 in Upper Rack, 11-1/4 in Lower Rack Minimum Height, 10-3/8 in Upper Rack, 13-1/4 in Lower Rack Maximum Height, 47 dBA Sound Level, Stainless Steel, Additional Information: 240 kW-hr Annual Energy, 1 to 12 hr Delay Start Hours",
    },
    "WDTS7024RZ": {
        "INVOICE_DESC": "DISHWASHER BLTLN SST SST 120V 10A 41DBA",
        "MOBILE_DESC": "Whirlpool, Dishwasher, Eco Series, WDTS7024RZ, Built-in Mounting",
        "SHORT_DESC": "Whirlpool® Eco Series WDTS7024RZ Dishwasher, Built-in Mounting, Stainless Steel, Stainless Steel",
        "RETAIL_DESC": "Eco Series Dishwasher, Built-in Mounting, Stainless Steel, Stainless Steel",
        "LONG_DESC1": "Whirlpool® Dishwasher, Eco Series, 120 V, 10 A, Built-in Mounting, 33-7/16 in H x 23-7/8 in W x 22-5/8 in D, 50-3/16 in Depth With Door Open, 33-7/16 in Minimum Height, 41 dBA Sound Level, Stainless Steel, Stainless Steel, Additional Information: Folding Tines, Leak Detection System",
    },
}


def test_descriptions_byte_for_byte(spark):
    schema = "brand_display string, manufacturer_name string, mpn string, product_name string, with_feature string, attrs map<string,struct<value:string,uom:string>>"
    facts = spark.createDataFrame([A, B], schema)
    out = D.descriptions(facts, D.Facts(feature="with_feature")).collect()
    assert {r.mpn: {k: r[k] for k in WANT[r.mpn]} for r in out} == WANT
    assert all(r.invoice_ok and len(r.INVOICE_DESC) <= 40 for r in out)


def test_header():
    names = reference.delivery_header()
    assert len(names) == len(set(names)) == 252 and names[54] == "Product Name" and names[55:58] == ["ATTRIBUTE_LABEL 1", "ATTRIBUTE_VALUE 1", "ATTRIBUTE_UOM 1"] and names[204] == "ATTRIBUTE_UOM 50"


PAGE = "Model WDX1 specifications. Voltage 120 V. Mounting Built-in. Colour: Eco Series Quiet Dishwasher. " * 5


@pytest.fixture(scope="module")
def rows(spark):
    schema = "Mfg_Part_Num string, Part_Desc string, E1_Brand string, Unilog_Brand string, DIB_Brand string, Part_Manuf string"
    data = [("WDX1", "Whirlpool Dishwasher SS", "-- none --", "W", "", "-"), ("NOB1", "Dishwasher SS", "x", "", "", "Co"), ("GE22", "GE Range 30", "", "", "", ""), ("ZZ9", "garden hose", "", "", "", "")]
    urls = [("WDX1", 0, "u0", 404, "text/html", "", ""), ("WDX1", 1, "u1", 200, "text/html", f"<html>{PAGE}</html>", ""), ("GE22", 0, "g0", 200, "text/html", "<p>nav</p>" * 90, ""), ("GE22", 1, "g1", None, "", "", "timed out")]
    pages = corpus.fetched_pages(spark.createDataFrame(urls, "mpn string, url_pos int, url string, status int, content_type string, body string, error string"))
    best = corpus.first_reachable(pages, ["mpn"])
    responses = [("WDX1", "Voltage Rating", True, "120 V", "Voltage 120 V"), ("WDX1", "Mounting Type", True, "Built-in", "mounting  built-in"), ("WDX1", "Color", True, "Eco Series Quiet Dishwasher", "Colour: Eco Series Quiet Dishwasher"), ("WDX1", "Sound Level", True, "41 dBA", "41 dBA quiet"), ("WDX1", "Series", False, "", "")]
    said = spark.createDataFrame(responses, "mpn string, label string, found boolean, value string, quote string")
    found = D.page_attributes(best.where("ok").select("mpn", F.lit("DISHWASHER").alias("category"), "text"), said)
    searched = corpus.brand_of_results(spark.createDataFrame([("NOB1", 0, "https://shop.example/a"), ("NOB1", 1, "//x/?uddg=https%3A%2F%2Fwww.frigidaire.ca%2Fp")], "mpn string, rank int, href string"), reference.brands(spark))
    out = D.assemble(spark.createDataFrame(data, schema), best, found, searched)
    return {r.Mfg_Part_Num: r for r in out.collect()}, out


def test_rows(rows):
    by, out = rows
    assert out.columns[:252] == reference.delivery_header()
    w = by["WDX1"]
    assert (w["ATTRIBUTE_LABEL 4"], w["ATTRIBUTE_VALUE 4"], w["ATTRIBUTE_UOM 4"]) == ("Voltage Rating", "120", "V")
    assert w["ATTRIBUTE_VALUE 6"] == "Built-in" and w["ATTRIBUTE_VALUE 14"] is None and w["ATTRIBUTE_VALUE 12"] is None and w["ATTRIBUTE_LABEL 1"] is None
    assert w.confidence == round(0.4 + 0.3 + 0.3 * 2 / 15, 3) and w.decision == "REVIEW" and w["MFR URL"] == "u1"
    assert w["E1_Brand"] is None and w["Unilog_Brand"] == "W" and w["Part_Manuf"] is None and w["INVOICE_DESC"].startswith("DISHWASHER BLTLN")
    n = by["NOB1"]
    assert n["BRAND_NAME"] == "FRIGIDAIRE®" and n["SHORT_DESC"] == "FRIGIDAIRE® NOB1 Dishwasher" and any("via search" in x for x in n.reasons)
    g = by["GE22"]
    assert g["MFR URL"] is None and g.confidence == 0.24 and any("unreachable (timed out)" in x for x in g.reasons)
    z = by["ZZ9"]
    assert z.confidence == 0.0 and z.decision == "REVIEW" and z["Dept"] is None and len(z.reasons) == 1


def test_files(rows, spark, tmp_path):
    _, out = rows
    sinks.write_delivery(out.coalesce(1), str(tmp_path / "d"))
    sinks.write_review_log(out.coalesce(1), str(tmp_path / "log"))
    [f] = (tmp_path / "d").glob("*.csv")
    with f.open(encoding="utf-8", newline="") as h:
        read = list(csv.reader(h))
    assert read[0] == reference.delivery_header() and len(read) == 5 and all(len(r) == 252 for r in read)
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).columns == ["mpn", "decision", "confidence", "reasons"]


def test_batch(spark, tmp_path):
    from provenia.plans import appliance

    (tmp_path / "in.csv").write_text("Mfg_Part_Num,Part_Desc,E1_Brand,Unilog_Brand,DIB_Brand,Part_Manuf\nWDX1,Whirlpool Dishwasher SS,,,,Keep\nQ2,garden hose,,,,Keep\nR3,Maytag dryer,,,,Skip\n")
    fetched = spark.createDataFrame([("WDX1", 0, "u1", 200, "text/html", f"<html>{PAGE}</html>", "")], "mpn string, url_pos int, url string, status int, content_type string, body string, error string")
    said = spark.createDataFrame([("WDX1", label, True, v, q) for label, v, q in (("Voltage Rating", "120 V", "Voltage 120 V"), ("Model", "WDX1", "Model WDX1"), ("Mounting Type", "Built-in", "Mounting Built-in"))], "mpn string, label string, found boolean, value string, quote string")
    counts = appliance.run_batch(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), fetched, said, excluded=("Skip",)).collect()
    assert [(r.decision, r.n) for r in counts] == [("AUTO_PUBLISH", 1)]
    rows = appliance.input_rows(spark, str(tmp_path / "in.csv"))
    urls = appliance.wanted_urls(rows).orderBy("mpn", "url_pos").collect()
    assert [u.mpn for u in urls] == ["R3"] * 3 + ["WDX1"] * 3 and urls[3].url.endswith("searchtext=WDX1")


def test_catalog_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Mfg_Part_Num,Part_Desc,Part_Manuf\nA,dishwasher,Keep\nB,dryer,Skip\n")
    assert [r.Mfg_Part_Num for r in corpus.catalog_rows(spark, str(tmp_path / "c.csv"), ("Skip",)).collect()] == ["A"]


def test_gold_file(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"labels": {"S": {"a": 50, "b": ["X", "Y"], "c": true}}}')
    got = {r.attribute: [(x.num, x.str, x.flag) for x in r.accepted] for r in corpus.gold_labels(spark, str(tmp_path / "g.json"), whole=True).collect()}
    assert got == {"a": [(50.0, None, None)], "b": [(None, "X", None), (None, "Y", None)], "c": [(None, None, True)]}


def test_gold_lines(spark, tmp_path):
    lines = ['{"sku": "S", "labels": {"a": 50, "b": ["X", "7", 1.5], "c": true, "d": null, "e": []}}', "", "{broken", '{"labels": {"a": 1}}', '{"sku": "T", "labels": 5}', '[1]', '{"sku": "U", "labels": {}}', '{"sku": 12, "labels": {"a": "false"}}']
    (tmp_path / "g.json").write_text("\n".join(lines))
    path = str(tmp_path / "g.json")
    got = {(r.sku, r.attribute): [(x.num, x.str, x.flag) for x in r.accepted] for r in corpus.gold_labels(spark, path).collect()}
    assert got == {("S", "a"): [(50.0, None, None)], ("S", "b"): [(None, "X", None), (7.0, None, None), (1.5, None, None)], ("S", "c"): [(None, None, True)], ("S", "d"): [(None, None, None)], ("S", "e"): [], ("12", "a"): [(None, None, False)]}
    assert sorted((r.reason, r.value) for r in corpus.gold_errors(spark, path).collect()) == [("no JSON", "{broken"), ("no labels", '{"sku": "T", "labels": 5}'), ("no sku", "[1]"), ("no sku", '{"labels": {"a": 1}}')]
    assert corpus.gold_errors(spark, path, whole=True).first().reason == "no JSON"


def test_documents_never_fetched_raise(spark, tmp_path):
    manifest = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    fetched = spark.createDataFrame([("a", "11")], "doc_id string, sha256 string")
    lock = spark.createDataFrame([("a", "22", "t")], "doc_id string, sha256 string, fetched_at string")
    assert corpus.load_documents(manifest.where("doc_id = 'a'"), fetched, lock).first().sha256 == "22"
    with pytest.raises(Exception, match="has not been fetched"):
        corpus.load_documents(manifest, fetched, lock).collect()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "f" / "y.pdf").write_bytes(b"<html>")
    assert corpus.pdf_files(spark, str(tmp_path / "f")).count() == 1
