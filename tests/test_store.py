import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from provenia.functions import values as V
from provenia.operators import arbitrate, gate, generators, publish, store
from provenia.operators.confidence import Model
from provenia.plans import appliance, datasheet
from provenia.sources import corpus, reference, scratch
from tests import sheets


def test_commits_are_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "store")
    rec = lambda *rows: spark.createDataFrame(list(rows), "sku string, name string")
    att = lambda *rows: spark.createDataFrame(list(rows), "sku string, attribute string, v int")
    log = lambda n: spark.createDataFrame([(f"e{n}",)], "event string")
    assert store.commits(spark, path).count() == 0
    assert store.save(path, rec(("a", "x"), ("b", "y")), att(("a", "p", 1), ("b", "p", 2)), log(1)) == 1
    assert store.save(path, rec(("a", "z")), att(("a", "p", 3), ("a", "q", 4)), log(2)) == 2
    rec(("b", "lost")).write.parquet(f"{path}/records/part-of-a-writer-that-was-lost")
    assert sorted(map(tuple, store.load(spark, path, "records").select("sku", "name").collect())) == [("a", "z"), ("b", "y")]
    assert sorted(map(tuple, store.load(spark, path, "attributes").select("sku", "attribute", "v").collect())) == [("a", "p", 3), ("a", "q", 4), ("b", "p", 2)]
    assert store.save(path, rec(("c", "w")), att(("c", "p", 5)), log(3)) == 3
    assert sorted(r.sku for r in store.load(spark, path, "records").collect()) == ["a", "b", "c"]
    assert sorted(r.event for r in store.load(spark, path, "audit").collect()) == ["e1", "e2", "e3"]


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "sku string, v int")


def _read(spark, path, version=None):
    return sorted((r.sku, r.v, r.version) for r in store.load(spark, path, "t", version).collect())


def test_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    path, keys = str(tmp_path / "store"), {"t": ["sku"]}
    assert store.commit(path, {"t": _rows(spark, ("a", 1), ("b", 1))}, keys) == 1
    listed, late = store._listed, []

    def stale(s, p):
        """What a writer sees that looks just before another one's commit is there."""
        out = listed(s, p)
        if not late:
            late.append(store.commit(path, {"t": _rows(spark, ("b", 2))}, keys) if late.append(0) is None else None)
        return out

    monkeypatch.setattr(store, "_listed", stale)
    assert store.commit(path, {"t": _rows(spark, ("a", 3))}, keys, base=1) == 3  # its entry was taken, its keys were not
    monkeypatch.setattr(store, "_listed", listed)
    assert late == [0, 2] and _read(spark, path) == [("a", 3, 3), ("b", 2, 2)]
    with pytest.raises(store.Conflict):
        store.commit(path, {"t": _rows(spark, ("b", 9), ("c", 9))}, keys, base=1)
    assert _read(spark, path) == [("a", 3, 3), ("b", 2, 2)] and store.commits(spark, path).count() == 3
    assert store.commit(path, {"t": _rows(spark, ("b", 9))}, keys, base=2) == 4 and store.commit(path, {"t": _rows(spark, ("b", 10))}, keys) == 5
    assert not store._publish(spark, f"{path}/_log/{5:012d}.json", {}) and _read(spark, path, 5) == [("a", 3, 3), ("b", 10, 5)]


def test_threads_commit_side_by_side(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "store")
    frames = [_rows(spark, (f"k{k}", k)) for k in range(6)]
    with ThreadPoolExecutor(3) as pool:
        versions = sorted(pool.map(lambda f: store.commit(path, {"t": f}, {"t": ["sku"]}), frames))
    assert versions == [1, 2, 3, 4, 5, 6] and [r[:2] for r in _read(spark, path)] == [(f"k{k}", k) for k in range(6)]


def test_checkpoints_bound_what_a_read_opens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "EVERY", 3)
    path, keys, now = str(tmp_path / "store"), {"t": ["sku"], "log": []}, {}
    versions = {}
    for k in range(1, 9):
        rows = _rows(spark, (f"k{k % 4}", k)).withColumn(store.REMOVED, F.lit(k == 6))
        now[f"k{k % 4}"] = (k, k)
        if k == 6:
            del now["k2"]
        store.commit(path, {"t": rows, "log": _rows(spark, ("e", k))}, keys)
        versions[k] = sorted((s, *v) for s, v in now.items())
    for k, want in versions.items():
        assert _read(spark, path, k) == want
        assert store.load(spark, path, "log", k).count() == k
    folders = {f.rsplit("/", 2)[1] for f in store.load(spark, path, "t").inputFiles()}
    assert len(folders) <= 3 and any(f.startswith("merged") for f in folders)
    with pytest.raises(ValueError, match="no version 99"):
        store.load(spark, path, "t", 99)
    with pytest.raises(ValueError, match="no table"):
        store.load(spark, path, "other")


def slow_arbitrate(claims):
    """The winner of claims (key, doc, vkey, prec, weight, ord) by plain loops."""
    import math

    cells = {}
    for _, doc, v, prec, weight, o in claims:
        cells.setdefault((doc, v), []).append((prec, weight, o))
    score, docs = {}, {}
    for (doc, v), got in cells.items():
        weight = min(got, key=lambda x: x[2])[1]
        score[v] = score.get(v, 0) + max(p for p, *_ in got) * weight * (1 + 0.5 * math.log2(len(got) + 1))
        docs.setdefault(v, set()).add(doc)
    order = sorted(score, key=lambda v: (-round(score[v], 9), v))
    win = order[0]
    return win, len(docs[win]), len(order) - 1, any(docs[v] - docs[win] for v in order[1:]), order[1:5]


def test_arbitration_matches_plain_loops(spark):
    rng = random.Random(21)
    rows = [(f"k{rng.randrange(12)}", rng.randrange(4), rng.choice("abcdefgh"), float(rng.randint(1, 3)), rng.choice([1.0, 0.4]), i) for i in range(260)] + [("solo", 1, "z", 1.0, 1.0, 1)]
    claims = spark.createDataFrame(rows, "k string, doc int, vkey string, prec double, weight double, ord int").withColumn("display", F.lit(""))
    got = {r.k: (r.vkey, r.agreeing_sources, r.n_rivals, r.conflicting, r.conflict_values) for r in arbitrate.arbitrate(claims.repartition(5), ["k"]).collect()}
    assert got == {k: slow_arbitrate([r for r in rows if r[0] == k]) for k in {r[0] for r in rows}}
    assert arbitrate.arbitrate(claims.limit(0), ["k"]).count() == 0


def test_a_registered_strategy_joins_the_panel(spark, monkeypatch):
    def fixed(text, mpn, spec, siblings, known):
        at = F.instr(text, "35 V") - 1
        c = generators._candidate(text, F.lit("35 V"), F.lit("V"), at, at + 4, at, at + 4, F.lit(2.5))
        return F.when((spec["attribute"] == "input_voltage_max") & (at >= 0), F.array(c)).otherwise(F.array().cast(f"array<{generators.CANDIDATE}>"))

    monkeypatch.setattr(generators, "_OWN", type(generators._OWN)())
    generators.register("fixed", fixed, spark)
    with pytest.raises(ValueError):
        generators.register("fixed", fixed, spark)
    assert "fixed" in generators.strategies(spark) and "fixed" not in generators.strategies(spark.newSession())
    skus, manifest, pages = sheets.tables(spark)
    work = datasheet.work_rows(skus, manifest, corpus.document_text(pages))
    rows = generators.candidates(work, ("fixed",)).collect()
    assert [(r.sku, r.attribute, r.extractor, r.extractor_pos, r.value_num, r.verified) for r in rows] == [("R1", "input_voltage_max", "fixed", 4, 35.0, True)]
    with pytest.raises(ValueError):
        generators.candidates(work, ("nothing",))


def test_an_unknown_class_raises(spark):
    skus, manifest, pages = sheets.tables(spark)
    strange = skus.withColumn("product_class", F.when(F.col("sku") == "R1", "TRANSISTOR").otherwise(F.col("product_class")))
    with pytest.raises(PySparkException, match="unknown product class TRANSISTOR"):
        datasheet.work_rows(strange, manifest, corpus.document_text(pages)).select("sku", "specs").collect()


def test_more_units(spark):
    cases = [(1.0, "mil", "mm", 0.0254), (2.0, "ft", "in", 24.0), (300.0, "K", "degC", 26.85), (2.0, "Ah", "mAh", 2000.0), (60.0, "rpm", "Hz", 1.0), (1.0, "kg", "lb", 2.2046226), (3.0, "kWh", "J", 1.08e7), (1.5, "MHz", "kHz", 1500.0)]
    rows = spark.createDataFrame(cases, "x double, a string, b string, want double")
    for r in rows.select("want", V.convert(F.col("x"), F.col("a"), F.col("b")).alias("got"), V.compatible(F.col("a"), F.lit("V")).alias("volts")).collect():
        assert r.got == pytest.approx(r.want, rel=1e-6) and not r.volts


def test_malformed_lines_cost_their_row_only(spark, tmp_path):
    (tmp_path / "in.csv").write_text('Mfg_Part_Num,Part_Desc,E1_Brand,Unilog_Brand,DIB_Brand,Part_Manuf\nA1,Whirlpool Dishwasher,,,,Co\nB2,GE Range,too,few\nC3,"LG ""Washer"", white",,,,Co\n')
    none = spark.createDataFrame([], "mpn string, url_pos int, url string, status int, content_type string, body string, error string")
    said = spark.createDataFrame([], "mpn string, label string, found boolean, value string, quote string")
    counts = appliance.run_batch(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), none, said)
    assert {r.decision: r.n for r in counts.collect()} == {"REVIEW": 3}
    log = {r.mpn: r.reasons for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out" / "review_log")).collect()}
    assert set(log) == {"A1", "B2", "C3"} and log["B2"].startswith("pipeline error: malformed line: B2,GE Range")


def test_health_and_classes(spark):
    decided = spark.createDataFrame([("s", "a", "AUTO_PUBLISH", False, True, 2, "q")], "sku string, attribute string, decision string, conflicting boolean, safety boolean, agreeing_sources int, quote string")
    row = publish.health(decided, decided.limit(0), spark.range(3), Model(), "1.2").first()
    assert (row.version, row.calibrated, row.threshold_general, row.records, row.documents, row.audit_events) == ("1.2", False, 0.9, 1, 3, 0)
    assert reference.attributes_of(spark, "DRYER").count() == len(reference.DELIVERED["DRYER"]) and reference.attributes_of(spark, "x").count() == 0
    assert reference.safety_critical(spark).where("class_key = 'RECTIFIER_DIODE'").count() == 3


def test_scratch_folders_are_fresh(spark):
    a, b = scratch.scratch_dir(spark), scratch.scratch_dir(spark)
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
    spark.range(1).write.parquet(a)
    scratch.delete(spark, a)
    spark.range(1).write.parquet(a)
