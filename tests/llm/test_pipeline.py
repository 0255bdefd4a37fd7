import random

from pyspark.sql import functions as F

import corpus_pipeline
from provenia.llm import exact_dedup, simhash


def corpus(spark, tmp_path):
    rng = random.Random(19)
    plain = ["".join(rng.choice(["ta", "ri", "no", "se", "lu"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda n=80: " ".join(rng.choice(plain) for _ in range(n))
    rows = [(i, text(), "en", f"src{i % 3}", 0) for i in range(300)]
    for i in range(300, 400):
        w = text().split()
        for _ in range(5):
            w[rng.randrange(80)] = rng.choice(["zwipot", "grabbul"])
        rows.append((i, " ".join(w), "en", "src0", 0))
    rows += [(400 + i, rows[i][1].replace(" ", "  ", 2), "en", "src0", 0) for i in range(20)]
    long = text(2000).split()
    rows += [(500 + i, " ".join([*long[: 100 * i], "other", *long[100 * i + 1 :]]), "en", "src0", 0) for i in range(5)]
    rows += [(600, "write to a@b.c now " + text(), "en", "src1", 0), (601, None, None, None, None), (602, "", "en", "src1", 0), (7, rows[7][1], "en", "src1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 300)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


def test_stages(spark, tmp_path):
    docs = corpus(spark, tmp_path)
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / "out" / name))
        now = spark.read.parquet(str(tmp_path / "out" / name))
        seen[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    ids = {n: sorted((r.doc_id for r in d.select("doc_id").collect()), key=str) for n, d in seen.items()}
    assert not set(ids["toxicity"]) & set(range(300, 400)) and set(range(300)) <= set(ids["toxicity"])
    kept = ids["exact_dedup"]
    assert len(kept) == len(set(kept)) and not set(kept) & set(range(400, 420)) and set(range(300)) <= set(kept) and (601 in kept) != (602 in kept)
    near = set(ids["near_dedup"])
    assert 500 in near and len(near & set(range(500, 505))) < 5 and set(range(300)) <= near
    red = {r.doc_id: r for r in seen["personal_data"].collect()}
    assert set(red) == near and red[600].text.startswith("write to [EMAIL] now") and red[600].n_chars == len(red[600].text)
    assert set(ids["packing"]) == near
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first() == seen["packing"].agg(F.sum("length")).first()


def test_rows_without_ids_or_text(spark):
    rows = [(None, "a b c d"), (None, "a b  c d"), (None, "x y z"), (3, "a b c d"), (3, "other text here"), (3, "a b c d"), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "u", "v") for i, t in rows], "doc_id long, text string, id string, class string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_copies(docs).collect()), key=str)
    assert got == sorted([(3, "a b c d"), (3, "other text here"), (4, ""), (None, "x y z")], key=str)
    got = simhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, "a b c d"), (3, "other text here"), (4, ""), (None, "x y z")], key=str)
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = corpus(spark, tmp_path).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / "empty" / name))
        docs = spark.read.parquet(str(tmp_path / "empty" / name))
        assert docs.count() == 0
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_with_clashing_columns_and_nulls(spark, tmp_path):
    """Columns named as the stages name theirs, nulls in each, ties and repeated rows, and a long text."""
    corpus(spark, tmp_path)
    long = "Long text of many words. " * 8000
    rows = [(1, "some few words of a text", "a"), (1, "some few words of a text", "b"), (2, "some few  words of a text", None), (None, None, "c"), (3, "", "d"), (None, "call +49 (30) 1234567 or a@b.org", None), (4, long, "e"), (5, long, "f"), (5, long, "f")]
    names = ["row", "out", "_kept", "id", "h64", "class", "stays", "n", "keep_id", "bucket", "fp", "f", "score", "part", "label", "fold.dots"]
    docs = spark.createDataFrame([(i, t, k, None) for i, t, k in rows], "doc_id long, text string, lang string, n_chars long")
    for name in names:
        docs = docs.withColumn(name, F.col("lang"))
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, docs, str(tmp_path))
        now.write.parquet(str(tmp_path / "odd" / name))
        now = spark.read.parquet(str(tmp_path / "odd" / name))
        if name != "packing":
            assert now.columns == docs.columns
        docs = now
        counts.append(docs.count())
    assert counts[:4] == [9, 4, 4, 4]
    red = {r.text for r in spark.read.parquet(str(tmp_path / "odd" / "personal_data")).collect()}
    assert "call [PHONE] or [EMAIL]" in red


def test_a_pass_empties_what_others_kept():
    import functools

    from provenia.llm import common

    @functools.lru_cache
    def one():
        return object()

    @functools.lru_cache
    def two():
        return object()

    common.turn_to(one)
    first = one()
    common.turn_to(one)
    assert one() is first
    common.turn_to(two)
    two()
    assert one.cache_info().currsize == 0 and two.cache_info().currsize == 1
    common.turn_to(None)
    assert two.cache_info().currsize == 0


def test_a_pass_that_ends_gives_its_memory_back(monkeypatch):
    import functools

    from provenia.llm import common

    given = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: given.append(one.cache_info().currsize)})())

    @functools.lru_cache
    def one():
        return 1

    common.turn_to(one)
    one()
    common.turn_to(one)
    assert given == []  # the pass goes on
    common.turn_to(None)
    assert given == [0]  # after its cache was emptied
    common.turn_to(None)
    assert given == [0]


def test_rows_are_kept_by_a_shuffle_too(spark, monkeypatch):
    """The join of kept rows beyond its broadcast bound gives the same, with nulls, repeats and a hot key."""
    from provenia.llm import rows as R

    made = [(i % 40 if i % 7 else None, ["a b c", None, "", "d e f g", f"text {i}"][i % 5]) for i in range(300)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    known = docs.select(F.col("doc_id").alias("id"), R.text_hash("text").alias("h64")).withColumn("class", F.col("h64") % 3)
    kept = lambda: sorted(map(str, R.keep_one_of_each(docs, known, "doc_id", "text").collect()))
    want = kept()
    monkeypatch.setattr(R, "BROADCAST_ROWS", -1)
    assert kept() == want and len(want) == known.select("class").distinct().count()
