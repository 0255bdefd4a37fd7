import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenia.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_find(terms, word):
    found = []
    for t in terms:
        d = min(distance(word[:n], t.text) for n in (range(len(word) + 1) if t.stem else [len(word)]))
        if d <= X.Automaton.edits(t):
            found.append(d)
    return min(found, default=None)


def test_automaton_finds_what_brute_force_finds(monkeypatch):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    for states in (100_000, 20):
        monkeypatch.setattr(X, "STATES", states)
        terms = [X.Term(word(rng.randint(4, 11)), rng.random() < 0.5, 0.9) for _ in range(25)]
        automaton = X.Automaton(terms)
        for _ in range(3000):
            w = word(rng.randint(0, 13)) if rng.random() < 0.5 else rng.choice(terms).text + word(rng.randint(0, 2))
            got = automaton.find(w)
            assert (got and got[0]) == slow_find(terms, w), w


def test_quotation_counts_less_than_abuse():
    words = X._Words(X.Automaton([X.Term("idiot", False, 0.95)]))
    abuse, quoted = X.measure(words, "you are an idiot today"), X.measure(words, 'he said the word "idiot" was used')
    assert abuse[0] > quoted[0] and quoted[2] > abuse[2]
    assert X.measure(words, "such an idioot")[1] > 0 == X.measure(words, "such an idioot")[0]
    assert X.measure(words, "") == [0.0, 0.0, 0.0, 0.0]


def test_runs_without_white_space_are_read():
    words = X._Words(X.Automaton([X.Term("idiot", False, 0.95)]))
    text = ["you", "are", "an", "idiot", *["word"] * 300, "such", "idioot"]
    assert X.measure(words, ",".join(text)) == X.measure(words, " ".join(text))


def test_long_words_and_other_scripts_are_read():
    words = X._Words(X.Automaton([X.Term("idiot", False, 0.95), X.Term("笨蛋", False, 0.9)]))
    assert X.measure(words, "a" * 100_000) == [0.0, 0.0, 0.0, 0.0]
    assert X.measure(words, "a" * 100_000 + " idiot")[0] > 0
    assert X.measure(words, "-".join(["x" * 50_000, "idiot", "y" * 50_000]))[0] > 0
    assert X.measure(words, "你，笨蛋！")[0] > 0


def slow_measure(terms, text):
    """Sums of measure() by the plain distance of each word to each term, where a quotation is a word in marks."""
    parts, sums = text.split(), [0.0, 0.0, 0.0]
    plain = [w.strip('"(),!').lower() for w in parts]
    marked = [w[0] == '"' for w in parts]
    for k, w in enumerate(plain):
        best = None
        for t in terms:
            d = min(distance(w[:n], t.text) for n in (range(len(w) + 1) if t.stem else [len(w)]))
            if d <= X.Automaton.edits(t) and (best is None or d < best[0]):
                best = (d, t)
        if best is None:
            continue
        around = range(max(0, k - X.CONTEXT), min(len(parts), k + X.CONTEXT + 1))
        to = 0 if marked[k] else sum(plain[j] in X.ADDRESSING and not marked[j] for j in around)
        report = marked[k] + sum(plain[j] in X.QUOTING for j in around)
        share = (1 + to) / (1 + to + 2 * report)
        sums[1 if best[0] else 0] += best[1].weight * share
        sums[2] += best[1].weight * (1 - share)
    return [*np.log1p(sums), (sums[0] + sums[1]) / max(1, len(parts)) ** 0.5]


def test_quotations_are_told_from_abuse_in_four_languages():
    words = X._Words(X.Automaton([X.Term(t, False, 0.9) for t in ("idiot", "idiota", "scum")]))
    pairs = [
        ("you are a total idiot and everyone knows", '"you are a total idiot and everyone knows" was in the film'),
        ("you are a total idiot and everyone knows", "“you are a total idiot and everyone knows” was in the film"),
        ("du bist ein idiot", "„du bist ein idiot“ stand an der Wand"),
        ("tu es un idiot fini", "« tu es un idiot fini » sur le mur"),
        ("eres un idiota total", "«eres un idiota total» en la pared"),
        ("you're an idiot", "'you're an idiot' on the wall"),
    ]
    for abuse, quoted in pairs:
        a, q = X.measure(words, abuse), X.measure(words, quoted)
        assert q[0] <= 0.62 * a[0] and q[2] > a[2], quoted
    # Outside the marks, after marks that never close, and with an apostrophe it is abuse as before.
    full = X.measure(words, "you are an idiot")[0]
    for text in ('"fine" you are an idiot', "you're an idiot, don't deny", '5" you are an idiot', '"' + "so " * 100 + "you are an idiot"):
        assert X.measure(words, text)[0] >= 0.99 * full, text
    assert X.spoken('He said "a b" c') == (["he", "said", "a", "b", "c"], [False, False, True, True, False])


def test_no_length_changes_how_words_are_read():
    words = X._Words(X.Automaton([X.Term("idiot", False, 0.64)]))
    sums = [np.expm1(X.measure(words, "idiot," * k)[0]) for k in range(1, 400)]
    assert np.allclose(sums, 0.64 * np.arange(1, 400))
    for n in (10, 39, 41, 998, 1002, 5000):
        piece = ("word," * n)[: n - 6] + "idiot,"
        assert np.isclose(X.measure(words, piece)[0], X.measure(words, piece.replace(",", " "))[0])


def test_measure_matches_brute_force():
    rng = random.Random(14)
    terms = [X.Term(t, stem, 0.9) for t, stem in (("zwipot", False), ("grabbul", True), ("trolmaggers", False), ("moktar", True))]
    words = X._Words(X.Automaton(terms))
    pool = ["zwipot", "zwippot", "grabbulen", "grabulen", "trolmagers", "moktarix", "moktr", "you", "said", "tu", "word", "house", "tari", "zwi", "grab", "ok"]
    for _ in range(300):
        text = " ".join(rng.choice(["{}", "{}", '"{}"', "{},", "({})", "{}!"]).format(rng.choice(pool)) for _ in range(rng.randint(0, 30)))
        assert np.allclose(X.measure(words, text), slow_measure(terms, text)), text


def test_the_same_model_from_the_same_rows(spark):
    docs, labels = corpus(spark, 300)
    near = docs.where("doc_id < 150").selectExpr("doc_id + 1000 AS doc_id", "concat(text, ' tail', doc_id) AS text", "score")
    more = labels.where("doc_id < 150").selectExpr("doc_id + 1000 AS doc_id", "quality", "toxic")
    docs, labels = docs.unionByName(near), labels.unionByName(more)
    a, b = X.fit(docs.repartition(7), labels), X.fit(docs.orderBy(F.desc("doc_id")).repartition(2), labels)
    assert a.terms == b.terms and np.allclose(a.score.w, b.score.w)


def test_query_holds_out_and_predicts(spark, tmp_path):
    docs, labels = corpus(spark, 300)
    docs.drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = X.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
    assert {r.predicted for r in rows if r.held_out} == {0, 1}
    swapped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.fit(docs, labels), X.fit(docs, swapped)  # held-out labels teach nothing
    assert a.terms == b.terms and np.allclose(a.score.w, b.score.w)


def corpus(spark, n=600):
    rng = random.Random(13)
    plain = ["".join(rng.choice(["ta", "ri", "no", "se", "lu"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(30, 80))]
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["zwipot", "grabbul" + rng.choice(["en", "ta", "os", "ix", "um"])])
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, 1, int(toxic)))
    rows += [(n, None, 1.0), (n + 1, "", 1.0), (n + 2, "zwippot grabbbulen zwipot zwipot ta ri", 1.0), (0, rows[0][1], 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_words_and_stems(spark):
    docs, labels = corpus(spark)
    model = X.fit(docs, labels)
    assert ("zwipot", False) in {(t.text, t.stem) for t in model.terms}
    assert any(t.stem and t.text.startswith("grab") for t in model.terms)
    got = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    assert sum(got[i] >= X.TOXIC for i in range(0, 600, 5)) > 110
    assert sum(got[i] >= X.TOXIC for i in range(600) if i % 5) == 0
    assert got[602] > 0.7 and got[600] == got[601] < 0.3
    kept = X.clean(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(s < X.TOXIC for s in got.values()) - (got[0] >= X.TOXIC) + (got[0] < X.TOXIC) + (got[0] >= X.TOXIC)


def test_terms_rarer_than_many_neutral_ones_are_learned(spark):
    neutral = " ".join("".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(11_000))
    rows = [(i, f"{neutral} word{i}x{i} zwipot" if i % 2 and i > 4 else f"{neutral} word{i}x{i}", i % 2) for i in range(24)]
    sample = spark.createDataFrame([(p, k, t) for p in (0, 1) for _, t, k in rows], "part int, label int, text string")
    toxic, clean = X._candidates(sample, [12, 12], [12, 12])
    assert toxic[0][("zwipot", False)] == toxic[1][("zwipot", False)] == 10 and clean[0][("zwipot", False)] == 0
    assert not any(k[0] in neutral for k in toxic[0])


@pytest.mark.parametrize("which", [0, 1])
def test_without_labels(spark, which):
    docs, labels = corpus(spark, 50)
    model = X.fit(docs, labels.where("toxic = 0") if which else labels.limit(0))
    assert {t.text for t in model.terms} == set(X.SEED)
    got = X.score(docs, model).agg(F.min("score"), F.max("score")).first()
    assert 0 <= got[0] <= got[1] < 0.7
    assert X.score(docs.limit(0), model).count() == 0
