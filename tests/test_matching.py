"""Automata over folded texts against the pattern search of one word or quote at a time."""

import random
import time

from pyspark.sql import functions as F

from provenia.functions.text import find_quote
from provenia.operators import gate, generators, matching


def test_characters_are_equal_as_patterns_have_them(spark):
    odd = "aAßẞsSſkKKåÅÅµμΜσςΣıiIİǅǆǄéÉÿŸͅιΙᾳᾼŉﬀ  \u0085 ​жЖ𐐀𐐨"
    pairs = spark.createDataFrame([(a, b) for a in odd for b in odd], "a string, b string")
    same = F.expr(r"rlike(concat('x', a, 'x'), concat('(?iuU)^\\Qx', b, 'x\\E$'))")
    for r in pairs.select("a", "b", same.alias("same")).collect():
        assert (matching.fold(r.a) == matching.fold(r.b)) == r.same, (r.a, r.b)
    text = odd * 3
    assert len(matching.fold(text)) == len(text) and matching.fold(text) == "".join(map(matching.fold, text))


def test_offsets_survive_folding():
    text = "Straße \t\n  ΟΔΟΣ  x"
    folded, at = matching.fold_blanks(text)
    assert folded == "straße οδοσ x" and [text[k] for k in at.tolist()] == list("Straße ΟΔΟΣ x")
    assert matching.fold_blanks("")[0] == "" and matching.folded_quote(" \n A  b\t") == "a b"


def pairs(quotes, texts):
    return [(q, quotes[q], d, texts[d]) for q in range(len(quotes)) for d in range(len(texts))]


def test_each_pair_is_found_as_one_by_one(spark, monkeypatch):
    rng = random.Random(31)
    piece = lambda n: "".join(rng.choice(["a", "B", "ab", "é", "É", "ß", "S", "Σ", "ς", " ", "  ", "\n", " ", "x.", "\\E", "("]) for _ in range(rng.randint(0, n)))
    texts = [piece(50) for _ in range(40)] + [None, "", "many words of one text, said twice: many  WORDS of one text"]
    quotes = [piece(5) for _ in range(60)] + ["", " ", "\n", None, "a", "A ", "many words", "WORDS of", "many words of one", " words  OF one text", "(", "x."]
    quotes += [t[k : k + rng.randint(1, 9)] for t in texts[:20] if t for k in (rng.randrange(len(t)),)]
    df = spark.createDataFrame(pairs(quotes, texts), "q int, quote string, d int, text string")
    at = find_quote(F.col("text"), F.col("quote"))
    want = {(r.q, r.d): r.at for r in df.select("q", "d", at.alias("at")).where("at >= 0").collect()}
    asked = spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    for held in (matching.HELD, 0):  # by one automaton, and by words
        monkeypatch.setattr(matching, "HELD", held)
        rows = gate.quotes_in_documents(asked, docs, with_text=True).collect()
        assert {(r.quote_id, r.doc_id): r.start for r in rows} == want and len(rows) == len(want) > 100
        assert all(r.text == texts[r.doc_id] and r.quote == quotes[r.quote_id] for r in rows)
    assert gate.quotes_in_documents(asked.limit(0), docs).count() == 0 and gate.quotes_in_documents(asked, docs.limit(0)).count() == 0


def test_places_are_those_of_patterns(spark):
    rng = random.Random(5)
    words = ["VF", "aa", "Forward voltage", "T J", "°c", "straße", "(max)"]
    texts = ["".join(rng.choice(["vf", "VF", "a", "AA", "forward VOLTAGE", " ", "T J", "t j", "°C", "STRASSE", "Straße", "(MAX)", "\n"]) for _ in range(30)) for _ in range(40)] + ["", None]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, places_of string")
    read = matching.with_places(docs, words, 80)
    assert read.columns == ["doc_id", "text", "places_of", "places", "headers"]
    alias = F.array(*map(F.lit, words))
    spans = lambda hits: F.transform(hits, lambda h: F.struct(h["s"], h["e"]))
    both = read.where("text is not null").select(spans(generators.alias_hits(F.col("text"), alias)).alias("a"), spans(generators.alias_hits(F.col("text"), alias, F.col("places"))).alias("b"), spans(generators.first_alias_hits(F.col("text"), alias)).alias("c"), spans(generators.first_alias_hits(F.col("text"), alias, F.col("places"))).alias("d"))
    rows = both.collect()
    assert sum(len(r.a) for r in rows) > 300 and all(r.a == r.b and r.c == r.d for r in rows)


def plain_chain(text, siblings, gap):
    """Each place of the first sibling, then each next one's first place after the last, near enough."""
    out, up, begin = [], text.upper(), -1
    while (begin := up.find(siblings[0].upper(), begin + 1)) >= 0:
        end = begin + len(siblings[0])
        for s in siblings[1:]:
            k = up.find(s.upper(), end)
            if k < 0 or k - end > gap:
                break
            end = k + len(s)
        else:
            out.append((begin, end))
    return out


def test_headers_follow_all_siblings(spark):
    rng = random.Random(6)
    rows = []
    for k in range(120):
        kin = rng.sample(["N1", "n12", "P7", "P77", "Q"], rng.randint(1, 4))
        rows.append((k, "".join(rng.choice([*kin, "q", " ", "-----", "n1"]) for _ in range(40)), kin))
    rows += [(200, None, ["a", "b"]), (201, "a b", None), (202, "a b", ["a", ""]), (203, "aaa b", ["aa", "b"])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, siblings array<string>")
    got = {r.doc_id: [tuple(h) for h in r.headers] for r in matching.with_places(docs, [], 12, "siblings").collect()}
    for k, t, kin in rows:
        assert got[k] == (plain_chain(t, kin, 12) if t and kin and len(kin) > 1 and all(kin) else []), (t, kin)
    assert sum(map(len, got.values())) > 50 and got[203] == [(0, 5), (1, 5)]


def test_headers_of_many_siblings_take_linear_time():
    kin = [f"P{k:03d}" for k in range(500)]
    text = (" ".join(kin) + " ") * 100
    began = time.time()
    found = matching.all_places(text, matching.automaton({matching.fold(w): w for w in kin}))
    headers = matching.chain([found[w] for w in kin], 80)
    assert len(headers) == 100 and headers[1] == (2500, 4999) and time.time() - began < 5
