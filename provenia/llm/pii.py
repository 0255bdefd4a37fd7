"""Personal data in texts: patterns propose spans, checks confirm them, nearby words score them.

Built from Spark SQL functions only. Positions come from the pieces between the matches
of a pattern, whose lengths are summed in blocks, so that a text costs about its length
plus its matches. The patterns are written so that Java matches them in linear time and
without recursion: possessive where nothing can follow, and begun only where a run
begins or the previous match ended.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import let

#: Matches whose positions are summed together; code points of context; score in hundredths from which spans of added kinds are admitted.
SUMMED, CONTEXT, ADMITTED = 256, 48, 50
#: In the order of ties; those before iban are found whatever their score.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = 4
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
}
#: What a text must have for the pattern to be tried.
GUARDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"),
}
#: Score of a confirmed span in hundredths, by how much a word nearby raises or lowers it, and these words in English, German, French and Spanish.
PRIOR, STEP = {"email": 80, "ip": 60, "card": 80, "phone": 70, "iban": 60}, 20
RAISING = {
    "email": "mail|e-mail|contact|write|reply|kontakt|schreiben|antwort|courriel|écrire|correo|contacto|escribir",
    "ip": "ip|address|host|server|client|login|adresse|rechner|serveur|adresse|dirección|servidor",
    "card": "card|visa|mastercard|amex|credit|debit|payment|cvv|karte|kreditkarte|zahlung|carte|paiement|tarjeta|pago",
    "phone": "tel|phone|call|mobile|fax|whatsapp|sms|telefon|anruf|handy|téléphone|appeler|portable|teléfono|llamar|móvil",
    "iban": "iban|account|bank|swift|bic|transfer|konto|überweisung|compte|banque|virement|cuenta|banco|transferencia",
}
LOWERING = {
    "email": "example|noreply|beispiel|exemple|ejemplo",
    "ip": "version|release|section|chapter|abschnitt|kapitel|chapitre|versión|sección|capítulo",
    "card": "order|tracking|serial|isbn|invoice|bestellung|sendung|rechnung|commande|suivi|facture|pedido|envío|factura",
    "phone": "equals|plus|sum|version|gleich|summe|égale|somme|suma",
    "iban": "serial|key|token|part|seriennummer|schlüssel|clé|jeton|clave|serie",
}
_SPAN = "array<struct<s:int,k:int,e:int,kind:string,m:string,score:int>>"
_FOUND = "struct<s:int,e:int,m:string,before:string,after:string>"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _blank(kind: str) -> Column:
    return F.from_json(F.lit("{}"), kind)


def _matches(text: Column, pattern: str) -> Column:
    """Matches of pattern: (s, e, m, before, after), positions in code points from 0, end exclusive."""

    def body(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            gap, m = F.element_at(x["p"], i), F.element_at(x["m"], i)
            s = acc["pos"] + F.length(gap)
            e = s + F.length(m)
            found = F.struct(s.alias("s"), e.alias("e"), m.alias("m"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(F.element_at(x["p"], i + 1), F.lit(CONTEXT)).alias("after"))
            return F.struct(e.alias("pos"), F.array_append(acc["out"], found.cast(_FOUND)).alias("out"))

        def block(b: Column) -> Column:
            start = F.struct(F.lit(0).alias("pos"), _empty(f"array<{_FOUND}>").alias("out"))
            return F.aggregate(F.sequence(b * SUMMED + 1, F.least(F.size(x["m"]), (b + 1) * SUMMED)), start, step)

        def shifted(blocks: Column) -> Column:
            begins = F.aggregate(
                blocks,
                F.struct(F.lit(0).alias("pos"), _empty("array<int>").alias("at")),
                lambda acc, b: F.struct((acc["pos"] + b["pos"]).alias("pos"), F.array_append(acc["at"], acc["pos"]).alias("at")),
                lambda acc: acc["at"],
            )
            return F.flatten(F.zip_with(blocks, begins, lambda b, at: F.transform(b["out"], lambda o: F.struct((o["s"] + at).alias("s"), (o["e"] + at).alias("e"), o["m"].alias("m"), o["before"].alias("before"), o["after"].alias("after")).cast(_FOUND))))

        some = let(F.transform(F.sequence(F.lit(0), F.floor((F.size(x["m"]) - 1) / SUMMED).cast("int")), block), shifted)
        return F.when(F.size(x["m"]) > 0, some).otherwise(_empty(f"array<{_FOUND}>"))

    return let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), body)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _mod97(m: Column) -> Column:
    turned = F.concat(F.substring(m, F.lit(5), F.length(m)), F.substring(m, F.lit(1), F.lit(4)))

    def add(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, acc * 10 + v - 48).otherwise(acc * 100 + v - 55) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _valid(kind: str, r: Column) -> Column:
    m = r["m"]
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: F.when(F.length(q) > 3, False).otherwise(q.cast("int") <= 255)))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return ~r["before"].rlike(r"[A-Za-z0-9]\z") & ~r["after"].rlike(r"\A[A-Za-z0-9]") & _mod97(m)
    return F.lit(True)


def _score(kind: str, r: Column) -> Column:
    near = F.concat_ws(" ", r["before"], r["after"])
    word = r"(?iu)(?<![\p{L}\p{N}])(?:%s)(?![\p{L}\p{N}])"
    up, down = (F.when(near.rlike(word % words), STEP).otherwise(0) for words in (RAISING[kind], LOWERING[kind]))
    return F.lit(PRIOR[kind]) + up - down


def spans(text: Column, least: int = ADMITTED) -> Column:
    """All personal data of a text by start, then kind: array of (s, k, e, kind, m, score).

    s and e are code points, k is the kind's place in KINDS, scores are hundredths. Base
    kinds are found whatever their score, others from `least`. Null counts as empty; a text
    without any gives an empty array. Spans of different kinds may overlap.
    """
    text = F.coalesce(text, F.lit(""))
    of = []
    for k, kind in enumerate(KINDS):
        good = F.filter(_matches(text, PATTERNS[kind]), lambda r: _valid(kind, r))
        own = F.transform(good, lambda r: F.struct(r["s"].alias("s"), F.lit(k).alias("k"), r["e"].alias("e"), F.lit(kind).alias("kind"), r["m"].alias("m"), _score(kind, r).alias("score"))).cast(_SPAN)
        if k >= BASE:
            own = F.filter(own, lambda r: r["score"] >= least)
        of.append(F.when(GUARDS[kind](text), own).otherwise(_empty(_SPAN)))
    return F.array_sort(F.concat(*of))


def redact(text: Column, least: int = ADMITTED) -> Column:
    """The text with each confirmed span replaced by its kind in brackets.

    Base kinds are replaced whatever their score, others from `least`. Of overlapping
    spans the first stands. Null stays null, a text without any stays as it is. No pattern
    spans a line break, so the work is done line by line and a long text costs about its length.
    """

    def line(x: Column) -> Column:
        def step(acc: Column, r: Column) -> Column:
            more = F.concat(acc["out"], F.substring(x, acc["pos"] + 1, r["s"] - acc["pos"]), F.lit("["), F.upper(r["kind"]), F.lit("]"))
            return F.when(r["s"] >= acc["pos"], F.struct(r["e"].alias("pos"), more.alias("out"))).otherwise(acc)

        start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
        return F.aggregate(spans(x, least), start, step, lambda acc: F.concat(acc["out"], F.substring(x, acc["pos"] + 1, F.length(x))))

    maybe = reduce(or_, [GUARDS[kind](text) for kind in KINDS])
    return F.when(maybe, F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")).otherwise(text)


def _joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda r: F.concat_ws(":", r["kind"], r["s"].cast("string"), r["e"].cast("string"))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found) for each row of docs, found as spans() gives it; repeated rows stay, empty tables give none.

    Null texts count as empty. Long texts are read whole, line by line; other columns play no part.
    """
    return docs.select(F.col(id_col), spans(F.col(text_col)).alias("found"))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans and their scores for each row of documents."""

    def digest(found: Column) -> Column:
        base = F.filter(found, lambda r: r["k"] < BASE)
        counts = [F.size(F.filter(found, lambda r: r["k"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:BASE])]
        return F.struct(*counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(found).alias("spans"), F.concat_ws(",", F.transform(found, lambda r: r["score"].cast("string"))).alias("scores"))

    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", let(F.col("found"), digest).alias("d")).select("doc_id", "d.*")


def _sql_kind(kind: str, pattern: str, valid: str) -> str:
    near = "right(p[i], {n}) || ' ' || left(p[i+1], {n})".format(n=CONTEXT)
    up, down = (rf"regexp_matches(near, '(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{words})(?:$|[^\p{{L}}\p{{N}}])')::INT" for words in (RAISING[kind], LOWERING[kind]))
    return f"""SELECT rid, '{kind}' AS kind, {KINDS.index(kind)} AS k, s, e, {PRIOR[kind]} + {STEP} * ({up} - {down}) AS score FROM (
  SELECT rid, m, s, s + length(m) AS e, before, after, near FROM (
    SELECT rid, m[i] AS m, coalesce(list_sum(list_transform(p[:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m[:i-1], lambda x: length(x))), 0)::BIGINT AS s,
           right(p[i], 1) AS before, left(p[i+1], 1) AS after, {near} AS near
    FROM (SELECT rid, p, m, unnest(generate_series(1, len(m))) AS i FROM (
      SELECT rid, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m FROM d)))) WHERE {valid}"""


_SQL_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_SQL_LUHN = f"""length({_SQL_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length({_SQL_DIGITS})), lambda j:
  CASE WHEN substr({_SQL_DIGITS}, (length({_SQL_DIGITS}) - j)::INT, 1)::INT * (1 + j % 2) > 9 THEN substr({_SQL_DIGITS}, (length({_SQL_DIGITS}) - j)::INT, 1)::INT * (1 + j % 2) - 9
       ELSE substr({_SQL_DIGITS}, (length({_SQL_DIGITS}) - j)::INT, 1)::INT * (1 + j % 2) END)) % 10 = 0"""
_SQL_97 = r"""NOT regexp_matches(before, '[A-Za-z0-9]') AND NOT regexp_matches(after, '[A-Za-z0-9]') AND
  list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), lambda c: ascii(c)::HUGEINT)),
    lambda a, v: CASE WHEN v < 58 THEN a * 10 + v - 48 ELSE a * 100 + v - 55 END % 97) = 1"""
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join((
    _sql_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _sql_kind("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) <= 255))"),
    _sql_kind("card", r"[0-9](?:[\x20-]?[0-9])+", _SQL_LUHN),
    _sql_kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_SQL_DIGITS}) BETWEEN 9 AND 15"),
    _sql_kind("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", _SQL_97)))}),
a AS (SELECT * FROM f WHERE k < {BASE} OR score >= {ADMITTED}),
g AS (SELECT rid, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 4), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
  string_agg(score::VARCHAR, ',' ORDER BY s, k) AS scores FROM a GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (rid)
"""
