"""One value for each attribute from candidates that disagree, and how far they do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.functions.values import value_key
from provenia.operators.generators import live
from provenia.sources.corpus import brand_matches
from provenia.sources.reference import AUTHORITY_TIERS, OTHER_TIER_WEIGHT, TIER_WEIGHTS

#: Rival values that a result shows; parts in which a key's values are ranked.
RIVALS_SHOWN, PARTS = 4, 8


def authority_tier(authority: Column) -> Column:
    tiers = F.create_map(*[F.lit(x) for pair in AUTHORITY_TIERS.items() for x in pair])
    return F.coalesce(F.try_element_at(tiers, authority), F.lit(AUTHORITY_TIERS["UNKNOWN"]))


def tier_weight(tier: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in TIER_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, tier), F.lit(OTHER_TIER_WEIGHT))


def brand_authority(candidates: DataFrame, brand: str = "brand") -> DataFrame:
    """Candidates of documents that another brand published count as a distributor's."""
    return candidates.withColumn("authority", F.when(brand_matches(F.col("publisher"), F.col(brand)), F.col("authority")).otherwise("AUTHORIZED_DIST"))


def arbitrate(claims: DataFrame, keys: list[str]) -> DataFrame:
    """The winning value of each key and what speaks against it.

    claims: keys, doc, vkey, prec, weight (of the document's authority), ord (a number or
    struct that orders claims), display, and anything else, which the winner keeps in `won`.
    First level: per document and value the best precision, its first claim, the number of
    claims and the authority of the first. Second: per value the sum of precision times
    authority times 1 + log2(n + 1) / 2, so repetition counts but little. The greatest sum
    wins, the smaller value on a tie. It conflicts if a rival has a document it has not.
    Keys must not be null. The claims are read once; no list of a key's claims, documents or
    values is gathered anywhere, but the few that are shown.
    """
    row = F.struct(*[c for c in claims.columns if c not in (*keys, "vkey")])
    order = F.struct((-F.col("prec")).alias("p"), F.col("ord"))
    cells = claims.groupBy(*keys, "doc", "vkey").agg(F.max("prec").alias("prec"), F.count("*").alias("n"), F.min_by("weight", "ord").alias("weight"), F.min_by(row, order).alias("rep"))
    # Each document is counted for the first of its values, so that a key's documents can be summed up.
    first = F.row_number().over(Window.partitionBy(*keys, "doc").orderBy("vkey")) == 1
    # Rounded, so that sums in another order rank alike.
    score = F.round(F.sum(F.col("prec") * F.col("weight") * (1 + 0.5 * F.log2(F.col("n") + 1))), 9)
    clusters = cells.withColumn("first", first).groupBy(*keys, "vkey").agg(
        score.alias("score"), F.count("*").cast("int").alias("docs"), F.sum("n").alias("reps"), F.count_if("first").alias("own"), F.min_by("rep", F.struct((-F.col("prec")).alias("p"), F.col("rep.ord"))).alias("rep")
    )
    # The best few values of each of a key's parts are gathered, and with the first of them what all of the part come to.
    part = Window.partitionBy(*keys, "part")
    ranked = clusters.withColumn("part", F.pmod(F.hash("vkey"), F.lit(PARTS))).withColumns(
        {"at": F.row_number().over(part.orderBy(F.desc("score"), "vkey")), "values": F.count("*").over(part), "all_docs": F.sum("own").over(part)}
    )
    shown = F.struct((-F.col("score")).alias("order"), "vkey", "score", "docs", "reps", "rep")
    sums = [F.sum(F.when(F.col("at") == 1, F.col(c))).alias(c) for c in ("values", "all_docs")]
    rows = ranked.where(F.col("at") <= 1 + RIVALS_SHOWN).groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(shown)), 1, 1 + RIVALS_SHOWN).alias("top"), *sums)
    win = F.col("top")[0]
    return rows.select(
        *keys,
        win["vkey"].alias("vkey"),
        win["score"].alias("score"),
        win["docs"].alias("agreeing_sources"),
        win["reps"].alias("repetitions"),
        (F.col("values") - 1).cast("int").alias("n_rivals"),
        F.transform(F.slice("top", 2, RIVALS_SHOWN), lambda x: F.coalesce(F.nullif(x["rep"]["display"], F.lit("")), x["vkey"])).alias("conflict_values"),
        # A document that has not the winner's value has a rival's.
        (F.col("all_docs") > win["docs"]).alias("conflicting"),
        win["rep"].alias("won"),
    )


def resolve(candidates: DataFrame) -> DataFrame:
    """A row for each (sku, attribute) that has candidates, with the winner's columns, counts and reasons.

    Candidates that fail the gate, are contaminated or dropped take no part but are counted.
    """
    keys = ["sku", "attribute"]
    tier = authority_tier(F.col("authority"))
    order = F.struct("doc_pos", "attr_pos", "extractor_pos", "cand_pos")
    marked = candidates.withColumns({"doc": F.col("doc_id"), "vkey": value_key(F.col("value_num"), F.col("value_str"), F.col("value_flag")), "prec": F.col("precision"), "weight": tier_weight(tier), "ord": order})
    won = arbitrate(marked.where(live()), keys)
    counts = candidates.groupBy(*keys).agg(
        F.count_distinct("doc_id").cast("int").alias("total_sources"),
        F.count_if(F.col("dropped_reason") != "").alias("n_dropped"),
        F.array_sort(F.collect_set(F.nullif("dropped_reason", F.lit("")))).alias("dropped_reasons"),
        F.count_if(F.col("contaminated_by") != "").alias("n_quarantined"),
        F.array_sort(F.collect_set(F.nullif("contaminated_by", F.lit("")))).alias("quarantined_by"),
        F.count("*").alias("n_candidates"),
        F.min("attr_pos").alias("attr_pos"),
    )
    joined = counts.join(won, keys, "left")
    n = lambda c: F.col(c).cast("string")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_dropped") > 0, F.concat(n("n_dropped"), F.lit(" candidate(s) rejected on provenance: "), F.left(F.array_join("dropped_reasons", "; "), F.lit(160)))),
            F.when(F.col("n_quarantined") > 0, F.concat(n("n_quarantined"), F.lit(" candidate(s) quarantined: evidence window named "), F.array_join("quarantined_by", ", "))),
            F.when(F.col("vkey").isNull(), "no candidate survived the evidence gate"),
            F.when(F.col("conflicting"), F.concat(F.lit("cross-document conflict: "), (F.col("n_rivals") + 1).cast("string"), F.lit(" distinct values across "), n("total_sources"), F.lit(" sources"))).when(F.col("n_rivals") > 0, F.concat(n("n_rivals"), F.lit(" competing value(s) within a single document, resolved by evidence quality ("), F.col("won.extractor"), F.lit(")"))),
            F.when(F.col("agreeing_sources") > 1, F.concat(n("agreeing_sources"), F.lit(" independent sources agree"))),
            F.when(F.col("won.section") != "OTHER", F.concat(F.lit("evidence read from the "), F.col("won.section"), F.lit(" section"))),
            F.when(F.col("won.column_index") >= 0, F.concat(F.lit("read from column "), (F.col("won.column_index") + 1).cast("string"), F.lit(" of "), F.col("won.column_of").cast("string"), F.lit(" in a series ratings table"))),
        )
    )
    kept = "value_num value_str value_flag unit display doc_id start end quote page match_mode verified section extractor precision column_index column_of focus_start self_consistency authority".split()
    return joined.select(
        *keys, "attr_pos", *[F.col(f"won.{c}").alias(c) for c in kept], "score", F.coalesce("agreeing_sources", F.lit(0)).alias("agreeing_sources"), "total_sources", F.coalesce("conflicting", F.lit(False)).alias("conflicting"),
        F.coalesce("conflict_values", F.array().cast("array<string>")).alias("conflict_values"), "n_quarantined", "n_dropped", "n_candidates", reasons.alias("reasons"),
    )
