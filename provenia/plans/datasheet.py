"""The datasheet pipeline as one plan: parts and documents in, decided attributes out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.operators import arbitrate, confidence, generators, matching, prefilter, rules
from provenia.sources import corpus
from provenia.sources.reference import ALIASES, attribute_specs


class Enriched(NamedTuple):
    candidates: DataFrame
    decided: DataFrame
    notes: DataFrame


def work(skus: DataFrame, manifest: DataFrame, docs: DataFrame, parts: DataFrame | None = None) -> generators.Work:
    """All that generators need: documents, once for each class of parts that they cover, and those parts.

    skus: sku, mpn, brand, product_class. manifest: doc_id, doc_pos, publisher, authority,
    covers. docs: doc_id, text, pages. Known parts are attached per document: only those
    its text names, so no list grows with the catalog. Each text is read once for all
    aliases of all classes and for its series headers. A product class that is not known
    raises an error when the rows are read. parts are all known parts, if those of skus and
    manifest are not all.
    """
    parts = corpus.known_parts(skus, manifest) if parts is None else parts
    tokens = docs.select("doc_id", F.explode(generators.part_tokens(F.col("text"))).alias("part"))
    known = prefilter.known_only(tokens, parts, "part").groupBy("doc_id").agg(F.collect_set("part").alias("known"))
    specs = attribute_specs(skus.sparkSession)
    row = F.struct(*[c for c in specs.columns if c != "class_key"])
    by_class = specs.groupBy(F.col("class_key").alias("_known_class")).agg(F.array_sort(F.collect_list(row)).alias("specs"))
    class_key = F.coalesce("product_class", F.lit("null")).alias("class_key")
    covered = corpus.docs_for_part(skus, manifest).select("sku", "mpn", "brand", "product_class", "doc_pos", "doc_id", class_key)
    about = manifest.select("doc_id", "publisher", "authority", F.col("covers").alias("siblings"))
    read = matching.with_places(docs.join(about, "doc_id"), ALIASES, generators.HEADER_GAP, "siblings")
    rows = read.join(known, "doc_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    rows = rows.join(covered.select("doc_id", "class_key").distinct(), "doc_id").join(F.broadcast(by_class), F.col("class_key") == F.col("_known_class"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown product class "), F.col("class_key")))
    rows = rows.withColumn("specs", F.when(F.col("_known_class").isNull(), unknown.cast(rows.schema["specs"].dataType)).otherwise(F.col("specs"))).drop("_known_class")
    return generators.Work(covered, rows)


def work_rows(skus: DataFrame, manifest: DataFrame, docs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """The rows of work() for each (sku, covering document), with the document's text in each."""
    made = work(skus, manifest, docs, parts)
    return made.parts.join(made.docs, generators.WORK_KEYS).drop("class_key")


def enrich(skus: DataFrame, manifest: DataFrame, docs: DataFrame, responses: DataFrame | None = None, panel: tuple[str, ...] = ("table_column", "range", "inline_spec", "llm"), model: confidence.Model = confidence.Model(), samples: int = 3, path: str | None = None) -> Enriched:
    """Generate, gate, arbitrate, check, score and decide.

    With a path, candidates are written there and read again, so that texts are searched
    once; without, nothing runs until it is read, and again for each use.
    """
    found = generators.candidates(work(skus, manifest, docs), panel, responses, samples)
    if path:
        found.write.mode("overwrite").parquet(path)
        found = skus.sparkSession.read.schema(found.schema).parquet(path)
    weighed, decided = decide(found, skus, model)
    return Enriched(weighed, decided, notes(skus, manifest, decided, weighed))


def decide(found: DataFrame, skus: DataFrame, model: confidence.Model) -> tuple[DataFrame, DataFrame]:
    """Candidates with the authority that their document has for the part's brand, and the decided attributes."""
    brand = skus.select("sku", "brand")
    weighed = arbitrate.brand_authority(found.join(brand, "sku")).drop("brand")
    resolved = arbitrate.resolve(weighed)
    class_of = skus.select("sku", F.col("product_class").alias("class_key"))
    specs = attribute_specs(skus.sparkSession).select("class_key", "attribute", "label", "safety")
    checked = rules.apply_rules(resolved, class_of).join(class_of, "sku").join(F.broadcast(specs), ["class_key", "attribute"])
    return weighed, confidence.score_and_decide(checked, model)


def notes(skus: DataFrame, manifest: DataFrame, decided: DataFrame, found: DataFrame) -> DataFrame:
    """(sku, note): parts without a document, documents of other brands, attributes without evidence."""
    bridge = corpus.docs_for_part(skus, manifest)
    none = skus.join(bridge.select("sku").distinct(), "sku", "left_anti").select("sku", F.concat(F.lit("no source document covers "), F.col("mpn")).alias("note"))
    cross = found.join(skus.select("sku", "brand"), "sku").where(~corpus.brand_matches(F.col("publisher"), F.col("brand"))).select("sku", F.concat(F.col("publisher"), F.lit(" datasheet used as cross-reference only ("), F.col("brand"), F.lit(" is the SKU brand)")).alias("note")).distinct()
    want = bridge.select("sku", "product_class").distinct().join(F.broadcast(attribute_specs(skus.sparkSession).select(F.col("class_key").alias("product_class"), "attr_pos", "attribute")), "product_class")
    gaps = want.join(decided.select("sku", "attribute"), ["sku", "attribute"], "left_anti").groupBy("sku").agg(F.array_sort(F.collect_list(F.struct("attr_pos", "attribute"))).alias("a"))
    missing = gaps.select("sku", F.concat(F.lit("no evidence found for: "), F.array_join(F.transform("a", lambda x: x["attribute"]), ", ")).alias("note"))
    return none.unionByName(cross).unionByName(missing)
