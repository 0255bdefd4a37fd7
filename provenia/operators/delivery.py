"""Catalog delivery: category and brand of a part, page attributes, descriptions, the wide row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.functions.text import find_quote, let, quote_regex
from provenia.sources.reference import BRAND_ALIASES, BRAND_TOKEN, CATEGORIES, SLOTS, UOM, brands, categories, delivered_attributes, delivery_header

# Labels whose values are short, words that such a value has not, abbreviations.
SHORT_LABELS = ("Color", "Material", "Mounting Type", "Plug Type", "Load Type", "Fuel Type")
JUNK_WORDS = r"(?i)\b(dishwasher|washer|dryer|refrigerator|series|rack|basket|cycle|feature|with a|and )\b"
MOUNT_ABBREVIATIONS = {"leg": "LEG", "built-in": "BLTLN"}
MATERIAL_ABBREVIATIONS = {"stainless steel": "SST"}
LONG_ORDER = ("Series", "Number of Wash Cycles", "Voltage Rating", "Amperage Rating", "Mounting Type", "Size", "Depth With Door Open", "Minimum Height", "Maximum Height", "Sound Level", "Material", "Color")
LONG_TAILS = {"Number of Wash Cycles": " Wash Cycles", "Mounting Type": " Mounting", "Depth With Door Open": " Depth With Door Open", "Minimum Height": " Minimum Height", "Maximum Height": " Maximum Height", "Sound Level": " Sound Level"}
WITH_UNIT = ("Voltage Rating", "Amperage Rating", "Depth With Door Open", "Minimum Height", "Maximum Height", "Sound Level")
#: Longest invoice description; least and most of a mobile one; confidence from which a row is published.
INVOICE_MOST, MOBILE_LEAST, MOBILE_MOST, PUBLISHED_FROM = 40, 60, 80, 0.75
#: Characters of a page that a model is shown.
SHOWN = 12_000
ATTRS = "map<string,struct<value:string,uom:string>>"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def classify(text: Column) -> Column:
    """The first category, in their order, whose pattern a description has; null if none."""
    chain = None
    for key, pattern, *_ in CATEGORIES:
        test = text.rlike(f"(?i){pattern}")
        chain = F.when(test, key) if chain is None else chain.when(test, key)
    return chain


def brand_token(text: Column) -> Column:
    """The leftmost brand name of a description as written; "" if none."""
    return F.regexp_extract(text, BRAND_TOKEN, 1)


def brand_key(text: Column) -> Column:
    token = brand_token(text)
    return F.when(token != "", _lookup(BRAND_ALIASES, F.upper(F.regexp_replace(token, r"(?U)\s+", " "))))


def normalize_uom(raw: Column) -> Column:
    """(unit, known): the delivered unit, or the text as it is."""
    key = F.regexp_replace(F.lower(F.trim(raw)), r"\.+$", "")
    known = _lookup(UOM, key)
    return F.struct(F.coalesce(known, F.trim(raw)).alias("unit"), known.isNotNull().alias("known"))


def is_placeholder(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return t.startswith("--") & t.endswith("--")


def split_value_unit(raw: Column, unit: Column) -> Column:
    """(value, uom): a leading number or fraction and the expected unit, else the text and no unit."""
    text = F.trim(raw)
    pattern = F.concat(F.lit(r"(?i)^([-\d/. ]+)\s*"), quote_regex(unit), F.lit(r"(?![\p{L}\p{N}_])"))
    value = F.when(unit.isNotNull(), F.trim(F.call_function("regexp_extract", text, pattern, F.lit(1))))
    return F.when(F.coalesce(value, F.lit("")) != "", F.struct(value.alias("value"), unit.alias("uom"))).otherwise(F.struct(text.alias("value"), F.lit("").alias("uom")))


def plausible(label: Column, value: Column) -> Column:
    """Short labels take at most 40 characters, five words and, but for mountings, no heading's word."""
    short = label.isin(*SHORT_LABELS)
    words = F.size(F.filter(F.split(F.trim(value), r"(?U)\s+"), lambda w: w != ""))
    return ~short | ((F.length(value) <= 40) & (words <= 5) & (~value.rlike(JUNK_WORDS) | (label == "Mounting Type")))


def page_prompts(pages: DataFrame, most: int = SHOWN) -> DataFrame:
    """(mpn, slot, label, spec_unit, shown): what a model is asked of a page, one row for each attribute of its category.

    shown is the page's first `most` characters.
    """
    rows = pages.join(F.broadcast(delivered_attributes(pages.sparkSession)), "category")
    return rows.select("mpn", "slot", "label", "spec_unit", F.left("text", F.lit(most)).alias("shown"))


def page_attributes(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """(mpn, slot, label, value, uom, quote, offset): attributes that recorded responses read from a page and the page has.

    pages: mpn, category, text. responses: mpn, label, found, value, quote, as answers to
    page_prompts(). The quote is looked up in the whole page.
    """
    specs = delivered_attributes(pages.sparkSession)
    said = responses.where(F.coalesce("found", F.lit(False)) & (F.trim(F.coalesce("value", F.lit(""))) != "") & (F.trim(F.coalesce("quote", F.lit(""))) != ""))
    rows = pages.join(F.broadcast(specs), "category").join(said, ["mpn", "label"])
    at = find_quote(F.col("text"), F.trim("quote"))
    parted = split_value_unit(F.col("value"), F.col("spec_unit"))
    done = rows.select("mpn", "slot", "label", let(parted, lambda p: p).alias("p"), F.trim("quote").alias("quote"), at.alias("offset"))
    kept = done.where((F.col("offset") >= 0) & plausible(F.col("label"), F.col("p.value")))
    return kept.select("mpn", "slot", "label", F.col("p.value").alias("value"), F.when(F.col("p.uom") != "", normalize_uom(F.col("p.uom"))["unit"]).otherwise("").alias("uom"), "quote", "offset")


class Facts:
    """Columns of a product: names as columns, attributes in a map from label to (value, uom)."""

    def __init__(self, brand="brand_display", maker="manufacturer_name", mpn="mpn", product="product_name", feature: str | None = None, attrs="attrs"):
        self.brand, self.maker, self.mpn, self.product = F.col(brand), F.col(maker), F.col(mpn), F.col(product)
        self.feature = F.nullif(F.col(feature), F.lit("")) if feature else F.lit(None).cast("string")
        self.attrs = F.col(attrs)

    def value(self, label: str) -> Column:
        """The value, or null where it is blank."""
        v = F.try_element_at(self.attrs, F.lit(label))["value"]
        return F.when(F.trim(v) != "", v)

    def uom(self, label: str) -> Column:
        return F.coalesce(F.try_element_at(self.attrs, F.lit(label))["uom"], F.lit(""))

    def phrase(self, label: str) -> Column:
        return F.concat_ws(" ", self.value(label), F.nullif(self.uom(label), F.lit("")))

    def mounting(self) -> Column:
        return F.concat(self.value("Mounting Type"), F.lit(" Mounting"))


def _short(table: dict[str, str], value: Column) -> Column:
    return F.coalesce(_lookup(table, F.lower(F.trim(value))), F.upper(value))


def invoice_desc(f: Facts) -> Column:
    """(text, ok): upper-case tokens in at most 40 characters, then the depth if it fits, else the
    sound level if that does. ok is false where a token has no abbreviation."""
    mount, material, color = f.value("Mounting Type"), f.value("Material"), f.value("Color")
    tokens = F.concat_ws(" ", F.upper(f.product), _short(MOUNT_ABBREVIATIONS, mount), f.value("Number of Wash Cycles"), _short(MATERIAL_ABBREVIATIONS, material), _short(MATERIAL_ABBREVIATIONS, color), F.concat(f.value("Voltage Rating"), F.lit("V")), F.concat(f.value("Amperage Rating"), F.lit("A")))
    depth = F.replace(F.upper(F.concat(f.value("Depth With Door Open"), f.uom("Depth With Door Open"))), F.lit(" "), F.lit(""))
    sound = F.upper(F.concat(f.value("Sound Level"), f.uom("Sound Level")))
    fits = lambda trailer: F.coalesce(F.length(tokens) + 1 + F.length(trailer) <= INVOICE_MOST, F.lit(False))
    text = F.when(fits(depth), F.concat_ws(" ", tokens, depth)).when(fits(sound), F.concat_ws(" ", tokens, sound)).otherwise(tokens)
    known = lambda table, v: v.isNull() | _lookup(table, F.lower(F.trim(v))).isNotNull()
    return F.struct(F.left(text, F.lit(INVOICE_MOST)).alias("text"), (known(MOUNT_ABBREVIATIONS, mount) & known(MATERIAL_ABBREVIATIONS, material)).alias("ok"))


def mobile_desc(f: Facts) -> Column:
    """Brand without marks (and maker, unless one names the other), product, series, part; the
    mounting where the text is short or it still fits in 80."""
    plain = F.translate(f.brand, "®™©", "")
    same = F.lower(plain).contains(F.lower(f.maker)) | F.lower(f.maker).contains(F.lower(plain))
    lead = F.when(same, plain).otherwise(F.concat_ws(" ", f.maker, plain))
    part = lambda c: F.nullif(c, F.lit(""))
    base = F.concat_ws(", ", part(lead), part(f.product), f.value("Series"), part(f.mpn))
    full = F.concat_ws(", ", base, f.mounting())
    short = (F.length(base) < MOBILE_LEAST) & f.mounting().isNotNull()
    return F.when(short, F.left(full, F.lit(MOBILE_MOST))).when(F.length(full) <= MOBILE_MOST, full).otherwise(F.left(base, F.lit(MOBILE_MOST)))


def _tail(f: Facts) -> list[Column]:
    return [f.mounting(), F.concat(f.value("Number of Wash Cycles"), F.lit("-Wash Cycle")), f.value("Material"), f.value("Color")]


def _with(head: Column, f: Facts) -> Column:
    return F.concat(head, F.coalesce(F.concat(F.lit(" With "), f.feature), F.lit("")))


def short_desc(f: Facts) -> Column:
    part = lambda c: F.nullif(c, F.lit(""))
    head = F.concat_ws(" ", part(f.brand), f.value("Series"), part(f.mpn), part(f.product))
    return F.concat_ws(", ", _with(head, f), *_tail(f))


def retail_desc(f: Facts) -> Column:
    return F.concat_ws(", ", F.concat_ws(" ", f.value("Series"), f.product), *_tail(f))


def long_desc(f: Facts) -> Column:
    """Head, then a phrase for each populated label in order, then the additional information."""
    clauses = [_with(F.concat_ws(" ", f.brand, f.product), f)]
    for label in LONG_ORDER:
        text = f.phrase(label) if label in WITH_UNIT else f.value(label)
        clauses.append(F.when(f.value(label).isNotNull(), F.concat(text, F.lit(LONG_TAILS.get(label, "")))))
    return F.concat_ws(", ", *clauses, F.concat(F.lit("Additional Information: "), f.value("Additional Information")))


def descriptions(facts: DataFrame, f: Facts | None = None) -> DataFrame:
    """facts with INVOICE_DESC, MOBILE_DESC, SHORT_DESC, RETAIL_DESC, LONG_DESC1 and invoice_ok."""
    f = f or Facts()
    invoice = let(invoice_desc(f), lambda x: x)
    return facts.withColumn("_invoice", invoice).withColumns({"INVOICE_DESC": F.col("_invoice.text"), "invoice_ok": F.col("_invoice.ok"), "MOBILE_DESC": mobile_desc(f), "SHORT_DESC": short_desc(f), "RETAIL_DESC": retail_desc(f), "LONG_DESC1": long_desc(f)}).drop("_invoice")


def slot_columns(filled: Column) -> list[Column]:
    """ATTRIBUTE_LABEL/VALUE/UOM n of a map from slot to (label, value, uom); a slot is its attribute's place, gaps stay null."""
    out = []
    for k in range(1, SLOTS + 1):
        x = F.try_element_at(filled, F.lit(k))
        out += [x["label"].alias(f"ATTRIBUTE_LABEL {k}"), x["value"].alias(f"ATTRIBUTE_VALUE {k}"), F.nullif(x["uom"], F.lit("")).alias(f"ATTRIBUTE_UOM {k}")]
    return out


def assemble(rows: DataFrame, pages: DataFrame, found: DataFrame, searched: DataFrame | None = None) -> DataFrame:
    """Delivered rows: the wide columns, confidence, decision and reasons.

    rows: Mfg_Part_Num, Part_Desc, E1_Brand, Unilog_Brand, DIB_Brand, Part_Manuf. pages:
    mpn, ok, url, reason (first_reachable). found: page_attributes. searched: mpn,
    brand_key, url of brand_of_results, for descriptions that name no brand.
    """
    spark = rows.sparkSession
    typed = rows.withColumns({"mpn": F.col("Mfg_Part_Num"), "category": classify(F.col("Part_Desc")), "named": brand_key(F.col("Part_Desc"))})
    if searched is not None:
        typed = typed.join(searched.select("mpn", F.col("brand_key").alias("_searched"), F.col("url").alias("_search_url")), "mpn", "left")
    else:
        typed = typed.withColumns({"_searched": F.lit(None).cast("string"), "_search_url": F.lit(None).cast("string")})
    keyed = typed.withColumn("brand_key", F.when(F.col("category").isNotNull(), F.coalesce("named", "_searched")))
    known = keyed.join(F.broadcast(categories(spark)), "category", "left").join(F.broadcast(brands(spark)), "brand_key", "left")
    source = pages.select("mpn", F.col("ok").alias("source_ok"), F.col("url").alias("source_url"), F.col("reason").alias("source_reason"))
    entry = F.struct("slot", F.struct("label", "value", "uom").alias("x"))
    attrs = found.groupBy("mpn").agg(F.map_from_entries(F.collect_list(entry)).alias("slots"), F.map_from_entries(F.collect_list(F.struct("label", F.struct("value", "uom").alias("x")))).alias("attrs"), F.count("*").alias("n_attrs"), F.array_sort(F.collect_list("label")).alias("labels"))
    n_specs = delivered_attributes(spark).groupBy("category").agg(F.count("*").alias("n_specs"))
    wide = known.join(source, "mpn", "left").join(attrs, "mpn", "left").join(F.broadcast(n_specs), "category", "left")
    branded, sourced = F.col("brand_display").isNotNull(), F.col("brand_display").isNotNull() & F.coalesce("source_ok", F.lit(False))
    used = F.when(sourced, F.coalesce("n_attrs", F.lit(0))).otherwise(0)
    wide = wide.withColumns({"attrs": F.when(used > 0, F.col("attrs")), "slots": F.when(used > 0, F.col("slots")), "used": used})
    described = descriptions(wide)
    full = branded & (F.col("used") > 0)
    coverage = F.col("used") / F.coalesce("n_specs", F.lit(1))
    trust = F.when(F.col("brand_verified"), 1.0).when(branded, 0.6).otherwise(0.0)
    confidence = F.when(F.col("category").isNull(), 0.0).otherwise(F.round(0.4 * trust + 0.3 * F.when(sourced, 1.0).otherwise(0.0) + 0.3 * coverage, 3))
    from_search = branded & F.col("named").isNull()
    reasons = F.when(F.col("category").isNull(), F.array(F.lit("could not classify the part into a known category"))).otherwise(
        F.array_compact(
            F.array(
                F.when(~F.col("category_verified"), F.concat(F.lit("classpath for "), F.col("fine"), F.lit(" is unverified"))),
                F.when(from_search, F.concat(F.lit("brand resolved via search: "), F.col("_search_url"))),
                F.when(branded & ~F.col("brand_verified"), F.concat(F.lit("brand style for "), F.col("brand_key"), F.lit(" is unverified"))),
                F.when(branded & ~sourced, F.concat(F.lit("manufacturer source unreachable ("), F.coalesce("source_reason", F.lit("no candidate URL")), F.lit(")"))),
                F.when(~branded, "brand could not be resolved"),
                F.when(F.col("used") > 0, F.concat(F.array_join("labels", ", "), F.lit(" sourced from "), F.col("source_url"))),
                F.when(full & ~F.col("invoice_ok"), "INVOICE_DESC used a token without abbreviation"),
                F.when(branded & (F.col("used") == 0), "no attributes were sourced; SHORT_DESC is brand, part and product name"),
            )
        )
    )
    fallback = F.concat_ws(" ", "brand_display", "mpn", "product_name")
    visible = lambda c: F.when(~is_placeholder(F.col(c)), F.nullif(c, F.lit("")))
    values = {
        "Mfg_Part_Num": F.col("Mfg_Part_Num"), "Part_Desc": F.col("Part_Desc"), "MANUFACTURER_PART_NUMBER": F.col("Mfg_Part_Num"),
        "E1_Brand": visible("E1_Brand"), "Unilog_Brand": visible("Unilog_Brand"), "DIB_Brand": visible("DIB_Brand"),
        "Part_Manuf": F.when(F.col("Part_Manuf") != "-", F.nullif("Part_Manuf", F.lit(""))),
        "Dept": F.col("dept"), "Class": F.col("class"), "Fine": F.col("fine"), "Classpath": F.col("classpath"), "Product Name": F.col("product_name"),
        "BRAND_NAME": F.col("brand_display"), "MANUFACTURER_NAME": F.col("manufacturer_name"), "MFR URL": F.when(sourced, F.col("source_url")),
        "INVOICE_DESC": F.when(full, F.col("INVOICE_DESC")), "MOBILE_DESC": F.when(full, F.col("MOBILE_DESC")), "RETAIL_DESC": F.when(full, F.col("RETAIL_DESC")), "LONG_DESC1": F.when(full, F.col("LONG_DESC1")),
        "SHORT_DESC": F.when(full, F.col("SHORT_DESC")).when(branded, fallback),
    }
    slots = dict(zip([f"ATTRIBUTE_{p} {k}" for k in range(1, SLOTS + 1) for p in ("LABEL", "VALUE", "UOM")], slot_columns(F.col("slots")), strict=True))
    header = [values.get(c, slots.get(c, F.lit(None))).cast("string").alias(c) for c in delivery_header()]
    return described.select(*header, confidence.alias("confidence"), F.when(confidence >= PUBLISHED_FROM, "AUTO_PUBLISH").otherwise("REVIEW").alias("decision"), reasons.alias("reasons"))


def error_rows(rows: DataFrame, reason: Column) -> DataFrame:
    """Delivered rows of input that could not be worked on: part and description, for review, with the reason."""
    header = [(F.col(c) if c in ("Mfg_Part_Num", "Part_Desc") else F.lit(None)).cast("string").alias(c) for c in delivery_header()]
    return rows.select(*header, F.lit(0.0).alias("confidence"), F.lit("REVIEW").alias("decision"), F.array(F.concat(F.lit("pipeline error: "), reason)).alias("reasons"))
