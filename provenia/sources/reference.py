"""Fixed values of the engine as Python constants and as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Trust in a publisher, and the weight that trust has.
AUTHORITY_TIERS = {"MFR_DATASHEET": 1, "MFR_WEB": 2, "AUTHORIZED_DIST": 3, "MARKETPLACE": 4, "UNKNOWN": 9}
TIER_WEIGHTS = {1: 1.0, 2: 0.6, 3: 0.4, 4: 0.25}
OTHER_TIER_WEIGHT = 0.15
MATCH_SCORES = {"exact": 1.0, "normalized": 0.9, "relocated": 0.55}
DECISIONS = ("AUTO_PUBLISH", "REVIEW", "REJECT")

# Attributes of the two product classes, in their order:
# name, label, type, unit, members, required, safety critical, aliases, least, most, sections, which end of a range.
_TEMPERATURE = ("operating temperature", "operating junction temperature", "T_A", "TJ")
_SHARED = [
    ("operating_temp_min", "Operating temperature (min)", "number", "degC", (), False, False, (*_TEMPERATURE, "storage temperature"), -100.0, 50.0, ("ABS_MAX", "RECOMMENDED", "FEATURES"), "min"),
    ("operating_temp_max", "Operating temperature (max)", "number", "degC", (), False, False, _TEMPERATURE, 25.0, 300.0, ("ABS_MAX", "RECOMMENDED", "FEATURES"), "max"),
    ("package", "Package / case", "string", None, (), True, False, ("package", "case", "case style", "outline", "package type"), None, None, ("MECHANICAL", "FEATURES"), None),
    ("mounting_type", "Mounting type", "enum", None, ("THROUGH_HOLE", "SURFACE_MOUNT"), False, False, ("mounting", "mount", "through hole", "surface mount", "SMD", "SMT"), None, None, (), None),
]
_RATED = ("ABS_MAX", "FEATURES", "RECOMMENDED")
CLASSES = {
    "RECTIFIER_DIODE": [
        ("reverse_voltage_max", "Reverse voltage (max)", "number", "V", (), True, True, ("VRRM", "peak repetitive reverse voltage", "maximum repetitive peak reverse voltage", "reverse voltage", "VR", "working peak reverse voltage"), 10.0, 2000.0, _RATED, None),
        ("forward_current_avg", "Average forward current", "number", "A", (), True, True, ("IF(AV)", "average rectified forward current", "forward current", "IO"), 0.01, 100.0, _RATED, None),
        ("forward_voltage_max", "Forward voltage (max)", "number", "V", (), False, False, ("VF", "forward voltage", "instantaneous forward voltage"), 0.1, 5.0, ("ABS_MAX", "FEATURES", "ELEC_CHAR"), None),
        ("surge_current_max", "Surge current (max)", "number", "A", (), False, True, ("IFSM", "peak forward surge current", "surge current", "non-repetitive peak forward surge"), 1.0, 1000.0, _RATED, None),
        *_SHARED,
        ("rohs_compliant", "RoHS compliant", "bool", None, (), False, False, ("RoHS", "lead free", "Pb-free", "halogen free"), None, None, (), None),
    ],
    "LINEAR_REGULATOR": [
        ("output_current_max", "Output current (max)", "number", "A", (), True, True, ("output current", "IO", "maximum output current", "load current", "IOUT"), 0.01, 20.0, _RATED, None),
        ("input_voltage_max", "Input voltage (max)", "number", "V", (), True, True, ("input voltage", "VI", "VIN", "maximum input voltage", "input-to-output differential"), 1.0, 100.0, _RATED, None),
        ("output_voltage_min", "Output voltage (min)", "number", "V", (), False, False, ("output voltage range", "VO", "VOUT", "adjustable"), 0.5, 50.0, (), "min"),
        ("output_voltage_max", "Output voltage (max)", "number", "V", (), False, False, ("output voltage range", "VO", "VOUT", "adjustable"), 1.0, 60.0, (), "max"),
        ("dropout_voltage_typ", "Dropout voltage (typ)", "number", "V", (), False, False, ("dropout voltage", "input-output differential", "VDO"), 0.05, 5.0, (), None),
        ("adjustable", "Adjustable output", "bool", None, (), False, False, ("adjustable", "programmable output", "fixed output"), None, None, (), None),
        ("polarity", "Polarity", "enum", None, ("POSITIVE", "NEGATIVE"), False, False, ("positive voltage regulator", "negative voltage regulator", "polarity"), None, None, (), None),
        *_SHARED,
    ],
}
#: Every alias of every class.
ALIASES = sorted({alias for specs in CLASSES.values() for spec in specs for alias in spec[7]})
# Plausibility across attributes: class, key, operands, condition, message, severity.
RULES = [
    ("RECTIFIER_DIODE", "surge_ge_continuous", ("surge_current_max", "forward_current_avg"), "surge_current_max > forward_current_avg", "surge current must exceed the continuous forward current", "error"),
    ("RECTIFIER_DIODE", "vf_below_vrrm", ("forward_voltage_max", "reverse_voltage_max"), "forward_voltage_max < reverse_voltage_max", "forward voltage must be below the reverse voltage", "error"),
    ("RECTIFIER_DIODE", "temp_ordered", ("operating_temp_min", "operating_temp_max"), "operating_temp_min < operating_temp_max", "temperature range must be ordered", "error"),
    ("RECTIFIER_DIODE", "silicon_vf_band", ("forward_voltage_max",), "forward_voltage_max BETWEEN 0.2 AND 2.0", "forward voltage is unusual for silicon", "warn"),
    ("LINEAR_REGULATOR", "vin_above_vout", ("input_voltage_max", "output_voltage_max"), "input_voltage_max > output_voltage_max", "input voltage must exceed the output voltage", "error"),
    ("LINEAR_REGULATOR", "vout_ordered", ("output_voltage_min", "output_voltage_max"), "output_voltage_min < output_voltage_max", "output range must be ordered", "error"),
    ("LINEAR_REGULATOR", "temp_ordered", ("operating_temp_min", "operating_temp_max"), "operating_temp_min < operating_temp_max", "temperature range must be ordered", "error"),
    ("LINEAR_REGULATOR", "dropout_sane", ("dropout_voltage_typ", "input_voltage_max"), "dropout_voltage_typ < input_voltage_max / 2", "dropout is high for the input voltage", "warn"),
]
# The scoring features in order, their weights before any labels, the bias and the decision floors.
FEATURES = ("extractor_precision", "match_quality", "agreeing_sources", "is_conflicting", "n_competing", "rule_violations", "authority", "column_resolved", "n_quarantined", "has_focus", "self_consistency")
PRIOR_WEIGHTS = (1.6, 2.2, 1.5, -2.6, -0.9, -2.4, 1.0, 1.3, -0.5, 0.6, 1.1)
PRIOR_BIAS = -1.9
GENERAL_FLOOR, SAFETY_FLOOR, REJECT_BELOW, LEAST_SAFETY = 0.90, 0.97, 0.25, 0.60
TARGET_PRECISION, TARGET_PRECISION_SAFETY = 0.98, 0.99

# Appliance categories in the order their patterns are tried: key, pattern, class, plural, path, product name, verified.
CATEGORIES = [
    ("LAUNDRY_CENTER", r"laundry\s*center", "Large Appliances", "Laundry Centers", "Laundry Appliances>Laundry Centers", "Laundry Center", False),
    ("DISHWASHER", r"\bdishwasher\b", "Large Appliances", "Dishwashers", "Kitchen Appliances>Built-In Dishwashers", "Dishwasher", True),
    ("DRYER", r"\bdryer\b", "Large Appliances", "Dryers", "Laundry Appliances>Clothes Dryers", "Dryer", False),
    ("WASHER", r"\bwasher\b", "Large Appliances", "Washers", "Laundry Appliances>Clothes Washers", "Washer", False),
    ("COOKTOP", r"\bcooktop\b", "Large Appliances", "Cooktops", "Kitchen Appliances>Cooktops", "Cooktop", False),
    ("RANGE", r"\brange\b|\bgrill\b", "Large Appliances", "Ranges", "Kitchen Appliances>Ranges", "Range", False),
    ("MICROWAVE", r"\bmicrowave\b", "Small Appliances", "Microwave Ovens", "Kitchen Appliances>Microwave Ovens", "Microwave Oven", False),
    ("FREEZER", r"\bfreezer\b", "Large Appliances", "Freezers", "Kitchen Appliances>Freezers", "Freezer", False),
    ("REFRIGERATOR", r"\b(fridge|refrigerator)\b", "Large Appliances", "Refrigerators", "Kitchen Appliances>Refrigerators", "Refrigerator", False),
]
DEPARTMENT, PATH_ROOT = "Appliances", "Appliances & Consumer Electronics>"
# Brands: key, as displayed, manufacturer, domain, verified.
BRANDS = [
    ("FRIGIDAIRE", "FRIGIDAIRE®", "Rheem Manufacturing", "www.frigidaire.com", True),
    ("WHIRLPOOL", "Whirlpool®", "Whirlpool Corporation", "www.whirlpool.com", True),
    ("GE", "GE®", "GE Appliances, a Haier company", "www.geappliances.com", False),
    ("LG", "LG®", "LG Electronics U.S.A., Inc.", "www.lg.com", False),
    ("KITCHENAID", "KitchenAid®", "Whirlpool Corporation", "www.kitchenaid.com", False),
    ("SPEED QUEEN", "Speed Queen®", "Alliance Laundry Systems LLC", "www.speedqueen.com", False),
    ("CAFE", "Café™", "GE Appliances, a Haier company", "www.cafeappliances.com", False),
    ("MAYTAG", "Maytag®", "Whirlpool Corporation", "www.maytag.com", False),
]
BRAND_ALIASES = {"GE": "GE", "GENERAL ELECTRIC": "GE", "LG": "LG", "KITCHEN AID": "KITCHENAID", "KITCHENAID": "KITCHENAID", "SQ": "SPEED QUEEN", "SPEED QUEEN": "SPEED QUEEN", "CAFE": "CAFE", "CAFÉ": "CAFE", "FRIGIDAIRE": "FRIGIDAIRE", "WHIRLPOOL": "WHIRLPOOL", "MAYTAG": "MAYTAG"}
BRAND_TOKEN = r"(?iu)(?<![\p{L}\p{N}_])(Kitchen\s*Aid|Speed\s*Queen|Frigidaire|Whirlpool|Maytag|Café|Cafe|GE|LG|SQ)(?![\p{L}\p{N}_])"
SUPPORT_SEARCH = {"WHIRLPOOL": "https://learnwhirlpool.com/smartsearchresults?searchtext=", "MAYTAG": "https://learnwhirlpool.com/smartsearchresults?searchtext="}
# Units of measure as delivered.
UOM = {
    "v": "V", "volt": "V", "volts": "V", "a": "A", "amp": "A", "amps": "A", "ampere": "A", "amperes": "A",
    "in": "in", "inch": "in", "inches": "in", '"': "in", "dba": "dBA", "db": "dBA", "kwh": "kW-hr", "kw-hr": "kW-hr", "kwhr": "kW-hr",
    "hr": "hr", "hrs": "hr", "hour": "hr", "hours": "hr", "w": "W", "watt": "W", "watts": "W", "cuft": "cu ft", "cu ft": "cu ft",
    "lb": "lb", "lbs": "lb", "pound": "lb", "pounds": "lb",
}
# Delivered attributes of a category in slot order: label, unit.
DELIVERED = {
    "DISHWASHER": [("Series", None), ("Model", None), ("Number of Wash Cycles", None), ("Voltage Rating", "V"), ("Amperage Rating", "A"), ("Mounting Type", None), ("Plug Type", None), ("Size", None), ("Depth With Door Open", "in"), ("Minimum Height", "in"), ("Maximum Height", "in"), ("Sound Level", "dBA"), ("Material", None), ("Color", None), ("Additional Information", None)],
    "WASHER": [("Series", None), ("Model", None), ("Capacity", "cu ft"), ("Voltage Rating", "V"), ("Amperage Rating", "A"), ("Load Type", None), ("Size", None), ("Sound Level", "dBA"), ("Material", None), ("Color", None), ("Additional Information", None)],
    "DRYER": [("Series", None), ("Model", None), ("Capacity", "cu ft"), ("Fuel Type", None), ("Voltage Rating", "V"), ("Amperage Rating", "A"), ("Size", None), ("Material", None), ("Color", None), ("Additional Information", None)],
}
SLOTS = 50


def delivery_header() -> list[str]:
    """The columns of a delivered row, in order; runs of numbered columns follow their rule."""
    # Column names of the delivery format.
    head = ["MFR URL", *(f"Ref URL {k}" for k in range(1, 6)), "PART_NUMBER", "Dept", "Class", "Fine", "SKU - MY_PART_NUMBER", "Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf", "MANUFACTURER_NAME", "BRAND_NAME", "TRADE_NAME", "MANUFACTURER_PART_NUMBER", "ALTERNATE_PART_NUMBER", "Classpath", "MOBILE_DESC", "INVOICE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC", "MARKETING_DESCRIPTION", *(f"ITEM_FEATURES_{k}" for k in range(1, 21)), "With", "Standard/Approvals", "Prop 65", "Application", "Includes", "Product Name"]
    slots = [f"ATTRIBUTE_{part} {k}" for k in range(1, SLOTS + 1) for part in ("LABEL", "VALUE", "UOM")]
    sizes = [x for d in ("LENGTH", "HEIGHT", "WIDTH", "WEIGHT", "VOLUME") for x in (d, f"{d}_UOM")]
    tail = ["UPC", "EAN", "GTIN", "UNSPSC", "Warranty", "List Price", "Selling Qty", "Selling UOM", "Standard Packaging Information", *sizes, "Product Image", *(f"Alternate Image {k}" for k in range(1, 5)), "SDS", "SDS_1", "Warranty Information", "Catalog", "Specification Sheet", "Instruction/Installation Manual", "Service Manual", "Owners/User Manual", "Line Drawing", "MTR", "RoHS", "Full Engineering Drawing", "Energy Star Guide", "Technical Bulletin", "Submittal", "Compatibility Chart", "Size Chart", "Product Label/Insert", "Video Link", "Video Link 1", "Country Of Origin", "Discontinued", "Actual Image (Yes/No)"]
    return head + slots + tail


SPEC = "class_key string, attr_pos int, attribute string, label string, dtype string, unit string, members array<string>, required boolean, safety boolean, aliases array<string>, table_aliases array<string>, low double, high double, sections array<string>, range_end string"


def attribute_specs(spark: SparkSession) -> DataFrame:
    """One row for each attribute of each class; aliases longest first, table_aliases with those without a space before the others."""
    rows = []
    for key, specs in CLASSES.items():
        for pos, (name, label, dtype, unit, members, required, safety, aliases, low, high, sections, end) in enumerate(specs):
            rows.append((key, pos, name, label, dtype, unit, list(members), required, safety, sorted(aliases, key=len, reverse=True), sorted(aliases, key=lambda a: (" " in a, -len(a))), low, high, list(sections), end))
    return spark.createDataFrame(rows, SPEC)


def brands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BRANDS, "brand_key string, brand_display string, manufacturer_name string, domain string, brand_verified boolean")


def categories(spark: SparkSession) -> DataFrame:
    rows = [(key, DEPARTMENT, klass, fine, PATH_ROOT + path, name, verified) for key, _, klass, fine, path, name, verified in CATEGORIES]
    return spark.createDataFrame(rows, "category string, dept string, class string, fine string, classpath string, product_name string, category_verified boolean")


def delivered_attributes(spark: SparkSession) -> DataFrame:
    rows = [(c, k, label, unit) for c, specs in DELIVERED.items() for k, (label, unit) in enumerate(specs, 1)]
    return spark.createDataFrame(rows, "category string, slot int, label string, spec_unit string")


def attributes_of(spark: SparkSession, key: str) -> DataFrame:
    """The attributes of a class, or those delivered of a category; an unknown one has none."""
    of_class = attribute_specs(spark).where(F.col("class_key") == key).select(F.col("attr_pos").alias("place"), F.col("attribute").alias("name"))
    of_category = delivered_attributes(spark).where(F.col("category") == key).select(F.col("slot").alias("place"), F.col("label").alias("name"))
    return of_class.unionByName(of_category)


def safety_critical(spark: SparkSession) -> DataFrame:
    """(class_key, attribute) of all safety-critical attributes."""
    return attribute_specs(spark).where("safety").select("class_key", "attribute")
