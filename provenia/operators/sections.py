"""Sections of a datasheet: where they begin, which one an offset lies in, and plots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenia.functions.text import find_all, let, slice_text

# Headings of each section.
HEADINGS = {
    "ABS_MAX": r"absolute\s+maximum\s+ratings|maximum\s+ratings\s+and\s+electrical\s+characteristics|(?<![a-z])maximum\s+ratings(?:\s*\(|\s*\n)",
    "RECOMMENDED": r"recommended\s+operating\s+conditions",
    "THERMAL": r"thermal\s+information|thermal\s+resistance\s+table",
    "TYPICAL_GRAPHS": r"typical\s+characteristics|typical\s+performance\s+characteristics",
    "ELEC_CHAR": r"electrical\s+characteristics|characteristics\s+\(\s*t[aj]\s*=",
    "FEATURES": r"primary\s+characteristics|(?:^|\n)\s*\d?\s*features(?:\s|\n)",
    "MECHANICAL": r"mechanical\s+data|ordering\s+information|package\s+(?:option|information|outline|materials)|tape\s+and\s+reel",
}
CONTENTS_LINE = r"\.{3,}|\n\s*\d{1,3}\s*\n\s*\d"
AXIS_UNIT = r"\(\s*(?:V|A|mA|μA|uA|pF|nF|W|mW|°C|s|ms|μs|Hz)\s*\)"
AXIS_LABEL = rf"[A-Za-z][A-Za-z ,.\-]{{4,44}}{AXIS_UNIT}"
#: Characters in which a contents line shows, an overlapping heading begins, a heading repeats, and a plot is looked for.
CONTENTS_REACH, OVERLAP, REPEAT, PLOT_REACH = 70, 60, 40, 300
OTHER = "OTHER"
_MARK = "struct<off:int,key:string>"


def section_marks(text: Column) -> Column:
    """Sorted array of (off, key). Lines of a table of contents don't count; a characteristics
    heading that begins at or up to 60 characters after a ratings heading belongs to that; a
    heading less than 40 characters after the last kept one of its kind repeats it."""

    def of(key: str) -> Column:
        hits = F.filter(find_all(text, f"(?i){HEADINGS[key]}"), lambda h: ~slice_text(text, h["e"], h["e"] + CONTENTS_REACH).rlike(CONTENTS_LINE))
        return F.transform(hits, lambda h: F.struct(h["s"].alias("off"), F.lit(key).alias("key")).cast(_MARK))

    def settle(marks: Column) -> Column:
        rated = F.filter(marks, lambda m: m["key"] == "ABS_MAX")
        own = let(rated, lambda r: F.filter(marks, lambda m: ~((m["key"] == "ELEC_CHAR") & F.exists(r, lambda a: (m["off"] - a["off"]).between(0, OVERLAP)))))

        def keep(acc: Column, m: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            repeats = F.coalesce((last["key"] == m["key"]) & (m["off"] - last["off"] < REPEAT), F.lit(False))
            return F.when(repeats, acc).otherwise(F.array_append(acc, m))

        return F.aggregate(own, F.array().cast(f"array<{_MARK}>"), keep)

    return let(F.array_sort(F.concat(*[of(k) for k in HEADINGS])), settle)


def section_at(marks: Column, at: Column) -> Column:
    """The section that an offset lies in: that of the last mark at or before it."""
    return F.coalesce(F.try_element_at(F.filter(marks, lambda m: m["off"] <= at), F.lit(-1))["key"], F.lit(OTHER))


def is_graph_region(text: Column, at: Column) -> Column:
    """Whether two or more axis labels lie around an offset."""
    several = lambda near, pattern: F.size(F.regexp_extract_all(near, F.lit(pattern), F.lit(0))) >= 2
    # Units in brackets are looked for first: most texts have none, and labels are tried at each letter.
    return let(slice_text(text, at - PLOT_REACH, at + PLOT_REACH), lambda near: F.when(several(near, AXIS_UNIT), several(near, AXIS_LABEL)).otherwise(False))


def section_summary(marks: Column) -> Column:
    """Marks of each section, as a map."""
    keys = F.array_distinct(F.transform(marks, lambda m: m["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.size(F.filter(marks, lambda m: m["key"] == k)))))
