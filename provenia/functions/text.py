"""Text functions of Spark columns: positions are code points from 0, ends are exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
WHITE = r"(?U)\s+"
_HIT = "struct<s:int,e:int,m:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """text from start to end, both clamped to it."""
    first = F.greatest(start, F.lit(0))
    return F.substring(text, first + 1, F.greatest(end - first, F.lit(0)))


def window(text: Column, at: Column, before: int = 240, after: int = 240) -> Column:
    return slice_text(text, at - before, at + after)


def quote_regex(text: Column) -> Column:
    """A pattern that matches text literally."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def flexible_pattern(quote: Column) -> Column:
    """A pattern for the words of quote in any case, with any white space between them."""
    words = F.split(F.trim(F.regexp_replace(quote, WHITE, " ")), " ")
    return F.concat(F.lit("(?iuU)"), F.array_join(F.transform(words, quote_regex), r"\s+"))


def find_quote(text: Column, quote: Column) -> Column:
    """Where quote begins in text: as it is, else with other white space or case; -1 if nowhere."""
    at = F.instr(text, quote) - 1
    loose = let(F.split(text, flexible_pattern(quote), 2), lambda p: F.when(F.size(p) > 1, F.length(p[0])).otherwise(-1))
    return F.when(collapse(quote) == "", -1).when(at >= 0, at).otherwise(loose)


def contains_quote(text: Column, quote: Column) -> Column:
    return find_quote(text, quote) >= 0


def find_all(text: Column, pattern: str | Column) -> Column:
    """All matches of a pattern that never matches emptily: array of (s, e, m)."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def positions(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            m = F.element_at(x["m"], i)
            s = acc["pos"] + F.length(F.element_at(x["p"], i))
            e = s + F.length(m)
            return F.struct(e.alias("pos"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), m.alias("m")).cast(_HIT)).alias("out"))

        start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_HIT}>").alias("out"))
        found = F.aggregate(F.sequence(F.lit(1), F.size(x["m"])), start, step, lambda acc: acc["out"])
        return F.when(F.size(x["m"]) > 0, found).otherwise(F.array().cast(f"array<{_HIT}>"))

    return let(F.struct(F.split(text, regex, -1).alias("p"), F.regexp_extract_all(text, regex, F.lit(0)).alias("m")), positions)


# What is taken out of a page's source, in order, and what stands in its place.
_MARKUP = ((r"(?is)<script\b[^>]*>.*?</script>", " "), (r"(?is)<style\b[^>]*>.*?</style>", " "), (r"<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), (r"[ \t]+", " "), (r"\n\s*\n+", "\n"))


def strip_html(html: Column) -> Column:
    """Visible text of a page: script and style bodies and tags gone, two entities decoded, blanks squeezed."""
    for pattern, by in _MARKUP:
        html = F.regexp_replace(html, pattern, by)
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?U)^\s+", ""), r"(?U)\s+$", ""))


def page_for_offset(pages: Column, at: Column) -> Column:
    """The page (page, char_start, char_end) that has an offset; else the last page; else 1."""
    inside = F.filter(pages, lambda p: (p["char_start"] <= at) & (at < p["char_end"]))
    return F.coalesce(F.try_element_at(inside, F.lit(1))["page"], F.try_element_at(pages, F.lit(-1))["page"], F.lit(1))


def page_text(text: Column, pages: Column, page: Column) -> Column:
    """The slice of text that is a page, or ""."""
    own = F.filter(pages, lambda p: p["page"] == page)
    return let(own, lambda o: F.when(F.size(o) > 0, slice_text(text, F.try_element_at(o, F.lit(1))["char_start"], F.try_element_at(o, F.lit(1))["char_end"])).otherwise(""))


def _product_error(a: Column, b: Column) -> Column:
    """What is lost of a * b when it is rounded to a double, exactly (Dekker's product)."""
    halves = lambda x: (lambda c: (c - (c - x), x - (c - (c - x))))(x * 134217729.0)
    (ah, al), (bh, bl) = halves(a), halves(b)
    return ((ah * bh - a * b) + ah * bl + al * bh) + al * bl


def format_g(x: Column) -> Column:
    """x as C's %g has it: six significant digits, no trailing zeros; null stays null.

    Java rounds the shortest decimal of x, C its exact binary value. They differ where
    that decimal has seven digits of which the last is 5; there the exact remainder of
    x * 10^m decides, and an exact tie goes to the even digit.
    """

    def parsed(v: Column) -> Column:
        seven = F.split(F.format_string("%.6e", F.abs(v)), "e")
        return let(F.struct(v.alias("v"), F.abs(v).alias("a"), seven.alias("p")), lambda d: F.struct(d["v"].alias("v"), d["a"].alias("a"), F.regexp_replace(F.try_element_at(d["p"], F.lit(1)), r"\.", "").try_cast("long").alias("whole"), (F.lit(6) - F.try_element_at(d["p"], F.lit(2)).try_cast("int")).alias("shift")))

    def powers(d: Column) -> Column:
        # A power of ten is exact up to 22, its inverse isn't.
        return F.struct(*[d[c].alias(c) for c in ("v", "a", "whole", "shift")], F.pow(F.lit(10.0), d["shift"]).alias("scale"), F.pow(F.lit(10.0), -d["shift"]).alias("big"))

    def digits(d: Column) -> Column:
        magnitude, whole, shift, scale, big = (d[c] for c in ("a", "whole", "shift", "scale", "big"))
        tie = (whole % 10 == 5) & shift.between(-22, 22) & (F.format_string("%.6e", magnitude).try_cast("double") == magnitude)
        large = shift < 0
        rest = F.when(large, (magnitude - whole * big) - _product_error(whole.cast("double"), big)).otherwise((magnitude * scale - whole) + _product_error(magnitude, scale))
        down = let(F.when(tie, rest), lambda r: (r < 0) | ((r == 0) & (F.floor(whole / 10) % 2 == 0)))
        return F.when(down, F.signum(d["v"]) * F.when(large, (whole - 1) * big).otherwise((whole - 1) / scale)).otherwise(d["v"])

    def shown(v: Column) -> Column:
        bare = lambda c: F.regexp_replace(F.regexp_replace(c, "0+$", ""), r"\.$", "")

        def of(d: Column) -> Column:
            exponent = d["p"]
            power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
            return F.when(exponent.between(-4, 5), bare(d["t"].try_cast("double").cast("decimal(30,12)").cast("string"))).otherwise(F.concat(bare(d["m"]), F.lit("e"), power))

        parts = lambda t: F.struct(t.alias("t"), F.try_element_at(F.split(t, "e"), F.lit(1)).alias("m"), F.try_element_at(F.split(t, "e"), F.lit(2)).try_cast("int").alias("p"))
        return F.when(v == 0, "0").otherwise(let(let(F.format_string("%.5e", v), parts), of))

    # Most numbers have six digits at most, which their shortest decimal shows as they are.
    plain = F.regexp_replace(x.cast("string"), r"\.0$", "")
    short = plain.rlike(r"^-?(?:[1-9][0-9]{0,5}|(?=[0-9.]{3,7}$)[1-9][0-9]*\.[0-9]+|0\.0{0,3}[1-9][0-9]{0,5})$")
    return F.when(x == 0, "0").when(short, plain).when(x.isNotNull(), let(let(let(let(x, parsed), powers), digits), shown))
