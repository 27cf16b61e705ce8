"""Threats in the characters of a text: invisible ones, variation selectors, look-alike letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import THREAT_TYPE, no_threats, threat
from ..functions.text import (
    confusable_count, confusable_samples, decode_zero_width, is_blank, let, may_be_suspicious, mixed_scripts, selector_chars, selectors, type_summary, visible_count, zero_width_chars, zero_width_density,
)

DENSITY, LEAST = 5.0, 8


def counts(text: Column) -> Column:
    """zw_count, visible, zw_density, selectors, confusables of a text; zeros for a blank one."""
    blank = is_blank(text)
    zero = lambda c: F.when(blank, F.lit(0)).otherwise(c)
    c = F.struct(zero(F.size(zero_width_chars(text))).alias("zw_count"), zero(visible_count(text)).alias("visible"), zero(F.size(selector_chars(text))).alias("selectors"), zero(confusable_count(text)).alias("confusables"))
    return let(c, lambda x: F.struct(x["zw_count"].alias("zw_count"), x["visible"].alias("visible"), zero_width_density(x["zw_count"], x["visible"]).alias("zw_density"), x["selectors"].alias("selectors"), x["confusables"].alias("confusables")))


def unicode_threats(text: Column) -> Column:
    """At most three threats, in this order: invisible characters, selectors, look-alike letters or mixed scripts."""
    return let(text, lambda t: F.when(is_blank(t) | ~may_be_suspicious(t), no_threats()).otherwise(let(counts(t), lambda c: _threats(t, c))))


def _threats(t: Column, c: Column) -> Column:
    """The threats of a text with its counts; what reads the whole text is evaluated once, and only where it is told."""
    found = F.struct(
        F.when(c["zw_count"] > 0, type_summary(zero_width_chars(t))).alias("kinds"),
        F.when(c["selectors"] > 0, selectors(t)).alias("selectors"),
        F.array_join(mixed_scripts(t), ", ").alias("names"),
    )
    return let(found, lambda f: _told(t, c, f["kinds"], f["selectors"], f["names"]))


def _told(t: Column, c: Column, kinds: Column, found: Column, names: Column) -> Column:
    density, n = F.format_string("%.1f", c["zw_density"]), c["zw_count"].cast("string")
    decoded = F.when(c["zw_count"] >= LEAST, decode_zero_width(t)).otherwise(F.lit(""))
    told = let(decoded, lambda d: F.when(d != "", F.concat(F.lit(" Decoded: '"), d, F.lit("'"))).otherwise(F.lit("")))
    invisible = threat("zero_width_chars", F.concat(n, F.lit(" invisible characters ("), kinds, F.lit("), "), density, F.lit(" for each 100 visible."), told), kinds, "stripped", F.concat(F.lit("chars 0–"), F.length(t).cast("string"), F.lit(" (density "), density, F.lit("%)")))
    more = F.when(c["selectors"] > 5, F.concat(F.lit(" (+"), (c["selectors"] - 5).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    listed = F.array_join(F.transform(F.slice(found, 1, 5), lambda s: F.concat(F.lit("pos "), s["pos"].cast("string"), F.lit(": "), s["name"])), ", ")
    selector = threat("variation_selector", F.concat(c["selectors"].cast("string"), F.lit(" variation selectors: "), listed, more), F.concat(F.lit("Unicode variation selectors ("), c["selectors"].cast("string"), F.lit(" total)")), "stripped", F.concat(F.lit("positions ["), F.array_join(F.transform(F.slice(found, 1, 3), lambda s: s["pos"].cast("string")), ", "), F.lit("]")))
    samples = F.array_join(F.transform(confusable_samples(t), lambda s: F.concat(F.lit("pos "), s["pos"].cast("string"), F.lit(": '"), s["ch"], F.lit("' → '"), s["looks_like"], F.lit("'"))), "; ")
    alike = threat("homoglyph", F.concat(c["confusables"].cast("string"), F.lit(" look-alike characters ("), F.coalesce(F.nullif(names, F.lit("")), F.lit("unknown script")), F.lit("): "), samples), F.concat(F.lit("Mixed-script homoglyphs ("), F.coalesce(F.nullif(names, F.lit("")), F.lit("non-Latin")), F.lit(")")), "normalized", F.concat(c["confusables"].cast("string"), F.lit(" positions across text")))
    letters = F.array_join(F.slice(F.regexp_extract_all(t, F.lit(r"([\p{L}&&[^\x00-\x7F]])"), 1), 1, 6), ", ")
    mixed = threat("homoglyph", F.concat(F.lit("Latin letters mixed with "), names, F.lit(": "), letters), F.concat(F.lit("Mixed scripts: "), names), "flagged", F.lit("throughout text"))
    each = [F.when((c["zw_density"] > DENSITY) & (c["zw_count"] > 0) | (c["zw_count"] >= LEAST), invisible), F.when(c["selectors"] > 0, selector), F.when(c["confusables"] > 0, alike).when(names != "", mixed)]
    return F.array_compact(F.array(*each)).cast(f"array<{THREAT_TYPE}>")
