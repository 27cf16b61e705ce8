"""Hidden text and instructions in HTML, as expressions over a document's nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import THREAT_TYPE, no_threats, threat
from ..functions.css import classes, hiding
from ..functions.text import let, strip
from ..patterns import instructs

# Attributes that automated readers see, and names of usual meta tags.
READABLE_ATTRS = ["alt", "aria-describedby", "aria-description", "aria-details", "aria-label", "aria-labelledby", "aria-placeholder", "aria-roledescription", "placeholder", "summary", "title"]
META_NAMES = ["description", "keywords", "author", "viewport", "robots", "theme-color", "generator", "application-name", "referrer", "color-scheme", "format-detection"]
NOT_SHOWN = ["style", "script", "head", "meta", "link"]


def inside(n: Column, e: Column) -> Column:
    return (n["pos"] > e["pos"]) & (n["pos"] <= e["end"])


def element_text(nodes: Column, e: Column) -> Column:
    """Stripped pieces of text below an element, joined by a space; a style or script has its own raw text.

    A node's pos is its place in nodes, all nodes of the document, so only those below the element are looked at.
    """
    own = F.when(e["tag"].isin("style", "script", "template"), "raw").otherwise("text")
    below = F.slice(nodes, e["pos"] + 2, e["end"] - e["pos"])
    pieces = F.transform(F.filter(below, lambda n: n["kind"] == own), lambda n: strip(n["text"]))
    return F.array_join(F.filter(pieces, lambda p: p != ""), " ")


def visible_text(nodes: Column) -> Column:
    """All text pieces of a document joined by a space, unstripped."""
    return F.array_join(F.transform(F.filter(nodes, lambda n: n["kind"] == "text"), lambda n: n["text"]), " ")


def hidden_elements(nodes: Column) -> Column:
    """(node, techniques) of the elements that styles hide, in document order."""
    told = F.filter(nodes, lambda n: n["styles"].isNotNull() & ~n["tag"].isin(NOT_SHOWN))
    checked = F.transform(told, lambda n: F.struct(n.alias("node"), hiding(n["styles"]).alias("techniques")))
    return F.filter(checked, lambda x: F.size(x["techniques"]) > 0)


def css_hidden(nodes: Column) -> Column:
    """Hidden texts of three characters or more: (text, node, techniques), the first of each techniques and 80-character beginning."""
    texts = F.transform(hidden_elements(nodes), lambda x: F.struct(element_text(nodes, x["node"]).alias("text"), x["node"].alias("node"), x["techniques"].alias("techniques")))
    key = lambda x: F.concat(F.array_join(F.array_sort(x["techniques"]), "\n"), F.lit("\n\n"), F.left(x["text"], F.lit(80)))

    def firsts(long: Column) -> Column:
        """Of equal keys the first: sorted by key and place, those that differ from the one before, in their old order."""
        keyed = F.array_sort(F.transform(long, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"))))
        places = let(keyed, lambda k: F.filter(k, lambda y, i: (i == 0) | (y["key"] != F.get(k, i - 1)["key"])))
        return F.transform(F.array_sort(F.transform(places, lambda y: y["i"])), lambda i: F.get(long, i))

    return let(F.filter(texts, lambda x: F.length(x["text"]) >= 3), firsts)


def css_threats(hidden: Column) -> Column:
    def one(h: Column) -> Column:
        used = F.array_join(h["techniques"], ", ")
        n = h["node"]
        place = F.when(F.length(n["attrs"]["id"]) > 0, F.concat(F.lit("#"), n["attrs"]["id"])).when(F.size(classes(n)) > 0, F.concat(F.lit("."), F.try_element_at(classes(n), F.lit(1)))).otherwise(F.concat(F.lit("<"), n["tag"], F.lit(">")))
        note = F.when(instructs(h["text"], "css"), " (reads like an instruction)").otherwise("")
        detail = F.concat(F.lit("<"), n["tag"], F.lit("> is hidden by "), used, F.lit("; "), F.length(h["text"]).cast("string"), F.lit(" characters: '"), F.left(h["text"], F.lit(120)), F.lit("'"), note)
        return threat("css_hidden_text", detail, used, "stripped", place)

    return F.transform(hidden, one).cast(f"array<{THREAT_TYPE}>")


def comments(nodes: Column) -> Column:
    return F.transform(F.filter(nodes, lambda n: n["kind"] == "comment"), lambda n: strip(n["text"]))


def flagged_comments(nodes: Column) -> Column:
    return F.filter(comments(nodes), lambda c: instructs(c, "html"))


def suspicious_attrs(nodes: Column) -> Column:
    """(pos, tag, attr, value) of readable attributes with instructions, or longer than 80 characters and unlike a label."""

    def of(n: Column) -> Column:
        values = F.transform(F.array(*[F.lit(a) for a in READABLE_ATTRS]), lambda a: F.struct(n["pos"].alias("pos"), n["tag"].alias("tag"), a.alias("attr"), strip(n["attrs"][a]).alias("value")))
        odd = lambda v: instructs(v, "html") | ((F.length(v) > 80) & ~v.rlike(r"(?U)^[\w\s,.\-/:()]{1,120}$"))
        return F.filter(values, lambda x: F.coalesce(odd(x["value"]), F.lit(False)))

    return F.flatten(F.transform(F.filter(nodes, lambda n: (n["kind"] == "element") & (F.size(n["attrs"]) > 0)), of))


def flagged_data_attrs(nodes: Column) -> Column:
    """(tag, attr, value) of data-* attributes with instructions."""

    def of(n: Column) -> Column:
        found = F.filter(F.map_entries(n["attrs"]), lambda e: e["key"].startswith("data-") & instructs(strip(e["value"]), "html"))
        return F.transform(found, lambda e: F.struct(n["tag"].alias("tag"), e["key"].alias("attr"), strip(e["value"]).alias("value")))

    return F.flatten(F.transform(F.filter(nodes, lambda n: (n["kind"] == "element") & (F.size(n["attrs"]) > 0)), of))


def flagged_metas(nodes: Column) -> Column:
    """(name, content, in_body) of meta tags with instructions; the usual names are exempt outside the body only."""
    first = lambda tag: F.try_element_at(F.filter(nodes, lambda n: (n["kind"] == "element") & (n["tag"] == tag)), F.lit(1))

    def of(b: Column) -> Column:
        metas = F.filter(nodes, lambda n: (n["kind"] == "element") & (n["tag"] == "meta"))
        name = lambda n: F.lower(F.coalesce(F.nullif(n["attrs"]["name"], F.lit("")), n["attrs"]["property"], F.lit("")))
        within = lambda n: F.coalesce(inside(n, b["body"]), F.lit(False)) & ~F.coalesce(inside(n, b["head"]), F.lit(False))
        listed = F.transform(metas, lambda n: F.struct(name(n).alias("name"), F.coalesce(n["attrs"]["content"], F.lit("")).alias("content"), within(n).alias("in_body")))
        return F.filter(listed, lambda m: instructs(m["content"], "html") & (m["in_body"] | ~m["name"].isin(META_NAMES)))

    return let(F.struct(first("body").alias("body"), first("head").alias("head")), of)


def flagged_noscripts(nodes: Column) -> Column:
    """Texts of noscript blocks with instructions or more than 100 characters."""
    found = F.filter(nodes, lambda n: (n["kind"] == "element") & (n["tag"] == "noscript"))
    return F.filter(F.transform(found, lambda n: element_text(nodes, n)), lambda t: instructs(t, "html") | (F.length(t) > 100))


def injection_threats(nodes: Column) -> Column:
    """At most one threat of each check: comments, readable attributes, data attributes, metas, noscript blocks."""
    count = lambda a: F.size(a).cast("string")
    first = lambda a, of=lambda x: x: F.left(of(F.try_element_at(a, F.lit(1))), F.lit(120))

    def when_any(found: Column, make) -> Column:
        return let(found, lambda a: F.when(F.size(a) > 0, make(a)))

    lines = [
        when_any(flagged_comments(nodes), lambda a: threat("html_comment_injection", F.concat(count(a), F.lit(" comment(s) with instructions, first: '"), first(a), F.lit("'")), F.concat(F.lit("HTML comment injection ("), count(a), F.lit(" comment(s))")), "stripped", F.lit("HTML comment nodes"))),
        when_any(suspicious_attrs(nodes), lambda a: threat("aria_attribute_injection", F.concat(count(a), F.lit(" suspicious attribute(s), first: '"), first(a, lambda x: x["value"]), F.lit("'")), F.concat(F.lit("ARIA/attribute injection in "), F.array_join(F.array_distinct(F.transform(F.slice(a, 1, 5), lambda x: x["attr"])), ", ")), "stripped", F.array_join(F.transform(F.slice(a, 1, 3), lambda x: F.concat(F.lit("<"), x["tag"], F.lit(" "), x["attr"], F.lit("=...>"))), ", "))),
        when_any(flagged_data_attrs(nodes), lambda a: threat("aria_attribute_injection", F.concat(count(a), F.lit(" data attribute(s) with instructions, first: '"), first(a, lambda x: x["value"]), F.lit("'")), F.concat(F.lit("data-* attribute injection ("), count(a), F.lit(" instances)")), "stripped", F.array_join(F.transform(F.slice(a, 1, 3), lambda x: F.concat(F.lit("<"), x["tag"], F.lit("> ["), x["attr"], F.lit("]"))), ", "))),
        when_any(flagged_metas(nodes), lambda a: threat("meta_injection", F.concat(count(a), F.lit(" meta tag(s) with instructions, first: '"), first(a, lambda x: x["content"]), F.lit("'")), F.lit("Meta tag content injection"), "stripped", F.lit("<meta> tags"))),
        when_any(flagged_noscripts(nodes), lambda a: threat("noscript_injection", F.concat(count(a), F.lit(" noscript block(s), first: '"), first(a), F.lit("'")), F.lit("NoScript block injection (targets JS-disabled agents)"), "stripped", F.lit("<noscript> blocks"))),
    ]
    return F.coalesce(F.array_compact(F.array(*lines)).cast(f"array<{THREAT_TYPE}>"), no_threats())
