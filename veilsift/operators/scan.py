"""The scan: routing, the detectors of each route, sanitised output and verdict, one row per document.

All steps work on a document's own row: the HTML is shredded once, every check is an expression, and
nothing is shuffled. Image bytes are read only where a row holds any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import SEVERITIES, UNKNOWN_WEIGHT, WEIGHTS, no_threats, severity_rank
from ..functions.text import let, sanitize_text, strip
from ..patterns import instructs, pattern
from ..sources.html import shred
from .html_checks import css_hidden, css_threats, hidden_elements, inside, injection_threats, element_text, visible_text
from .unicode_checks import unicode_threats

# Content types of the routes.
HTML_TYPES = ["text/html", "application/xhtml+xml"]
TEXT_TYPES = ["text/plain", "text/markdown", "text/csv"]
IMAGE_TYPES = ["image/jpeg", "image/png", "image/gif", "image/webp", "image/bmp", "image/tiff"]
TAGS = "<html|<body|<div|<p>|<span|<!doctype"
DROPPED_ATTRS = ["aria-description", "aria-details", "data-prompt", "data-instruction", "data-system", "data-ai", "data-llm"]
INPUTS = ["content", "raw", "content_type", "filename", "deep", "decoded"]
RESULTS = ["route", "type", "text", "run_image", "threats", "sanitized_content", "tier_timings", "recommended_action", "scores", "safe", "confidence", "threat_count", "max_severity", "has_critical"]
TIERS = ["t1", "t2", "t3"]
CHECKED_ATTRS = ["aria-label", "aria-description", "title", "alt", "placeholder"]


def mime(content_type: Column) -> Column:
    return F.trim(F.split_part(F.lower(F.coalesce(content_type, F.lit(""))), F.lit(";"), F.lit(1)))


def lossy_text(raw: Column) -> Column:
    """Bytes as UTF-8, with replacement characters for what is none."""
    return F.make_valid_utf8(raw.cast("string"))


def looks_like_html(text: Column) -> Column:
    head = F.lower(F.substring(F.regexp_replace(text, r"(?U)^\s+", ""), 1, 200))
    return head.contains("<") & head.contains(">") & head.rlike(TAGS)


def file_name(url: Column) -> Column:
    """The last path segment of a URL without its query; empty without a slash."""
    return F.when(url.contains("/"), F.split_part(F.substring_index(url, "/", -1), F.lit("?"), F.lit(1))).otherwise(F.lit(""))


def routed(docs: DataFrame) -> DataFrame:
    """docs (content string, raw binary, content_type, deep) with type, route (html, text, image), text, run_image and bytes.

    A row with raw is bytes, else a string. Bytes with a text type are read as text and as an image too.
    """
    is_bytes, kind = F.col("raw").isNotNull(), mime(F.col("content_type"))
    text = F.when(is_bytes, lossy_text(F.col("raw"))).otherwise(F.coalesce("content", F.lit("")))
    html = kind.isin(HTML_TYPES) | (~is_bytes & looks_like_html(F.col("content")))
    route = F.when(F.coalesce(html, F.lit(False)), "html").when(kind.isin(TEXT_TYPES) | ~is_bytes, "text").otherwise("image")
    df = docs.withColumns({"route": route, "text": text})
    retyped = F.when((F.col("route") == "text") & ~is_bytes & ~kind.isin(TEXT_TYPES), "text/plain").otherwise(kind)
    return df.withColumns({"type": retyped, "run_image": is_bytes | F.when(F.col("route") != "text", kind.isin(IMAGE_TYPES)).otherwise(F.lit(False))})


def max_severity(threats: Column) -> Column:
    """The gravest severity, null without threats."""
    rank = F.array_max(F.transform(threats, lambda t: severity_rank(t["severity"])))
    return F.when(F.size(threats) > 0, F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank + 1))


def has_critical(threats: Column) -> Column:
    return F.exists(threats, lambda t: t["severity"] == "critical")


def confidence(threats: Column) -> Column:
    """1 without threats; else the largest weight plus a hundredth for each further threat, five at most, 0.99 at most."""
    def weight(s: Column) -> Column:
        out = F.lit(UNKNOWN_WEIGHT)
        for name, w in WEIGHTS.items():
            out = F.when(s == name, w).otherwise(out)
        return out

    top = F.array_max(F.transform(threats, lambda t: weight(t["severity"])))
    return F.when(F.size(threats) == 0, F.lit(1.0)).otherwise(F.least(F.lit(0.99), top + F.least(F.lit(0.05), 0.01 * (F.size(threats) - 1))))


def verdict(df: DataFrame, threats: str = "threats") -> DataFrame:
    t = F.col(threats)
    return df.withColumns({"safe": F.size(t) == 0, "confidence": confidence(t), "threat_count": F.size(t).cast("long"), "max_severity": max_severity(t), "has_critical": has_critical(t)})


def html_threats(nodes: Column) -> Column:
    """Of shredded documents: hidden text, then instructions, then the characters of the visible text."""
    return F.concat(css_threats(css_hidden(nodes)), injection_threats(nodes), unicode_threats(visible_text(nodes)))


def removable(nodes: Column) -> Column:
    """Numbers of the nodes that sanitising drops: hidden elements, noscript blocks and body metas with instructions."""
    hidden = F.transform(hidden_elements(nodes), lambda x: x["node"]["pos"])
    noscript = F.filter(nodes, lambda n: (n["kind"] == "element") & (n["tag"] == "noscript") & instructs(element_text(nodes, n), "clean"))
    body = F.filter(nodes, lambda n: (n["kind"] == "element") & (n["tag"] == "body"))
    meta = F.filter(nodes, lambda n: (n["tag"] == "meta") & (n["kind"] == "element") & F.exists(body, lambda b: inside(n, b)) & instructs(F.coalesce(n["attrs"]["content"], F.lit("")), "clean"))
    return F.array_distinct(F.concat(hidden, F.transform(noscript, lambda n: n["pos"]), F.transform(meta, lambda n: n["pos"])))


def rewrite(df: DataFrame, html: str, gone: str, out: str) -> DataFrame:
    """df with the column out: the HTML without the nodes numbered in gone, without comments and suspicious attributes. Blank input stays."""
    import re

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    at, where = df.columns.index(html), df.columns.index(gone)
    bad = pattern("clean").replace("(?isU)", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..sources.html import parse, serialise

        suspicious = re.compile(bad, re.I | re.S).search

        def keep(name: str, value: str) -> bool:
            return name not in DROPPED_ATTRS and not ((name.startswith("data-") or name in CHECKED_ATTRS) and suspicious(value))

        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part, done = batch.slice(first, 500), []
                for text, drop in zip(part.column(at).to_pylist(), part.column(where).to_pylist(), strict=True):
                    nodes = parse(text, written=True) if drop is not None else []
                    done.append(text if not nodes else serialise(nodes, set(drop), {n["pos"]: [a for a in n["attrs"] if keep(*a)] for n in nodes if n["kind"] == "element"}))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def sanitize_html(docs: DataFrame, html: str = "html", out: str = "sanitized") -> DataFrame:
    shredded = shred(docs, html, "_nodes").withColumn("_gone", removable(F.col("_nodes"))).drop("_nodes")
    return rewrite(shredded, html, "_gone", out).drop("_gone")


def scan(docs: DataFrame, model: Callable[[list[bytes]], Sequence[float]] | None = None, shredded: tuple[str, str] | None = None) -> DataFrame:
    """docs (content, raw, content_type, filename, deep and any others) with route, type, text, run_image, threats,
    sanitized_content, recommended_action, scores, verdict columns and tier_timings: for each tier that saw the row, the milliseconds that Python
    workers spent on it (t1: parsing, 0 for texts; t2: reading the image; t3: its share of the model's batch). The checks
    themselves are expressions that Spark runs row after row in one loop, so they have no time of a single row.

    All columns of docs stay as they are; a result whose name one of them has is called scan_ and its name. The pixels of
    images are read from a column decoded if there is one (image_checks.with_pixels joins it to files), else from 8-bit PNG
    bytes only. model gives, for a list of images, the probabilities that they hide data; it sees the images that the pixel
    tests suspect and those with deep set. Without it the third tier finds nothing. shredded names two columns of docs with the
    nodes of each row's own text and the milliseconds that took, where shred has been at it before; they are not kept.
    """
    from .image_checks import deep_threats, deep_verdict, triage

    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    given = [c for c in docs.columns if c.lower() in INPUTS]
    spent = list(shredded or [])
    others = [c for c in docs.columns if c.lower() not in INPUTS and c not in spent]
    row = [F.struct(*map(named, others)).alias("_row")] if others else []
    df = routed(docs.select(*map(named, given), *row, *[named(c).alias(n) for c, n in zip(spent, ("_nodes", "_t1"), strict=False)]))
    page = F.col("route") == "html"
    if not shredded:
        df = shred(df.withColumn("_html", F.when(page, F.col("text"))), "_html", "_nodes", "_t1").drop("_html")
    df = df.withColumn("_text", F.when(page, html_threats(F.col("_nodes"))).when(F.col("route") == "text", unicode_threats(F.col("text"))).otherwise(no_threats()))
    df = df.withColumn("_gone", F.when(page, removable(F.col("_nodes")))).drop("_nodes")
    image = next(c for c in given if c.lower() == "raw")  # rows with raw are all looked at as images
    df = triage(df, image, "filename", "_triage", "decoded" if "decoded" in map(str.lower, given) else None, "_t2")
    gate = F.col("run_image") & (F.octet_length(named(image)) > 0) & (F.coalesce("_triage.is_suspicious", F.lit(False)) | F.coalesce(F.col("deep"), F.lit(False)))
    df = df.withColumn("_gate", F.coalesce(gate, F.lit(False)))
    if model is None:
        df = df.withColumns({"_deep": no_threats(), "_t3": F.lit(0.0)})
    else:
        judged = deep_verdict(df.withColumn("_suspect", F.when(F.col("_gate"), named(image))), "_suspect", "_judged", model)
        df = judged.withColumns({"_deep": deep_threats(F.col("_judged")), "_t3": F.coalesce("_judged.ms", F.lit(0.0))}).drop("_suspect", "_judged")
    df = df.withColumn("threats", F.concat("_text", F.coalesce("_triage.threats", no_threats()), "_deep"))
    df = rewrite(df, "text", "_gone", "_clean")
    df = df.withColumn("sanitized_content", F.when(page, F.col("_clean")).when(F.col("route") == "text", sanitize_text(F.col("text"))))
    tier = lambda name, seen: F.when(seen, F.create_map(F.lit(name), F.coalesce(f"_{name}", F.lit(0.0)))).otherwise(F.create_map().cast("map<string,double>"))
    tiers = F.map_concat(tier("t1", F.lit(True)), tier("t2", F.coalesce("run_image", F.lit(False))), tier("t3", F.col("_gate")))
    df = verdict(df.withColumns({"tier_timings": tiers, "recommended_action": F.col("_triage.recommended_action"), "scores": F.col("_triage.scores")}))
    taken = {c.lower() for c in docs.columns}
    kept = [named(c) if c in given else F.col("_row")[c].alias(c) for c in docs.columns if c not in spent]
    return df.select(*kept, *[F.col(r).alias(f"scan_{r}" if r in taken else r) for r in RESULTS])


def observed(scanned: DataFrame, timings: str = "tier_timings") -> tuple[DataFrame, Observation]:
    """scanned, and an observation that the next action over it fills: see tier_report."""
    seen = Observation()
    of = lambda t: F.try_element_at(timings, F.lit(t))
    metrics = [m for t in TIERS for m in (F.count(of(t)).alias(f"{t}_rows"), F.sum(of(t)).alias(f"{t}_ms"), F.max(of(t)).alias(f"{t}_max_ms"))]
    return scanned.observe(seen, *metrics), seen


def tier_report(seen: Observation) -> dict[str, dict[str, float]]:
    """By tier: rows that it saw, the milliseconds of them all and of the slowest. Waits for an action over the observed rows; 0 without rows."""
    got = seen.get
    return {t: {m: got[f"{t}_{m}"] or 0 for m in ("rows", "ms", "max_ms")} for t in TIERS}


def scan_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, threats and verdict) of pages that are known to be HTML; no image checks, no sanitised copy."""
    shredded = shred(pages.select(key, html), html, "_nodes")
    return verdict(shredded.select(key, html_threats(F.col("_nodes")).alias("threats")))


def visible(docs: DataFrame, html: str = "html", out: str = "visible_text") -> DataFrame:
    """docs with the stripped text of their HTML, sanitised as text."""
    return shred(docs, html, "_nodes").withColumn(out, sanitize_text(F.array_join(F.filter(F.transform(F.filter("_nodes", lambda n: n["kind"] == "text"), lambda n: strip(n["text"])), lambda s: s != ""), " "))).drop("_nodes")


__all__ = ["confidence", "file_name", "has_critical", "html_threats", "let", "looks_like_html", "max_severity", "mime", "observed", "rewrite", "routed", "sanitize_html", "scan", "scan_pages", "tier_report", "verdict", "visible"]
