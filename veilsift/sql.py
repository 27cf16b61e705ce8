"""The library under SQL names: table functions for lateral joins, and scalar functions that Spark inlines.

    register(spark)
    spark.sql("SELECT p.page_id, n.tag FROM pages p, LATERAL shred_html(p.html) n WHERE is_instruction_html(n.text)")

The table functions are Python: shred_html gives a row for each node of a document, image_metadata one for each field
of an image. A query that reads one lateral join for all its checks parses each document once. The scalar functions are
temporary SQL functions, so Catalyst sees their expressions; unicode_nfc alone is an Arrow function. Null gives null
from scalar functions and no rows from table functions, like input that cannot be parsed. Spark doesn't allow SQL
functions inside lambdas; join or concatenate an array's elements instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .dims import ZERO_WIDTH, confusables
from .functions.text import SELECTOR_CLASS, ZERO_WIDTH_CLASS
from .operators.scan import HTML_TYPES, IMAGE_TYPES, TAGS, TEXT_TYPES
from .patterns import instructs_sql
from .sources.html import parse
from .sources.images import metadata, png_pixels
from .session import ship

NODE_COLUMNS = "pos int, `end` int, parent int, parent_tag string, kind string, tag string, attrs map<string, string>, text string"
DETECTORS = ("css", "html", "image", "clean")


class ShredHtml:
    def eval(self, html: str) -> Iterator[tuple]:
        nodes = parse(html)
        for n in nodes:
            yield n["pos"], n["end"], n["parent"], nodes[n["parent"]]["tag"] if n["parent"] >= 0 else None, n["kind"], n["tag"], None if n["attrs"] is None else dict(n["attrs"]), n["text"]


class ImageMetadata:
    def eval(self, data: bytes) -> Iterator[tuple]:
        for field, value in metadata(bytes(data)) if data is not None else ():
            yield field, value.decode("utf-8", "replace").rstrip("\0"), len(value)


class ImagePixels:
    """Channel values of an image that is decoded here, one row for each pixel."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        pixels = png_pixels(bytes(data)) if data is not None else None
        if pixels is not None:
            for y, row in enumerate(pixels.tolist()):
                for x, channels in enumerate(row):
                    yield x, y, channels


TABLES = {
    "shred_html": (ShredHtml, NODE_COLUMNS),
    "image_metadata": (ImageMetadata, "field string, value string, n_bytes int"),
    "image_pixels": (ImagePixels, "x int, y int, channels array<int>"),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(values: list[str]) -> str:
    return ", ".join(map(_quoted, values))


def scalar_functions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, type, body) of the scalar functions."""
    table = confusables()
    keys, targets = _quoted("".join(table)), _quoted("".join(table.values()))
    invisible, selector = f"r'({ZERO_WIDTH_CLASS})'", f"r'({SELECTOR_CLASS})'"
    stripped = f"regexp_replace(text, r'{ZERO_WIDTH_CLASS}|{SELECTOR_CLASS}', '')"
    head = r"lower(substring(regexp_replace(text, r'(?U)^\s+', ''), 1, 200))"
    kinds = "CASE ch " + " ".join(f"WHEN {_quoted(chr(c))} THEN {_quoted(n)}" for c, n in ZERO_WIDTH.items()) + " END"
    route = f"CASE WHEN mime_type(content_type) IN ({_listed(HTML_TYPES)}) THEN 'html' WHEN mime_type(content_type) IN ({_listed(TEXT_TYPES)}) THEN 'text' WHEN mime_type(content_type) IN ({_listed(IMAGE_TYPES)}) THEN 'image' END"
    return {
        **{f"is_instruction_{d}": ("text STRING", "BOOLEAN", f"CASE WHEN text IS NOT NULL THEN {instructs_sql(d, 'text')} END") for d in DETECTORS},
        "trim_space": ("text STRING", "STRING", r"regexp_replace(text, r'(?U)^\s+|\s+$', '')"),
        "zero_width_chars": ("text STRING", "ARRAY<STRING>", f"regexp_extract_all(text, {invisible}, 1)"),
        "zero_width_name": ("ch STRING", "STRING", kinds),
        "variation_selectors": ("text STRING", "ARRAY<STRING>", f"regexp_extract_all(text, {selector}, 1)"),
        "visible_chars": ("text STRING", "INT", r"length(regexp_replace(text, r'[\p{C}\x{2028}\x{2029}]', ''))"),
        "confusable_letters": ("text STRING", "INT", f"length(text) - length(translate(text, {keys}, ''))"),
        "normalize_letters": ("text STRING", "STRING", f"translate(text, {keys}, {targets})"),
        "strip_invisible": ("text STRING", "STRING", stripped),
        "sanitize_text": ("text STRING", "STRING", f"translate({stripped}, {keys}, {targets})"),
        "mime_type": ("content_type STRING", "STRING", "trim(split_part(lower(coalesce(content_type, '')), ';', 1))"),
        "content_route": ("content_type STRING", "STRING", route),
        "looks_like_html": ("text STRING", "BOOLEAN", f"contains({head}, '<') AND contains({head}, '>') AND {head} RLIKE {_quoted(TAGS)}"),
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions callable from spark.sql in this session; returns their names."""
    ship(spark)
    for name, (handler, columns) in TABLES.items():
        spark.udtf.register(name, F.udtf(handler, returnType=columns))
    scalars = scalar_functions()
    for name, (parameters, kind, body) in scalars.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")

    @F.pandas_udf("string")
    def unicode_nfc(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    spark.udf.register("unicode_nfc", unicode_nfc)
    return [*TABLES, *scalars, "unicode_nfc"]
