"""Files as rows: documents by path, labelled samples by manifest, confusables tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Content types by extension and by leading bytes.
EXTENSIONS = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff"}
TEXT_EXTENSIONS = {"html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json"}
MAGIC = [("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff")]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def mime_of_name(path: Column) -> Column:
    """The image type that an extension stands for, else null."""
    return _lookup(extension(path), EXTENSIONS)


def sniff(content: Column) -> Column:
    """The image type of content with twelve bytes at least, by its first bytes, else null."""
    head, out = F.hex(F.substring(content, 1, 12)), F.lit(None).cast("string")
    out = F.when(head.startswith("52494646") & head.endswith("57454250"), "image/webp").otherwise(out)
    for magic, kind in reversed(MAGIC):
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return F.when(F.octet_length(content) >= 12, out)


def read_documents(spark: SparkSession, path: str, deep: bool = False, pattern: str | None = None) -> DataFrame:
    """(path, content, raw, content_type, filename, deep) of files; text types that are valid UTF-8 become strings. A missing path raises; empty files make no row, as in Spark's binaryFile source."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    kind = F.coalesce(_lookup(extension(F.col("path")), {**EXTENSIONS, **TEXT_EXTENSIONS}), sniff(F.col("content")), F.lit("application/octet-stream"))
    as_text = kind.startswith("text/") & F.is_valid_utf8(F.col("content").cast("string"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.when(as_text, F.col("content").cast("string")).alias("content"), F.when(~as_text, F.col("content")).alias("raw"), kind.alias("content_type"), name.alias("filename"), F.lit(deep).alias("deep"))


def from_base64(docs: DataFrame) -> DataFrame:
    """Image content given as base64 text becomes bytes; what does not decode stays text."""
    decoded = F.when(F.col("content_type").startswith("image/"), F.try_to_binary(F.col("content"), F.lit("base64")))
    return docs.withColumn("raw", F.coalesce("raw", decoded)).withColumn("content", F.when(F.col("raw").isNull(), F.col("content")))


def read_manifest(spark: SparkSession, manifest: str, samples: str) -> DataFrame:
    """Entries of a JSON manifest with the bytes of their files; entries without a file go, and, as Spark's binaryFile source reads none, those with an
    empty file; the format labelled_samples (sources.samples) keeps these."""
    files = spark.read.format("binaryFile").load(samples).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").alias("raw"))
    return spark.read.option("multiLine", True).json(manifest).join(files, "file")


def cycle(pool: DataFrame, n: int) -> DataFrame:
    """n rows (i, and the pool's columns) that repeat the pool, ordered by its column pos, from the start."""
    size = pool.count()
    numbered = pool.withColumn("pos", F.col("pos").cast("long"))
    return pool.sparkSession.range(n).withColumnRenamed("id", "i").withColumn("pos", F.pmod("i", F.lit(max(1, size)))).join(numbered, "pos").drop("pos")


def read_confusables(spark: SparkSession, path: str) -> dict[str, str]:
    """Character to look-alike from a file of `source ; target ; class # note` lines; ASCII targets only. A dimension, a few thousand rows."""
    parts = F.split(F.substring_index("value", "#", 1), ";")
    rows = spark.read.text(path).select(F.trim(parts[0]).alias("a"), F.trim(parts[1]).alias("b")).filter("a rlike '^[0-9A-Fa-f]{2,6}$' and b rlike '^[0-9A-Fa-f]{2,6}$'").distinct()
    found = ((int(r["a"], 16), int(r["b"], 16)) for r in rows.collect())
    return {chr(a): chr(b) for a, b in found if b < 128}


def newest(spark: SparkSession, path: str, pattern: str = "*.json") -> str | None:
    """The most recently written file below a path."""
    row = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).orderBy(F.desc("modificationTime"), F.desc("path")).select("path").first()
    return row["path"] if row else None


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by a bar and commas in notes become semicolons."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.translate(c, ",", ";").alias(c) if c == "notes" else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def latex_table(df: DataFrame, caption: str, label: str) -> str:
    """A booktabs table of a small result."""
    rows = [" & ".join("" if v is None else str(v).replace("_", r"\_").replace("%", r"\%") for v in r) + r" \\" for r in df.collect()]
    head = " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\"
    return "\n".join([r"\begin{table}[ht]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", head, r"\midrule", *rows, r"\bottomrule", r"\end{tabular}", r"\end{table}"])
