"""Image triage: type against name, metadata, and pixel statistics; and stubs of the deep tier."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import THREAT_TYPE, no_threats, threat
from ..functions.text import let
from ..patterns import instructs
from ..sources.files import mime_of_name, sniff

ENTROPY_LEAST, FIELD_BYTES = 6.5, 4
COMBINED_LEAST, CHI_LEAST, ODD_LEAST, QUARANTINE = 0.55, 0.60, 0.35, 0.75

_FACTS = T.StructType(
    [
        T.StructField("fields", T.ArrayType(T.StructType([T.StructField("field", T.StringType()), T.StructField("value", T.BinaryType()), T.StructField("entropy", T.DoubleType())]))),
        T.StructField("pixels", T.StructType([T.StructField(n, T.DoubleType()) for n in ("chi_square", "rs", "spa", "entropy_r", "entropy_g", "entropy_b")])),
        T.StructField("ms", T.DoubleType()),
    ]
)
_ARROW = pa.struct([("fields", pa.list_(pa.struct([("field", pa.string()), ("value", pa.binary()), ("entropy", pa.float64())]))), ("pixels", pa.struct([(n, pa.float64()) for n in ("chi_square", "rs", "spa", "entropy_r", "entropy_g", "entropy_b")])), ("ms", pa.float64())])


def facts(df: DataFrame, image: str, out: str, decoded: str | None = None) -> DataFrame:
    """df with the column out: metadata fields of more than four bytes with their entropy, statistics of the pixels, and the
    milliseconds that took.

    Pixels come from the column decoded, a struct of Spark's image source, where there is one, else from an 8-bit PNG.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, _FACTS)])
    at, where = df.columns.index(image), df.columns.index(decoded) if decoded else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from time import perf_counter

        import numpy as np

        from ..functions.image import chi_square_of, entropy_of, regular_singular_of, sample_pairs_of
        from ..sources.images import metadata, png_pixels, source_pixels

        def of(data: bytes | None, seen: dict | None) -> dict | None:
            if data is None or len(data) < 16:
                return None
            start = perf_counter()
            fields = [{"field": f, "value": v, "entropy": entropy_of(np.frombuffer(v, np.uint8))} for f, v in metadata(data) if len(v) > FIELD_BYTES]
            px, stats = png_pixels(data) if seen is None else source_pixels(seen), None
            if px is not None and px.size:
                rgb = px[:, :, :3] if px.shape[2] >= 3 else np.repeat(px[:, :, :1], 3, 2)
                red = rgb[:, :, 0]
                stats = {"chi_square": chi_square_of(red), "rs": regular_singular_of(red), "spa": sample_pairs_of(red), **{f"entropy_{c}": entropy_of(rgb[:, :, i]) for i, c in enumerate("rgb")}}
            return {"fields": fields, "pixels": stats, "ms": 1000 * (perf_counter() - start)}

        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                seen = part.column(where).to_pylist() if decoded else [None] * part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([of(*x) for x in zip(part.column(at).to_pylist(), seen, strict=True)], _ARROW)], names=schema.names)

    return df.mapInArrow(run, schema)


def combined(chi: Column, rs: Column, spa: Column) -> Column:
    return 0.4 * chi + 0.4 * rs + 0.2 * spa


def judge(facts: Column, image: Column, filename: Column) -> Column:
    """threats, is_suspicious, scores, recommended_action, detected_mime and claimed_mime of one image."""
    detected, claimed = sniff(image), mime_of_name(filename)
    mismatch = F.coalesce(detected != claimed, F.lit(False))
    text = lambda f: F.make_valid_utf8(f["value"].cast("string"))
    flagged = F.filter(facts["fields"], lambda f: (f["entropy"] >= ENTROPY_LEAST) | instructs(text(f), "image"))
    ranked = F.array_sort(F.coalesce(flagged, F.array().cast(_FACTS["fields"].dataType)), lambda a, b: F.when(a["entropy"] > b["entropy"], -1).when(a["entropy"] < b["entropy"], 1).otherwise(0))
    p = facts["pixels"]
    chi, rs, spa = p["chi_square"], p["rs"], p["spa"]
    score, most = combined(chi, rs, spa), F.greatest(chi, rs, spa)
    hidden = F.coalesce((score >= COMBINED_LEAST) | (chi >= CHI_LEAST), F.lit(False))
    odd = ~hidden & F.coalesce(most >= ODD_LEAST, F.lit(False))
    told = F.format_string("chi-square %.2f, regular-singular %.2f, sample pairs %.2f, combined %.2f", chi, rs, spa, score)

    def of(r: Column) -> Column:
        instruction = F.exists(r, lambda f: instructs(text(f), "image"))
        top = F.try_element_at(r, F.lit(1))
        names = F.array_join(F.transform(F.slice(r, 1, 3), lambda f: F.concat(f["field"], F.lit(" (entropy "), F.format_string("%.2f", f["entropy"]), F.lit(")"))), ", ")
        meta = lambda kind: threat(kind, F.concat(F.size(r).cast("string"), F.lit(" suspicious metadata field(s): "), names), F.lit("Image metadata"), "stripped", top["field"])
        threats = F.array_compact(F.array(
            F.when(mismatch, threat("magic_byte_mismatch", F.concat(F.lit("Named as "), claimed, F.lit(", content is "), detected), F.lit("File type mismatch"), "quarantined", F.lit("file header"))),
            F.when(F.size(r) > 0, F.when(instruction, meta("exif_payload")).otherwise(meta("high_entropy_metadata"))),
            F.when(hidden, threat("lsb_steganography", told, F.lit("LSB statistics of the red channel"), "quarantined", F.lit("pixel data"))).when(odd, threat("high_entropy_pixels", told, F.lit("LSB statistics of the red channel, borderline"), "flagged", F.lit("pixel data"))),
        )).cast(f"array<{THREAT_TYPE}>")
        named = [("chi_square", chi), ("rs_analysis", rs), ("spa", spa), ("combined", score), ("entropy_r", p["entropy_r"]), ("entropy_g", p["entropy_g"]), ("entropy_b", p["entropy_b"]), ("max_metadata_entropy", top["entropy"]), ("borderline", F.when(odd, F.lit(1.0)))]
        scores = F.map_filter(F.create_map(*[x for k, v in named for x in (F.lit(k), v.cast("double"))]), lambda k, v: v.isNotNull())
        suspicious = mismatch | (F.size(r) > 0) | hidden | odd
        action = F.when(~suspicious, F.when(chi.isNull(), "not_analysed").otherwise("clean")).when(mismatch | F.coalesce(most > QUARANTINE, F.lit(False)), "quarantine").otherwise("deep_scan")
        return F.struct(threats.alias("threats"), suspicious.alias("is_suspicious"), scores.alias("scores"), action.alias("recommended_action"), detected.alias("detected_mime"), claimed.alias("claimed_mime"))

    nothing = F.struct(no_threats().alias("threats"), F.lit(False).alias("is_suspicious"), F.create_map().cast("map<string,double>").alias("scores"), F.lit("clean").alias("recommended_action"), F.lit(None).cast("string").alias("detected_mime"), F.lit(None).cast("string").alias("claimed_mime"))
    return F.when(F.octet_length(image) >= 16, let(ranked, of)).otherwise(nothing)


def triage(df: DataFrame, image: str = "raw", filename: str = "filename", out: str = "triage", decoded: str | None = None, took: str | None = None) -> DataFrame:
    """df with the column out, null where there is no image, and the column took, if named: the milliseconds that reading the
    image took. An image without findings whose pixels nothing decoded is not_analysed."""
    known = facts(df, image, "_facts", decoded)
    known = known.withColumn(took, F.col("_facts.ms")) if took else known
    return known.withColumn(out, F.when(F.col(image).isNotNull(), judge(F.col("_facts"), F.col(image), F.col(filename)))).drop("_facts")


def with_pixels(spark: SparkSession, files: DataFrame, path: str, out: str = "decoded") -> DataFrame:
    """files, with a column path as the binaryFile source gives it, with the column out: what Spark's image source decodes of
    the files below path, null for others."""
    place = lambda c: F.regexp_replace(F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^([a-z]+):/+", "$1:/"), "/+$", "")
    seen = spark.read.format("image").option("dropInvalid", True).load(path).select(place(F.col("image.origin")).alias("_origin"), F.struct("image.height", "image.width", "image.nChannels", "image.data").alias(out))
    return files.join(seen, place(F.col("path")) == F.col("_origin"), "left").drop("_origin")


def triage_files(spark: SparkSession, path: str, out: str = "triage") -> DataFrame:
    """(path, filename, out) of the image files below path: bytes from the binaryFile source, pixels from the image source, joined on path."""
    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("content").alias("raw"))
    return triage(with_pixels(spark, files, path), out=out, decoded="decoded").select("path", "filename", out)


def channels(spark: SparkSession, path: str) -> DataFrame:
    """(origin, y, x, r, g, b) of the images below a path that Spark's image source decodes; for small images, a row a pixel."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    place = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i")
    byte = lambda k: F.conv(F.hex(F.substring("data", F.col("i") * F.col("nChannels") + 1 + k, F.lit(1))), 16, 10).cast("int")
    return rows.select("origin", "width", "nChannels", "data", place).select("origin", F.floor(F.col("i") / F.col("width")).alias("y"), (F.col("i") % F.col("width")).alias("x"), *[F.when(F.col("nChannels") >= 3, byte(k)).otherwise(byte(0)).alias(c) for c, k in (("r", 2), ("g", 1), ("b", 0))])


def deep_verdict(df: DataFrame, image: str = "raw", out: str = "deep_result", model=None) -> DataFrame:
    """verdict, confidence, method, detail, and ms, an image's share of its batch's time. Without a model, a function of a list of bytes giving probabilities, all is
    inconclusive; with one, it sees the images that are not null, and the others get null."""
    schema = T.StructType([T.StructField("verdict", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("method", T.StringType()), T.StructField("detail", T.StringType()), T.StructField("ms", T.DoubleType())])
    if model is None:
        return df.withColumn(out, F.struct(F.lit("inconclusive").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit("unavailable").alias("method"), F.lit("no deep model").alias("detail"), F.lit(None).cast("double").alias("ms")))

    @F.pandas_udf(schema)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from time import perf_counter

        for images in batches:
            there, start = images.dropna(), perf_counter()
            p = pd.Series(model([bytes(x) for x in there]) if len(there) else [], index=there.index, dtype=float)
            stego = p > 0.5
            told = pd.DataFrame({"verdict": stego.map({True: "stego", False: "clean"}).astype(object), "confidence": p.where(stego, 1 - p), "method": "model", "detail": "probability " + p.round(4).astype(str), "ms": 1000 * (perf_counter() - start) / max(1, len(there))})
            whole = told.reindex(images.index)
            yield whole.astype({c: object for c in ("verdict", "method", "detail")}).where(whole.notna(), None)

    return df.withColumn(out, F.when(F.col(image).isNotNull(), judged(image)))


def tool_verdict(output: Column) -> Column:
    """The verdict that a detector's printed text stands for: the words for hidden data are looked for first, so "not stego" counts as found."""
    low = F.lower(output)
    found, clean = low.rlike("stego|hidden|detected"), low.rlike("clean|no hidden|not detected")
    return F.struct(F.when(found, "stego").when(clean, "clean").otherwise("inconclusive").alias("verdict"), F.when(found, 0.85).when(clean, 0.8).otherwise(0.0).alias("confidence"))


def deep_threats(result: Column) -> Column:
    """The third tier's threat where the verdict is stego."""
    found = threat("lsb_steganography", result["detail"], F.concat(F.lit("Deep analysis: "), result["method"]), "quarantined", F.lit("pixel data"), tier=3, label="Deep Steganography Detection")
    return F.when(result["verdict"] == "stego", F.array(found)).otherwise(no_threats())


def strip_metadata(df: DataFrame, image: str = "raw", out: str = "stripped") -> DataFrame:
    """df with the image without its metadata; bytes that are no PNG or JPEG stay."""
    @F.pandas_udf("binary")
    def clean(s: pd.Series) -> pd.Series:
        from ..sources.images import strip_metadata as strip

        return s.map(lambda x: None if x is None else strip(bytes(x)))

    return df.withColumn(out, clean(image))
