"""Structured Streaming: scan events, running statistics, bounded history, request lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import CAPACITY, newest

REQUEST = "struct<type: string, url: string, content: string, content_type: string, filename: string, deep: boolean>"
KNOWN = ["scan_url", "scan_content"]


def requests(lines: DataFrame, value: str = "value", fields: str = REQUEST) -> DataFrame:
    """Requests from JSON lines; broken lines go, unknown types become error rows."""
    parsed = lines.select("*", F.from_json(value, fields, {"mode": "PERMISSIVE"}).alias("r")).filter(F.col("r.type").isNotNull())
    return parsed.select(*[c for c in lines.columns if c != value], "r.*", F.when(~F.col("r.type").isin(KNOWN), F.concat(F.lit("unknown message type: "), F.col("r.type"))).alias("error"))


def events(scans: DataFrame, key: str = "id") -> DataFrame:
    """The messages of each scan, in order: start, progress, a tier each, a threat each, complete; or one error."""
    event = lambda kind, data: F.struct(F.lit(kind).alias("event"), data.cast("string").alias("data"))
    many = lambda items, kind, data: F.transform(items, lambda x: event(kind, data(x)))
    error = F.col("error") if "error" in scans.columns else F.lit(None).cast("string")
    tiers = many(F.array_sort(F.map_keys("tier_timings")), "tier", lambda k: k) if "tier_timings" in scans.columns else F.array().cast("array<struct<event:string,data:string>>")
    good = F.concat(F.array(event("start", F.col(key)), event("progress", F.lit("scanning"))), tiers, many(F.col("threats"), "threat", lambda t: F.to_json(t)), F.array(event("complete", F.to_json(F.struct("safe", "confidence", F.size("threats").alias("threat_count"))))))
    return scans.select(key, F.posexplode(F.when(error.isNotNull(), F.array(event("error", error))).otherwise(good)).alias("seq", "e")).select(key, "seq", "e.event", "e.data")


def running_stats(scans: DataFrame) -> DataFrame:
    """Verdicts by source so far; for update or complete mode."""
    return scans.groupBy("source").agg(F.count("*").alias("total"), F.count_if("safe").alias("safe_count"), F.count_if(~F.col("safe")).alias("unsafe_count"))


def threat_windows(scans: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Threats of each type in tumbling windows of event time, late rows up to the watermark. An addition; the model has no event time."""
    seen = scans.withWatermark(time, late).select(time, F.explode("threats").alias("t"))
    return seen.groupBy(F.window(time, width), F.col("t.type").alias("type")).agg(F.count("*").alias("n"))


def keep_newest(path: str, capacity: int = CAPACITY):
    """A foreachBatch function that keeps the last capacity rows of all batches, as a new version beside the old one.

    Each batch writes version batch id + 1 from the version before it, so a batch that runs again writes the
    same version again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = batch
        if batch_id > 0:
            kept = spark.read.schema(batch.schema).parquet(f"{path}/version={batch_id}").unionByName(batch)
        newest(kept, capacity).write.mode("overwrite").parquet(f"{path}/version={batch_id + 1}")

    return run


def gateway_counters(decided: DataFrame) -> DataFrame:
    """Inspected, alerted and blocked responses so far."""
    hit = lambda c: F.sum(c.cast("long"))
    return decided.groupBy().agg(hit(F.col("intercepted")).alias("scanned"), hit(F.col("alert")).alias("threats"), hit(F.col("action") == "block").alias("blocked"))
