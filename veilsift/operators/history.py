"""Scan history: a table of verdicts (id, seq, timestamp, source, source_hint, safe, confidence, scan_time_ms, threats, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CAPACITY = 500
#: Rows of a range of an ordered table, about, and the most ranges; beyond that ranges become longer.
RANGE_ROWS, MAX_RANGES = 1_000_000, 10_000


def order() -> list[Column]:
    """Newest first: by time, seq and id; rows without a time last."""
    return [F.desc("timestamp"), F.desc("seq"), F.desc("id")]


def record(scans: DataFrame, source: str, hint: str) -> DataFrame:
    """Verdicts with an id, the time, their source (url, content or file) and the column that names it."""
    return scans.withColumns({"id": F.expr("uuid()"), "timestamp": F.unix_micros(F.current_timestamp()) / 1e6, "source": F.lit(source), "source_hint": F.col(hint).cast("string"), "scan_time_ms": F.lit(0)})


def newest(history: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The last rows by time and seq; a top-k, so only capacity rows of each task travel."""
    return history.orderBy(F.desc("timestamp"), F.desc("seq")).limit(capacity)


def evicted(index: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of an index whose scans are no longer kept."""
    return index.join(live.select("id"), "id", "left_anti")


def page(history: DataFrame, number: int = 1, size: int = 20, safe: bool | None = None) -> DataFrame:
    """Rows of one page, newest first, with total; safe keeps verdicts of one kind only.

    The rows up to the page's end come from a top-k, not from numbering all rows.
    """
    number, size = max(1, number), min(100, max(1, size))
    kept = history if safe is None else history.filter(F.col("safe") == safe)
    total = kept.agg(F.count("*").alias("total"))
    top = kept.orderBy(F.desc("timestamp"), F.desc("seq")).limit(number * size)
    ranked = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("timestamp"), F.desc("seq"))))
    return ranked.filter(F.col("position") > (number - 1) * size).crossJoin(F.broadcast(total))


def write_ordered(history: DataFrame, path: str, ranges: int | None = None) -> None:
    """history as a table at path, in ranges of about RANGE_ROWS rows by falling time, seq and id; rows without a time last."""
    n = ranges or min(MAX_RANGES, history.count() // RANGE_ROWS + 1)
    history.repartitionByRange(n, *order()).withColumn("range", F.spark_partition_id()).write.mode("overwrite").partitionBy("range").parquet(path)


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """(range, n, before) of an ordered table: the rows of each range, and of all ranges before it. At most MAX_RANGES rows."""
    counted = spark.read.parquet(path).groupBy("range").agg(F.count("*").alias("n"))
    return counted.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Every row of an ordered table with its position, from 1: its place in its range and the rows before that."""
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order()))
    placed = spark.read.parquet(path).withColumn("place", place).join(F.broadcast(ranges(spark, path)), "range")
    return placed.withColumn("position", F.col("before") + F.col("place")).drop("range", "n", "before", "place")


def page_at(spark: SparkSession, path: str, number: int = 1, size: int = 20) -> DataFrame:
    """Rows of one page of an ordered table with their positions; only the ranges that hold the page are read."""
    number, size = max(1, number), min(100, max(1, size))
    low, high = (number - 1) * size, number * size
    hold = ranges(spark, path).filter((F.col("before") < high) & (F.col("before") + F.col("n") > low)).orderBy("range").collect()
    before = hold[0]["before"] if hold else high
    rows = spark.read.parquet(path).filter(F.col("range").isin([r["range"] for r in hold]))
    top = rows.drop("range").orderBy(*order()).limit(high - before)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order())) + F.lit(before)).filter(F.col("position") > low)


def after(history: DataFrame, timestamp: float, seq: int, scan_id: str, size: int = 20) -> DataFrame:
    """The next rows behind the one with this key, by a filter that reaches the scan and a top-k, whatever the depth."""
    t, s = F.col("timestamp"), F.col("seq")
    behind = (t < timestamp) | ((t == timestamp) & ((s < seq) | s.isNull() | ((s == seq) & (F.col("id") < scan_id)))) | t.isNull()
    return history.filter(((t <= timestamp) | t.isNull()) & behind).orderBy(*order()).limit(min(100, max(1, size)))


def pages_needed(total: int, size: int = 20) -> int:
    return -(-total // size)


def get(history: DataFrame, scan_id: str) -> DataFrame:
    return history.filter(F.col("id") == scan_id)


def cleared(history: DataFrame) -> DataFrame:
    """An empty table of the same columns, to write over the old one."""
    return history.limit(0)


def summary(history: DataFrame) -> DataFrame:
    """total, safe_count, unsafe_count and the mean scan time, zeros for an empty history."""
    return history.agg(
        F.count("*").alias("total"),
        F.count_if("safe").alias("safe_count"),
        F.count_if(~F.col("safe")).alias("unsafe_count"),
        F.coalesce(F.round(F.avg("scan_time_ms"), 2), F.lit(0.0)).alias("avg_scan_time_ms"),
    )


def type_counts(history: DataFrame) -> DataFrame:
    """Threats of each type, most frequent first; ties by where the type was first seen."""
    seen = history.select("seq", F.posexplode("threats").alias("pos", "t")).select("seq", "pos", F.col("t.type").alias("type"))
    return seen.groupBy("type").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("first")).orderBy(F.desc("n"), "first").select("type", "n")


def severity_counts(history: DataFrame) -> DataFrame:
    return history.select(F.explode("threats").alias("t")).groupBy(F.col("t.severity").alias("severity")).agg(F.count("*").alias("n"))


def source_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("source").agg(F.count("*").alias("n"))


def top_types(history: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent types with their share of the most frequent one, for bars."""
    top = type_counts(history).limit(k)
    return top.withColumn("width", F.col("n") / F.max("n").over(Window.partitionBy()))
