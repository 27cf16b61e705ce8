"""Request lines to events, each request answered once.

A line is a JSON object with a request_id, the time when it was sent, and what the scan takes. A client that gets no answer
sends its request again, and a source may hand over a line twice; of all lines with one request_id the first is answered,
as long as the others come within the watermark's delay. State is a request_id and its expiry, and goes when the watermark
passes it. Broken lines, and lines without type, request_id or time, go; unknown types are answered by an error.

Each batch writes its events into a folder of its own and replaces what is there. So a batch that runs again, because
its executors or the driver were lost before it was recorded as done, leaves its events once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import scan
from .events import REQUEST, events, requests

FIELDS = REQUEST.replace("struct<", "struct<request_id: string, sent: timestamp, ")
EVENTS = "request_id string, seq int, event string, data string"


def asked(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """The requests of a stream of lines, each once."""
    known = requests(lines, fields=FIELDS).filter(F.col("request_id").isNotNull() & F.col("sent").isNotNull())
    return known.withWatermark("sent", late).dropDuplicatesWithinWatermark(["request_id"])


def judged(found: DataFrame) -> DataFrame:
    """Requests with the results of the scan of their content."""
    return scan(found.withColumn("raw", F.lit(None).cast("binary")))


def answer(lines: DataFrame, path: str, judge: Callable[[DataFrame], DataFrame] = judged, late: str = "1 hour") -> None:
    """Answers the lines that a stream has now, as events below path; a later call with the same path goes on from there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")

    told = events(judge(asked(lines, late)), "request_id")
    told.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def answers(spark: SparkSession, path: str) -> DataFrame:
    """The events that answer() has written."""
    return spark.read.schema(EVENTS).parquet(f"{path}/events")
