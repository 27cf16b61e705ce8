"""The bounded history as a stream's state: the newest scans of each source, with eviction, and a timer for idle sources.

Each key keeps its newest `capacity` scans in a map state, so a batch reads and writes what it changes and nothing else.
A source that holds a third of all scans would make one task of its batch: keys are (source, slot), with `slots` slots that
scans are dealt to by their id; a slot keeps `capacity` scans of its own, and live() takes the newest of all slots.

The stream gives changes, a row when a scan comes into the history and a row when it leaves. A scan that comes and goes
within a batch gives none. live() of all changes is the history; it doesn't depend on how scans are cut into batches, nor on
the order in which they arrive. State lives in the RocksDB store and its checkpoint folder, which a restart goes on from.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.history import CAPACITY

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "source string, slot int, timestamp double, seq long, id string, safe boolean, live boolean"


class Newest(StatefulProcessor):
    """Keeps the newest scans of a key by (timestamp, seq, id); all of them leave after `idle` ms without a new one."""

    def __init__(self, capacity: int, idle: int | None) -> None:
        self.capacity, self.idle = capacity, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "timestamp double, seq long, id string", "safe boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = {tuple(k): v[0] for k, v in self.kept.iterator()}
        heap, safe = list(before), dict(before)
        heapq.heapify(heap)
        for r in rows:
            new = (r.timestamp, r.seq, r.id)
            if new in safe:
                continue
            safe[new] = r.safe
            heapq.heappush(heap, new)
            if len(heap) > self.capacity:
                del safe[heapq.heappop(heap)]
        if self.idle is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        for gone in sorted(before.keys() - safe.keys()):
            self.kept.removeKey(gone)
            yield self._change(key, gone, before[gone], False)
        for new in sorted(safe.keys() - before.keys()):
            self.kept.updateValue(new, (safe[new],))
            yield self._change(key, new, safe[new], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        gone = sorted((tuple(k), v[0]) for k, v in self.kept.iterator())
        self.kept.clear()
        for scan, safe in gone:
            yield self._change(key, scan, safe, False)

    def close(self) -> None:
        pass

    @staticmethod
    def _change(key, scan: tuple, safe: bool, live: bool) -> Row:
        return Row(source=key[0], slot=key[1], timestamp=scan[0], seq=scan[1], id=scan[2], safe=safe, live=live)


def changes(scans: DataFrame, capacity: int = CAPACITY, slots: int = 8, idle: int | None = None) -> DataFrame:
    """What comes into and leaves the history of a stream of scans (id, seq, timestamp, source, safe); null sources are one."""
    slot = F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int")
    rows = scans.select("source", slot.alias("slot"), F.col("timestamp").cast("double").alias("timestamp"), F.col("seq").cast("long").alias("seq"), "id", "safe")
    return rows.groupBy("source", "slot").transformWithState(Newest(capacity, idle), CHANGES, "Update", "None" if idle is None else "ProcessingTime")


def live(changed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The history after all changes: the newest `capacity` scans of each source that came in and didn't leave."""
    there = changed.groupBy("source", "timestamp", "seq", "id").agg(F.min("live").alias("live"), F.first("safe").alias("safe")).filter("live").drop("live")
    order = Window.partitionBy("source").orderBy(F.desc("timestamp"), F.desc("seq"), F.desc("id"))
    return there.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= capacity)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below a temporary one where that is unset and Spark runs in this process."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        import tempfile

        there = tempfile.mkdtemp(prefix="veilsift-")
    return f"{there.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run(stream: DataFrame, path: str, capacity: int = CAPACITY, slots: int = 8, idle: int | None = None) -> None:
    """Reads what a stream has now and appends its changes to path/changes; a later call with the same path goes on from there.

    A batch that runs again after a failure replaces what it had written.
    """
    conf = stream.sparkSession.conf
    before = conf.get("spark.sql.streaming.stateStore.providerClass", None)
    conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        # Timers keep asking for further batches, so with them a call is one batch.
        once = {"availableNow": True} if idle is None else {"once": True}
        query = changes(stream, capacity, slots, idle).writeStream.outputMode("update").foreachBatch(_append(f"{path}/changes")).option("checkpointLocation", f"{path}/checkpoint").trigger(**once).start()
        query.awaitTermination()
    finally:
        conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else conf.unset("spark.sql.streaming.stateStore.providerClass")


def _append(path: str):
    """Each batch replaces its own folder, so one that runs again leaves its rows once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read(spark: SparkSession, path: str) -> DataFrame:
    """The changes that run() has written."""
    return spark.read.schema(CHANGES).parquet(f"{path}/changes")
