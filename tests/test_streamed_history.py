from pyspark.sql import functions as F

from veilsift.streaming import history as h

SCHEMA = "id string, seq long, timestamp double, source string, safe boolean"


def newest(rows, capacity):
    out = {}
    for r in rows:
        out.setdefault(r[3], set()).add((r[2], r[1], r[0]))
    return {s: sorted(v, reverse=True)[:capacity] for s, v in out.items()}


def test_restart_late_rows_repeats_and_a_hot_source(spark, tmp_path):
    rows = [(f"s{i}", i, float((i * 37) % 101), None if i % 11 == 0 else "hot" if i % 3 else "cold", i % 2 == 0) for i in range(240)]
    rows += rows[:20]
    path = str(tmp_path / "run")
    for part in range(2):
        spark.createDataFrame(rows[part::2], SCHEMA).coalesce(2).write.mode("append").parquet(f"{path}/scans")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/scans")
        h.run(stream, path, capacity=7, slots=3)
        so_far = {r for k in range(part + 1) for r in rows[k::2]}
        got = {}
        for r in h.live(h.read(spark, path), 7).orderBy("position").collect():
            got.setdefault(r.source, []).append((r.timestamp, r.seq, r.id))
        assert got == newest(so_far, 7)
    changed = h.read(spark, path)
    assert changed.filter("NOT live").count() > 0 and changed.groupBy("id", "live").count().filter("count > 1").count() == 0
    per_slot = changed.groupBy("source", "slot").agg((F.count_if("live") - F.count_if(~F.col("live"))).alias("n"))
    assert per_slot.agg(F.max("n")).first()[0] == 7


def test_idle_sources_leave(spark, tmp_path):
    path = str(tmp_path / "run")
    spark.createDataFrame([("a", 1, 1.0, "x", True)], SCHEMA).write.parquet(f"{path}/scans")
    h.run(spark.readStream.schema(SCHEMA).parquet(f"{path}/scans"), path, idle=1)
    assert [r.id for r in h.live(h.read(spark, path)).collect()] == ["a"]
    spark.createDataFrame([("b", 2, 2.0, "y", True)], SCHEMA).write.mode("append").parquet(f"{path}/scans")
    h.run(spark.readStream.schema(SCHEMA).parquet(f"{path}/scans"), path, idle=1)
    assert [r.id for r in h.live(h.read(spark, path)).collect()] == ["b"]
