import pytest
from pyspark.sql import functions as F

from veilsift.dims import THREAT_TYPE, threat
from veilsift.operators import evaluation, gateway, history, render, scan
from veilsift.streaming import events


@pytest.fixture(scope="module")
def scans(spark):
    t = lambda k: threat(k, F.lit("d"), F.lit("t"), "flagged", F.lit("l"))
    i = F.col("id")
    threats = F.when(i % 3 == 0, F.array().cast(f"array<{THREAT_TYPE}>")).when(i % 3 == 1, F.array(t("homoglyph"))).otherwise(F.array(t("css_hidden_text"), t("homoglyph")))
    base = spark.range(30).select(i.cast("string").alias("id"), i.alias("seq"), (i * 1.0).alias("timestamp"), F.timestamp_seconds(i * 60).alias("ts"), F.when(i % 2 == 0, "url").otherwise("file").alias("source"), (i * 2).cast("int").alias("scan_time_ms"), threats.alias("threats"))
    return scan.verdict(base)


def test_history(scans):
    s = history.summary(scans).first()
    assert (s.total, s.safe_count, s.unsafe_count, s.avg_scan_time_ms) == (30, 10, 20, 29.0)
    assert [(r.type, r.n) for r in history.type_counts(scans).collect()] == [("homoglyph", 20), ("css_hidden_text", 10)]
    assert {r.severity: r.n for r in history.severity_counts(scans).collect()} == {"medium": 20, "critical": 10}
    assert {r.source: r.n for r in history.source_counts(scans).collect()} == {"url": 15, "file": 15}
    assert [r.id for r in history.page(scans, 2, 5, safe=True).orderBy("position").collect()] == ["12", "9", "6", "3", "0"]
    assert history.page(scans, 9, 20).count() == 0 and history.page(scans, 0, 1000).count() == 30
    kept = history.newest(scans, 4)
    assert sorted(r.id for r in kept.collect()) == ["26", "27", "28", "29"] and history.evicted(scans, kept).count() == 26
    assert history.get(scans, "7").count() == 1 and history.cleared(scans).count() == 0 and history.pages_needed(41) == 3
    empty = history.summary(history.cleared(scans)).first()
    assert (empty.total, empty.safe_count, empty.avg_scan_time_ms) == (0, 0, 0.0)
    assert history.top_types(scans).first().width == 1.0
    assert {"id", "source_hint"} <= set(history.record(scans.drop("id", "source"), "url", "seq").columns)


def test_evaluation(spark):
    rows = [("a", True, True)] * 5 + [("a", False, False)] * 3 + [("a", False, True)] + [("b", True, False)]
    got = {r.suite: r for r in evaluation.confusion(spark.createDataFrame(rows, "suite string, expected_safe boolean, predicted_safe boolean")).collect()}
    assert (got["a"].tp, got["a"].fp, got["a"].tn, got["a"].fn) == (3, 0, 5, 1) and got["a"].recall == 0.75 and got["a"].f1 == 0.8571
    assert got["aggregate"].fp == 1 and got["b"].precision == 0.0
    times = spark.createDataFrame([("tier1", "s", float(v)) for v in range(1, 101)] + [("zzz", "s", 7.0)], "detector string, suite string, latency_ms double")
    got = {r.detector: r for r in evaluation.latency(times).collect()}
    ranked = sorted(range(1, 101))
    assert got["tier1"].p95_ms == ranked[max(0, int(100 * 95 / 100) - 1)] == 95 and got["tier1"].median_ms == 50.5 and not got["tier1"]["pass"]
    assert got["zzz"].p99_ms == 7.0 and got["zzz"].budget_ms == 500.0 and got["zzz"]["pass"]
    manifest = spark.createDataFrame([("x", "c", False), ("gone", "c", True)], "file string, category string, expected_safe boolean")
    scanned = spark.createDataFrame([("x", True)], "file string, safe boolean").withColumn("threats", F.array(threat("homoglyph", F.lit(""), F.lit(""), "flagged", F.lit(""))))
    assert [(r.file, r.predicted_safe, r.threat_types, r.correct) for r in evaluation.evaluate(manifest, scanned, "css").collect()] == [("x", True, ["homoglyph"], False)]


def test_gateway_and_rendering(scans):
    r = scans.withColumns({"content_type": F.when(F.col("seq") % 5 == 0, "font/woff").otherwise("Text/html"), "sanitized_content": F.when(F.col("seq") % 2 == 0, "clean"), "body": F.lit("body")})
    got = {x.seq: x for x in gateway.decide(r).collect()}
    assert (got[2].action, got[2].status) == ("block", 403) and (got[4].action, got[4].served) == ("sanitize", "clean") and (got[3].action, got[5].action) == ("pass", "pass")
    assert not got[5].intercepted and got[1].alert and not {x.seq: x for x in gateway.decide(r, gateway.Policy(threshold="critical")).collect()}[1].alert
    open_gate = {x.seq: x for x in gateway.decide(r, gateway.Policy(block_critical=False, content_types=["font"])).collect()}
    assert open_gate[2].action == "pass" and open_gate[5].intercepted
    c = gateway.counters(gateway.decide(r)).first()
    assert c.scanned == 24 and c.blocked == sum(1 for i in range(30) if i % 3 == 2 and i % 5)
    text = scans.select("seq", render.report(F.col("safe"), F.col("confidence"), F.col("threats"), F.col("source")).alias("t"), render.envelope(F.col("safe"), F.lit("s"), F.struct("safe")).alias("e"), gateway.enforcement(F.col("safe"), F.lit(None)).alias("l"))
    got = {x.seq: x for x in text.collect()}
    assert got[0].t.splitlines() == ["Source: url", "Verdict: SAFE", "Confidence: 100%"] and len(got[2].t.splitlines()) == 6
    assert got[0].e == '{"content":[{"type":"text","text":"s"},{"type":"text","text":"{\\"safe\\":true}"}],"isError":false}' and got[1].l == "block/review"


def test_streams_match_batches(spark, scans, tmp_path):
    scans.filter("seq < 15").write.parquet(str(tmp_path / "in"))
    scans.filter("seq >= 15").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    events.events(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r) for r in events.events(scans).collect()) and len(got) == 30 * 3 + 30
    keep = events.keep_newest(str(tmp_path / "hist"), 7)
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "hist").iterdir())
    assert last > 1 and sorted(r.seq for r in spark.read.parquet(str(tmp_path / "hist" / f"version={last}")).collect()) == list(range(23, 30))
    windows = events.threat_windows(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    windows.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, events.threat_windows(scans).collect()))
    gate = gateway.decide(stream.withColumns({"content_type": F.lit("text/html"), "sanitized_content": F.lit(None).cast("string"), "body": F.lit("")}))
    q = events.gateway_counters(gate).writeStream.outputMode("complete").format("memory").queryName("g").trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("g").first()) == (30, 20, 10)


def test_request_lines(spark):
    lines = spark.createDataFrame([('{"type":"scan_url","url":"u"}',), ("{broken",), ('{"type":"zzz"}',), ('{"url":"x"}',)], "value string").coalesce(1)
    assert [(r.type, r.error) for r in events.requests(lines).collect()] == [("scan_url", None), ("zzz", "unknown message type: zzz")]
