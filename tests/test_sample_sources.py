"""The data sources of labelled samples and reports."""

import json

import pytest
from pyspark.sql import functions as F

from veilsift.sources import files, samples

SCHEMA = "file string, expected_safe boolean, category string, n int, raw binary"


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "samples"
    folder.mkdir()
    entries = [{"file": f"s{i}.bin", "expected_safe": i % 2 == 0, "category": "a" * (i % 5), "n": i} for i in range(60)]
    for e in entries[:50]:
        (folder / e["file"]).write_bytes(e["file"].encode() * e["n"])
    return tmp_path, entries


def read(spark, manifest, folder, **options):
    return spark.read.format("labelled_samples").schema(SCHEMA).options(samples=str(folder), **options).load(str(manifest))


def test_manifest_equals_the_join(spark, corpus):
    path, entries = corpus
    samples.register(spark)
    (path / "lines.json").write_text("\n".join(map(json.dumps, entries[:30])) + "\n\n" + "\n".join(map(json.dumps, entries[30:])))
    (path / "array.json").write_text(json.dumps(entries))
    want = sorted(map(tuple, files.read_manifest(spark, str(path / "array.json"), str(path / "samples")).select("file", "expected_safe", "category", "n", "raw").collect()))
    want = sorted([*want, ("s0.bin", True, "", 0, b"")])  # the binaryFile source of the join leaves empty files out
    assert len(want) == 50
    for split in ("113", "370", "100000"):
        lines = read(spark, path / "lines.json", path / "samples", splitBytes=split)
        assert sorted(map(tuple, lines.collect())) == want
    array = read(spark, path / "array.json", path / "samples")
    assert sorted(map(tuple, array.collect())) == want and array.rdd.getNumPartitions() == 1


def test_odd_manifests(spark, corpus):
    path, entries = corpus
    samples.register(spark)
    (path / "empty.json").write_text("")
    assert read(spark, path / "empty.json", path / "samples").count() == 0
    (path / "twice.json").write_text('{"file": "s1.bin", "more": [1]}\n' * 2)
    assert [tuple(r) for r in read(spark, path / "twice.json", path / "samples").collect()] == [("s1.bin", None, None, None, b"s1.bin")] * 2
    (path / "broken.json").write_text('{"file": "s1.bin"}\n{"file')
    with pytest.raises(Exception, match="JSON"):
        read(spark, path / "broken.json", path / "samples").collect()


def test_reports(spark, tmp_path):
    samples.register(spark)
    rows = spark.range(20, numPartitions=3).select("id", (F.col("id") / 7).alias("x"), (F.col("id") % 2 == 0).alias("ok"), F.when(F.col("id") != 3, F.concat(F.lit('a,"_%'), F.col("id").cast("string"))).alias("note"))
    want = sorted(map(tuple, rows.collect()))
    for layout in ("csv", "json"):
        rows.write.format("report").option("layout", layout).mode("overwrite").save(str(tmp_path / layout))
        back = spark.read.schema("id bigint, x double, ok boolean, note string").option("header", True).option("escape", '"').format(layout).load(str(tmp_path / layout))
        assert sorted(map(tuple, back.collect())) == want
    folder = tmp_path / "json"
    before = {f.name for f in folder.iterdir()}
    rows.write.format("report").option("layout", "json").mode("append").save(str(folder))
    assert len(list(folder.iterdir())) == 2 * len(before)
    rows.limit(1).write.format("report").option("layout", "latex").mode("overwrite").save(str(folder))
    table = next(folder.glob("table-*.tex")).read_text()
    parts = [p for p in folder.glob("part-*.tex") if p.read_text()]
    assert [p.read_text() for p in parts] == ['0 & 0.0000 & \\checkmark & a,"\\_\\%0 \\\\\n'] and parts[0].name in table and not before & {f.name for f in folder.iterdir()}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    samples.register(spark)
    folder = tmp_path / "r"
    spark.range(3).write.format("report").mode("overwrite").save(str(folder))
    before = {f.name: f.read_text() for f in folder.iterdir()}
    fails = spark.range(40, numPartitions=4).select(F.when(F.col("id") == 37, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception):
        fails.write.format("report").mode("overwrite").save(str(folder))
    assert {f.name: f.read_text() for f in folder.iterdir()} == before
