"""The scan keeps the columns it is given, and its third tier sees suspected images only."""

import numpy as np
import pytest

from veilsift.operators import scan
from veilsift.sources import images


def test_columns_stay_and_results_step_aside(spark):
    rows = [("<p>hi</p>", "mine", "home", 5, "x"), ("plain", "yours", None, None, None)]
    docs = spark.createDataFrame(rows, "content string, text string, route string, safe int, `a.b` string")
    docs = docs.selectExpr("*", "cast(null as binary) raw", "cast(null as string) content_type", "cast(null as string) filename", "false deep")
    out = scan.scan(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    got = {r["text"]: r for r in out.collect()}
    assert (got["mine"]["route"], got["mine"]["safe"], got["mine"]["a.b"], got["mine"]["scan_route"], got["mine"]["scan_text"]) == ("home", 5, "x", "html", "<p>hi</p>")
    assert (got["yours"]["route"], got["yours"]["scan_route"], got["yours"]["scan_safe"]) == (None, "text", True)


def test_scan_without_other_columns_and_without_rows(spark):
    docs = spark.createDataFrame([], "content string, raw binary, content_type string, filename string, deep boolean")
    assert scan.scan(docs).collect() == [] and scan.scan(docs).columns == [*docs.columns, *scan.RESULTS]


@pytest.mark.parametrize("deep", [None, False, True])
def test_third_tier(spark, deep):
    clean = np.random.default_rng(11).integers(0, 256, (64, 64, 3), dtype=np.uint8) & 0xFE | 1
    rows = [(1, images.write_png(np.zeros((16, 16, 3), np.uint8)), "flat.png"), (2, images.write_png(clean), "noise.png"), (3, b"", "empty.png"), (4, None, None)]
    docs = spark.createDataFrame(rows, "id int, raw binary, filename string").selectExpr("*", "if(id = 4, 'text', null) content", "'image/png' content_type", f"cast({'null' if deep is None else str(deep).lower()} as boolean) deep")

    def model(xs):
        assert all(xs)
        return [0.9] * len(xs)

    plain = {r.id: r for r in scan.scan(docs).collect()}
    got = {r.id: r for r in scan.scan(docs, model).collect()}
    tiers = {i: [t.tier for t in r.threats] for i, r in got.items()}
    assert 3 in tiers[1] and "t3" in got[1].tier_timings and got[1].threat_count == plain[1].threat_count + 1
    assert (3 in tiers[2]) == ("t3" in got[2].tier_timings) == (deep is True or not plain[2].safe)
    assert tiers[3] == [] and "t3" not in got[3].tier_timings and tiers[4] == [] and "t3" not in got[4].tier_timings
