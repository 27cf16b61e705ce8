import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veilsift.operators import evaluation, history


def plain(values):
    s = sorted(values, key=lambda v: (math.isnan(v), v))
    at = lambda p: s[max(1, len(s) * p // 100) - 1]
    return at(50), at(95), at(99), (s[math.ceil(len(s) / 2) - 1] + s[len(s) // 2]) / 2


@pytest.mark.parametrize("groups", [20_000, 1])
def test_ranks_against_sorting(spark, monkeypatch, groups):
    """Both ways in which cells meet rows; signs, zeros, ties, far exponents, NaN, null values, null and single groups."""
    monkeypatch.setattr(evaluation, "MAX_GROUPS", groups)
    r = random.Random(7)
    rows = [("hot", r.choice([-1, 1]) * r.random() * 10.0 ** r.randrange(-300, 300)) for _ in range(700)]
    rows += [("ties", float(r.randrange(-3, 3))) for _ in range(200)] + [("near", 1 + k * 2.0**-52) for k in range(99)]
    rows += [("zeros", -0.0), ("zeros", 0.0), ("one", 4.5), (None, 1.0), (None, 2.0), (None, 4.0), ("edge", math.inf), ("edge", -math.inf), ("edge", math.nan), ("edge", 5e-324)]
    df = spark.createDataFrame([*rows, ("hot", None), ("nothing", None)], "g string, v double")
    got = {x.g: x for x in evaluation.nearest_rank(df, ["g"], "v", {"p50": 50, "p95": 95, "p99": 99}).collect()}
    assert set(got) == {g for g, _ in rows}
    for g, x in got.items():
        for mine, true in zip((x.p50, x.p95, x.p99, x.median_ms), plain([v for h, v in rows if h == g]), strict=True):
            assert mine == true or (math.isnan(mine) and math.isnan(true))


def test_ranks_of_nothing(spark):
    assert evaluation.nearest_rank(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"p95_ms": 95}).count() == 0


def test_no_window_over_values(spark):
    """Windows of the plan are over digits only."""
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.rand(1).alias("v"))
    plan = evaluation.nearest_rank(df, ["g"], "v", {"p95_ms": 95})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) >= 4 and all("_n#" in w and ("_at#" in w or "_all#" in w) for w in windows)


def test_pages_of_an_ordered_table(spark, tmp_path):
    rows = [(str(i), i % 40, float(i % 7) if i % 11 else None, i % 2 == 0) for i in range(300)]
    scans = spark.createDataFrame(rows, "id string, seq long, timestamp double, safe boolean")
    path = str(tmp_path / "ordered")
    history.write_ordered(scans, path, ranges=9)
    down = lambda v: (v is None, -(v or 0))
    order = [x[0] for x in sorted(sorted(rows, key=lambda x: x[0], reverse=True), key=lambda x: (down(x[2]), -x[1]))]
    assert [x.id for x in history.numbered(spark, path).orderBy("position").collect()] == order
    for number, size in ((1, 20), (4, 33), (15, 20), (16, 20), (10_000, 100)):
        page = history.page_at(spark, path, number, size).orderBy("position").collect()
        assert [x.id for x in page] == order[(number - 1) * size : number * size]
        assert [x.position for x in page] == list(range((number - 1) * size + 1, (number - 1) * size + 1 + len(page)))
    plan = history.page_at(spark, path, 8, 20)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[\(?range#\d+ (IN \(\d+,\d+\)|= \d+)", plan) or re.search(r"PartitionFilters: \[isnotnull\(range#\d+\), \(range#\d+ = \d+", plan)
    by_id = {x[0]: x for x in rows}
    for k in (0, 19, 150, 265):
        last = by_id[order[k]]
        if last[2] is not None:
            assert [x.id for x in history.after(scans, last[2], last[1], last[0], 25).collect()] == order[k + 1 : k + 26]


def test_pages_of_an_empty_table(spark, tmp_path):
    scans = spark.createDataFrame([], "id string, seq long, timestamp double")
    assert history.after(scans, 1.0, 1, "a").count() == 0
