import numpy as np
import pytest

from veilsift.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<double>, label int, row int, slab int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 3, 3) for r in rows], SCHEMA)


def brute(rows, k=5):
    good = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows if v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    late = lambda i: (i is None, i)
    out = []
    for n, (a, v, y) in enumerate(good):
        if a is None or a % 100:
            continue
        scored = sorted(((-score(v, w), late(i), z) for m, (i, w, z) in enumerate(good) if m != n), key=lambda r: r[:2])
        for p in [r for r in scored if r[2] == y][:k]:
            fits = [r for r in scored if r[2] != y and 80 * -p[0] <= 100 * -r[0] <= 100 * -p[0]][:k]
            out += [(a, p[1][1], rank + 1, r[1][1], -p[0], -r[0]) for rank, r in enumerate(fits)]
    return sorted(out, key=str)


def mined(df):
    return sorted((tuple(r) for r in h.mine(df, df["vec_id"] % 100 == 0).collect()), key=str)


def test_lengths_of_all_kinds_over_rounds(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 8)) * r.lognormal(0, 1.5, (1500, 1))
    rows = [(i, v.round(2).tolist(), int(y)) for (i, v), y in zip(enumerate(x), r.integers(0, 4, 1500))]
    monkeypatch.setattr(h, "SLAB_BYTES", 5_000)
    monkeypatch.setattr(h, "BLOCK_BYTES", 600)
    monkeypatch.setattr(h, "ROUND", 3)
    got = mined(table(spark, rows))
    assert got == brute(rows) and got


def test_buckets_that_cannot_reach_a_window_are_left_out(monkeypatch):
    seen = []
    monkeypatch.setattr(h, "BUCKET", 10)
    monkeypatch.setattr(h, "products", lambda a, b, most, real=h.products: seen.append(len(b)) or real(a, b, most))
    import pyarrow as pa

    norms = np.repeat([100.0, 10.0, 1.0], 10)
    rows = pa.table({"row": np.arange(30), "id": np.arange(30), "label": np.zeros(30, int), "norm": norms, "size": np.ones(30, int), "vec": pa.array([np.float64(x).tobytes() for x in norms], pa.binary())})
    one = pa.table({"row": [99], "label": [1], "norm": [10.0], "size": [1], "vec": pa.array([np.float64(10).tobytes()], pa.binary()), "windows": [[{"w": 7, "low": 50, "high": 10_000, "kth": None}]]})
    out = h._cell(False, 12)(one, rows).to_pylist()
    assert [o["score"] for o in out] == [1000] * 10 + [100] * 2 and len(seen) == 2
    assert len(h._cell(False, 5)(one, rows)) == 5 and len(seen) == 3  # the k-th score ends it after one bucket


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 2), (None, [1.0, 0.9], 2), (4, [1.0], 2), (5, [], 2), (6, None, 2), (7, [inf, 1.0], 1), (8, [nan, 1.0], 2), (9, [1.0, None], 1), (10, [1.0, 1.0], None), (100, [0.0, 0.0], 3), (200, [-1.0, 0.0], 4), (201, [1.0, 0.0], 4), (300, [2.0, 0.0, 5.0], 5)]
    got = mined(table(spark, rows))
    assert got == brute(rows)
    assert {g[0] for g in got} == {0}


@pytest.mark.parametrize("same", [True, False])
def test_one_vector_many_times(spark, same):
    rows = [(i, [0.5, 0.25, 0.0], 1 if same or i % 3 else 2) for i in range(3000)]
    assert mined(table(spark, rows)) == ([] if same else brute(rows))


def test_products_beyond_doubles(spark):
    rows = [(i, [3e6 + i, 1.0 * i], i % 2) for i in range(101)]
    got = mined(table(spark, rows))
    assert got == brute(rows) and got
    with pytest.raises(OverflowError):
        h.products(np.full((1, 1), 2.0**40), np.full((1, 1), 2.0**40), 2.0**80)


def test_empty(spark):
    assert mined(table(spark, [])) == [] and mined(table(spark, [(1, [1.0], 1)])) == [] and mined(table(spark, [(0, [1.0], 1)])) == []
