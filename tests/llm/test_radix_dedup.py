import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from veilsift.llm import radix_dedup as d
from veilsift.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, key int, r1 int, start string"


def brute(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + window] for _, t in texts for k in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k] += 1
                gone[k + window if k + window <= len(t) else len(t)] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=str)


def removed(spark, rows, window, gram):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    out = d.remove_repeats(df, window=window, gram=gram).collect()
    assert all(sum(s["to"] - s["from"] for s in o.removed) == o.n_removed for o in out)
    return sorted(((o.doc_id, o.n_bytes, o.n_removed, len(o.removed), bytes(o.kept)) for o in out), key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    new = lambda k: "".join(r.choice("abcé 𝄞") for _ in range(k))
    shared = [new(k) for k in (19, 20, 21, 40, 90)]
    rows = [(i, new(r.randint(0, 60)) + r.choice(shared) + new(r.randint(0, 60)) + r.choice(shared)[: r.randint(1, 60)]) for i in range(n)]
    return [*rows, (1, rows[1][1]), (1, rows[1][1]), (500, rows[2][1]), (501, None), (502, ""), (None, shared[4]), (503, "a" * 150), (504, "xyz" * 70), (505, "q" + "0123456789" * 6)]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = corpus(seed)
    assert removed(spark, rows, 20, 7) == brute(rows, 20)


def test_hot_anchors_by_further_digits_and_single_windows(spark, monkeypatch):
    monkeypatch.setattr(d, "HOT", 2)
    monkeypatch.setattr(d, "SORT_BYTES", 300)
    monkeypatch.setattr(d, "LONGEST", 5)
    rows = corpus(3)
    assert removed(spark, rows, 20, 7) == brute(rows, 20)


def test_windows_over_the_edges_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 64)
    rows = corpus(4)
    assert removed(spark, rows, 20, 7) == brute(rows, 20)


def test_a_very_long_text(spark):
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(1_500_000))
    rows = [(1, long), (2, "z" * 500 + long[700_000:700_600] + "y"), (3, "-" * 450)]
    got = removed(spark, rows, 400, 64)
    assert [g[2] for g in got] == [600, 500 + 600, 450] and [g[3] for g in got] == [1, 1, 1]


def test_shard_sorts_down_to_the_window():
    text = b"abcdefghijklmnop-abcdefghijklmnoq-zzzzzzzzzzzzzzzzzzz"
    for window in (3, 8, 9, 15, 16):
        run, first, last = d.repeated_in_shard(np.array([5, 5]), np.frombuffer(text + text[:20], np.uint8), np.array([0, len(text), len(text) + 20]), window)
        got = {(int(r), int(k)) for r, a, b in zip(run, first, last) for k in range(a, b)}
        parts = [text, text[:20]]
        seen = Counter(p[k : k + window] for p in parts for k in range(len(p) - window + 1))
        assert got == {(r, k) for r, p in enumerate(parts) for k in range(len(p) - window + 1) if seen[p[k : k + window]] > 1}


def test_empty(spark):
    assert removed(spark, [], 20, 7) == []


def test_op11(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    want = [(i, n, g, s, hashlib.sha256(k).hexdigest()) for i, n, g, s, k in brute(rows, 400)]
    got = [(o.doc_id, o.n_bytes, o.n_removed, o.n_spans, o.kept_sha256) for o in QUERIES["op11_radix_dedup"](spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(g[2] for g in got)
