import random

import numpy as np
import pytest

from tests.llm.test_parity_join import LOW, WORD, corpus
from veilsift.llm import parity_join as p


def brute_links(rows, n, num, den):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append((i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    near = lambda a, b: bool(a & b) and den * len(a & b) >= num * len(a | b)
    return {i: sum(near(a, b) for j, b in sets if j != i) for i, a in sets}


def near_copies(k):
    """k texts that all link with each other, two of them three times, and some others."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    out = [" ".join(base[:j] + [f"new{j}"] + base[j:]) for j in range(5, 5 + k)]
    out += out[:2] * 2 + [" ".join(r.choices(base, k=60)) for _ in range(5)]
    return list(enumerate(out, 1000))


@pytest.mark.parametrize(("blocks", "columns", "parts"), [(256, 4096, 3), (4, 50, 7)])
def test_links_are_counted_exactly(spark, monkeypatch, blocks, columns, parts):
    monkeypatch.setattr(p, "BLOCK_SETS", blocks)
    monkeypatch.setattr(p, "COLUMNS", columns)
    rows = corpus(1) + near_copies(30)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r.doc_id: r.n_links for r in p.similar_groups(df, 4, 85, 100).collect()}
    want = brute_links(rows, 4, 85, 100)
    assert got == want and want[1000] >= 33


def test_matrix_of_links():
    values, at = np.array([1, 2, 3, 1, 2, 3, 4, 1, 2, 3, 9, 10], np.uint64), np.array([0, 3, 7, 10, 12])
    every = np.arange(4)
    got = p.links_between(values, at, every, every, 75, 100)
    assert got.astype(int).tolist() == [[0, 1, 1, 0], [1, 0, 1, 0], [1, 1, 0, 0], [0, 0, 0, 0]]
