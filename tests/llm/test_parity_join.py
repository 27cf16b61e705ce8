import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilsift.llm import parity_join as p
from veilsift.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if j < i and both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    base = [" ".join(f"é{r.randrange(500)}" for _ in range(r.choice([1, 3, 4, 5, 8, 20, 60, 150]))) for _ in range(25)]
    rows = []
    for t in base:
        for _ in range(r.randrange(1, 9)):
            w = t.split()
            for _ in range(r.randrange(0, max(2, len(w) // 25))):
                w[r.randrange(len(w))] = f"n{r.randrange(9)}"
            rows.append((" " if r.random() < 0.5 else "\n").join(w).upper() if r.random() < 0.2 else " ".join(w))
    rows += ["", None, "the same", "THE same", " ".join(["x"] * 50), " ".join(["x"] * 90)]
    r.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "n", "num", "members"), [(1, 4, 85, 2048), (2, 5, 80, 2)])
def test_against_brute_force(spark, monkeypatch, seed, n, num, members):
    monkeypatch.setattr(p, "BLOCK_MEMBERS", members)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, node int, key string").repartition(3)
    got = p.similar_groups(df, n, num, 100).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n, num, 100)


def chain(k, seed):
    """k texts of one family at a similarity of 0.7 to 0.95, most of which reach no single text of it."""
    r = random.Random(seed)
    w, out = [f"w{i}" for i in range(150)], []
    for i in range(k):
        w = list(w)
        for _ in range(r.randrange(1, 3)):
            w[r.randrange(len(w))] = f"n{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("members", [3, 2048])
def test_families_that_few_links_hold_together(spark, monkeypatch, members):
    monkeypatch.setattr(p, "BLOCK_MEMBERS", members)
    rows = list(enumerate(chain(60, 1) + [" ".join(f"z{i % 90}" for i in range(j, j + 80)) for j in range(30)]))
    got = p.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(11), 4, 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 85, 100)


def test_a_long_text_null_ids_repeats_and_clashing_columns(spark):
    r = random.Random(8)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(100_000))
    rows = [(1, long), (2, long + " end"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, "q r s t u"), (None, None), (None, "q r s t u"), (9, "other words here now")]
    df = spark.createDataFrame([(i, t, 0, "x", None, 1.0) for i, t in rows], "doc_id long, text string, node int, key string, root string, hash double")
    got = sorted((x.doc_id or 0, x.component_id or 0, x.n_links) for x in p.similar_groups(df).collect())
    assert got == [(0, 0, 0), (0, 0, 1), (0, 0, 1), (0, 2, 1), (1, 1, 1), (2, 1, 1), (2, 2, 1), (9, 9, 0)]


def test_similar_sets_share_a_key():
    r = np.random.default_rng(0)
    for size in (7, 12, 13, 20, 50, 200, 1000):
        a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
        for extra in range(0, 40):
            other = np.unique(r.integers(0, 2**63, extra).astype(np.uint64))
            b = np.unique(np.concatenate([a[extra // 3 :], other]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both):
                continue
            keys, who = p.sketch_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 85, 100)
            same = len(a) == len(b) == both
            assert same or set(keys[who == 0].tolist()) & set(keys[who == 1].tolist())


@pytest.mark.parametrize("blocks", [1, 4])
def test_pairs_in_reach_join_all_roots_that_links_join(spark, blocks):
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{r.integers(30)}" for _ in range(r.integers(5, 200))) for _ in range(40)]
    texts += [t + " more words" for t in texts[:20]]
    sets = p.set_table(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), 2)
    nodes = sets.select("node", "sketch", F.col("n_shingles").alias("size")).dropDuplicates(["node"])
    rows = nodes.crossJoin(spark.range(3).select(F.col("id").alias("key"))).select("key", "node", F.col("node").alias("root"), F.lit(blocks).alias("blocks"))
    found = p.in_reach(p.block_pairs(rows, "key"), nodes, 80, 100)
    roots = {x.node: x.root for x in components(found).collect()}
    number = {x.key: x.node for x in sets.collect()}
    linked = {number[i]: c for i, (_, c) in brute(list(enumerate(texts)), 2, 80, 100).items()}
    assert all(roots[v] == roots[number[c]] for v, c in linked.items() if v != number[c])
    assert 10 < len(set(roots.values())) + nodes.count() - len(roots) <= len(set(linked.values()))


def test_forest_connects_what_links_connect():
    r = np.random.default_rng(3)
    for _ in range(20):
        linked = r.random((9, 7)) < 0.1
        left, right = np.arange(9), np.arange(9, 16)
        links = [(int(a), int(b) + 9) for a, b in np.argwhere(linked)]
        forest = p.spanning_forest(linked, left, right)

        def groups(pairs):
            root = list(range(16))
            for _ in range(16):
                for a, b in pairs:
                    root[a] = root[b] = min(root[a], root[b])
            return root

        assert groups(forest) == groups(links) and len(forest) == 16 - len(set(groups(links)))


def test_equal_sets_have_equal_numbers():
    values, at = p.shingle_sets(pa.array(["a b c d e", None, "A  b\tc d E", "a b", "a b c d e a b c d e"]), 4)
    n = p.set_numbers(values, at)
    assert n[0] == n[2] and len({n[0], n[3], n[4]}) == 3 and np.diff(at).tolist() == [2, 0, 2, 1, 5]


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (None, 3)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8, **{i: 100 for i in range(100, 141)}}


def test_empty_table(spark):
    assert p.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
