import numpy as np

from veilsift.llm import learned_ann as a


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int, block int")


def brute(x, ids, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    order = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
    return ids[order].tolist()


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(4)
    centres = r.normal(0, 3, (20, 16))
    x = (centres[r.integers(0, 20, 3000)] + r.normal(0, 1, (3000, 16))).astype(np.float32)
    df = vectors(spark, [(i, v.tolist(), 0, 0) for i, v in enumerate(x)])
    model = a.fit(df)
    out = a.search(df, df.filter("vec_id % 100 = 0"), model).collect()
    hit = 0
    for q in range(0, 3000, 100):
        mine = sorted((o.rank, o.vec_id, o.score) for o in out if o.query_id == q)
        assert [o[0] for o in mine] == list(range(1, 11)) and q not in [o[1] for o in mine]
        assert all(abs(s - np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum())) < 1e-12 for _, i, s in mine)
        hit += len(set(brute(x.astype(float), np.arange(3000), q)) & {o[1] for o in mine})
    assert hit / 300 >= 0.9 and model.probes < a.PARTS


def test_odd_vectors_ties_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, None]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    df = vectors(spark, [(*r, 1, 1) for r in rows])
    out = a.search(df, df.filter("vec_id = 0 or vec_id = 1"), a.fit(df), 10)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out.orderBy("rank").collect()] == [(0, 1, 5, 0.0), (0, 2, 6, 0.0), (0, 3, 7, 1.0)]


def test_many_equal_vectors_split_into_blocks(spark):
    df = vectors(spark, [(i, [1.0, float(i > 4990)], 0, 0) for i in range(5000)])
    out = a.search(df, df.filter("vec_id = 100"), a.fit(df), 10).orderBy("rank").collect()
    assert [r.vec_id for r in out] == list(range(10)) and all(r.score == 0 for r in out)


def test_empty_table(spark):
    df = vectors(spark, [])
    assert a.search(df, df, a.fit(df)).count() == 0


def test_parts_are_balanced():
    r = np.random.default_rng(0)
    label = a.balanced_parts(a.neighbours(r.normal(size=(1000, 8)), 10), 8, r)
    assert np.bincount(label).tolist() == [125] * 8


def test_blocks_grow_before_their_number_does():
    assert [a.blocks_of(n) for n in (0, 1, 2_048, 2_049, 131_072, 1_000_000, 4_194_304, 100_000_000)] == [1, 1, 1, 2, 64, 64, 64, 1526]
