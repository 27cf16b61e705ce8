import numpy as np

from veilsift.llm import toxic_spans as t


def plain_marginals(e, first, step, start):
    out, joint = [], np.zeros((2, 2))
    for a, z in zip(first[:-1], first[1:], strict=True):
        if a == z:
            continue
        local = np.stack([np.ones(z - a), np.exp(e[a:z])], 1)
        alpha = [np.exp(start) * local[0]]
        for k in range(1, z - a):
            v = (alpha[-1] @ np.exp(step)) * local[k]
            alpha.append(v / v.sum())
        beta = [np.ones(2)]
        for k in range(z - a - 1, 0, -1):
            v = np.exp(step) @ (local[k] * beta[0])
            beta.insert(0, v / v.sum())
        out += [x[1] * y[1] / (x * y).sum() for x, y in zip(alpha, beta, strict=True)]
        for k in range(1, z - a):
            x = alpha[k - 1][:, None] * np.exp(step) * (local[k] * beta[k])[None]
            joint += x / x.sum()
    return np.array(out), joint


def test_forward_backward():
    r = np.random.default_rng(1)
    e, first = r.normal(0, 2, 700), np.array([0, 3, 3, 300, 301, 700])
    step, start = r.normal(0, 1, (2, 2)), r.normal(0, 1, 2)
    p, joint, _ = t.marginals(e, first, step, start, pairs=True)
    want, pairs = plain_marginals(e, first, step, start)
    assert np.allclose(p, want) and np.allclose(joint, pairs)
    assert len(t.marginals(np.zeros(0), np.array([0, 0]), step, start)) == 0


def corpus(n, seed):
    r = np.random.default_rng(seed)
    texts, toxic = [], []
    for _ in range(n):
        words = [f"{'abcdefghij'[r.integers(10)]}{r.integers(200)}word" for _ in range(r.integers(5, 60))]
        bad = bool(r.random() < 0.3)
        for _ in range(r.integers(1, 4) if bad else 0):
            words.insert(r.integers(len(words)), ["nasty", "Vile,", f"scumm{r.integers(50)}"][r.integers(3)])
        texts.append(" ".join(words))
        toxic.append(bad)
    return texts, toxic


def test_held_out_accuracy_and_spans(spark):
    model = t.fit(*corpus(400, 1))
    texts, toxic = corpus(300, 2)
    texts += [None, "", "é" * 10 + " nasty " + "ok " * 3000]
    df = spark.createDataFrame([(i, x, 1.0) for i, x in enumerate(texts)], "doc_id int, text string, score double")
    got = {r.doc_id: r for r in t.score(df, model).collect()}
    assert t.score(df, model).columns == ["doc_id", "score", "toxic_spans"]
    right = sum((got[i].score >= 0.5) == y for i, y in enumerate(toxic))
    assert right >= 0.95 * len(toxic)
    assert got[300].score == got[301].score < 0.5 and got[300].toxic_spans == []
    assert [(s.start, s.end) for s in got[302].toxic_spans] == [(11, 16)] and got[302].score >= 0.5
    assert t.score(df.limit(0), model).count() == 0


def test_without_toxic_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None), (9, 0)], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in t.score(docs, t.train(docs, labels)).collect())
    assert all(r.score < 0.5 for r in t.score(docs, t.train(docs, labels.limit(0))).collect())
