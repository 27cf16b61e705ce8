import random
import re

import numpy as np
import pytest

from veilsift.llm import substring_dedup as d
from veilsift.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = {}
    for w in words:
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n, v=300: " ".join(f"é{r.randrange(v)}" for _ in range(n))
    passages = [text(n) for n in (35, 36, 60, 34, 120)]
    rows = [(i, text(r.randrange(0, 90)) + " " + r.choice(passages) + "\n" + text(r.randrange(0, 60))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a " * 80), (103, "a b " * 60), (104, rows[0][1]), (105, text(2000, 3)), (106, "  x")]
    return rows


@pytest.mark.parametrize("hot", [500, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(d, "HOT", hot)
    rows = corpus(hot)
    rows += [rows[3]]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id int, text string, row int, segment string")
    got = sorted([tuple(x) for x in d.remove_repeats(df).collect()], key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert d.remove_repeats(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_index_counts_occurrences():
    r = np.random.default_rng(3)
    parts = [r.integers(1, 5, r.integers(1, 50)) for _ in range(40)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    symbols = np.concatenate(parts)
    index = FMIndex(symbols, offsets)
    texts = [p.tolist() for p in parts]
    count = lambda q: sum(t[i : i + len(q)] == q for t in texts for i in range(len(t)))
    ends = np.concatenate([np.arange(a + 6, b + 1) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    found = index.matching_statistics(symbols, ends, 6)
    for e, n in zip(ends, found, strict=True):
        best = max([k for k in range(1, 7) if count(symbols[e - k : e].tolist()) >= 2], default=0)
        assert n == best
