import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veilsift.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string, depth int, print string, split int"


def brute(rows, borrow=True):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if borrow else 0
        built[c] = [*turns.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h], *mine[h:]]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(set)
    for n in members:
        if n:
            children[n[:-1]].add(n)
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    name = lambda n: min(members[n])
    ends = lambda n: hashlib.sha256(",".join(str(c) for c in sorted(members[n]) if len(built[c]) == len(n)).encode()).hexdigest()
    return sorted((name(n), len(n), name(n[:-1]) if n else None, len(m), len(children[n]), leaves[n], saved[n], ends(n)) for n, m in members.items())


def built(spark, rows, borrow=True, **options):
    df = spark.createDataFrame([(*r, 1, "print", 2) for r in rows], SCHEMA)
    borrowed = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    out = p.trie(df, borrowed, F.col("conv") - F.col("conv") % 100, **options) if borrow else p.trie(df, **options)
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2])


def some(n, words, longest, seed=3):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), r.choice(words)) for c in range(n) for t in range(r.randint(1, longest))]


def test_odd_rows(spark):
    rows = [*some(60, ["a", "b", "é𝄞"], 5), (300, None, None, None), (300, 1, "", ""), (300, 1, "", ""), (301, 5, "user", ""), (301, 5, "assistant", "z"), (301, 5, "assistant", "a"), (-7, 0, "user", "a"), (-107, 0, "user", "a"), (-100, 0, "user", "q"), (None, 0, "user", "a"), (399, 0, "user", "long " * 50_000), (-205, 1, "user", "b")]
    assert built(spark, rows) == brute(rows)


@pytest.mark.parametrize("bits", [2])
def test_colliding_prefixes_are_split(spark, bits):
    rows = some(25, ["a", "b", "c"], 5)
    assert built(spark, rows, bits=bits) == brute(rows)


def test_colliding_turns_are_told_apart(spark):
    rows = some(25, ["a", "b", "cc", "dd"], 4)
    assert built(spark, rows, hashed=lambda role, text: F.length(text).cast("long")) == brute(rows)


def test_one_conversation_over_many_partitions_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(p, "BLOCK", 64)
    monkeypatch.setattr(p, "LIST", 7)
    long = [(7, t, "user", f"t{t % 5}") for t in range(300)] + [(8, t, "user", f"t{t % 5}") for t in range(200)]
    rows = [*long, *[(c, t, "user", "same") for c in range(1000, 1120) for t in range(3)], *some(40, ["a", "b"], 4)]
    want = brute(rows, False)
    assert built(spark, rows, False) == want
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert built(spark, rows, False) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_only_turnless_conversations(spark):
    rows = [(c, 0, "user", "a") for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6]
    assert built(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_empty(spark):
    assert built(spark, []) == [] and built(spark, [(None, 1, "user", "a")]) == []
