import random

import pytest

from veilsift.llm import source_mix as m


def water_fill(sizes, total):
    """Targets by repeated capping: sources at their cap leave, the rest share what is left."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        new = {s for s in names if s not in capped and left * weight[s] / free > 2 * sizes[s]} if free else set()
        if not new:
            return {s: 2 * sizes[s] if s in capped else left * weight[s] / free for s in names}
        capped |= new


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_totals(spark, seed):
    r = random.Random(seed)
    rows = [(i, "w " * r.choice([0, 1, 5, 30, 200, 2000]), r.choice(["a", "b", "B", "é", "z", None] if seed < 3 else ["a"])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", None), (None, "x y", "b"), rows[0]]
    df = spark.createDataFrame([(i, t, s, 1, "m") for i, t, s in rows], "doc_id long, text string, source string, row int, mix string")
    sized = df.withColumn("size", m.size_in_words(df.text))
    got = m.allocate(sized).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water_fill(sizes, 1.5 * sum(sizes.values()))
    taken, largest = {}, {}
    for x in got:
        assert x.mix.target == pytest.approx(want[x.source]) and x.mix.source_size == sizes[x.source]
        assert x.mix.taken == x.mix.copies * x.size <= 2 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.mix.taken
        largest[x.source] = max(largest.get(x.source, 0), x.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = m.allocate(sized.repartition(7)).collect()
    assert sorted((str(x.doc_id), x.size, x.mix.copies) for x in got) == sorted((str(x.doc_id), x.size, x.mix.copies) for x in again)
    mixed = m.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(x.mix.copies for x in got)


def test_empty_table_and_only_empty_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.mix(df).count() == 0
    only = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [x.mix.taken for x in m.allocate(only.withColumn("size", m.size_in_words(only.text))).collect()] == [0, 0]


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 3, "a")], "doc_id long, size long, source string")
    assert "Python" not in m.allocate(df)._jdf.queryExecution().executedPlan().toString()


def by_sql(rows, tmp_path):
    import duckdb
    import pyarrow as pa

    from veilsift.llm.queries import ORACLE

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "source": pa.array([r[2] for r in rows], pa.string())}))
    return sorted(con.sql(f"SELECT doc_id, size, taken FROM ({ORACLE['op9_source_mix']})").fetchall(), key=str)


@pytest.mark.parametrize("key", [7, None])
def test_repeated_ids_and_rows_at_the_edge(spark, tmp_path, key):
    rows = [(key, "w " * 12, "a") for _ in range(300)] + [(100 + i, "w " * (3 + i), "a") for i in range(20)] + [(None, "v " * (i % 7), "b") for i in range(40)]
    df = spark.createDataFrame([(i, t, s, 0, None) for i, t, s in rows], "doc_id long, text string, source string, rank int, edge string").repartition(5)
    got = m.allocate(df.withColumn("size", m.size_in_words(df.text))).collect()
    assert sorted(((x.doc_id, x.size, x.mix.taken) for x in got), key=str) == by_sql(rows, tmp_path)
    for s in "ab":
        own = [x for x in got if x.source == s]
        assert abs(sum(x.mix.taken for x in own) - own[0].mix.target) <= max(x.size for x in own)
    assert sum(len(t.split()) for *_, t in [(r.text,) for r in m.mix(df).collect()]) == sum(x.mix.taken for x in got)


def test_long_documents_have_greater_inclusion_odds(spark):
    rows = [(i, 10 if i % 2 else 40, "a") for i in range(8000)]
    got = [x for x in m.allocate(spark.createDataFrame(rows, "doc_id long, size long, source string")).collect() if x.source == "a"]
    whole = min(x.mix.copies for x in got)
    share = {s: sum(x.mix.copies - whole for x in got if x.size == s) / 4000 for s in (10, 40)}
    odds = {s: v / (1 - v) for s, v in share.items()}
    want = (40 / (40 + 25)) / (10 / (10 + 25))
    assert 0.05 < share[10] < share[40] < 0.95 and abs(odds[40] / odds[10] / want - 1) < 0.2, (share, want)
    assert sum(x.mix.taken for x in got) == pytest.approx(got[0].mix.target, abs=40)
