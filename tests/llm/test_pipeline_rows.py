import random

import corpus_pipeline


def test_near_duplicates_by_row(spark):
    r = random.Random(3)
    a, b, c, d = (" ".join(f"w{r.randrange(900)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (1, b), (2, b + " more"), (3, c), (None, a + " end"), (None, d), (None, d + " near"), (7, "e f"), (7, "e f"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, df.repartition(4), "")
    assert got.columns == df.columns
    kept = [(x.doc_id, x.text) for x in got.collect()]
    assert sorted((k for k in kept if k[0] is not None)) == [(1, a), (1, b), (3, c), (7, "e f")]
    rest = [t for i, t in kept if i is None]
    assert len(rest) == 2 and None in rest and (d in rest) != (d + " near" in rest)
