import re

from pyspark.sql import Row

from veilsift.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [" ".join(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h a b c d e f g h", "x " * 40, "l1 a\nl2\nl1 a\n\nl1 a", "# * $ % & | < > é ü", "a b c", "\x1f a \x0b b",
    " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(5, 20)), "the of and to in is that for it as " * 3 + "end",
]


def test_metrics_match_a_plain_version(spark):
    rows = spark.createDataFrame([Row(i=i, text=t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = {r.i: r.quality for r in q.assess(rows).collect()}
    for i, t in enumerate(TEXTS):
        m = got[i].metrics
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == brute(t), t
        assert got[i].base_failed == (m.n_words < 20 or 100 * m.n_repeat_words > 30 * m.n_words)
        assert not (got[i].base_failed and got[i].kept)


def test_a_clean_text_stays_and_junk_goes(spark):
    clean = "it was the best of times and it was the worst of times for all of us in the city that year and nobody knew"
    junk = ["word word word word " * 10, " ".join(f"a{i}###" for i in range(30)), "short text"]
    rows = spark.createDataFrame([(t,) for t in [clean, *junk]], "text string")
    assert [r.text for r in q.keep(rows).collect()] == [clean]


def test_no_user_functions_in_the_plan(spark):
    plan = q.assess(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_clashing_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([("it is a text of the kind " * 5, 1, 2)], "text string, quality int, row int")
    assert q.keep(rows).columns == ["text", "quality", "row"]
    assert q.assess(rows.limit(0)).count() == 0
