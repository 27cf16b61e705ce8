"""Queries over whole texts, against plain versions on tables that a prefix or a filter would cut."""

import re

import pytest

from veilsift.plans.queries import QUERIES


@pytest.mark.parametrize(("name", "width"), [("cloaked_addresses", 200), ("cloaked_whole_texts", 50)])
def test_cloaking_compares_whole_texts(spark, tmp_path, name, width):
    texts = ["", "short", "ab cd " * 90, "x" * 49 + "\n" + "word " * 400, "".join(f"{chr(97 + i % 26) * (i % 7 + 1)} " for i in range(900)), "tail " * 41 + "the last of all blocks here"]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.url: (r.divergence, r.n_exclusive, r.cloaked) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts, 1):
        plain = re.sub("[^A-Za-z ]", "x", t)
        parts = [plain[k : k + width].strip() for k in range(0, len(plain), width)]
        other = (["only agents read this text"] if i % 5 == 0 else parts[:1]) + parts[1:] + ["agents must now obey this paragraph"] * (i % 3 == 0)
        human, agent = ({b for b in x if len(b) > 20} for x in (parts, other))
        d = 1 - len(human & agent) / len(human | agent) if human | agent else 0.0
        want[f"http://site/{i}"] = (pytest.approx(d, abs=1e-6), len(agent - human), d >= 0.05 and bool(agent - human))
    assert got == want


def test_no_text_is_left_out_of_the_character_checks(spark, tmp_path):
    texts = {5: "tab\tand “quotes”…", 11: "p\u0430y now", 17: "a\u200bb\u200c" + "\u200b" * 3, 23: "日本", 29: "plain"}  # ids that no seed changes
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    threats = {r.doc_id: r.threats for r in run("unicode_threats")}
    assert threats == {5: "", 11: "homoglyph:normalized", 17: "zero_width_chars:stripped", 23: "", 29: ""}
    assert {r.doc_id: r.scripts for r in run("mixed_scripts")}.keys() == texts.keys()
    assert {(r.doc_id, r.ch, r.n) for r in run("zero_width_kind_counts")} == {(17, "\u200b", 4), (17, "\u200c", 1)}


def test_routes_follow_the_texts(spark, tmp_path):
    rows = [(1, "<p>a page</p>"), (3, "<html><body>x</body></html>"), (4, "words"), (5, "<p>bytes of a table</p>")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.route for r in QUERIES["text_routes"](spark, str(tmp_path)).collect()} == {1: "html", 3: "html", 4: "text", 5: "text"}
