"""Null, empty, very long and repeated texts, extra columns with clashing names, and empty tables."""

import hashlib
import random
import re
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from veilsift.llm import tokenizer_files
from veilsift.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, kept boolean, row long, part int"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(11)
    words = " ".join(f"w{r.randrange(5000)}" for _ in range(120_000))
    long = words[:400_000] + " token=abcdefgh " + words[400_000:] + " AKIA" + "Q" * 20
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "password: secret12"), (4, "password: secret12"), (5, long), (None, "a b"), (None, "a b")]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, "en", None, 0, -1, "x", None, 7, 7) for i, t in texts], COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path, texts


def found(spark, path, name):
    return sorted(QUERIES[name](spark, path).collect(), key=lambda x: (x.doc_id is None, x.doc_id or 0))


def base_metrics(text):
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_secrets(spark, table):
    path, texts = table
    got = found(spark, path, "op1_secret_scan")
    long = texts[5][1]
    at = long.index("token=")
    assert [(x.doc_id, x.n_assign, x.n_access, x.n_hex) for x in got] == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 1, 0, 0), (4, 1, 0, 0), (5, 1, 1, 0), (None, 0, 0, 0), (None, 0, 0, 0)]
    named = f"assign:{at}:{at + 14},access:{len(long) - 24}:{len(long)}"
    assert got[5].base_sha256 == hashlib.sha256(named.encode()).hexdigest()
    assert got[3] == got[4] and got[6] == got[7]


def test_quality(spark, table):
    path, texts = table
    got = found(spark, path, "op4_quality_rules")
    assert [x.doc_id for x in got] == [i for i, _ in texts] and got[3] == got[4]
    for x, (_, t) in zip(got, texts, strict=True):
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == base_metrics(t or "")
        assert x.base_failed == (x.n_words < 20) and not (x.base_failed and x.kept)


def test_pieces(spark, table):
    path, texts = table
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_files.path("piece_bpe_32k.model"))
    for x, (i, t) in zip(found(spark, path, "op10_piece_codec"), texts, strict=True):
        ids = library.encode(t or "", add_eos=True)
        assert (x.doc_id, x.n_tokens) == (i, len(ids))
        assert x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_the_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for _, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, docs, str(tmp_path))
        assert stage.columns == docs.columns and stage.isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).isEmpty()
