"""The registered queries on the small table, against plain versions of what they return."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm.test_link_counts import brute_links
from tests.llm.test_parity_join import brute as groups
from veilsift.llm import tokenizer_files
from veilsift.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


@pytest.fixture(scope="module")
def documents():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


def test_op1(spark, documents):
    got = rows(spark, "op1_secret_scan")
    assert got.keys() == documents.keys()
    for i, t in documents.items():
        spans = [(m.start(), k, m.end(), kind) for k, (kind, rule, keep) in enumerate(BASE) for m in rule.finditer(t) if keep(m)]
        named = [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]
        assert got[i].base_sha256 == sha(",".join(named))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[3] == k for x in spans) for k in ("assign", "access", "hex"))
        assert set(named) <= set(got[i].spans.split(","))


def test_op2(spark, documents):
    got, words = rows(spark, "op2_substring_dedup"), {i: WORD.findall(t) for i, t in documents.items()}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    assert got.keys() == words.keys() and max(seen.values()) > 1
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].kept_sha256 == sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def test_op3(spark, documents):
    from tokenizers import Tokenizer

    plain, start, got = Tokenizer.from_file(tokenizer_files.path("byte_bpe_50k.json")), 0, rows(spark, "op3_token_table")
    for i in sorted(documents):
        ids = plain.encode(documents[i], add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op6(spark):
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    good = {i: np.array(v, float) for i, v in table if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    found, hits = {}, 0
    for r in QUERIES["op6_learned_ann"](spark, SF).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(found) == {i for i in good if i % 100 == 0}
    for q, rows in found.items():
        rows.sort()
        exact = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)
        assert [k for k, *_ in rows] == list(range(1, min(10, len(good) - 1) + 1)) and [x[1:] for x in rows] == sorted(x[1:] for x in rows)
        assert all(s == pytest.approx(np.sqrt(((good[q] - good[i]) ** 2).sum()), rel=1e-12) for _, s, i in rows)
        hits += len({i for _, _, i in rows} & {i for _, i in exact[:10]})
    assert hits >= 0.9 * sum(len(x) for x in found.values())


def test_op7(spark, documents):
    got = rows(spark, "op7_toxic_spans")
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet' WHERE toxic IS NOT NULL").fetchall())
    assert got.keys() == documents.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert sum(got[i].predicted != toxic[i] for i in got.keys() & toxic.keys()) <= 0.05 * len(toxic)


def test_op8(spark, documents):
    got = rows(spark, "op8_parity_join")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == groups(list(documents.items()), 4, 85, 100)
    assert {i: r.n_links for i, r in got.items()} == brute_links(list(documents.items()), 4, 85, 100)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want)
