import io
import random
import zlib

import numpy as np
import pyarrow as pa

from veilsift.llm import token_table as t
from veilsift.llm import tokenizer_files


def test_ids_match_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_files.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["", " ", "a  b", " a", "a ", "a\n b", "a \n b", "it's we'll 12 34,5", "é  x", "  y", "x\x1c y", "tab\t tab", "日本 語", "<|endoftext|> a", "a<|endoftext|>b", " " * 9, "long " * 500]
    r = random.Random(4)
    parts = [" ", " ", " ", "  ", "\n", "\u00a0", "\u2003", "\x85", "\x1c", "\u3000", "\t", "a", "it's", "12", "é", "日本", "$$", "<|endoftext|>", "word", "Ünïcode", ".", ","]
    texts += ["".join(r.choices(parts, k=r.randrange(1, 25))) for _ in range(1500)] + [None, "x " * 300_000]
    enc = t.ChunkEncoder(path)
    for _ in range(2):
        ids, at = enc.encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text
        assert enc.encode(pa.array([], pa.string()))[1].tolist() == [0] and ids.dtype == np.dtype("<u2")


def test_forgotten_chunks_are_encoded_again(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_files.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    monkeypatch.setattr(t, "CACHE_CHUNKS", 20)
    monkeypatch.setattr(t, "JOINED", 3)
    enc = t.ChunkEncoder(path)
    for i in range(30):
        texts = [f"one word{j} two  {j}" if j % 4 == 0 else f"one word{j} two, {j}" for j in range(i, i + 9)]
        ids, at = enc.encode(pa.array(["skipped", *texts]).slice(1))
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(9)] == [plain.encode(x, add_special_tokens=False).ids for x in texts]


def test_file_round_trip_and_lookup():
    keys = [None, -(2**62), -1, 0, 5, 5, 7, 2**40, "a", "ab", "b"]
    raw, f = sorted(map(t.key_bytes, keys)), io.BytesIO()
    w = t.TableWriter(f)
    for i, k in enumerate(raw):
        w.add(k, np.arange(i, dtype="<u2").tobytes(), i)
    w.close()
    r = t.TableReader(f)
    assert [(k, n) for k, _, n, _ in r] == [(k, i) for i, k in enumerate(raw)]
    assert [b for _, b, _, _ in r] == np.concatenate([[0], np.cumsum(range(len(raw)))])[:-1].tolist()
    assert [t.key_of(k) for k in raw] == keys
    assert len(r.get(t.key_bytes(5))) == 2 and r.get(t.key_bytes(6)) == [] and len(r.get(t.key_bytes(None))) == 1


def test_many_blocks(monkeypatch):
    monkeypatch.setattr(t, "BLOCK_BYTES", 64)
    f = io.BytesIO()
    w = t.TableWriter(f)
    for i in range(500):
        w.add(t.key_bytes(i // 3 * 3), b"\1\0" * (i % 7), i % 7)
    w.close()
    r = t.TableReader(f)
    assert len(r.index) > 20 and all(len(r.get(t.key_bytes(i))) == (3 if i < 498 else 2) for i in range(0, 500, 3)) and not r.get(t.key_bytes(1))


def test_spark_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_files.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i * 7 % 50, f"text {i} é" * (i % 5)) for i in range(50)] + [(None, "nobody"), (3, "again"), (60, None)]
    df = spark.createDataFrame([(k, x, 0) for k, x in rows], "doc_id long, text string, start int")
    shards = t.write_tables(df, path, str(tmp_path / "out"))
    got = t.read_tables(spark, shards).orderBy("start").collect()
    assert [r.key for r in got] == sorted([k for k, _ in rows], key=lambda k: (k is not None, k))
    start = 0
    for r in got:
        assert r.start == start and len(r.ids) == 4 * r.n_tokens
        start += r.n_tokens
    want = sorted(zlib.crc32(np.array(plain.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for _, x in rows)
    assert sorted(zlib.crc32(bytes(r.ids)) for r in got) == want
    found = t.lookup(spark.createDataFrame([(3,), (4,), (1000,), (None,)], "k long"), shards, "k").collect()
    assert sorted([r.key for r in found], key=str) == sorted([3, 3, 4, None], key=str)


def test_empty_table(spark, tmp_path):
    shards = t.write_tables(spark.createDataFrame([], "doc_id long, text string"), tokenizer_files.path("byte_bpe_50k.json"), str(tmp_path / "none"))
    assert shards == [] and t.read_tables(spark, shards).count() == 0
