import hashlib

import numpy as np

from veilsift.llm import piece_codec as c
from veilsift.llm import tokenizer_files

MODEL = tokenizer_files.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a ", " a", "a  b", "▁", "a▁b", "▁▁a", "\n", "a\nb\t c", "a\x00b", "日本 語", "😀 x", "</s> <s>", "é̂", " x  ", "   lead", "trail   ", "<0x0A>", "word " * 300, "Ärger über 12,5 %"]


def test_ids_and_spans_match_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = c.Codec(MODEL)
    assert codec.by_words
    for _ in range(2):
        ids, begins, ends = codec.encode(TEXTS)
        for t, i, b, e in zip(TEXTS, ids, begins, ends, strict=True):
            assert i.tolist() == library.encode(t, add_eos=True), t
            pieces = library.encode(t, return_type="proto").pieces
            assert [(x.begin, x.end) for x in pieces] == list(zip(b.tolist(), e.tolist(), strict=True))[:-1], t


def test_spans_tile_the_text(spark):
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate([*TEXTS, None])], "doc_id int, text string, ids string")
    rows = {r.doc_id: r for r in c.encode(df, MODEL).collect()}
    assert c.encode(df, MODEL).columns == ["doc_id", "ids", "begins", "ends", "decoded"]
    for i, t in enumerate([*TEXTS, None]):
        r, raw = rows[i], (t or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends, strict=True)) == raw
        assert r.ids[-1] == 2
    assert rows[len(TEXTS)].ids == [2] and rows[len(TEXTS)].decoded == ""
    assert c.encode(df.limit(0), MODEL).count() == 0


def double_array(entries):
    """A compiled map with the given replacements, laid out with every node's children at a free base."""
    keys, texts, blob = {}, {}, b""
    for k, v in entries.items():
        keys[k], texts[k] = len(blob), v
        blob += v + b"\0"
    units, used = {0: 0}, {0}

    def place(prefix, at):
        nexts = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in keys
        base = next(b for b in range(1, 5000) if not ({b ^ at ^ ch for ch in nexts} | ({b ^ at} if leaf else set())) & used and (b ^ at) not in used)
        node = at ^ base
        used.update({node ^ ch for ch in nexts} | {node})
        units[at] = units[at] | base << 10 | (256 if leaf else 0)
        if leaf:
            units[node] = keys[prefix] | 1 << 31
        for ch in nexts:
            units[node ^ ch] = ch
        for ch in nexts:
            place(prefix + bytes([ch]), node ^ ch)

    place(b"", 0)
    flat = np.zeros(max(units) + 300, "<u4")
    for at, u in units.items():
        flat[at] = u
    return len(flat.tobytes()).to_bytes(4, "little") + flat.tobytes() + blob


def test_longest_prefix_normalisation_keeps_offsets():
    codec = c.Codec(MODEL)
    codec.map, codec.squeeze = c.CharacterMap(double_array({"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"YZ", "é".encode(): b"e", b"\t": b" "})), True
    assert codec.map.longest(b"abcd", 0) == (3, b"YZ") and codec.map.longest(b"abd", 0) == (2, b"X") and codec.map.longest(b"zab", 0) == (0, b"")
    text, align = codec.normalise("  ﬁ abcé\t b ")
    mark = "▁".encode()
    assert text == mark + b"fi" + mark + b"YZe" + mark + b"b"
    source = "  ﬁ abcé\t b ".encode()
    at = {text.index(b"fi"): "ﬁ", text.index(b"YZ"): "abc", text.index(b"e"): "é"}
    for place, piece in at.items():
        assert source[align[place] :].startswith(piece.encode())
    assert len(align) == len(text) + 1 and list(align) == sorted(align)


def test_digests(spark):
    from veilsift.llm.queries import piece_digests

    r = piece_digests(c.encode(spark.createDataFrame([("a b",)], "text string"), MODEL)).first()
    ids = c.Codec(MODEL).encode(["a b"])[0][0].tolist()
    assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(b"a b").hexdigest()
