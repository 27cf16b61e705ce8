"""SentencePiece encoding that keeps the byte offsets of the source text.

A text is normalised as the model says: the longest prefix found in the model's compiled character
map is replaced, and for each byte of the normalised text the byte of the source that it came from is
recorded. Pieces tile the normalised text, so each piece's place there projects to a byte span of the
source, ends exclusive. Ids come from the sentencepiece library. If no piece of the model has a word
mark after another character, merges never cross the start of a word, so words can be encoded one by
one: those already seen are looked up, the others go to the library together.

Null counts as an empty text; it has the end id only and decodes to an empty text. Texts of any
length are encoded whole; memory follows the text. Repeated rows give repeated results, an empty
table an empty one. Other columns are carried only if named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textcols import slices, utf8

MARK = "▁"
#: Words whose ids a worker remembers at most.
CACHE_WORDS = 600_000
SLICE_BYTES = 2 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


class CharacterMap:
    """The compiled map: a double-array trie over source bytes, and the replacements."""

    def __init__(self, raw: bytes):
        size = int.from_bytes(raw[:4], "little") if raw else 0
        self.units = np.frombuffer(raw, "<u4", size // 4, 4).tolist() if raw else []
        self.texts = raw[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes]:
        """(length, replacement) of the longest prefix of text[at:] in the map; length 0 if there is none."""
        if not self.units:
            return 0, b""
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, best, where = step(self.units[0]), 0, 0
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != text[i]:
                break
            unit = self.units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                best, where = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return (best, self.texts[where : self.texts.index(b"\0", where)]) if best else (0, b"")


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            spec = dict(_fields(next(v for k, v in _fields(f.read()) if k == 3)))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.end = self.library.eos_id()
        self.bytes_of = np.array([1 if self.library.is_byte(i) else 0 if self.library.is_control(i) or self.library.is_unknown(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64)
        self.by_words = not self.map.units and self.prefix and self.escape and not self.squeeze and not any(MARK in p.lstrip(MARK) for p in pieces) and self.library.is_byte(self.library.piece_to_id("<0x00>"))
        self.words = re.compile("(?<=[^ ▁])(?=[ ▁])").split
        self.mark_id = self.library.piece_to_id(MARK)
        self.known: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text and for each of its bytes, and its end, the source byte it stands for."""
        raw = text.encode("utf-8", "replace")
        space = MARK.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:
            codes = np.frombuffer(raw, np.uint8)
            width = np.where(codes == 32, len(space), 1)
            head = np.zeros(len(space) if self.prefix and raw else 0, np.int64)
            align = np.concatenate([head, np.repeat(np.arange(len(raw)), width), [len(raw)]])
            return space * bool(self.prefix and raw) + raw.replace(b" ", space), align
        out, align, at, blank = bytearray(), [], 0, self.squeeze

        def put(piece: bytes, source: int) -> None:
            out.extend(piece)
            align.extend([source] * len(piece))

        started = False
        while at < len(raw):
            size, new = self.map.longest(raw, at)
            if not size:
                lead = raw[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = raw[at : at + size]
            if self.squeeze and blank:
                new = new.lstrip(b" ")
            if new and not started:
                started = True
                if self.prefix:
                    put(space, at)
            for k in range(len(new)):
                put(space if new[k : k + 1] == b" " else new[k : k + 1], at)
            blank = new.endswith(b" ") if new else blank
            at += size
        if self.squeeze:
            while out.endswith(space):
                at = align[len(out) - len(space)]
                del out[-len(space) :], align[-len(space) :]
        return bytes(out), np.array([*align, at], np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without the end id."""
        if not self.by_words:
            return [np.array(x, np.int32) for x in self.library.encode(texts, num_threads=1)]
        parts = [self.words((" " + t).replace(MARK, " ")) if t else [] for t in texts]
        new = list({w for ws in parts for w in ws}.difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {}
            new = list({w for ws in parts for w in ws})
        for word, found in zip(new, self.library.encode([w[1:] for w in new], num_threads=1), strict=True):
            self.known[word] = np.array(found if len(word) > 1 else [self.mark_id], np.int32).tobytes()
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in ws]), np.int32) for ws in parts]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Ids with the end id, and the begins and ends of each piece in the source's bytes."""
        all_ids, begins, ends = [], [], []
        for text, ids in zip(texts, self.ids(texts), strict=True):
            normal, align = self.normalise(text)
            if self.by_words:
                sizes = self.bytes_of[ids]
            else:
                pieces = self.library.encode(text, out_type=str)
                sizes = np.array([1 if self.library.is_byte(int(i)) else len(p.encode()) for i, p in zip(ids, pieces, strict=True)], np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            if at[-1] != len(normal):
                raise ValueError("pieces do not tile the normalised text")
            all_ids.append(np.append(ids, np.int32(self.end)))
            begins.append(align[np.append(at[:-1], len(normal))])
            ends.append(align[np.append(at[1:], len(normal))])
        return all_ids, begins, ends


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def encode(docs: DataFrame, model: str, text: str = "text", carry: list[str] | None = None, decoded: bool = True) -> DataFrame:
    """The columns in carry (if None, all but text and those named like outputs), ids, begins and ends (arrays), and decoded: decode(ids) if asked for."""
    carry = [c for c in docs.columns if c not in (text, "ids", "begins", "ends", "decoded")] if carry is None else carry
    ints = T.ArrayType(T.IntegerType())
    added = [("ids", ints), ("begins", ints), ("ends", ints), *([("decoded", T.StringType())] if decoded else [])]
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for a, b in slices(utf8(batch.column(0))[1], SLICE_BYTES):
                part = batch.slice(a, b - a)
                ids, begins, ends = c.encode([t or "" for t in part.column(0).to_pylist()])
                more = [pa.array(c.library.decode([x.tolist() for x in ids]), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[1:], _lists(ids), _lists(begins), _lists(ends), *more], names=schema.names)

    return docs.select(docs[text].alias("_text"), *[docs[c] for c in carry]).mapInArrow(run, schema)
