"""Token ids in sorted-string-table shards: documents keyed by identifier, found by binary search.

Documents are dealt out by key range, sorted, encoded and written as one file for each range to the
folder that all executors share. A file is

    blocks of entries | Bloom filter | block index | footer

An entry is varint shared, varint unshared, varint length, the key's unshared bytes, the value; shared
counts the bytes that the key has in common with the one before it, and is 0 at each block's start.
A value is varint n_tokens and the ids, little-endian, 2 bytes each (4 if the vocabulary is larger
than 65,536). Each block ends in its crc32. The sparse index has for each block its first key, place,
length and the ids of the file before it. The footer has the places of the other parts, the counts
and a magic number. Keys sort as bytes: null first, then integers, then strings.

A task writes under a name of its own and reports it only when the file is closed, so a retried task
leaves an unreported file behind and never a torn shard. The report, one row for each shard, is all
that reaches the driver; from it each shard's first id number follows. Null and empty texts have no
ids but the end id. Rows that repeat a key are kept, ordered by text hash. A long text is one value.
An empty table gives no shards and no rows. Other columns are not stored.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import shared_dir
from .textcols import mix

MAGIC = b"VSSST001"
FOOTER = struct.Struct("<QQQQQQQ8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Chunks of text whose ids a worker remembers at most.
CACHE_CHUNKS = 1_000_000


# --- encoding ---------------------------------------------------------------------------------


#: Characters that any of the libraries takes for white space; two in a row, or one at an end, make a text uneven.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNEVEN = rf"\A{_SPACE}|{_SPACE}{_SPACE}|{_SPACE}\z"
#: Chunks that the library gets in one string.
JOINED = 2_000


class ChunkEncoder:
    """Byte-level BPE of whole texts through the tokenizers library, chunk by chunk.

    The vocabulary's splitting pattern never joins text across a single space between two characters
    that are not white space, so such spaces start chunks whose ids do not depend on their neighbours.
    Ids of chunks are remembered; only new ones are given to the library, many in one string, whose ids
    are told apart by the tokens' lengths in bytes. A text with white space that doesn't stand alone
    between others is cut by a pattern, and its chunks are given to the library one by one.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # A byte-level token's name has a character for each byte.
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.split = re.compile(r"(?<=\S)(?= \S)").split
        self._forget()

    def _forget(self) -> None:
        """Numbers of known chunks, by their text and, for those that follow a space, by the text after it; their ids."""
        self.plain: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.ids, self.size = np.zeros(1 << 16, self.dtype), 0
        self.begins, self.sizes, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0

    def _remember(self, names: dict[str, int], chunks: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        while self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(ends) > len(self.begins):
            self.begins, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.sizes))
        begins, new = np.concatenate([[0], ends[:-1]]), slice(self.known, self.known + len(ends))
        self.ids[self.size : self.size + len(ids)] = ids
        self.begins[new], self.sizes[new] = begins + self.size, ends - begins
        names.update(zip(chunks, range(self.known, self.known + len(ends)), strict=True))
        self.size, self.known = self.size + len(ids), self.known + len(ends)

    def _numbers(self, chunks: list[str], spaced: bool) -> np.ndarray:
        """The number of each chunk, new ones encoded; of the spaced ones, what follows their space is given."""
        known = self.spaced if spaced else self.plain
        numbers = list(map(known.get, chunks))
        if None not in numbers:
            return np.array(numbers, np.int64)
        new = list(dict.fromkeys(c for c, k in zip(chunks, numbers, strict=True) if k is None))
        for a in range(0, len(new), 10 * JOINED):
            part = new[a : a + 10 * JOINED]
            if spaced:
                texts = [" " + " ".join(part[b : b + JOINED]) for b in range(0, len(part), JOINED)]
                ids = np.concatenate([np.array(x.ids, np.int64) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
                size = np.cumsum([len(c.encode()) + 1 for c in part])
                ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), size) + 1
            else:
                found = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                ids, ends = np.array([i for x in found for i in x], np.int64), np.cumsum([len(x) for x in found])
            self._remember(known, part, ids, ends)
        return np.array(list(map(known.__getitem__, chunks)), np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, null counting as empty, and n + 1 offsets into them."""
        if self.known > CACHE_CHUNKS:
            self._forget()
        texts = texts.fill_null("")
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        pieces = pc.split_pattern(pc.if_else(pa.array(uneven), "", texts), " ")
        first = pieces.offsets.to_numpy().astype(np.int64) - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        later = np.ones(len(codes), bool)
        later[first[:-1]] = False
        used = np.flatnonzero(np.bincount(codes[later], minlength=len(names)))
        number = np.zeros(len(names), np.int64)
        number[used] = self._numbers(names.take(pa.array(used)).to_pylist(), True)
        chunk = number[codes]
        chunk[first[:-1]] = self._numbers(names.take(pa.array(codes[first[:-1]])).to_pylist(), False)
        count = np.diff(first)
        rows = np.flatnonzero(uneven)
        if len(rows):
            parts = [self.split(texts[i].as_py()) for i in rows.tolist()]
            count[rows] = [len(x) for x in parts]
            numbers = self._numbers([c for x in parts for c in x], False)
            even, whole = np.repeat(~uneven, count), np.empty(int(count.sum()), np.int64)
            whole[even] = chunk[np.repeat(~uneven, np.diff(first))]
            whole[~even] = numbers
            chunk, first = whole, np.concatenate([[0], np.cumsum(count)])
        size = self.sizes[chunk]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return self.ids[np.repeat(self.begins[chunk] - ends[:-1], size) + np.arange(ends[-1])], ends[first]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


# --- the file format --------------------------------------------------------------------------


def key_bytes(key: int | str | None) -> bytes:
    if key is None:
        return b"\0"
    if isinstance(key, str):
        return b"\2" + key.encode()
    return b"\1" + (key + (1 << 63)).to_bytes(8, "big")


def key_of(raw: bytes) -> int | str | None:
    return None if raw == b"\0" else raw[1:].decode() if raw[0] == 2 else int.from_bytes(raw[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    h1 = mix(np.array([zlib.crc32(k) << 32 | zlib.adler32(k) for k in keys], np.uint64))
    h2 = mix(h1) | np.uint64(1)
    return (h1[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * h2[:, None]) % np.uint64(bits)


class TableWriter:
    """Writes entries that come in key order to an open binary file; memory holds a block and the keys."""

    def __init__(self, file):
        self.file, self.at, self.block, self.last = file, 0, bytearray(), b""
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int]] = []
        self.first, self.tokens, self.block_tokens = b"", 0, 0

    def add(self, key: bytes, ids: bytes, n_tokens: int) -> None:
        if not self.block:
            self.first, self.last, self.block_tokens = key, b"", self.tokens
        shared = len(os.path.commonprefix([self.last, key]))
        head = _varint(n_tokens)
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(head) + len(ids)) + key[shared:] + head
        self.block += ids
        self.last = key
        self.keys.append(key)
        self.tokens += n_tokens
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _write(self, raw: bytes) -> int:
        self.file.write(raw)
        self.at += len(raw)
        return len(raw)

    def _end_block(self) -> None:
        if self.block:
            raw = bytes(self.block)
            self.index.append((self.first, self.at, len(raw), self.block_tokens))
            self._write(raw + struct.pack("<I", zlib.crc32(raw)))
            self.block = bytearray()

    def close(self) -> None:
        self._end_block()
        bits = max(64, (len(self.keys) * BLOOM_BITS + 63) // 64 * 64)
        bloom = np.zeros(bits // 8, np.uint8)
        for a in range(0, len(self.keys), 100_000):
            at = _bloom_places(self.keys[a : a + 100_000], bits).ravel()
            np.bitwise_or.at(bloom, at >> np.uint64(3), (np.uint64(128) >> (at & np.uint64(7))).astype(np.uint8))
        bloom_at = self.at
        self._write(bloom.tobytes())
        index_at = self.at
        for key, at, length, before in self.index:
            self._write(_varint(len(key)) + key + _varint(at) + _varint(length) + _varint(before))
        self._write(FOOTER.pack(bloom_at, bits, index_at, self.at - index_at, len(self.index), len(self.keys), self.tokens, MAGIC))


class TableReader:
    """Reads one shard from an open, seekable binary file."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        file.seek(size - FOOTER.size)
        self.bloom_at, self.bits, index_at, index_size, n_blocks, self.n, self.tokens, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        file.seek(index_at)
        raw, at, self.index = file.read(index_size), 0, []
        for _ in range(n_blocks):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            place, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            before, at = _read_varint(raw, at)
            self.index.append((key, place, length, before))
        self.firsts = [x[0] for x in self.index]
        self.bloom: np.ndarray | None = None

    def entries(self, k: int) -> Iterator[tuple[bytes, int, int, bytes]]:
        """Of block k: (key, ids of the file before it, n_tokens, ids)."""
        _, place, length, before = self.index[k]
        self.file.seek(place)
        raw = self.file.read(length + 4)
        if zlib.crc32(raw[:length]) != struct.unpack("<I", raw[length:])[0]:
            raise ValueError("a block's checksum is wrong")
        at, key = 0, b""
        while at < length:
            shared, at = _read_varint(raw, at)
            unshared, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key, at = key[:shared] + raw[at : at + unshared], at + unshared
            n, start = _read_varint(raw, at)
            yield key, before, n, raw[start : at + size]
            before, at = before + n, at + size

    def __iter__(self) -> Iterator[tuple[bytes, int, int, bytes]]:
        for k in range(len(self.index)):
            yield from self.entries(k)

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            self.file.seek(self.bloom_at)
            self.bloom = np.frombuffer(self.file.read(self.bits // 8), np.uint8)
        bits = self.bloom
        at = _bloom_places([key], self.bits)[0]
        return bool(np.all(bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1))

    def get(self, key: bytes) -> list[tuple[int, int, bytes]]:
        """All entries of a key as (ids before it, n_tokens, ids): Bloom filter, binary search, then blocks."""
        if not self.index or not self.may_hold(key):
            return []
        k, found = max(0, bisect_right(self.firsts, key) - 1), []
        while k > 0 and self.firsts[k] == key:
            k -= 1
        while k < len(self.index) and self.firsts[k] <= key:
            found += [x[1:] for x in self.entries(k) if x[0] == key]
            k += 1
        return found


# --- Spark ------------------------------------------------------------------------------------


def _store(path: str):
    """The file system of a path, and the path in it. Hadoop's names of stores become those that Arrow knows; plain paths are local or mounted."""
    from pyarrow import fs

    scheme, colon, rest = path.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}.get(scheme, scheme) + colon + rest)


def _open(path: str, write: bool):
    store, inner = _store(path)
    return store.open_output_stream(inner) if write else store.open_input_file(inner)


def _folder(path: str) -> None:
    store, inner = _store(path)
    store.create_dir(inner, recursive=True)


SHARD = "path string, first binary, first_hash long, n_docs long, n_tokens long, n_bytes long"


def write_tables(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int | None = 0) -> list[dict]:
    """Writes docs as shards below folder and returns the shards in key order, with `start`, the ids before each."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder)
    folder = "file://" + folder.removeprefix("file://").removeprefix("file:") if folder.startswith("file:") else folder
    _folder(folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, first = None, "", None
        for batch in batches:
            for part in _parts(batch, 4 << 20):
                enc = encoder(tokenizer)
                ids, offsets = enc.encode(part.column(1))
                if end_id is not None:
                    n = np.arange(1, len(offsets))
                    ids, offsets = np.insert(ids, offsets[1:], enc.dtype.type(end_id)), np.concatenate([[0], offsets[1:] + n])
                raw, width = ids.tobytes(), enc.dtype.itemsize
                for k, h, a, b in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    if writer is None:
                        path = f"{folder}/{uuid4().hex}.sst"
                        writer, first = TableWriter(_open(path, True)), (key_bytes(k), h)
                    writer.add(key_bytes(k), raw[a * width : b * width], b - a)
        if writer is not None:
            writer.close()
            writer.file.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first": [first[0]], "first_hash": [first[1]], "n_docs": [len(writer.keys)], "n_tokens": [writer.tokens], "n_bytes": [writer.at]})

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("h"))
    shards = [r.asDict() for r in rows.repartitionByRange("key", "h").sortWithinPartitions("key", "h").mapInArrow(encode, SHARD).collect()]
    shards.sort(key=lambda s: (bytes(s["first"]), s["first_hash"]))
    start = 0
    for s in shards:
        s["start"], start = start, start + s["n_tokens"]
    return shards


def _parts(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch cut into ranges of rows with about limit bytes of text, the second column."""
    from .textcols import slices, utf8

    for a, b in slices(utf8(batch.column(1))[1], limit):
        yield batch.slice(a, b - a)


def read_tables(spark: SparkSession, shards: list[dict], wide: bool = False, key_type: str = "bigint") -> DataFrame:
    """All documents of the shards: key, start (ids before it), n_tokens and ids (binary, little-endian, 4 bytes each)."""
    stored = np.dtype("<u4" if wide else "<u2")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _open(path, False) as file:
                    rows, held = [], 0
                    for key, start, n, ids in TableReader(file):
                        rows.append((key_of(key), before + start, n, np.frombuffer(ids, stored).astype("<u4").tobytes()))
                        held += n
                        if held > 1 << 21:
                            yield _rows(rows, kind)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows, kind)

    kind = pa.string() if key_type == "string" else pa.int64()
    schema = f"key {key_type}, start bigint, n_tokens bigint, ids binary"
    if not shards:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start bigint")
    return listed.repartition(len(shards), "path").mapInArrow(read, schema)


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    keys, starts, counts, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["key", "start", "n_tokens", "ids"])


def lookup(keys: DataFrame, shards: list[dict], key: str, wide: bool = False) -> DataFrame:
    """The documents of the given keys. Each key goes to the shards whose range can hold it, and there by binary search."""
    firsts, stored = [bytes(s["first"]) for s in shards], np.dtype("<u4" if wide else "<u2")
    kind = keys.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int64()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, TableReader | None] = (-1, None)
        for batch in batches:
            rows = []
            for raw, k in sorted((key_bytes(x), x) for x in batch.column(0).to_pylist()):
                at = max(0, bisect_right(firsts, raw) - 1)
                while at > 0 and firsts[at] == raw:
                    at -= 1
                while at < len(firsts) and firsts[at] <= raw:
                    if opened[0] != at:
                        opened = (at, TableReader(_open(shards[at]["path"], False)))
                    rows += [(k, shards[at]["start"] + s, n, np.frombuffer(ids, stored).astype("<u4").tobytes()) for s, n, ids in opened[1].get(raw)]
                    at += 1
            if rows:
                yield _rows(rows, arrow)

    return keys.select(key).repartitionByRange(key).mapInArrow(find, schema)
