"""Substring deduplication: words in windows of WINDOW words that also start elsewhere are removed.

Equal windows have to meet. A window's anchor is the smallest fingerprint of its ANCHOR-word sequences;
a run of windows of one document with the same anchor is a segment. An anchor that occurs once has no
equal windows and is dropped. Of all segments with equal words one is kept, with their number. The
remaining segments are dealt to shards by anchor, and each shard builds a compressed FM-index over its
segments. The documents' segments are then streamed through it: backward search over the wavelet matrix
gives the matching statistics at each window's end, and windows whose match reaches WINDOW words, or
whose segment has copies, are reported as intervals. These go back to all segments with the same words,
and each document drops the words that its intervals cover.

An anchor with more than HOT different segments, say a very common line in ever new surroundings, would
make one large shard. Its segments are cut into their windows, which are segments of their own: one of all
windows with equal words is kept, with their number, those that occur once are dropped, and the others are
dealt to the shards by their words. What the shards report goes back to all windows with the same words.

Words are compared by 64-bit fingerprints. Windows are judged on the input. Null texts have no words;
texts shorter than a window lose nothing; long texts are held one at a time; rows that repeat a key and
text count as two documents and lose the same words; an empty table gives an empty table. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import DEPTH, FMIndex
from .staging import discard, release, stage
from .textcols import _power, mix, ngram_hashes, slices, spans, utf8, word_hashes

WINDOW, ANCHOR = 35, 8
HOT = 500
SLICE_BYTES = 4 << 20
#: Words of a shard's segments, about.
SHARD_WORDS = 1_000_000


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    starts, ends, first = spans(data, offsets)
    return word_hashes(data, starts, ends), first


def sequence_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of the word sequences h[a:b]."""
    up, down = _power(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def segments(h: np.ndarray, first: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word in it, number of windows, anchor, fingerprint of the words) of each segment."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none, none
    value, place = ngram_hashes(h, anchor), np.arange(len(h) - anchor + 1)
    size, reach = 1, window - anchor + 1
    while size < reach:
        jump = min(size, reach - size)
        less = value[jump:] < value[:-jump]
        value, place = np.where(less, value[jump:], value[:-jump]), np.where(less, place[jump:], place[:-jump])
        size += jump
    at = np.arange(len(value))
    doc = np.searchsorted(first, at, "right") - 1
    at = at[at + window <= first[doc + 1]]
    if not len(at):
        return none, none, none, none, none
    doc = doc[at]
    head = np.ones(len(at), bool)
    head[1:] = (place[at[1:]] != place[at[:-1]]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(head)
    n = np.diff(np.append(begin, len(at)))
    start = at[begin]
    words = sequence_hashes(h, start, start + n + window - 1)
    return doc[begin], start - first[doc[begin]], n, value[start].astype(np.int64), words.astype(np.int64)


def segment_table(docs: DataFrame) -> DataFrame:
    """(anchor, segment, row, start, n) of the rows (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices(utf8(batch.column(1))[1], SLICE_BYTES):
                doc, start, n, anchor, words = segments(*_hashes(batch.column(1).slice(a, b - a)))
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(words), pa.array(rows[a:b][doc]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int16))], names=["anchor", "segment", "row", "start", "n"])

    return docs.select("row", "text").mapInArrow(run, "anchor long, segment long, row long, start int, n short")


def repeated_in_shard(names: np.ndarray, weights: np.ndarray, words: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to) of the windows that occur twice or more among a shard's segments."""
    symbols = np.unique(words, return_inverse=True)[1] + 1
    index = FMIndex(symbols, offsets, max(DEPTH, window))
    n = np.diff(offsets) - window + 1
    owner = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    match = index.matching_statistics(symbols, offsets[owner] + number + window, window)
    hit = np.flatnonzero((match >= window) | (weights[owner] > 1))
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    head = np.ones(len(hit), bool)
    head[1:] = (owner[hit[1:]] != owner[hit[:-1]]) | (number[hit[1:]] != number[hit[:-1]] + 1)
    a = np.flatnonzero(head)
    last = np.append(a[1:], len(hit)) - 1
    return names[owner[hit[a]]], number[hit[a]], number[hit[last]] + 1


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, from, to): runs of windows of the rows (row, text) that start elsewhere too, as first and last + 1 window."""
    all_segments = stage(segment_table(docs))
    distinct = all_segments.groupBy("anchor", "segment").agg(F.count("*").alias("copies"), F.min(F.struct("row", "start", "n")).alias("at"))
    distinct = stage(distinct)
    anchors = distinct.groupBy("anchor").agg(F.sum("copies").alias("occurs"), F.count("*").alias("kinds")).filter("occurs > 1").select("anchor", (F.col("kinds") > HOT).alias("hot"))
    kept = distinct.join(anchors, "anchor").select("anchor", "segment", "copies", "hot", "at.row", "at.start", "at.n")
    by_row = kept.groupBy("row").agg(F.collect_list(F.struct("anchor", "segment", "copies", "hot", "start", "n")).alias("items"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(utf8(batch.column(0))[1], SLICE_BYTES):
                h, first = _hashes(batch.column(0).slice(a, b - a))
                items = batch.column(1).slice(a, b - a)
                doc = np.repeat(np.arange(b - a), items.value_lengths().to_numpy(zero_copy_only=False))
                flat = items.flatten()
                col = lambda name: flat.field(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                start, n, hot = first[doc] + col("start"), col("n").astype(np.int64), col("hot").astype(bool)
                anchor, segment, copies = col("anchor"), col("segment"), col("copies")
                whole, raw = np.flatnonzero(~hot), h.view(np.uint8).tobytes()
                yield _pieces(anchor[whole], segment[whole], np.zeros(len(whole), np.int16), copies[whole], [raw[8 * i : 8 * j] for i, j in zip(start[whole].tolist(), (start + n + window - 1)[whole].tolist(), strict=True)])
                if hot.any():
                    k = np.repeat(np.flatnonzero(hot), n[hot])
                    offset = np.arange(len(k)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
                    prints = sequence_hashes(h, start[k] + offset, start[k] + offset + window).astype(np.int64)
                    yield _pieces(prints, segment[k], offset.astype(np.int16), copies[k], [None] * len(k))

    pieces = stage(docs.join(by_row, "row").select("text", "items").mapInArrow(cut, "route long, segment long, offset short, copies long, words binary"))
    release(docs.sparkSession)
    total = pieces.filter("words is not null").agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    # Windows of hot anchors: one of each kind that occurs twice or more.
    windows = pieces.filter("words is null").select("route", "segment", "offset", "copies")
    kinds = windows.groupBy("route").agg(F.sum("copies").alias("copies"), F.min(F.struct("segment", "offset")).alias("at")).filter("copies > 1").select("route", "copies", "at.segment", "at.offset")
    placed = kinds.join(kept.filter("hot").select("segment", "row", "start"), "segment").select("row", F.struct("route", "copies", (F.col("start") + F.col("offset")).alias("start")).alias("item"))
    by_row = placed.groupBy("row").agg(F.collect_list("item").alias("items"))

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(utf8(batch.column(0))[1], SLICE_BYTES):
                h, first = _hashes(batch.column(0).slice(a, b - a))
                items = batch.column(1).slice(a, b - a)
                flat, doc = items.flatten(), np.repeat(np.arange(b - a), items.value_lengths().to_numpy(zero_copy_only=False))
                start, raw = (first[doc] + flat.field("start").to_numpy()).tolist(), h.view(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([flat.field("route"), flat.field("copies"), pa.array([raw[8 * i : 8 * (i + window)] for i in start], pa.binary())], names=["route", "copies", "words"])

    hot = stage(docs.join(by_row, "row").select("text", "items").mapInArrow(cut_windows, "route long, copies long, words binary"))
    release(docs.sparkSession)
    total += hot.count() * window
    shards = max(int(total // SHARD_WORDS) + 1, docs.sparkSession.sparkContext.defaultParallelism)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, words, whole = [], [], [], []
        for batch in batches:
            names.append(batch.column(0).to_numpy())
            weights.append(batch.column(1).to_numpy())
            words += batch.column(2).to_pylist()
            whole.append(batch.column(3).to_numpy(zero_copy_only=False))
        if words:
            offsets = np.concatenate([[0], np.cumsum([len(w) // 8 for w in words])]).astype(np.int64)
            number, low, high = repeated_in_shard(np.arange(len(words)), np.concatenate(weights), np.frombuffer(b"".join(words), np.uint64), offsets, window)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)[number]), pa.array(low), pa.array(high), pa.array(np.concatenate(whole)[number])], names=["name", "first", "last", "whole"])

    cold = pieces.filter("words is not null").select("route", F.col("segment").alias("name"), "copies", "words", F.lit(True).alias("whole"))
    dealt = cold.unionByName(hot.select("route", F.col("route").alias("name"), "copies", "words", F.lit(False).alias("whole")))
    searched = dealt.repartition(shards, "route").select("name", "copies", "words", "whole").mapInArrow(shard, "name long, first long, last long, whole boolean")
    searched = stage(searched)
    counted = windows.join(searched.filter("not whole").select(F.col("name").alias("route")), "route").select("segment", F.col("offset").cast("long").alias("first"), (F.col("offset") + 1).cast("long").alias("last"))
    found = stage(searched.filter("whole").select(F.col("name").alias("segment"), "first", "last").unionByName(counted))
    discard(distinct, pieces, hot, searched)
    release(docs.sparkSession)
    return all_segments.join(found, "segment").select("row", (F.col("start") + F.col("first")).cast("int").alias("from"), (F.col("start") + F.col("last")).cast("int").alias("to"))


def _pieces(route: np.ndarray, segment: np.ndarray, offset: np.ndarray, copies: np.ndarray, words: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(route), pa.array(segment), pa.array(offset), pa.array(copies), pa.array(words, pa.binary())], names=["route", "segment", "offset", "copies", "words"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, n_words, n_removed and kept: the words not covered by a repeated window, joined by one space."""
    rows = docs.select(F.xxhash64(docs[key], docs[text]).alias("row"), docs[key].alias("key"), docs[text].alias("text"))
    runs = stage(repeated(rows.select("row", "text"), window).groupBy("row").agg(F.collect_set(F.struct("from", "to")).alias("runs")))
    release(docs.sparkSession)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                ws = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                n = len(ws)
                if found:
                    edge = np.zeros(n + 1, np.int64)
                    for r in found:
                        edge[r["from"]] += 1
                        edge[min(n, r["to"] + window - 1)] -= 1
                    ws = list(compress(ws, (np.cumsum(edge[:n]) == 0).tolist()))
                counts.append(n)
                removed.append(n - len(ws))
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["key", "n_words", "n_removed", "kept"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return rows.join(runs, "row", "left").select("key", "text", "runs").mapInArrow(drop, schema)
