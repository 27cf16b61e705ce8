"""Substring deduplication by a depth-limited radix sort: bytes in windows of WINDOW bytes that also start elsewhere go.

The suffixes of all texts are sorted, most significant digit first, and only as deep as a window. The first digit of a
window is its anchor, the smallest fingerprint of its GRAM-byte strings; windows that follow each other mostly share it,
so a run of them is one row. Runs whose anchor occurs in no other place hold no repeated window and go. Of runs with
equal bytes two stay, enough for their windows to meet, whatever their number. Anchors that more than HOT
different runs share, say a common line in ever new surroundings, are dealt by the next digit: the smallest fingerprint
after those before, up to DIGITS of them, then by how far before the first of them they begin, in ever smaller
cells, and at last by the fingerprint of the whole window. Only one run of each kind is looked at again. The runs that are left are
dealt to shards by their digits, so that equal windows meet, and each shard goes on with digits of eight bytes: groups
that fall apart are sorted, single suffixes leave, and after the last digit the groups that remain are exactly the
repeated windows. What a shard finds in a run holds for all runs with equal bytes.

Fingerprints have 64 bits. Matches never cross documents, and windows are judged on the input. Null texts are empty;
texts shorter than a window lose nothing; long texts are read in blocks of BLOCK bytes; rows that repeat an id and a text
count as documents of their own, so they lose all windows; ties and runs of one byte are windows that repeat at the next
place. An empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import discard, stage
from .textcols import _BYTE_CODES, _power, mix, utf8

WINDOW, GRAM = 400, 64
#: Bytes read at once, windows in a run at most, and bytes sorted at once, about.
BLOCK, LONGEST, SORT_BYTES = 1 << 19, 2048, 1 << 20
#: Different runs of an anchor from which on the next digit is looked at, the number of anchors looked at, and windows in a cell.
HOT, DIGITS, CELLS = 500, 2, [32, 8, 2]
WORD = 8
TOP = np.uint64(2**64 - 1)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of data[starts:ends]."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def smallest(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of each reach consecutive values."""
    size = 1
    while size < reach:
        jump = min(size, reach - size)
        values = np.minimum(values[jump:], values[:-jump])
        size += jump
    return values


def runs(data: np.ndarray, owner: np.ndarray, at: np.ndarray, digits: int, window: int, gram: int, cell: int = 0) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, key, fingerprint of the bytes, again) of the runs among the windows that start at `at`.

    owner numbers what a window must not leave; its equal values lie together. The windows of a run follow each other and
    agree in their `digits` smallest fingerprints, and with a cell in how many cells before the first of them they begin;
    without digits each window is a run. again: 1 where the first of these
    fingerprints lies at several places of the run, so that its windows can repeat within it.
    """
    if not len(at):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    if not digits:
        prints = strings(data, at, at + window)
        return at, np.ones(len(at), np.int64), prints, prints, np.zeros(len(at), np.int64)
    grams = np.arange(len(data) - gram + 1)
    value = strings(data, grams, grams + gram)
    least = smallest(value, window - gram + 1)[at]
    cut = np.append(True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))
    keys = [least]
    cut[1:] |= least[1:] != least[:-1]
    for _ in range(digits - 1):
        # The digit before doesn't count any more in the windows that have it; windows of one run lie together.
        begin = np.flatnonzero(cut)
        length = np.diff(np.append(begin, len(at)))
        parts, where, size = [], np.empty(len(at), np.int64), 0
        for a, n in zip(begin.tolist(), length.tolist(), strict=True):
            own = value[at[a] : at[a] + n + window - gram]
            parts.append(np.where(np.isin(own, [k[a] for k in keys]), TOP, own))
            where[a : a + n] = np.arange(size, size + n)
            size += len(own)
        least = smallest(np.concatenate(parts), window - gram + 1)[where]
        keys.append(least)
        cut[1:] |= least[1:] != least[:-1]
    if cell:
        begin = np.flatnonzero(cut)
        before = np.empty(len(at), np.int64)
        for a, n in zip(begin.tolist(), np.diff(np.append(begin, len(at))).tolist(), strict=True):
            found = np.flatnonzero(value[at[a] : at[a] + n + window - gram] == keys[0][a])
            before[a : a + n] = (found[np.searchsorted(found, np.arange(n))] - np.arange(n)) // cell
        keys.append(before.astype(np.uint64))
        cut[1:] |= before[1:] != before[:-1]
    begin = np.flatnonzero(cut)
    length = np.diff(np.append(begin, len(at)))
    pieces = -(-length // LONGEST)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(begin, pieces) + step * LONGEST
    length = np.minimum(np.repeat(length, pieces) - step * LONGEST, LONGEST)
    start = at[begin]
    key = keys[0][begin]
    for k in keys[1:]:
        key = mix(key * np.uint64(3) + k[begin])
    reach = length + window - gram
    first = np.cumsum(reach) - reach
    inside = np.arange(reach.sum()) + np.repeat(start - first, reach)
    again = np.add.reduceat(value[inside] == np.repeat(keys[0][begin], reach), first, dtype=np.int64) > 1
    return start, length, key, strings(data, start, start + length + window - 1), again.astype(np.int64)


def run_table(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, bytes, again, r1, r2, start, n): the runs by first digits of the documents (r1, r2, text)."""
    names = ["key", "bytes", "again", "r1", "r2", "start", "n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a in range(0, max(len(data) - window + 1, 0), BLOCK):
                part = data[a : a + BLOCK + window - 1]
                at = np.arange(a, min(a + BLOCK, len(data) - window + 1))
                doc = np.searchsorted(offsets, at, "right") - 1
                fits = at + window <= offsets[doc + 1]
                owner = np.zeros(len(part), np.int64)
                owner[: len(doc)] = doc
                start, n, key, prints, again = runs(part, owner, at[fits] - a, 1, window, gram)
                row = pa.array(owner[start])
                first = start + a - offsets[owner[start]]
                yield pa.RecordBatch.from_arrays([*_named(key, prints, again), batch.column(0).take(row), batch.column(1).take(row), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=names)

    return docs.mapInArrow(read, "key long, bytes long, again byte, r1 long, r2 long, start int, n int")


def _named(key: np.ndarray, prints: np.ndarray, again: np.ndarray) -> list[pa.Array]:
    return [pa.array(key.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(again.astype(np.int8))]


def _items(items: pa.Array, *fields: str) -> list[np.ndarray]:
    flat = items.flatten()
    return [flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]


def pieces_of(texts: DataFrame, places: DataFrame, window: int, *name: str) -> DataFrame:
    """(key, bytes, hot, copies, run): the bytes of places (name, start, n, key, bytes, hot, copies) of texts (name, data)."""
    listed = places.groupBy(*name).agg(F.collect_list(F.struct("key", "bytes", "hot", "copies", "start", "n")).alias("items"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw, items = batch.column(0)[row].as_buffer().to_pybytes(), batch.column(1).slice(row, 1)
                start, n = _items(items, "start", "n")
                runs = pa.array([raw[a:b] for a, b in zip(start.tolist(), (start + n + window - 1).tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[items.flatten().field(f) for f in ("key", "bytes", "hot", "copies")], runs], names=["key", "bytes", "hot", "copies", "run"])

    # Rows that agree in everything are read once.
    return texts.join(listed, [*name]).dropDuplicates([*name]).select("data", "items").mapInArrow(cut, "key long, bytes long, hot boolean, copies long, run binary")


def refined(whole: DataFrame, places: DataFrame, digits: int, cell: int, window: int, gram: int) -> DataFrame:
    """(key, bytes, again, name, start, n, copies): places (name, start, n, copies) of the runs whole (name, data) as runs by
    so many digits and in cells of so many windows, or window by window for no digits."""
    listed = places.groupBy("name").agg(F.collect_list(F.struct("start", "n", "copies")).alias("items"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = utf8(batch.column(1).view(pa.string()))
            begins, sizes, weights = _items(batch.column(2), "start", "n", "copies")
            of = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            ends = np.cumsum(sizes + window - 1)
            a = 0
            while a < len(of):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK)))
                n, low = sizes[a:b], offsets[of[a:b]] + begins[a:b]
                begin = ends[a:b] - (n + window - 1) - (ends[a - 1] if a else 0)
                part = np.concatenate([data[x : x + m + window - 1] for x, m in zip(low.tolist(), n.tolist(), strict=True)])
                owner = np.repeat(np.arange(b - a), n + window - 1)
                at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
                start, m, key, prints, again = runs(part, owner, at, digits, window, gram, cell)
                which = owner[start]
                place = start - begin[which] + begins[a:b][which]
                yield pa.RecordBatch.from_arrays([*_named(key, prints, again), batch.column(0).take(pa.array(of[a:b][which])), pa.array(place.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(weights[a:b][which])], names=["key", "bytes", "again", "name", "start", "n", "copies"])
                a = b

    return whole.join(listed, "name").select("name", "data", "items").mapInArrow(read, "key long, bytes long, again byte, name long, start int, n int, copies long")


def repeated_in_shard(keys: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first window, last + 1) of the windows that occur twice or more among a shard's runs.

    A suffix is the place of a window. Groups begin as the runs of one key; each pass looks at the next WORD bytes of all
    suffixes left, sorts the groups that disagree there, and drops suffixes that stand alone.
    """
    # Runs by key, then their places: 32 bits each, as a shard's bytes are few. The owner of a place is found at the end.
    n = np.diff(offsets) - window + 1
    order = np.argsort(keys, kind="stable")
    rank = np.cumsum(np.append(0, keys[order][1:] != keys[order][:-1]), dtype=np.int32) if len(keys) else np.zeros(0, np.int32)
    m = n[order]
    group = np.repeat(rank, m)
    place = np.arange(len(group), dtype=np.int32)
    place += np.repeat((offsets[:-1][order] - (np.cumsum(m) - m)).astype(np.int32), m)
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
    word = np.zeros(len(data), np.uint64)
    for j in range(WORD):
        word = (word << np.uint64(8)) | padded[j : j + len(data)]
    for depth in [*range(0, window - WORD, WORD), window - WORD] if window >= WORD else [0]:
        digit = word[place + depth]
        if window < WORD:
            digit = digit >> np.uint64(8 * (WORD - window))
        together = group[1:] == group[:-1]
        differs = np.append(False, together & (digit[1:] != digit[:-1]))
        if differs.any():
            broken = np.zeros(int(group[-1]) + 1, bool)
            broken[group[differs]] = True
            mixed = np.flatnonzero(broken[group]).astype(np.int32)
            turn = mixed[np.lexsort((digit[mixed], group[mixed]))]
            place[mixed], digit[mixed] = place[turn], digit[turn]
        head = np.append(True, ~together | (digit[1:] != digit[:-1])) if len(group) else np.zeros(0, bool)
        alone = head & np.append(head[1:], True)
        group = np.cumsum(head, dtype=np.int32)
        if alone.any():
            place, group = place[~alone], group[~alone]
    hit = np.sort(place)
    head = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1)) if len(hit) else np.zeros(0, np.int64)
    owner = np.searchsorted(offsets, hit, "right") - 1
    if len(hit):
        head = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1])))
    last = hit[np.append(head[1:], len(hit)) - 1] if len(hit) else hit
    return owner[head], hit[head] - offsets[owner[head]], last + 1 - offsets[owner[head]]


def judged(level: DataFrame, hot: bool, *place: str) -> DataFrame:
    """(key, bytes, copies, a, b, hot) of the different runs of a level whose key lies at several places; a and b are two of a
    run's places, the same twice if there is no other."""
    at = F.struct(*place, "start", "n")
    kinds = stage(level.groupBy("key", "bytes").agg(F.sum("copies").alias("copies"), F.max("again").alias("again"), F.min(at).alias("a"), F.max(at).alias("b")))
    keys = kinds.groupBy("key").agg(F.sum("copies").alias("occurs"), F.count("*").alias("kinds"), F.max("again").alias("again")).filter("occurs > 1 OR again > 0")
    kept = stage(kinds.join(keys.select("key", ((F.col("kinds") > HOT) & F.lit(hot)).alias("hot")), "key").drop("again"))
    discard(kinds)
    return kept


def _places(kept: DataFrame) -> DataFrame:
    """Two places of each run that occurs twice or more, so that its windows meet; one of those that are looked at again."""
    both = F.when((F.col("copies") > 1) & ~F.col("hot"), F.array("a", "b")).otherwise(F.array("a"))
    return kept.select("key", "bytes", "hot", "copies", F.explode(both).alias("at")).select("key", "bytes", "hot", "copies", "at.*")


def repeated(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(r1, r2, start, found): by run, which of its windows, from first to before last, occur elsewhere too."""
    first = stage(run_table(docs, window, gram))
    kept = judged(first.withColumn("copies", F.lit(1).cast("long")), True, "r1", "r2")
    pieces = stage(pieces_of(docs.withColumnRenamed("text", "data"), _places(kept), window, "r1", "r2"))
    found = [stage(in_shards(pieces.filter("NOT hot"), window)).select(F.col("bytes").alias("name"), "first", "last")]
    whole = pieces.filter("hot").select(F.col("bytes").alias("name"), F.col("run").alias("data"))
    places = kept.filter("hot").select(F.col("bytes").alias("name"), F.lit(0).alias("start"), "a.n", "copies")
    levels, cold, used = [], [], [kept]
    for step, (digits, cell) in enumerate([*[(d, 0) for d in range(2, DIGITS + 1)], *[(DIGITS, c) for c in CELLS], (0, 0)]):
        if places.isEmpty():
            break
        # Keys and names of bytes are of their own in each step, so that all steps can be sorted together.
        own = {c: F.xxhash64(c, F.lit(step)) for c in ("key", "bytes")}
        level = stage(refined(whole, places, digits, cell, window, gram).withColumns(own))
        kept = judged(level, digits > 0, "name")
        levels.append(level)
        cold.append(_places(kept.filter("NOT hot")))
        places = level.join(kept.filter("hot").select("bytes"), "bytes", "left_semi").groupBy("name", "start", "n").agg(F.sum("copies").alias("copies"))
        used += [level, kept]
    if levels:
        every = reduce(DataFrame.unionByName, levels).select("bytes", "name", "start")
        sorted_runs = stage(in_shards(pieces_of(whole, reduce(DataFrame.unionByName, cold), window, "name"), window))
        found.append(sorted_runs.join(every, "bytes").select("name", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")))
    every = reduce(DataFrame.unionByName, found)
    # A run has LONGEST windows at most, and so many intervals.
    merged = stage(every.groupBy("name").agg(F.collect_set(F.struct("first", "last")).alias("found")).mapInArrow(_merged, "name long, found array<struct<first:long,last:long>>"))
    discard(*used, pieces)
    return first.join(merged.withColumnRenamed("name", "bytes"), "bytes").select("r1", "r2", "start", "found")


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        spans = [[{"first": a, "last": b} for a, b in _joined([(x["first"], x["last"]) for x in found])] for found in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["name", "found"])


def in_shards(pieces: DataFrame, window: int) -> DataFrame:
    """(bytes, first, last): the repeated windows of the runs (key, bytes, run), by the fingerprint of the run's bytes."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            end = np.cumsum(pc.binary_length(batch.column(2)).to_numpy())
            # A key is sorted as a whole: cuts lie where a new one begins.
            fresh = np.flatnonzero(np.append(key[0] != last, key[1:] != key[:-1]))
            begin, before = 0, 0
            for p in fresh.tolist():
                here = int(end[p - 1]) if p else 0
                if size + here - before >= SORT_BYTES:
                    yield sorted_out([*held, batch.slice(begin, p - begin)])
                    held, size, begin, before = [], 0, p, here
            held.append(batch.slice(begin))
            size += int(end[-1]) - before
            last = key[-1]
        if held:
            yield sorted_out(held)

    def sorted_out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, names = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        values = [v for b in held for v in b.column(2).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
        run, first, last = repeated_in_shard(keys, np.frombuffer(b"".join(values), np.uint8), offsets, window)
        return pa.RecordBatch.from_arrays([pa.array(names[run]), pa.array(first), pa.array(last)], names=["bytes", "first", "last"])

    shards = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces.sparkSession.sparkContext.defaultParallelism)
    return pieces.select("key", "bytes", "run").repartition(shards, "key").sortWithinPartitions("key").mapInArrow(shard, "bytes long, first long, last long").distinct()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, n_bytes, n_removed, removed (from, to) and kept: the bytes not covered by a repeated window."""
    if gram > window:
        raise ValueError("gram has to fit into a window")
    rows = docs.select(F.xxhash64(docs[key], docs[text]).alias("r1"), F.xxhash64(F.lit(1), docs[key], docs[text]).alias("r2"), docs[key].alias("key"), docs[text].alias("text"))
    found = repeated(rows.select("r1", "r2", "text"), window, gram).groupBy("r1", "r2").agg(F.collect_set(F.struct("start", "found")).alias("found"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for value, own in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                out = _joined([(o["start"] + x["first"], o["start"] + x["last"] + window - 1) for o in own or () for x in o["found"]])
                edges = [0, *[e for span in out for e in span], len(raw)]
                sizes.append(len(raw))
                spans.append([{"from": a, "to": b} for a, b in out])
                kept.append(b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
            gone = pa.array([sum(s["to"] - s["from"] for s in x) for x in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), gone, pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.binary())], names=["key", "n_bytes", "n_removed", "removed", "kept"])

    span = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span), T.StructField("kept", T.BinaryType())])
    return rows.join(found, ["r1", "r2"], "left").select("key", "text", "found").mapInArrow(drop, schema)
