"""Approximate nearest neighbours by learned partitions.

On a sample of SAMPLE vectors at most, taken in hash order of their ids, a graph of nearest neighbours
is cut into parts of equal size: recursive bisection at the median of a slowly varying vector of the
graph, then swaps of pairs that cut fewer edges. A small network learns a vector's part. It files every
vector of the table under its most probable part, and sends a query to its most probable parts, as many
as the calibration on the sample asks for to reach TARGET recall there. All vectors of those parts are
ranked by their exact distance. A part with many rows is split into blocks by a hash of the id; a query
visits all blocks of its parts, so one very frequent vector never makes a large task.

Distances are Euclidean, in double precision, on the original vectors; ties go to the smaller id; a
query never finds its own id. Vectors that are null, zero, of another length than the sample's most
frequent one, or hold null or non-finite components take no part, nor do null ids. A query whose parts
hold fewer than k others visits more parts, all if need be. Rows that repeat an id are candidates each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 4_096
TARGET = 0.95
#: Rows of a block, about: at least the first, more where a part would have more than BLOCKS blocks, at most the second. A query
#: is copied once for each block that it visits.
BLOCK_ROWS, MOST_BLOCK_ROWS, BLOCKS = 2_048, 65_536, 64
PARTS = 16


@dataclass
class Model:
    """A network of one hidden layer: logits of the parts; probes is how many of them a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int
    size: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def usable(vector: Column, size: int | None = None) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine & (F.size(vector) == size) if size else fine, F.lit(False))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    out, norms = np.empty((len(x), min(k, len(x) - 1)), np.int64), (x * x).sum(1)
    for a in range(0, len(x), 1024):
        d = norms[None] - 2 * x[a : a + 1024] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 1024] = np.argpartition(d, out.shape[1] - 1, 1)[:, : out.shape[1]]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each node of a neighbour graph; parts, a power of two, differ by one node at most before refinement and keep their sizes in it."""
    n = len(graph)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    label, step = np.zeros(n, np.int64), 1
    while step < parts:
        inner = label[a] == label[b]
        x, y = a[inner], b[inner]
        degree = np.bincount(x, minlength=n) + 1.0
        v = rng.normal(size=n)
        for _ in range(60):  # smooth along edges, without the part's mean: tends to the slowest mode of each part
            v = (v + np.bincount(x, v[y], n)) / degree
            v -= (np.bincount(label, v, step) / np.maximum(1, np.bincount(label, minlength=step)))[label]
            v /= np.sqrt(np.bincount(label, v * v, step) + 1e-30)[label]
        order = np.lexsort((v, label))
        sizes = np.bincount(label, minlength=step)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        label, step = label * 2 + (rank >= sizes[label] / 2), step * 2
    for _ in range(8):  # swap the best movers of each pair of parts, in equal numbers
        links = np.bincount(a * parts + label[b], minlength=n * parts).reshape(n, parts)
        gain = links - links[np.arange(n), label][:, None]
        gain[np.arange(n), label] = -1
        to, moved = gain.argmax(1), 0
        best = gain[np.arange(n), to]
        for p in range(parts):
            for q in range(p + 1, parts):
                u, w = (np.flatnonzero((label == i) & (to == j) & (best > 0)) for i, j in ((p, q), (q, p)))
                m = min(len(u), len(w))
                u, w = u[np.argsort(-best[u], kind="stable")][:m], w[np.argsort(-best[w], kind="stable")][:m]
                label[u], label[w], moved = q, p, moved + m
        if not moved:
            break
    return label


def train(x: np.ndarray, parts: int = PARTS, hidden: int = 128, epochs: int = 20, seed: int = 5) -> Model:
    """Fits partition and network to sample vectors and calibrates the number of probes."""
    rng = np.random.default_rng(seed)
    size = x.shape[1] if len(x) else 0
    while parts > 1 and len(x) < 8 * parts:
        parts //= 2
    w1, w2 = rng.normal(size=(size, hidden)) * np.sqrt(2 / max(1, size)), rng.normal(size=(hidden, parts)) * 0.1
    model = Model(w1, np.zeros(hidden), w2, np.zeros(parts), parts, size)
    if parts == 1:
        return model
    graph = neighbours(x, 10)
    label = balanced_parts(graph, parts, rng)
    scale = np.sqrt((x * x).mean()) + 1e-12
    soft = np.eye(parts)[label] + np.eye(parts)[label[graph]].sum(1)
    soft /= soft.sum(1, keepdims=True)
    weights = [model.w1, model.b1, model.w2, model.b2]
    mean, square, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = order[a : a + 256]
            v = x[rows] / scale
            h = np.maximum(v @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - soft[rows]) / len(rows)
            back = (d @ weights[2].T) * (h > 0)
            grads, t = [v.T @ back, back.sum(0), h.T @ d, d.sum(0)], t + 1
            for k, g in enumerate(grads):
                g = g + 1e-4 * weights[k]
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                weights[k] -= 2e-3 * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)
    weights[0] /= scale
    model = Model(*weights, parts, size)
    z = model.logits(x)
    filed, order = z.argmax(1), np.argsort(-z, 1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None], 1)
    needed = place[np.repeat(np.arange(len(x)), graph.shape[1]), filed[graph.ravel()]]
    share = np.cumsum(np.bincount(needed, minlength=parts)) / len(needed)
    model.probes = int(np.searchsorted(share, TARGET) + 1)
    return model


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", **options) -> Model:
    """Trains on the SAMPLE vectors with the smallest hashes of their ids."""
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).collect()
    sizes = Counter(len(r[0]) for r in rows)
    size = max(sizes, key=lambda s: (sizes[s], s)) if sizes else 0
    sample = [r[0] for r in rows if len(r[0]) == size]
    return train(np.array(sample, np.float64) if sample else np.zeros((0, 0)), **options)


def blocks_of(rows: int) -> int:
    """Into how many blocks a part of so many rows is split."""
    return max(1, -(-rows // min(MOST_BLOCK_ROWS, max(BLOCK_ROWS, rows // BLOCKS))))


def search(vectors: DataFrame, queries: DataFrame, model: Model, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): each query's k nearest vectors other than its own id, among the parts it visits."""
    kind = vectors.schema[vector].dataType.simpleString()
    take = lambda df: df.filter(F.col(key).isNotNull() & usable(F.col(vector), model.size or None)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))

    def matrix(column: pa.Array) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.asarray(flat.flatten(), np.float64).reshape(len(column), -1)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = model.logits(matrix(batch.column(1))).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["id", "v", "part"])

    filed = take(vectors).mapInArrow(file, f"id long, v {kind}, part int")
    sizes = {r["part"]: r["count"] for r in filed.groupBy("part").count().collect()}
    blocks = [blocks_of(sizes.get(p, 0)) for p in range(model.b2.size)]
    counts = np.array([sizes.get(p, 0) for p in range(model.b2.size)])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-model.logits(matrix(batch.column(1))), 1, kind="stable")
            enough = (np.cumsum(counts[order], 1) <= k).sum(1) + 1
            probes = np.minimum(np.maximum(model.probes, enough), order.shape[1])
            rows = np.repeat(np.arange(len(order)), probes)
            parts = np.concatenate([o[:n] for o, n in zip(order, probes, strict=True)])
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows)) for c in batch.columns], pa.array(parts.astype(np.int32))], names=["id", "v", "part"])

    split = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("part") + 1)
    base = filed.select("part", F.pmod(F.xxhash64("id"), split).cast("int").alias("block"), F.lit(0).alias("turn"), "id", "v")
    asked = take(queries).mapInArrow(visit, f"id long, v {kind}, part int").select("part", F.explode(F.sequence(F.lit(0), split - 1)).alias("block"), F.lit(1).alias("turn"), "id", "v")
    rows = base.unionByName(asked).repartition("part", "block").sortWithinPartitions("part", "block", "turn", "id")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, held = None, [], []
        ready: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            part, block, turn, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x = matrix(batch.column(4)) if batch.num_rows else np.zeros((0, 1))
            out: list[tuple[int, int, float]] = []
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(turn) != 0)) + 1 if batch.num_rows else []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if here != (part[a], block[a]):
                    here, ids, held, ready = (part[a], block[a]), [], [], None
                if turn[a] == 0:
                    ids.append(number[a:b])
                    held.append(x[a:b])
                    continue
                if ready is None:
                    ready = (np.concatenate(ids), np.concatenate(held)) if ids else (np.zeros(0, np.int64), np.zeros((0, x.shape[1])))
                for q, v in zip(number[a:b], x[a:b], strict=True):
                    out += nearest(q, v, *ready, k)
            q, i, s = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "id", "score"])

    found = rows.mapInArrow(rank, "query_id long, id long, score double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", order.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def nearest(query: int, v: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest rows of a block by (distance, id), without the query's own id."""
    other = ids != query
    d = x - v
    d = np.sqrt(np.einsum("ij,ij->i", d, d))
    d[~other] = np.inf
    n = min(k, int(other.sum()))
    if n == 0:
        return []
    near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
    near = near[other[near]]
    near = near[np.lexsort((ids[near], d[near]))][:n]
    return [(int(query), int(ids[i]), float(d[i])) for i in near]
