"""Hard-negative mining: per anchor and positive, the best other-label rows inside a window of scores, by norm buckets.

Candidates are sorted by the length of their vectors, longest first, and cut into slabs by range partitioning;
inside a slab they form buckets of BUCKET rows. Anchors form blocks in the same order. A cell is a block of
anchors and a slab of candidates, both of bounded size. Within a cell the buckets are read in order: by
Cauchy-Schwarz no score exceeds the product of two lengths, so an anchor leaves as soon as its own length
times the bucket's greatest one is below what all its windows still ask for, the larger of the window's lower
limit and the k-th best score found so far. Slabs are visited in rounds that grow ROUND-fold; between rounds
the best scores of all cells are merged, and slabs that no anchor of a block can use any more aren't dealt to
it. The same search runs twice: with one open window over rows of the anchor's label for the positives, and
with a window for each positive over rows of other labels for the negatives.

Components become floor(scale * x) in double precision. Products are exact: in doubles while no partial sum can
leave 2^53, otherwise in whole Python numbers; a score, or a window's limit, beyond 64 bits is an error. Rows
with a null label, a null vector, or a null or non-finite component take no part; a shorter vector counts as
ending in zeros, an empty one as zeros throughout. Rows are told apart by a number of their own: rows that
repeat an id are rows like others, and repeated anchors return their rows repeatedly. A null id sorts last and
is returned as null. Ties go to the smaller id. Columns other than the three named ones are ignored, whatever
their names. Empty tables, anchors without positives and windows without negatives give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

BUCKET = 2048
#: Anchors scored at once, so that a matrix of scores stays at 8 MB.
CHUNK = 512
#: Bytes of the vectors in a slab of candidates and in a block of anchors.
SLAB_BYTES, BLOCK_BYTES = 32 << 20, 8 << 20
#: So many times more slabs are visited in each round.
ROUND = 16
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(row, id, label, anchor, norm, size, vec) of the usable rows (row, id, label, anchor, v); vec holds doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(4)
            keep = np.asarray(v.is_valid()) & np.asarray(batch.column(2).is_valid())
            size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(v)), size)
            x = np.floor(v.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            keep[owner[~np.isfinite(x)]] = False
            x = x[keep[owner]]
            rest = np.flatnonzero(keep)
            size, owner = size[rest], owner[keep[owner]]
            norm = np.sqrt(np.bincount(owner, x * x, len(v)))[rest]
            at = np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int32)
            vec = pa.Array.from_buffers(pa.binary(), len(rest), [None, pa.py_buffer(at), pa.py_buffer(x.tobytes())])
            ids = [batch.column(i).take(pa.array(rest)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(norm), pa.array(size), vec], names=["row", "id", "label", "anchor", "norm", "size", "vec"])

    return rows.mapInArrow(run, "row long, id long, label long, anchor boolean, norm double, size long, vec binary")


def _matrix(vec: pa.ChunkedArray, width: int) -> np.ndarray:
    """The doubles of binary values, one row each, padded with zeros."""
    values = vec.to_pylist()
    if all(len(v) == 8 * width for v in values):
        return np.frombuffer(b"".join(values), np.float64).reshape(len(values), width)
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v) // 8] = np.frombuffer(v, np.float64)
    return out


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """All inner products of whole-numbered rows; most bounds their size."""
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(y) for y in r] for r in x], object).reshape(x.shape)
    scores = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    if scores.size and (scores.max() > MOST or scores.min() < LEAST):
        raise OverflowError("an inner product needs more than 64 bits")
    return scores.astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first of each group by (score descending, number), ordered by group and rank."""
    order = np.lexsort((number, -score, group))
    g = group[order]
    head = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(head, np.diff(np.append(head, len(g))))
    return order[rank < k]


def _cell(same: bool, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The search of a cell: each anchor's windows over the slab's rows of the same, or another, label."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if anchors.num_rows and candidates.num_rows:
            col = lambda t, name: t[name].to_numpy()
            width = max(col(anchors, "size").max(), col(candidates, "size").max())
            order = np.argsort(-col(candidates, "norm"), kind="stable")
            norms, rows, labels = (col(candidates, n)[order] for n in ("norm", "row", "label"))
            ids = candidates["id"].fill_null(MOST).to_numpy()[order]
            matrix = _matrix(candidates["vec"].take(pa.array(order)), width)
            asked = np.full((anchors.num_rows, 3, max(map(len, windows := anchors["windows"].to_pylist()))), LEAST)
            asked[:, 0], asked[:, 1] = MOST, LEAST
            for i, ws in enumerate(windows):
                for j, w in enumerate(ws):
                    asked[i, :, j] = w["low"], w["high"], w["w"]
                    if w["kth"] is not None:
                        asked[i, 0, j] = max(w["low"], w["kth"])
            for a in range(0, anchors.num_rows, CHUNK):
                found.append(_scan(anchors.slice(a, CHUNK), _matrix(anchors["vec"].slice(a, CHUNK), width), asked[a : a + CHUNK], matrix, norms, rows, labels, ids, same, k))
        joined = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(joined[0]), pa.array(joined[1]), pa.array(joined[2], mask=joined[2] == MOST), pa.array(joined[3])], names=["anchor_row", "w", "id", "score"])

    return run


def _scan(anchors: pa.Table, x: np.ndarray, asked: np.ndarray, matrix: np.ndarray, norms: np.ndarray, rows: np.ndarray, labels: np.ndarray, ids: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
    own, label, norm = (anchors[n].to_numpy() for n in ("row", "label", "norm"))
    floor, high, name = asked[:, 0].copy(), asked[:, 1], asked[:, 2]
    width = floor.shape[1]
    top = [np.zeros(0, np.int64)] * 3
    for b in range(0, len(norms), BUCKET):
        reach = norm * norms[b] * (1 + 1e-9) + 1e-6
        live = np.flatnonzero(reach >= floor.min(1))
        if not len(live):
            break
        part = slice(b, b + BUCKET)
        score = products(x[live], matrix[part], float((norm[live].max() * norms[b])))
        fits = (label[live][:, None] == labels[part]) == same
        i, j = np.nonzero(fits & (score >= floor.min(1)[live][:, None]) & (own[live][:, None] != rows[part]))
        s, i, j = score[i, j], live[i], j + b
        for w in range(width):
            hit = np.flatnonzero((s >= floor[i, w]) & (s <= high[i, w]))
            if not len(hit):
                continue
            group, value, number = (np.concatenate(z) for z in zip(top, (i[hit] * width + w, s[hit], ids[j[hit]]), strict=True))
            kept = best(group, value, number, k)
            top = [group[kept], value[kept], number[kept]]
            last = np.flatnonzero(np.bincount(top[0], minlength=floor.size) >= k)
            end = np.searchsorted(top[0], last, "right") - 1
            floor.reshape(-1)[last] = np.maximum(floor.reshape(-1)[last], top[1][end])
    return own[top[0] // width], name.reshape(-1)[top[0]], top[2], top[1]


def search(anchors: DataFrame, candidates: DataFrame, windows: DataFrame, same: bool, k: int, slabs: int) -> DataFrame:
    """(anchor_row, w, rank, id, score): for each window (row, w, low, high) of an anchor its k first candidates.

    anchors (row, label, norm, size, vec, block) and candidates (row, id, label, norm, size, vec, slab) are written tables;
    slab numbers follow falling norms.
    """
    spark = anchors.sparkSession
    blocks = (anchors.agg(F.max("block")).first()[0] or 0) + 1
    tops = stage(candidates.groupBy("slab").agg(F.max("norm").alias("top")))
    first = Window.partitionBy("anchor_row", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    low, step, state = 0, max(spark.sparkContext.defaultParallelism, 8), None
    while low < slabs:
        high = min(slabs, low + step)
        kth = windows.withColumn("kth", F.lit(None).cast("long")) if state is None else windows.join(state.filter(F.col("rank") == k).select(F.col("anchor_row").alias("row"), "w", F.col("score").alias("kth")), ["row", "w"], "left")
        asked = kth.groupBy("row").agg(F.collect_list(F.struct("w", "low", "high", "kth")).alias("windows"))
        ready = anchors.join(asked, "row")
        need = F.array_min(F.transform("windows", lambda w: F.greatest(w["low"], w["kth"]))).cast("double")
        reach = F.when(F.col("norm") > 0, need / F.col("norm")).otherwise(F.when(need <= 0, F.lit(0.0)).otherwise(F.lit(float("inf"))))
        here = tops.filter((F.col("slab") >= low) & (F.col("slab") < high)).select("slab", "top", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        cells = here.join(ready.groupBy("block").agg(F.min(reach).alias("reach")), "block").filter(F.col("top") * (1 + 1e-9) + 1e-6 >= F.col("reach")).select("slab", "block")
        left = ready.join(cells, "block").select("slab", "block", "row", "label", "norm", "size", "vec", "windows")
        right = candidates.filter((F.col("slab") >= low) & (F.col("slab") < high)).join(cells, "slab").select("slab", "block", "row", "id", "label", "norm", "size", "vec")
        found = left.groupBy("slab", "block").cogroup(right.groupBy("slab", "block")).applyInArrow(_cell(same, k), "anchor_row long, w long, id long, score long")
        found = found if state is None else found.unionByName(state.drop("rank"))
        state = stage(found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k))
        low, step = high, step * ROUND
    return state


def _limit(num: int, den: int, up: bool) -> Column:
    """num * score / den, rounded up or down in whole numbers; no step is larger than the result for num <= den."""
    rest = f"({num} * (score % {den}))"
    return F.expr(f"{num} * (score div {den}) + {rest} div {den} + CASE WHEN {rest} % {den} {'>' if up else '<'} 0 THEN {1 if up else -1} ELSE 0 END")


def _ranged(rows: DataFrame, n: int, name: str) -> DataFrame:
    """rows, written, with a number below n that follows falling norms, whatever number of partitions Spark makes of them."""
    dealt = stage(rows.repartitionByRange(n, F.col("norm").desc(), F.col("row")).withColumn("part", F.spark_partition_id()))
    parts = (dealt.agg(F.max("part")).first()[0] or 0) + 1
    return dealt.withColumn(name, F.expr(f"cast(cast(part as long) * {min(n, parts)} div {parts} as int)")).drop("part")


def mine(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, den: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where anchor holds.

    The positives of an anchor are its first other rows of the same label; the negatives of an anchor and positive are
    the first rows of other labels whose score is between low / den and high / den of the positive's.
    """
    spark = rows.sparkSession
    given = rows.select(F.monotonically_increasing_id().alias("row"), rows[key].cast("long").alias("id"), rows[label].cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), rows[vector].alias("v"))
    usable = stage(whole_vectors(given, scale))
    n, n_anchors, size = usable.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1)), F.max("size")).first()
    bytes_each = 8 * max(size or 0, 1) + 64
    slabs = max(spark.sparkContext.defaultParallelism, -(-n * bytes_each // SLAB_BYTES))
    candidates = _ranged(usable.drop("anchor"), slabs, "slab")
    anchors = _ranged(usable.filter("anchor").drop("anchor"), max(1, -(-n_anchors * bytes_each // BLOCK_BYTES)), "block")
    open_window = anchors.select("row", F.lit(0).cast("long").alias("w"), F.lit(LEAST).cast("long").alias("low"), F.lit(MOST).cast("long").alias("high"))
    near = search(anchors, candidates, open_window, True, positives, slabs)
    windows = near.select(F.col("anchor_row").alias("row"), F.col("rank").cast("long").alias("w"), _limit(low, den, True).alias("low"), _limit(high, den, False).alias("high")).filter("low <= high")
    hard = search(anchors, candidates, windows, False, negatives, slabs)
    pairs = near.select("anchor_row", F.col("rank").cast("long").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = hard.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(pairs, ["anchor_row", "w"])
    return named.join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
