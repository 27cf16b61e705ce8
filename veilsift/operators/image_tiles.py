"""Statistics of pictures that come as tiles, from states that add up.

A tile is a rectangle of one channel: its counts of values, of steps between neighbours and of blocks of four are summed
where the tile lies, and only these counts and the cells along its vertical edges are shuffled. So no task ever holds a
picture, whatever its size, and a tile that is read again after a loss gives the same counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Numbers of the counts behind those of the 256 values; BROKEN counts tiles whose bytes are not width * height.
NEAR, STEPS, RM, SM, RN, SN, BLOCKS, BROKEN = range(256, 264)
EVEN, ODD = (1, 0, 1, 0), (0, 1, 0, 1)
CELLS = "array<struct<x: int, tile: int, v: int>>"


def tile_counts(pixels: np.ndarray, x0: int) -> np.ndarray:
    """The 264 counts of a tile that starts in column x0."""
    v = pixels.astype(np.int64)
    step = np.abs(np.diff(v, axis=1))
    blocks = v[:, _inner(x0, v.shape[1])].reshape(-1, 4)
    rough = lambda flip: np.abs(np.diff(blocks ^ np.array(flip), axis=1)).sum(1)
    base, even, odd = rough((0, 0, 0, 0)), rough(EVEN), rough(ODD)
    more = [(step <= 1).sum(), step.size, (even > base).sum(), (even < base).sum(), (odd > base).sum(), (odd < base).sum(), len(blocks), 0]
    return np.concatenate([np.bincount(v.ravel(), minlength=256), more]).astype(np.int64)


def _inner(x0: int, width: int) -> slice:
    """The columns of a tile that make whole blocks; blocks begin at multiples of four of the picture's columns."""
    start = min(-x0 % 4, width)
    return slice(start, start + (width - start) // 4 * 4)


def seam_columns(x0: int, width: int) -> list[int]:
    """The columns of a tile that neighbours in other tiles are compared with, or that share a block with those."""
    inside = _inner(x0, width)
    return sorted({*range(inside.start), *range(inside.stop, width), 0, width - 1})


def _states(tiles: DataFrame, image: str) -> DataFrame:
    """(image, line, key, n, cells): counts by key where line is null, else cells of a picture's line."""
    kind = tiles.schema[image].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            sums: dict = {}
            for row in range(batch.num_rows):
                name, x0, y0, width, height, data = (batch.column(k)[row].as_py() for k in range(6))
                count = sums.setdefault(name, np.zeros(264, np.int64))
                if data is None or None in (x0, y0, width, height) or min(width, height) < 1 or len(data) != width * height:
                    count[BROKEN] += 1
                    continue
                pixels = np.frombuffer(data, np.uint8).reshape(height, width)
                count += tile_counts(pixels, x0)
                columns = seam_columns(x0, width)
                cells = pa.StructArray.from_arrays([pa.array(np.tile(np.array(columns, np.int32) + x0, height)), pa.array(np.full(height * len(columns), x0, np.int32)), pa.array(pixels[:, columns].ravel().astype(np.int32))], ["x", "tile", "v"])
                lists = pa.ListArray.from_arrays(np.arange(height + 1, dtype=np.int32) * len(columns), cells)
                yield _batch(pa.array([name] * height, names.type), pa.array(np.arange(y0, y0 + height, dtype=np.int64)), pa.array(np.full(height, -1, np.int32)), pa.array(np.zeros(height, np.int64)), lists)
            for name, count in sums.items():
                keys = np.flatnonzero(count).astype(np.int32)
                yield _batch(pa.array([name] * len(keys), names.type), pa.nulls(len(keys), pa.int64()), pa.array(keys), pa.array(count[keys]), pa.nulls(len(keys), pa.list_(pa.struct([(c, pa.int32()) for c in ("x", "tile", "v")]))))

    columns = [image, "x0", "y0", "width", "height", "data"]
    typed = [F.col(image), *[F.col(c).cast("int") for c in columns[1:5]], F.col("data")]
    return tiles.select(*typed).mapInArrow(run, f"image {kind}, line bigint, key int, n bigint, cells {CELLS}")


def _batch(*arrays: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays), names=["image", "line", "key", "n", "cells"])


def _seams(cells: Column) -> Column:
    """Counts of the neighbours and blocks of a line that no single tile holds, as an array of (key, n)."""

    def of(c: Column) -> Column:
        at = lambda i, k: F.get(c, i + k)
        places = F.sequence(F.lit(0), F.size(c) - 1)
        met = F.filter(places, lambda i: (at(i, 1)["x"] == at(i, 0)["x"] + 1) & (at(i, 1)["tile"] != at(i, 0)["tile"]))
        near = F.filter(met, lambda i: F.abs(at(i, 1)["v"] - at(i, 0)["v"]) <= 1)
        whole = F.filter(places, lambda i: (at(i, 0)["x"] % 4 == 0) & (at(i, 3)["x"] == at(i, 0)["x"] + 3) & (at(i, 3)["tile"] != at(i, 0)["tile"]))

        def rough(i: Column, flip: tuple[int, ...]) -> Column:
            v = [at(i, k)["v"].bitwiseXOR(F.lit(f)) for k, f in enumerate(flip)]
            return F.abs(v[1] - v[0]) + F.abs(v[2] - v[1]) + F.abs(v[3] - v[2])

        turned = F.transform(whole, lambda i: F.struct(rough(i, (0, 0, 0, 0)).alias("base"), rough(i, EVEN).alias("even"), rough(i, ODD).alias("odd")))
        tests = {RM: lambda r: r["even"] > r["base"], SM: lambda r: r["even"] < r["base"], RN: lambda r: r["odd"] > r["base"], SN: lambda r: r["odd"] < r["base"]}
        counts = {NEAR: F.size(near), STEPS: F.size(met), BLOCKS: F.size(whole), **{k: F.size(F.filter(turned, t)) for k, t in tests.items()}}
        return F.array(*[F.struct(F.lit(k).alias("key"), n.cast("long").alias("n")) for k, n in counts.items()])

    return let(F.sort_array(cells), of)


def statistics(tiles: DataFrame, image: str = "image") -> DataFrame:
    """(image, n_pixels, n_broken, entropy, chi_square, regular_singular, sample_pairs) of pictures given as tiles.

    tiles has the columns image, x0, y0 (place of the upper left cell), width, height and data: one channel's bytes, line by
    line. Tiles of a picture must not overlap; any tiling, of any order, gives what functions.image gives for the whole
    picture. A tile with a null, or with bytes of another number than width * height, adds to n_broken only; a picture with
    no other tiles has statistics 0. A null image is a picture like others; other columns are ignored; no tiles, no rows.
    """
    met = _states(tiles, image).groupBy("image", "line", "key").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("cells")).alias("cells"))
    parts = F.when(F.col("line").isNull(), F.array(F.struct("key", "n"))).otherwise(_seams(F.col("cells")))
    sums = met.select("image", F.explode(parts).alias("p")).groupBy("image", "p.key").agg(F.sum("p.n").alias("n"))
    counts = sums.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("m"))
    n = lambda k: F.coalesce(F.try_element_at("m", F.lit(k) if isinstance(k, int) else k), F.lit(0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    counts = counts.withColumn("n_pixels", F.aggregate(F.sequence(F.lit(0), F.lit(255)), F.lit(0).cast("long"), lambda x, k: x + n(k)))
    share = lambda k: n(k) / F.col("n_pixels")
    entropy = total(F.transform(F.filter(F.sequence(F.lit(0), F.lit(255)), lambda k: n(k) > 0), lambda k: -share(k) * F.log2(share(k))))
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(254), F.lit(2)), lambda k: F.struct(n(k).alias("even"), (n(k) + n(k + 1)).alias("all"))), lambda p: p["all"] >= 5)
    off = total(F.transform(pairs, lambda p: 2 * F.pow(p["even"] - p["all"] / 2, F.lit(2.0)) / (p["all"] / 2)))
    rm, sm, rn, sn = (n(k) / n(BLOCKS) for k in (RM, SM, RN, SN))
    bottom = rm - rn - sm + sn
    turned = F.when((n(BLOCKS) == 0), 0.0).when(F.abs(bottom) < 1e-9, 0.0).otherwise(F.least(F.lit(1.0), F.abs((rn - rm) / (2 * bottom))))
    smooth = F.when(n(STEPS) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (n(NEAR) / n(STEPS) - 0.35) / 0.15)))
    even = F.when(F.size(pairs) == 0, 0.0).otherwise(F.exp(-off / (2 * F.size(pairs))))
    return counts.select(F.col("image").alias(image), "n_pixels", n(BROKEN).alias("n_broken"), entropy.alias("entropy"), even.alias("chi_square"), turned.alias("regular_singular"), smooth.alias("sample_pairs"))
