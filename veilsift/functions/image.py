"""Statistics of bytes and pixel channels: entropy and three tests for data in the lowest bits.

Each exists as an aggregation over rows (image, y, x, v), for use in SQL, and as a numpy function on an
array, for whole images inside a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entropy_of(values: np.ndarray) -> float:
    """Shannon entropy in bits of 8-bit values; 0 for none."""
    if values.size == 0:
        return 0.0
    p = np.bincount(values.ravel(), minlength=256) / values.size
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def chi_square_of(channel: np.ndarray) -> float:
    """How even the counts of 2i and 2i + 1 are: exp(-chi2 / 2k) over the k pairs with five values at least."""
    pairs = np.bincount(channel.ravel(), minlength=256).reshape(-1, 2).astype(float)
    total = pairs.sum(1)
    pairs, total = pairs[total >= 5], total[total >= 5]
    if not len(total):
        return 0.0
    half = total / 2
    return float(np.exp(-(((pairs - half[:, None]) ** 2) / half[:, None]).sum() / (2 * len(total))))


def regular_singular_of(channel: np.ndarray) -> float:
    """Share of groups of four neighbours that grow rougher or smoother when lowest bits flip at even or at odd places."""
    v = channel.astype(np.int64)
    width = v.shape[1] // 4 * 4
    blocks = v[:, :width].reshape(-1, 4)
    if not len(blocks):
        return 0.0
    rough = lambda b: np.abs(np.diff(b, axis=1)).sum(1)
    base, even, odd = rough(blocks), rough(blocks ^ np.array([1, 0, 1, 0])), rough(blocks ^ np.array([0, 1, 0, 1]))
    rm, sm, rn, sn = ((x > base).mean() if up else (x < base).mean() for x, up in ((even, 1), (even, 0), (odd, 1), (odd, 0)))
    bottom = rm - rn - sm + sn
    return 0.0 if abs(bottom) < 1e-9 else float(np.clip(abs((rn - rm) / (2 * bottom)), 0, 1))


def sample_pairs_of(channel: np.ndarray) -> float:
    """Share of horizontal neighbours that differ by one at most, from 0.35 (0) to 0.5 (1)."""
    v = channel.astype(np.int64)
    if v.size < 2 or v.shape[1] < 2:
        return 0.0
    return float(np.clip(((np.abs(np.diff(v, axis=1)) <= 1).mean() - 0.35) / 0.15, 0, 1))


def entropy(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Entropy in bits of a column's values in each group."""
    n = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy())
    return rows.groupBy(*by, value).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / n).groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def chi_square(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """chi_square_of in each group."""
    pair = F.shiftright(F.col(value).cast("int"), 1).alias("pair")
    even = F.count_if(F.col(value) % 2 == 0).alias("even")
    pairs = rows.groupBy(*by, pair).agg(even, F.count("*").alias("total"))
    half = F.col("total") / 2
    counted = pairs.withColumn("term", F.when(F.col("total") >= 5, 2 * (F.col("even") - half) * (F.col("even") - half) / half))  # both values of a pair are equally far from half
    return counted.groupBy(*by).agg(F.coalesce(F.exp(-F.sum("term") / (2 * F.nullif(F.count("term"), F.lit(0)))), F.lit(0.0)).alias("chi_square"))


def sample_pairs(rows: DataFrame, image: list[str], line: list[str], x: str, value: str) -> DataFrame:
    """sample_pairs_of in each group; neighbours are consecutive x of one line."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*image, *line).orderBy(x)))
    share = F.avg(F.when(F.col("step").isNotNull(), (F.col("step") <= 1).cast("int")))
    return rows.withColumn("step", step).groupBy(*image).agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - 0.35) / 0.15)), F.lit(0.0)).alias("sample_pairs"))


def regular_singular(rows: DataFrame, image: list[str], line: list[str], x: str, value: str) -> DataFrame:
    """regular_singular_of in each group: blocks of four consecutive values of a line, x counted from 0; an incomplete last block is left out."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(value).alias("v")))), lambda s: s["v"].cast("int"))
    blocks = rows.groupBy(*image, *line, F.floor(F.col(x) / 4).alias("block")).agg(ordered.alias("b")).filter(F.size("b") == 4)

    def rough(flip: tuple[int, ...]) -> Column:
        at = [F.col("b")[i].bitwiseXOR(F.lit(m)) for i, m in enumerate(flip)]
        return sum((F.abs(at[i + 1] - at[i]) for i in range(3)), F.lit(0))

    r = blocks.select(*image, rough((0, 0, 0, 0)).alias("base"), rough((1, 0, 1, 0)).alias("even"), rough((0, 1, 0, 1)).alias("odd"))
    share = lambda test, name: F.avg(test.cast("int")).alias(name)
    r = r.groupBy(*image).agg(share(F.col("even") > F.col("base"), "rm"), share(F.col("even") < F.col("base"), "sm"), share(F.col("odd") > F.col("base"), "rn"), share(F.col("odd") < F.col("base"), "sn"))
    bottom = F.col("rm") - F.col("rn") - F.col("sm") + F.col("sn")
    score = F.when(F.abs(bottom) < 1e-9, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.abs((F.col("rn") - F.col("rm")) / (2 * bottom))))
    return r.select(*image, score.alias("regular_singular"))
