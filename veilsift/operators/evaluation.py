"""Evaluation: confusion matrices and ratios of labelled samples, and latency statistics of benchmarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Budgets of a detector's 95th percentile, in ms.
BUDGETS = {"css_hidden_text": 50.0, "unicode_stego": 50.0, "html_injection": 50.0, "image_triage": 500.0, "full_scan_html": 50.0, "full_scan_image": 500.0, "tier1": 50.0, "tier2": 500.0}
DEFAULT_BUDGET = 500.0
#: Bits of a histogram's digit, and groups up to which the cells of a selection are broadcast.
DIGIT, MAX_GROUPS = 16, 20_000


def ratio(a: Column, b: Column) -> Column:
    """a / b rounded to four places, 0 if b is 0."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)


def with_ratios(m: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = (F.coalesce(F.try_divide(tp.cast("double"), (tp + x).cast("double")), F.lit(0.0)) for x in (fp, fn))
    return m.withColumns({
        "precision": F.round(precision, 4), "recall": F.round(recall, 4), "f1": F.round(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), 4),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "specificity": ratio(tn, tn + fp), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp),
    })


def confusion(samples: DataFrame, by: str = "suite") -> DataFrame:
    """Per group and for all together ('aggregate'): tp, fp, tn, fn and the ratios. samples has expected_safe and predicted_safe; unsafe is positive."""
    expected, predicted = ~F.col("expected_safe"), ~F.col("predicted_safe")
    counts = samples.rollup(by).agg(F.count_if(expected & predicted).alias("tp"), F.count_if(~expected & predicted).alias("fp"), F.count_if(~expected & ~predicted).alias("tn"), F.count_if(expected & ~predicted).alias("fn"))
    return with_ratios(counts.withColumn(by, F.coalesce(by, F.lit("aggregate"))))


def sortable(value: Column, back: bool = False) -> Column:
    """Doubles as longs in the same order (NaN last, both zeros equal), or such longs as doubles."""

    def there(v: pd.Series) -> pd.Series:
        bits = (v.to_numpy(np.float64) + 0.0).view(np.int64)
        bits = np.where(np.isnan(v), np.array([np.nan]).view(np.int64), bits)
        return pd.Series(bits ^ ((bits >> 63) & np.int64(2**63 - 1)))

    def again(v: pd.Series) -> pd.Series:
        bits = v.to_numpy(np.int64)
        return pd.Series((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64))

    return F.pandas_udf(again, "double")(value) if back else F.pandas_udf(there, "long")(value)


def nearest_rank(rows: DataFrame, by: list[str], value: str, percents: dict[str, int]) -> DataFrame:
    """Element max(1, floor(n p / 100)) of each group's sorted values, and median_ms, the mean of the two in the middle.

    A selection in rounds of histograms: a value is four digits of DIGIT bits; each round counts, in the cells that hold a
    wanted rank, the rows by their next digit, and goes on with the digit where the rank lies. So no task sorts or holds
    more than 2 ** DIGIT counts of a cell, however many values a group has, and rows are counted before they are
    shuffled. Cells come to the rows by broadcast where the groups are MAX_GROUPS at most, else by a join on their keys.
    Values are taken as doubles; null values don't count, NaN is the largest, and null groups are groups.
    """
    keyed = rows.filter(F.col(value).isNotNull()).select(*by, sortable(F.col(value).cast("double")).alias("_key"))
    few = rows.select(*by).distinct().limit(MAX_GROUPS + 1).count() <= MAX_GROUPS
    ranks = {name: F.greatest(F.lit(1), F.floor(F.col("_all") * p / 100)) for name, p in percents.items()}
    ranks |= {"_low": F.ceil(F.col("_all") / 2), "_high": F.floor(F.col("_all") / 2) + 1}
    names = list(ranks)
    counted, w = keyed.groupBy(*by, F.shiftright("_key", 64 - DIGIT).alias("_at")).agg(F.count("*").alias("_n")), Window.partitionBy(*by)
    counted = counted.withColumn("_all", F.sum("_n").over(w)).withColumns(ranks)
    for left in range(64 - DIGIT, -1, -DIGIT):
        placed = counted.withColumn("_upto", F.sum("_n").over(w.orderBy("_at")))
        before = F.col("_upto") - F.col("_n")
        inside = [F.when((F.col(k) > before) & (F.col(k) <= F.col("_upto")), F.col(k) - before).alias(k) for k in names]
        cells = placed.select(*by, "_at", *inside).filter(F.coalesce(*names).isNotNull())
        if left:
            cells = cells.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_at").alias("_cell"), *names)
            same = F.shiftright("_key", left) == F.col("_cell")
            for i, c in enumerate(by):
                same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
            met = keyed.join(F.broadcast(cells) if few else cells, same)
            counted = met.groupBy(*by, "_cell", F.shiftright("_key", left - DIGIT).alias("_at")).agg(F.count("*").alias("_n"), *[F.first(k).alias(k) for k in names])
            w = Window.partitionBy(*by, "_cell")
    found = cells.groupBy(*by).agg(*[F.max(F.when(F.col(k).isNotNull(), F.col("_at"))).alias(k) for k in names])
    at = {k: sortable(F.col(k), back=True) for k in names}
    return found.withColumns(at).select(*by, *percents, ((F.col("_low") + F.col("_high")) / 2).alias("median_ms"))


def latency(rows: DataFrame, by: list[str] | None = None, value: str = "latency_ms") -> DataFrame:
    """n_samples, mean, median, min, max, p95 and p99 of each group, with budget and pass for a detector column."""
    by = by or ["detector", "suite"]
    plain = rows.groupBy(*by).agg(F.count("*").alias("n_samples"), F.avg(value).alias("mean_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))
    out = plain.join(nearest_rank(rows.filter(F.col(value).isNotNull()), by, value, {"p95_ms": 95, "p99_ms": 99}), by, "left")
    return passed(out) if "detector" in by else out


def passed(stats: DataFrame) -> DataFrame:
    """stats with each detector's budget, DEFAULT_BUDGET for others, and whether p95 keeps it."""
    budgets = stats.sparkSession.createDataFrame(list(BUDGETS.items()), "detector string, budget_ms double")
    return stats.join(F.broadcast(budgets), "detector", "left").withColumn("budget_ms", F.coalesce("budget_ms", F.lit(DEFAULT_BUDGET))).withColumn("pass", F.col("p95_ms") <= F.col("budget_ms"))


def evaluate(manifest: DataFrame, scanned: DataFrame, suite: str) -> DataFrame:
    """Samples (file, category, expected_safe, predicted_safe, threat_types, correct, notes) of a suite; images count as safe unless suspicious."""
    both = manifest.join(scanned, "file")
    safe = F.coalesce(F.col("is_suspicious") == F.lit(False), F.col("safe")) if suite == "images" and "is_suspicious" in scanned.columns else F.col("safe")
    cols = both.withColumn("predicted_safe", safe)
    notes = F.col("notes") if "notes" in both.columns else F.lit("")
    return cols.select(F.lit(suite).alias("suite"), "file", "category", "expected_safe", "predicted_safe", F.transform("threats", lambda t: t["type"]).alias("threat_types"), (F.col("expected_safe") == F.col("predicted_safe")).alias("correct"), notes.alias("notes"))
