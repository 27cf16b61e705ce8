"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

The mix holds `share` times all words. Sources in code point order (null last) weigh 5, 2, 1,
repeating; a source's target is its weight's part of the mix, at most `cap` times its own words, and
what a cap cuts off is shared again by weight among the others. With target / size = whole + rest,
each document gets `whole` certain copies, and the rest is a Pareto sample of fixed size in words: documents
are ranked by their random odds u / (1 - u) divided by their inclusion odds, and taken from the front until
the source's words are reached. Inclusion odds are rest / (1 - rest) times 2 * size / (size + mean size of the
source), so within a source a long document is up to twice as likely in odds as one of mean size, and a short
one less. The document on the edge is taken if at least half of it still fits, so a source misses its target by
half a document at most.

The cut is found without sorting a source in one task: three rounds of 256-bin histograms of the rank
narrow it down to a 2^-24 part of a source, and only that part is ordered. u comes from a hash of the
key, the size and the seed, so reruns agree. Null or empty texts have size 0 and nothing is taken from them.
Rows of one rank are ordered by key, size and a hash of all columns, null keys as empty ones; of rows that agree
in all of these, as many are taken as fit, and if that isn't all of them, they alone are numbered in one task.
Null sources are one source. An empty table gives an empty mix. Other columns of the input stay as they are,
whatever their names; the decision is one struct. Sources are numbered and summed up in one task, a slim row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import checkpoint
from .textcols import words

WEIGHTS = (5, 2, 1)
_BITS = 48
#: Rows of the table of cuts up to which it is sent to all executors; above, it is joined by shuffle.
MAX_BROADCAST_SOURCES = 100_000


def size_in_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """From (source, source_size), a row per source, the same with target: by weight, with caps, in words.

    Sorted by cap / weight, a source is capped exactly when its cap is below its weight's part of what the
    sources before it have left; one pass of running sums finds all caps.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    t = sizes.withColumn("weight", weight.cast("double")).withColumn("total", share * F.sum("source_size").over(everything))
    t = t.withColumn("most", (cap * F.col("source_size")).cast("double"))
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("capped", F.col("most") / F.col("weight") < left / free)
    over_free = lambda c, capped: F.coalesce(F.sum(F.when(F.col("capped") == capped, F.col(c))).over(everything), F.lit(0.0))
    level = (F.col("total") - over_free("most", True)) / over_free("weight", False)
    return t.select(*sizes.columns, F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * level).alias("target"))


def _odds(key: Column, size: Column, seed: str) -> Column:
    """Random odds u / (1 - u) from 52 bits of a hash of seed, key and size."""
    named = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), size.cast("string"))
    u = (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)
    return u / (1.0 - u)


def _rank(odds: Column, rest: Column, size: Column, mean: Column) -> Column:
    """The Pareto rank q = odds / inclusion odds as an integer of 48 bits, q / (1 + q) times 2^48."""
    q = F.try_divide(odds, rest / (1.0 - rest) * (2.0 * size / (size + mean)))
    return F.when((rest <= 0) | (size <= 0), F.lit(2**_BITS - 1)).otherwise(F.floor(q / (1.0 + q) * float(2**_BITS))).cast("long")


def allocate(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", out: str = "mix", seed: str = "mix", **shares) -> DataFrame:
    """docs with a struct column out: source_size, target, copies and taken (words)."""
    order = ("rank", "key", "size", "hash")
    named, long = F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(size).cast("long")
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    slim = checkpoint(docs.select(F.col(source).cast("string").alias("source"), long.alias("size"), named.alias("key"), hashed.alias("hash"), _odds(F.col(key), long, seed).alias("odds")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = source_targets(sizes, **shares).withColumn("whole", whole)
    plan = plan.withColumn("need", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = plan.withColumn("mean", F.coalesce(F.try_divide("source_size", "n"), F.lit(0.0)))
    plan = checkpoint(plan.withColumn("rest", F.coalesce(F.try_divide("need", "source_size"), F.lit(0.0))))

    def beside(left: DataFrame, right: DataFrame, small: bool) -> DataFrame:
        right = right.withColumnRenamed("source", "_mix_source")
        return left.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")

    small = plan.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    rank = _rank(F.col("odds"), F.col("rest"), F.col("size"), F.col("mean")).alias("rank")
    ranked = beside(slim, plan.filter("rest > 0").select("source", "need", "rest", "mean"), small).select("source", "size", "key", "hash", rank)
    cut = plan.filter("rest > 0").select("source", "need", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("before"))
    shift = _BITS
    for _ in range(3):
        within = beside(ranked, cut, small).filter(F.shiftright("rank", shift) == F.col("cell"))
        shift -= 8
        bins = within.groupBy("source", "need", "before", F.shiftright("rank", shift).alias("bin")).agg(F.sum("size").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        reach = bins.withColumn("upto", upto).groupBy("source", "need").agg(
            F.min(F.when(F.col("upto") >= F.col("need"), F.struct(F.col("bin").alias("cell"), (F.col("upto") - F.col("words")).alias("before")))).alias("a"),
            F.max(F.struct(F.col("bin").alias("cell"), (F.col("upto") - F.col("words")).alias("before"))).alias("b"),
        )
        cut = checkpoint(reach.select("source", "need", F.coalesce("a", "b").alias("at")).select("source", "need", "at.cell", "at.before"))
    last = beside(ranked, cut, small).filter(F.shiftright("rank", shift) == F.col("cell"))
    # Equal rows are one row here, with their number; of the last that fit, `some` are taken.
    last = last.groupBy("source", "need", "before", *order).agg(F.count("*").alias("equal"))
    prior = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("equal")).over(Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fit = F.least(F.col("equal"), F.floor(F.try_divide(F.col("need") - F.col("prior"), F.col("size")) + 0.5))
    edge = last.withColumn("prior", prior).withColumn("some", F.coalesce(fit, F.col("equal"))).filter("some > 0")
    edge = edge.groupBy("source").agg(F.max(F.struct(*order, "some", "equal")).alias("edge"))
    taken = cut.select(F.col("source").alias("_s"), "cell").join(edge.withColumnRenamed("source", "_e"), F.col("_s").eqNullSafe(F.col("_e")), "left").drop("_e")
    full = plan.join(taken, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", "rest", "mean", "cell", "edge")
    full = checkpoint(full.select(F.col("source").alias("_mix_source"), F.struct("source_size", "target", "whole", "rest", "mean", "cell", "edge").alias("_mix_plan")))

    p = F.col("_mix_plan")
    rank = _rank(_odds(F.col(key), long, seed), p["rest"], long, p["mean"])
    own = F.struct(rank.alias("rank"), named.alias("key"), long.alias("size"), hashed.alias("hash"))
    edge = F.struct(*[p["edge"][c].alias(c) for c in order])
    cell = F.shiftright(rank, shift)
    joined = docs.join(F.broadcast(full) if small else full, F.col(source).cast("string").eqNullSafe(F.col("_mix_source")))
    at_edge = F.coalesce((p["rest"] > 0) & p["edge"].isNotNull() & (own == edge), F.lit(False))
    drawn = (p["rest"] > 0) & ((cell < p["cell"]) | (cell == p["cell"]) & F.coalesce(p["edge"].isNotNull() & (own <= edge), F.lit(False)))
    if not full.filter("_mix_plan.edge.some < _mix_plan.edge.equal").isEmpty():
        joined = joined.withColumn("_mix_number", F.lit(0))
        number = F.row_number().over(Window.partitionBy("_mix_source").orderBy(F.lit(0)))
        joined = joined.filter(~at_edge).unionByName(joined.filter(at_edge).withColumn("_mix_number", number))
        drawn = drawn & (F.col("_mix_number") <= F.coalesce(p["edge"]["some"], F.lit(0)))
    copies = p["whole"] + F.coalesce(drawn, F.lit(False)).cast("long")
    chosen = F.struct(p["source_size"].alias("source_size"), p["target"].alias("target"), copies.alias("copies"), (copies * long).alias("taken"))
    return joined.withColumn(out, chosen).drop("_mix_source", "_mix_plan", "_mix_number")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mixed documents themselves: each row as many times as it was given copies, columns unchanged."""
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.col(key).alias("key"), size_in_words(F.col(text)).alias("size"))
    chosen = allocate(rows, key="key", **options).filter(F.col("mix.copies") > 0)
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int"))).alias("copy")).select("row.*")
