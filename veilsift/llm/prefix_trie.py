"""Conversation prefix trie: which conversations share their first turns, node by node.

A turn's fingerprint is a 64-bit hash of role and text. One aggregation shows whether two different turns share a
fingerprint; those that do are numbered and get others, so that from then on fingerprints stand for turns. The
turns are sorted by conversation and order over range partitions; numpy scans give each turn the polynomial
fingerprint of all turns up to it, and conversations that lie on several partitions are continued by the sums of
their earlier pieces. Polynomials can be cut and joined, so a conversation rebuilt from the first turns of another
needs no second scan.

Equal (depth, fingerprint) make a group, whose representative is its smallest conversation. A group is verified by
its last turn and its parent's fingerprint: where the least and the greatest of both agree, all agree with the
representative, turn by turn as the same holds at each depth above. Groups in which they don't agree, and all below
them, are split: their conversations are compared with the representative's turns one by one, and those that differ
before the group's depth start over with a representative of their own.

Sums over subtrees need no walk by depth. The smallest conversation of a node stays the smallest at all nodes below
that it passes, so every conversation owns one run of nodes down to its end; a subtree's sum is that of the node's
own run from there on and the whole runs of its other members. Leaves are counted the same way. No step collects a
group: runs are summed in blocks of BLOCK depths, hot keys are summed before the shuffle, and the hash of a node's
conversations reads them as a sorted stream.

Null roles and texts are empty ones. A null turn comes first; turns of the same number are ordered by role and
text, and repeated rows are turns that repeat. Rows without a conversation's id belong to none and are left out.
Very long texts are hashed where they are read. An empty table has no nodes, not even a root. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import discard, stage
from .textcols import _MULT, _power

#: Depths summed at once; conversations written at once into a list that is hashed.
BLOCK, LIST = 4096, 65_536
KEY = ["split", "depth", "print"]
NO_CONVERSATION = hashlib.sha256(b"").hexdigest()


def power(n: np.ndarray) -> np.ndarray:
    """_MULT to the n-th power modulo 2^64, for n of either sign."""
    up, down = _power(int(np.abs(n).max(initial=0)) + 1)
    return np.where(n >= 0, up[np.maximum(n, 0)], down[np.maximum(-n, 0)])


def _u(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def turn_prints(turns: DataFrame, hashed: Callable[..., Column]) -> DataFrame:
    """turns (conv, turn, role, text) with x, which two turns share only if role and text are equal."""
    named = turns.withColumn("x", hashed("role", "text"))
    while True:
        kinds = named.groupBy("x", "role", "text").agg(F.lit(1).alias("one")).groupBy("x").agg(F.count("*").alias("kinds")).filter("kinds > 1")
        shared = stage(kinds)
        if shared.isEmpty():
            return named
        order = Window.partitionBy("x").orderBy("role", "text")
        split = stage(named.join(shared, "x", "left_semi").select("x", "role", "text").distinct().withColumn("n", F.row_number().over(order)))
        fresh = F.when(F.col("n") > 1, F.xxhash64("x", "n")).otherwise(F.col("x"))
        named = named.join(split, ["x", "role", "text"], "left").withColumn("x", fresh).drop("n")


def scanned(turns: DataFrame) -> DataFrame:
    """(conv, part, i, s, x, chars): each turn's number in its piece of the conversation and the sum of x * _MULT^i so far."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, i, s = None, 0, np.uint64(0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, x = batch.column(0).to_numpy(), _u(batch.column(2))
            head = np.append(True, ids[1:] != ids[:-1])
            begin = np.flatnonzero(head)
            if conv != ids[0]:
                i, s = 0, np.uint64(0)
            of = np.cumsum(head) - 1
            number = np.arange(1, n + 1) - begin[of]
            number[of == 0] += i
            sums = np.concatenate([[np.uint64(0)], np.cumsum(x * power(number), dtype=np.uint64)])
            total = sums[1:] - sums[begin[of]]
            total[of == 0] += s
            conv, i, s = ids[-1], int(number[-1]), total[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number), pa.array(total.view(np.int64)), batch.column(2), batch.column(3)], names=["conv", "part", "i", "s", "x", "chars"])

    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = turns.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select("conv", F.spark_partition_id().cast("long").alias("part"), "x", F.length("text").cast("long").alias("chars")).mapInArrow(scan, "conv long, part long, i long, s long, x long, chars long")


def _continued(pieces: pa.Table) -> pa.Table:
    """offset and carry of the pieces of one conversation: the number and the sum of all turns before."""
    order = np.argsort(pieces["part"].to_numpy())
    n, total = pieces["n"].to_numpy()[order], pieces["total"].to_numpy()[order].view(np.uint64)
    offset = np.cumsum(n) - n
    moved = total * power(offset)
    carry = np.cumsum(moved, dtype=np.uint64) - moved
    return pa.table({"conv": pieces["conv"].take(pa.array(order)), "part": pieces["part"].take(pa.array(order)), "offset": offset, "carry": carry.view(np.int64)})


def rebuilt_rows(turns: DataFrame, borrowed: Column, lender: Column) -> DataFrame:
    """(conv, depth, print, parent, x, chars, last) of the rebuilt conversations, with a row of depth 0 for each.

    Of turns (conv, turn, role, text, x), conversation conv gets the first `borrowed` turns, 5 at most, of `lender`, then
    its own after as many; both are expressions of conv.
    """
    t = stage(scanned(turns))
    pieces = stage(t.groupBy("conv", "part").agg(F.max("i").alias("n"), F.max_by("s", "i").alias("total")))
    several = pieces.groupBy("conv").agg(F.count("*").alias("pieces")).filter("pieces > 1").select("conv")
    later = stage(pieces.join(several, "conv", "left_semi").groupBy("conv").applyInArrow(_continued, "conv long, part long, offset long, carry long"))

    def placed(rows: DataFrame) -> DataFrame:
        known = rows.join(later, ["conv", "part"], "left")
        return known.fillna(0, ["offset", "carry"])

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From conv, i, s, x, chars, offset, carry and the rebuilding's h, u, head_sum, own_sum, n."""
        for batch in batches:
            get = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            p = get["i"].to_numpy() + get["offset"].to_numpy()
            x = _u(get["x"])
            total = _u(get["carry"]) + power(get["offset"].to_numpy()) * _u(get["s"])
            shift = get["u"].to_numpy() - get["h"].to_numpy()
            by = power(shift)
            here = _u(get["head_sum"]) + by * (total - _u(get["own_sum"]))
            above = here - by * x * power(p)
            out = [get["conv"], pa.array(p + shift), pa.array(here.view(np.int64)), pa.array(above.view(np.int64)), get["x"], get["chars"], pa.array(p == get["n"].to_numpy())]
            yield pa.RecordBatch.from_arrays(out, names=["conv", "depth", "print", "parent", "x", "chars", "last"])

    schema = "conv long, depth long, print long, parent long, x long, chars long, last boolean"
    plain = [F.lit(0).cast("long").alias(c) for c in ("h", "u", "head_sum", "own_sum", "n")]
    row = ["conv", "i", "s", "x", "chars", "offset", "carry"]
    firsts = stage(placed(t.filter("i <= 5")).filter("i + offset <= 5").select(*row, *plain).mapInArrow(prints, schema).drop("last"))
    lent = firsts.select(F.col("conv").alias("head"), F.col("depth").alias("p"), F.col("print").alias("head_sum"), "parent", "x", "chars")
    convs = pieces.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("h", borrowed.cast("long")).withColumn("head", lender.cast("long"))
    sums = lent.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("p", "head_sum"))).alias("sums"))
    convs = convs.join(sums, "head", "left").withColumn("u", F.least("h", F.coalesce(F.size("sums"), F.lit(0))).cast("long"))
    convs = convs.withColumn("head_sum", F.when(F.col("u") > 0, F.element_at("sums", F.greatest(F.col("u"), F.lit(1)).cast("int"))["head_sum"]).otherwise(0)).drop("sums")
    at = firsts.select("conv", F.col("depth").alias("h"), F.col("print").alias("own_sum"))
    convs = stage(convs.join(at, ["conv", "h"], "left").fillna(0, ["own_sum"]).select("conv", "n", "h", "u", "head", "head_sum", "own_sum"))
    of_piece = pieces.select("conv", "part").join(convs.drop("head"), "conv").filter("n > h")
    own = placed(t.join(of_piece, ["conv", "part"])).filter("i + offset > h").select(*row, "h", "u", "head_sum", "own_sum", "n").mapInArrow(prints, schema)
    taken = convs.select("conv", "head", "u", (F.col("n") <= F.col("h")).alias("ends")).join(lent, "head").filter("p <= u")
    taken = taken.select("conv", F.col("p").alias("depth"), F.col("head_sum").alias("print"), "parent", "x", "chars", (F.col("ends") & (F.col("p") == F.col("u"))).alias("last"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "print", "parent", "x", "chars")]
    roots = convs.select("conv", *zero, ((F.col("u") == 0) & (F.col("n") <= F.col("h"))).alias("last"))
    rebuilt = stage(own.unionByName(taken).unionByName(roots))
    discard(t, pieces, later, firsts, convs)
    return rebuilt


def separated(rows: DataFrame) -> DataFrame:
    """rows with split and parent_split: False where groups of equal print are nodes; True where prints collide, there or
    above, and print and parent are the smallest conversations of the nodes instead."""
    apart = F.max("x") != F.min("x")
    bad = stage(rows.groupBy("depth", "print").agg(apart.alias("x"), (F.max("parent") != F.min("parent")).alias("parent")).filter("x OR parent").select("depth", "print"))
    whole = rows.withColumn("split", F.lit(False)).withColumn("parent_split", F.lit(False))
    if bad.isEmpty():
        return whole
    start = stage(rows.join(bad, ["depth", "print"]).groupBy("conv").agg(F.min("depth").alias("start")))
    held = rows.select("conv", "depth", "x")
    left = stage(rows.join(start, "conv").filter("depth >= start").select("conv", "depth", "print"))
    done: list[DataFrame] = []
    while not left.isEmpty():
        named = stage(left.join(left.groupBy("depth", "print").agg(F.min("conv").alias("node")), ["depth", "print"]))
        pairs = named.filter("conv <> node").select("conv", "node").distinct()
        other = held.select(F.col("conv").alias("node"), "depth", F.col("x").alias("y"))
        differ = stage(pairs.join(held, "conv").join(other, ["node", "depth"]).filter("x <> y").groupBy("conv", "node").agg(F.min("depth").alias("differ")))
        judged = named.join(differ, ["conv", "node"], "left")
        done.append(stage(judged.filter("differ IS NULL OR depth < differ").select("conv", "depth", "node")))
        left = stage(judged.filter("depth >= differ").select("conv", "depth", "print"))
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    above = nodes.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("above"))
    both = rows.join(nodes, ["conv", "depth"], "left").join(above, ["conv", "depth"], "left")
    return stage(both.select("conv", "depth", F.coalesce("node", "print").alias("print"), F.coalesce("above", "parent").alias("parent"), "x", "chars", "last", F.col("node").isNotNull().alias("split"), F.col("above").isNotNull().alias("parent_split")))


def end_hashes(ends: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of the ends (KEY, conv): the hash of the conversations, ascending, joined by commas."""
    counted = stage(ends.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv").alias("conv")))
    alone = counted.filter("n = 1").select(*KEY, F.sha2(F.col("conv").cast("string"), 256).alias("ends_sha256"))
    many = ends.join(counted.filter("n > 1").select(*KEY), KEY, "left_semi")
    order = [*KEY, "conv"]
    parts = max(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        change = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
        head = np.flatnonzero(change)
        return list(zip(head.tolist(), np.append(head[1:], batch.num_rows).tolist(), strict=True))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [(i, min(i + LIST, b)) for a, b in (runs(batch) if batch.num_rows else []) for i in range(a, b, LIST)]
            first = pa.array([a for a, _ in cuts], pa.int64())
            ids = batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([*[c.take(first) for c in batch.columns], pa.array([",".join(map(str, ids[a:b])) for a, b in cuts], pa.string())], names=[*order, "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            for *here, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
                if here == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key:
                    done.append((*key, sha.hexdigest()))
                key, sha = here, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(named, d, strict=True)) for d in done], kinds)
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip(named, (*key, sha.hexdigest()), strict=True))], kinds)

    named = [*KEY, "ends_sha256"]
    kinds = pa.schema([("split", pa.bool_()), ("depth", pa.int64()), ("print", pa.int64()), ("ends_sha256", pa.string())])
    lists = many.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*order).mapInArrow(listed, "split boolean, depth long, print long, conv long, ids string")
    hashes = lists.repartition(parts, *KEY).sortWithinPartitions(*order).mapInArrow(digested, "split boolean, depth long, print long, ends_sha256 string")
    return alone.unionByName(hashes)


def trie(turns: DataFrame, borrowed: Column | None = None, lender: Column | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", hashed: Callable[..., Column] = F.xxhash64, bits: int = 64) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    borrowed and lender, expressions over a column conv, rebuild conversations first (rebuilt_rows). A node is named by
    its smallest conversation and its depth. saved_tokens sums, over the subtree, the code points of a node's last text
    for all members but one. bits narrows the prefix fingerprints, and hashed makes those of turns.
    """
    given = turns.select(turns[conv].cast("long").alias("conv"), turns[turn].alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text")).filter("conv IS NOT NULL")
    rows = rebuilt_rows(turn_prints(given, hashed), F.lit(0) if borrowed is None else borrowed, F.col("conv") if lender is None else lender)
    if bits < 64:
        rows = rows.withColumns({c: F.col(c).bitwiseAND(F.lit((1 << bits) - 1)) for c in ("print", "parent")})
    rows = separated(rows)
    nodes = stage(rows.groupBy(*KEY).agg(F.min("parent_split").alias("parent_split"), F.min("parent").alias("parent"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")))
    above = [F.col("parent_split").alias("split"), (F.col("depth") - 1).alias("depth"), F.col("parent").alias("print")]
    children = nodes.filter("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    weight = (F.col("n_convs") - 1) * F.col("chars")
    nodes = stage(nodes.join(children, KEY, "left").fillna(0, ["n_children"]).withColumn("weight", weight).withColumn("block", F.expr(f"depth div {BLOCK}")))
    runs = stage(nodes.groupBy("conv").agg(F.sum("weight").alias("run"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")))
    passing = rows.join(runs.filter("run > 0 OR leaf > 0"), "conv").groupBy(*KEY).agg(F.sum("run").alias("runs"), F.sum("leaf").alias("n_leaves"))
    blocks = nodes.groupBy("conv", "block").agg(F.sum("weight").alias("sum"))
    after = Window.partitionBy("conv").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("sum").over(after), F.lit(0)).alias("deeper"))
    below = Window.partitionBy("conv", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = nodes.withColumn("own", F.sum("weight").over(below)).join(blocks, ["conv", "block"]).join(runs.select("conv", "run"), "conv")
    named = nodes.select(*KEY, F.col("conv").alias("parent_conv_id"))
    full = own.join(passing, KEY, "left").fillna(0, ["runs", "n_leaves"]).join(end_hashes(rows.filter("last").select(*KEY, "conv")), KEY, "left")
    saved = F.col("own") + F.col("deeper") + F.col("runs") - F.col("run")
    result = full.select(F.col("conv").alias("conv_id"), F.col("depth").alias("at"), *above, "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_CONVERSATION)).alias("ends_sha256"))
    return result.join(named, KEY, "left").select("conv_id", F.col("at").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
