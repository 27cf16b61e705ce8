"""N-gram Jaccard join by parity sketches: documents whose shingle sets have a similarity of num / den or more.

A document's set is its distinct n-word shingles of lower-cased (A-Z) words, or its whole word sequence
if it is shorter; texts without words have an empty set and link with nothing. Equal sets are one node,
numbered by a 64-bit fingerprint of the set, so copies cost nothing after the first step.

Similar sets have sizes within num / den of each other and a symmetric difference of at most
d = (den - num) / (den + num) times the sum of their sizes. Sizes are cut into bands so that similar
sets lie in one band or in neighbours. Each node joins in its own band, and in the next one too if a
set of that band can be similar to it. In a band the shingles are dealt to d + 1 + e parts, and each
part's tokens are XOR-hashed: the hash is equal exactly where the part's parity sketch is. A shingle
that only one set has changes one part, so by the pigeonhole principle at least e + 1 parts of two
similar sets are equal. A set with at most e empty parts therefore joins by the others only, and e is
chosen so that nearly all sets are such; one with more empty parts joins by all.

1. Nodes that share a key form a bucket. Within a slice of the input and then across all slices, each
   member is paired with one pivot only. Each node is compared with the pivot it shares most keys with,
   by size and by the Hamming distance of a parity sketch of a bit or two a member, which is a lower
   bound of the symmetric difference. What these leave in reach is closed to families.
2. In a bucket whose members are in several families, pairs of different families are compared by the
   same sketches, in memory, and families that touch become one as soon as a pair in reach is seen.
   Thus every pair that shares a key is ruled out by its sketches or lies in one family.
3. In a family every pair is compared on the whole sets: the sizes of all intersections come from products of
   0/1 matrices over the shingles that several sets share. Counts of links leave a task, and of the
   links themselves a spanning forest, whose closure gives the components.

A bucket or family of any size is dealt into blocks of a bounded size, and each pair of blocks meets in
one group, so no task holds more than two blocks; rows grow with members times blocks. The comparisons
of 2 and 3 themselves grow with the square of a bucket or family.

Null texts count as empty. A long text makes a large set, held one at a time. Rows that share a key, or
have none, are documents of their own; a component's number is its smallest key that isn't null, and null if
it has none. Ties don't arise: of equal sets, one stands for all. An empty table gives an empty table.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .staging import checkpoint, discard, release, stage
from .textcols import LOWER, mix, ngram_hashes, slices, spans, utf8, word_hashes

SLICE_BYTES = 3 << 20
#: Of two bands' lower bounds, the least ratio. Wider bands ask for more keys of their small sets, narrower ones make more sets join twice.
WIDTH = 1.5
#: Members of one block of a bucket.
BLOCK_MEMBERS = 2_048
#: Sets and shingles of one block of a family, about.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 20
#: Shingles that a matrix of sets has as columns at most.
COLUMNS = 4_096


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle fingerprints of each text, sorted, and n + 1 offsets into them."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets)
    h = word_hashes(data, starts, ends)
    counts = np.diff(first)
    grams = ngram_hashes(h, n)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(sizes)])
    values, fresh = np.empty(int(at[-1]), np.uint64), np.ones(int(at[-1]), bool)
    for i, (a, b, w, k) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), first[:-1].tolist(), counts.tolist(), strict=True)):
        if k >= n:
            part = np.sort(grams[w : w + b - a])
            values[a:b] = part
            fresh[a + 1 : b] = part[1:] != part[:-1]
        elif k:
            values[a] = ngram_hashes(h[w : w + k], k)[0] + np.uint64(k)
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return values[fresh], kept[at]


def set_numbers(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set, from sums over its members and its size."""
    a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values), dtype=np.uint64)])
    b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x5BF03635)), dtype=np.uint64)])
    total = (a[at[1:]] - a[at[:-1]]) ^ mix(b[at[1:]] - b[at[:-1]]) ^ np.diff(at).astype(np.uint64)
    return mix(total).astype(np.int64)


def bands(largest: int, num: int, den: int) -> np.ndarray:
    """Lower bounds of the size bands up to two beyond largest; each is WIDTH times the one before, and at least den / num times."""
    out = [1]
    while len(out) < 3 or out[-3] <= largest:
        out.append(max(out[-1] + 1, -(-out[-1] * den // num), int(out[-1] * WIDTH)))
    return np.array(out, np.int64)


def band_parts(low: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each band but the last: its parts, and how many of them a set may have empty without joining by those."""
    most = (den - num) * 2 * (low[1:] - 1) // (den + num)
    spare = np.zeros(len(most), np.int64)
    for _ in range(3):
        parts = most + 1 + spare
        empty = parts * np.exp(-low[:-1] / parts)
        spare = np.ceil(empty + 2 * np.sqrt(empty)).astype(np.int64)
    return np.where(most > 0, most + 1 + spare, 0), spare


def sketch_keys(values: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The join keys of each set, and the number of the set that each belongs to."""
    sizes = np.diff(at)
    low = bands(int(sizes.max(initial=1)), num, den)
    own = np.searchsorted(low, np.maximum(sizes, 1), "right") - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h = mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    place, token = h >> np.uint64(32), mix(h)
    parts_of, spare_of = band_parts(low, num, den)
    keys, sets = [], []
    for band in (own, own + 1):
        reaches = (band == own) | (den * sizes >= num * low[band])
        parts = np.where((sizes > 0) & reaches, parts_of[band], 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        use = parts[owner] > 0
        slot = base[owner[use]] + ((place[use] * parts[owner[use]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        words = np.zeros(int(base[-1]), np.uint64)
        np.bitwise_xor.at(words, slot, token[use])
        who = np.repeat(np.arange(len(sizes)), parts)
        empty = np.bincount(slot, minlength=len(words)) == 0
        joins = ~empty | (np.bincount(who[empty], minlength=len(sizes)) > spare_of[band])[who]
        number = np.arange(len(who)) - base[who]
        label = mix((band[who].astype(np.uint64) << np.uint64(40)) | number.astype(np.uint64))
        keys.append(mix(words + label)[joins])
        sets.append(who[joins])
    return np.concatenate(keys).astype(np.int64), np.concatenate(sets)


def sketches(values: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of each set a parity sketch of one or two bits a member, a power of two, 64 at least."""
    sizes = np.diff(at)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = (mix(values ^ np.uint64(0x3C6EF372FE94F82B)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(base[owner] + place, minlength=int(base[-1])) & 1
    raw = np.packbits(odd.astype(np.uint8)).tobytes()
    return [raw[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for a, b in slices(utf8(batch.column(0))[1], SLICE_BYTES):
        part = batch.slice(a, b - a)
        values, at = shingle_sets(part.column(0), n)
        yield part, values, at, set_numbers(values, at)


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """A row per row (key, text): key, hash of the text, n_shingles, node (the number of its set, null if it is empty), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values, at, numbers in _sets(batch, n):
                sizes = np.diff(at)
                empty = sizes == 0
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64(), mask=empty), pa.array(sketches(values, at), pa.binary(), mask=empty)], names=["key", "hash", "n_shingles", "node", "sketch"])

    kind = docs.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("sketch", T.BinaryType())])
    return docs.select("text", "key", F.xxhash64("text").alias("hash")).mapInArrow(run, schema)


def buckets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(key, node, pivot) of all buckets with at least two nodes. Members that met their pivot in the same slice
    travel under a number of their own, so a key's rows in the shuffle are one for each slice at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, values, at, numbers in _sets(batch, n):
                sizes, fresh = np.diff(at), np.zeros(len(numbers), bool)
                for i, number in enumerate(numbers.tolist()):
                    if sizes[i] and number not in seen:
                        fresh[i] = True
                        seen.add(number)
                if len(seen) > 1_000_000:
                    seen.clear()
                at = np.concatenate([[0], np.cumsum(sizes[fresh])])
                keys, which = sketch_keys(values[np.repeat(fresh, sizes)], at, num, den)
                nodes = numbers[fresh][which]
                order = np.argsort(keys, kind="stable")
                keys, nodes = keys[order], nodes[order]
                head = np.ones(len(keys), bool)
                head[1:] = keys[1:] != keys[:-1]
                first = np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))
                pivots = nodes[first]
                last = np.ones(len(keys), bool)
                last[:-1] = head[1:]
                absorbed = ~head & (nodes != pivots)
                use = head | absorbed
                joint, away = (head & ~last)[use], absorbed[use]
                keys, nodes, pivots = keys[use], nodes[use], pivots[use]
                route = np.where(away, mix(nodes.astype(np.uint64) ^ keys.astype(np.uint64)).astype(np.int64), keys)
                yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(nodes), pa.array(keys, mask=~away), pa.array(pivots, mask=~away), pa.array(joint)], names=["route", "node", "key", "pivot", "joint"])

    rows = docs.select("text").mapInArrow(run, "route long, node long, key long, pivot long, joint boolean").withColumn("absorbed", F.col("key").isNotNull())
    w = Window.partitionBy("route", "absorbed")
    met = rows.withColumn("low", F.min("node").over(w)).withColumn("high", F.max("node").over(w)).withColumn("any", F.max("joint").over(w))
    return met.filter("absorbed or any or low < high").select(F.coalesce("key", "route").alias("key"), "node", F.coalesce("pivot", "low").alias("pivot"))


def in_reach(members: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), enough pairs of buckets (key, a, b, block, node, root) to join all roots between which a bucket has a pair whose
    sizes and sketches allow the similarity. In the group of blocks a and b, members of one are compared with those of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            same = np.ones(joined.num_rows, bool)
            for c in ("key", "a", "b"):
                column = joined.column(c).to_numpy()
                same &= column == column[-1]
            cut = joined.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = joined.slice(cut)
            yield _joining(joined.slice(0, cut), num, den)
        if rest is not None:
            yield _joining(rest, num, den)

    rows = members.hint("merge").join(nodes.select("node", "size", "sketch"), "node").select("key", "a", "b", "block", "node", "root", "size", "sketch")
    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "a long, b long")


def _joining(rows: pa.Table, num: int, den: int) -> pa.RecordBatch:
    """The pairs of whole groups, which are runs of equal (key, a, b): each row is compared with the rows 1, 2, ... places after
    it, and roots that a pair joins are one from then on. All sketches of a group are folded to the shortest one's length."""
    found: list[tuple[int, int]] = []
    if rows.num_rows:
        key, a, b, block, node, root, size = (rows.column(c).to_numpy() for c in ("key", "a", "b", "block", "node", "root", "size"))
        raw = rows.column("sketch").to_pylist()
        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        members = np.diff(np.append(head, len(key)))
        ends = np.repeat(head + members, members)
        own = np.array([len(x) for x in raw])
        shortest = np.repeat(np.minimum.reduceat(own, head), members)
        label = np.unique(root, return_inverse=True)[1]
        parent = list(range(int(label.max()) + 1))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for width in np.unique(shortest):
            some = np.flatnonzero(shortest == width)
            words = np.empty((len(some), width // 8), np.uint64)
            for length in np.unique(own[some]):
                which = np.flatnonzero(own[some] == length)
                folded = np.frombuffer(b"".join(raw[i] for i in some[which]), np.uint8).reshape(len(which), length // width, width)
                words[which] = np.ascontiguousarray(np.bitwise_xor.reduce(folded, axis=1)).view(np.uint64)
            place = np.full(len(key), -1)
            place[some] = np.arange(len(some))
            i, step, joins = some, 1, False
            while len(i):
                i = i[i + step < ends[i]]
                for x in np.array_split(i, len(i) // 200_000 + 1):
                    y = x + step
                    small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                    fit = (label[x] != label[y]) & (den * small >= num * large) & ((a[x] == b[x]) | (block[x] != block[y]))
                    x, y = x[fit], y[fit]
                    apart = np.bitwise_count(words[place[x]] ^ words[place[y]]).sum(1, dtype=np.int64)
                    near = apart * (den + num) <= (den - num) * (small + large)[fit]
                    for p, q in zip(x[near].tolist(), y[near].tolist(), strict=True):
                        u, v = top(int(label[p])), top(int(label[q]))
                        if u != v:
                            parent[max(u, v)] = min(u, v)
                            found.append((int(node[p]), int(node[q])))
                            joins = True
                if joins:
                    label, joins = np.array([top(x) for x in range(len(parent))])[label], False
                step += 1
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """rows with the number of blocks of their group, each in its block and once for every pair (a, b) of blocks it belongs to."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("other", "blocks")


def links_between(values: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the sets numbered left reach the similarity with which of those numbered right, as a matrix; no set links with itself."""
    sizes = np.diff(at)
    _, column, held = np.unique(values, return_inverse=True, return_counts=True)
    shared = held > 1
    use = shared[column]
    column, row = (np.cumsum(shared) - 1)[column[use]], np.repeat(np.arange(len(sizes)), sizes)[use]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(left), len(right)), np.int64)
    width = int(shared.sum())
    for low in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        has = np.zeros((len(sizes), min(COLUMNS, width - low)), np.float32)
        has[row[a:b], column[a:b] - low] = 1
        both += (has[left] @ has[right].T).astype(np.int64)
    linked = (both > 0) & (den * both >= num * (sizes[left][:, None] + sizes[right] - both))
    return linked & (left[:, None] != right)


def spanning_forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Enough of the links to connect all that they connect, found breadth first."""
    size = int(max(left.max(initial=-1), right.max(initial=-1))) + 1
    touches = np.zeros((size, size), bool)
    touches[np.ix_(left, right)] = linked
    touches |= touches.T
    todo, found = touches.any(1), []
    for start in np.flatnonzero(todo).tolist():
        if not todo[start]:
            continue
        todo[start], front = False, [start]
        while front:
            x = front.pop()
            new = np.flatnonzero(touches[x] & todo).tolist()
            todo[new] = False
            found += [(x, y) for y in new]
            front += new
    return found


def compare_families(members: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, links, other) of members (node, root, size, copies, key, hash), the sets of families: rows without other count the
    documents with other sets that reach the similarity with node, rows with one are links that connect all that links connect."""
    number = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    dealt = block_pairs(members.select("root", "node", "copies").join(members.groupBy("root").agg(number.alias("blocks")), "root"), "root")
    # A text for each set. The documents are shuffled at any size: a plan that broadcasts a small side says nothing about a large one.
    wanted = members.select("node", F.col("key").alias("_key"), F.col("hash").alias("_hash"))
    same = (F.col("hash") == F.col("_hash")) & F.col("key").eqNullSafe(F.col("_key"))
    texts = docs.withColumn("hash", F.xxhash64("text")).join(wanted.hint("merge"), same).select("node", "text").dropDuplicates(["node"])
    rows = dealt.hint("merge").join(texts, "node").select("root", "a", "b", "node", "block", "copies", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def compared() -> pa.RecordBatch:
            values, at = shingle_sets(pa.array([x[3] for x in held], pa.string()), n)
            node, block, copies = (np.array([x[i] for x in held], np.int64) for i in range(3))
            left, right = np.flatnonzero(block == group[1]), np.flatnonzero(block == group[2])
            linked, links = links_between(values, at, left, right, num, den), np.zeros(len(held), np.int64)
            links[left] += linked.astype(np.int64) @ copies[right]
            if group[1] != group[2]:
                links[right] += linked.T.astype(np.int64) @ copies[left]
            forest = np.array(spanning_forest(linked, left, right), np.int64).reshape(-1, 2)
            some = np.flatnonzero(links)
            other = np.concatenate([np.zeros(len(some), np.int64), node[forest[:, 1]]])
            counts = np.arange(len(other)) < len(some)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[some], node[forest[:, 0]]])), pa.array(np.concatenate([links[some], np.zeros(len(forest), np.int64)])), pa.array(other, mask=counts)], names=["node", "links", "other"])

        for batch in batches:
            for root, a, b, node, block, copies, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, a, b) != group:
                    if len(held) > 1:
                        yield compared()
                    group, held = (root, a, b), []
                held.append((node, block, copies, text))
        if len(held) > 1:
            yield compared()

    sorted_rows = rows.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "node")
    return sorted_rows.mapInArrow(compare, "node long, links long, other long")


def similar_groups(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, n_shingles, component_id (the smallest key that links lead to) and n_links (how
    many other documents reach the similarity with it, exact copies included)."""
    docs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    spark = docs.sparkSession
    found = stage(buckets(docs, n, num, den))
    release(spark)
    table = stage(set_table(docs, n))
    least = F.min(F.struct("key", "hash")).alias("least")
    nodes = stage(table.filter("node is not null").groupBy("node").agg(F.any_value("sketch").alias("sketch"), F.any_value("n_shingles").alias("size"), least, F.count("*").alias("copies"), F.min("key").alias("smallest")))

    shared = found.filter("pivot <> node").groupBy(F.col("pivot").alias("p"), F.col("node").alias("q")).agg(F.count("*").alias("shared"))
    best = shared.groupBy("q").agg(F.max_by("p", F.struct("shared", "p")).alias("p"))
    ends = best.select(F.col("q").alias("key"), F.explode(F.array("p", "q")).alias("node"))
    first = stage(in_reach(ends.select("key", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("block"), "node", F.col("node").alias("root")), nodes, num, den))
    families = checkpoint(components(first))
    release(spark)

    rows = found.select("key", "node").join(families, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = stage(rows)
    number = F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int")
    apart = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), number.alias("blocks")).filter("low < high").select("key", "blocks")
    members = block_pairs(rows.hint("merge").join(apart, "key").distinct(), "key")
    second = stage(in_reach(members, nodes, num, den))
    discard(found, rows)
    release(spark)
    families = checkpoint(components(first.unionByName(second)))
    members = families.join(nodes, "node").select("node", "root", "size", "copies", "least.key", "least.hash")
    compared = stage(compare_families(stage(members), docs, n, num, den))
    release(spark)
    roots = components(compared.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = nodes.select("node", "copies", "smallest").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    links = compared.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    named = placed.join(placed.groupBy("root").agg(F.min("smallest").alias("component_id")), "root").join(links, "node", "left")
    named = stage(named.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    discard(first, second, compared)
    release(spark)
    out = table.join(named, "node", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.coalesce("component_id", "key").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
