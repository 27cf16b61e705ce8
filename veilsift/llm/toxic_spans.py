"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

A word's features are fingerprints of itself, lower-cased and without outer punctuation, of its first
four, five and six bytes and of its last three, looked up in one table of weights. The chain has two
states. Forward-backward runs over all words of a slice of documents at once: a document's first word
has a transition matrix that forgets the state before it, so documents do not touch, and the 2 x 2
matrix products are taken column by column over rows of a fixed length, then carried from row to row.

Training labels are of documents. Words are labelled by a greedy cover: the feature that occurs in most
toxic documents not yet explained, and far more often than in others, marks its words as toxic, until no feature
explains more documents. The field is then fitted to the labelled words, and two numbers of each
document, its largest marginal's odds and its expected count of toxic words, to the documents' labels.
It is fitted on a sample of MOST_TOXIC + MOST_CLEAN labelled documents at most, in hash order of their
ids, whole texts; everything else reads all documents. Without toxic labels all scores are near 0.

Null and empty texts have no spans and get the score of a text without toxic words. Long texts are
scored whole, memory follows the text. Repeated rows get equal scores; an empty table gives an empty
table. A score of exactly 0.5 counts as toxic in the query. Other columns are carried only if named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcols import LOWER, slices, spans, utf8, word_hashes

MOST_TOXIC, MOST_CLEAN = 1_000, 2_000
#: How many times more frequent in toxic documents than in others a feature is that marks words as toxic.
PURITY = 8
SLOTS = 1 << 20
ROW = 256
SLICE_BYTES = 2 << 20
#: Kinds of features: the word, prefixes by their bytes, a suffix.
PREFIXES, SUFFIX = (4, 5, 6), 3

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    step: np.ndarray
    start: np.ndarray
    document: np.ndarray


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of each word's features (words x kinds), its byte start and end, each text's first word, and the texts' bytes and offsets."""
    data, offsets = utf8(column)
    low = LOWER[data]
    starts, ends, first = spans(data, offsets)
    s, e = starts.copy(), ends.copy()
    for at, move, edge in ((s, 1, 0), (e, -1, -1)):
        open_ = np.flatnonzero(e - s > 1)
        while len(open_):
            open_ = open_[_PUNCTUATION[low[at[open_] + edge]] & (e[open_] - s[open_] > 1)]
            at[open_] += move
    kinds = [(s, e), *[(s, np.minimum(s + k, e)) for k in PREFIXES], (np.maximum(s, e - SUFFIX), e)]
    slots = np.empty((len(s), len(kinds)), np.int32)
    for k, (a, b) in enumerate(kinds):
        slots[:, k] = ((word_hashes(low, a, b) + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(23)) % np.uint64(SLOTS)
    return slots, s, e, first, data, offsets


def marginals(emission: np.ndarray, first: np.ndarray, step: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Of each word the probability of the toxic state; with pairs also the summed pair and start marginals.

    emission: log odds of the toxic state from the word alone; first: n + 1 positions of documents.
    """
    n = len(emission)
    if n == 0:
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
    rows = -(-n // ROW)
    on = 1.0 / (1.0 + np.exp(-np.clip(emission, -30, 30)))
    local = np.stack([1.0 - on, on])
    move, begin = np.exp(step), np.exp(start - start.max())
    fresh = np.zeros(n, bool)
    fresh[first[:-1][first[:-1] < first[1:]]] = True
    m = np.empty((2, 2, rows * ROW))
    m[:, :, n:] = np.eye(2)[:, :, None]
    for i in range(2):
        for j in range(2):
            m[i, j, :n] = np.where(fresh, begin[j], move[i, j]) * local[j]
    m = np.ascontiguousarray(m.reshape(2, 2, rows, ROW).transpose(3, 0, 1, 2))
    left, right = np.empty_like(m), np.empty_like(m)

    def times(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
        for i in range(2):
            for j in range(2):
                np.multiply(a[i, 0], b[0, j], out=out[i, j])
                out[i, j] += a[i, 1] * b[1, j]
        out /= out[0, 0] + out[0, 1] + out[1, 0] + out[1, 1]

    left[0] = m[0]
    for c in range(1, ROW):
        times(left[c - 1], m[c], left[c])
    right[ROW - 1] = np.eye(2)[:, :, None]
    for c in range(ROW - 2, -1, -1):
        times(m[c + 1], right[c + 1], right[c])
    before, after = np.empty((2, rows)), np.empty((2, rows))
    v = np.full(2, 0.5)
    for r in range(rows):
        before[:, r] = v
        v = v @ left[ROW - 1, :, :, r]
        v /= v.sum()
    v = np.full(2, 0.5)
    for r in range(rows - 1, -1, -1):
        after[:, r] = v
        v = m[0, :, :, r] @ (right[0, :, :, r] @ v)
        v /= v.sum()
    alpha = [before[0] * left[:, 0, j] + before[1] * left[:, 1, j] for j in range(2)]
    beta = [right[:, j, 0] * after[0] + right[:, j, 1] * after[1] for j in range(2)]
    flat = lambda x: x.T.reshape(-1)[:n]
    alpha, beta = [flat(x) for x in alpha], [flat(x) for x in beta]
    yes, no = alpha[1] * beta[1], alpha[0] * beta[0]
    p = yes / (yes + no)
    if not pairs:
        return p
    inner = np.flatnonzero(~fresh)
    joint = np.stack([alpha[i][inner - 1] * move[i, j] * local[j][inner] * beta[j][inner] for i in range(2) for j in range(2)])
    joint /= joint.sum(0)
    return p, joint.sum(1).reshape(2, 2), np.array([(1 - p[fresh]).sum(), p[fresh].sum()])


def _cover(slots: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Slots that explain toxic documents, by greedy cover; the suffix is no explanation."""
    kinds = range(slots.shape[1] - 1)
    pairs = [np.unique(slots[:, k].astype(np.int64) * len(toxic) + doc) for k in kinds]
    count = lambda part: sum(np.bincount(p[toxic[p % len(toxic)] == part] // len(toxic), minlength=SLOTS) for p in pairs)
    inside, outside = count(True), count(False)
    pure = (inside >= 2) & (outside * toxic.sum() * PURITY <= inside * max(1, (~toxic).sum()))
    pairs = np.concatenate([p[toxic[p % len(toxic)] & pure[p // len(toxic)]] for p in pairs])
    slot, where = pairs // len(toxic), pairs % len(toxic)
    found, least = [], max(2, int(toxic.sum()) // 500)
    while len(slot):
        gain = np.bincount(slot, minlength=SLOTS)
        best = int(gain.argmax())
        if gain[best] < least:
            break
        found.append(best)
        covered = np.zeros(len(toxic), bool)
        covered[where[slot == best]] = True
        rest = ~covered[where]
        slot, where = slot[rest], where[rest]
    return np.array(found, np.int64)


def document_numbers(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: 1, the log odds of its largest marginal, and the log of one plus its expected toxic words."""
    out = np.tile(np.array([1.0, -8.0, 0.0]), (len(first) - 1, 1))
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        top = np.clip(np.maximum.reduceat(p, first[some]), 1e-9, 1 - 1e-9)
        out[some, 1] = np.clip(np.log(top / (1 - top)), -8, 8)
        out[some, 2] = np.log1p(np.add.reduceat(np.where(p >= 0.5, p, 0.0), first[some]))
    return out


def fit(texts: list[str], toxic: list[bool], epochs: int = 4, rate: float = 0.5) -> Model:
    """Fits the field and the document scores to labelled texts."""
    y = np.array(toxic, bool)
    model = Model(np.zeros(SLOTS, np.float32), -4.0, np.zeros((2, 2)), np.zeros(2), np.array([-4.0, 1.0, 0.0]))
    if not y.any():
        return model
    slots, _, _, first, _, _ = word_features(pa.array(texts, pa.string()))
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    marked = np.zeros(SLOTS, bool)
    marked[_cover(slots, doc, y)] = True
    tags = (marked[slots[:, :-1]].any(1) & y[doc]).astype(np.float64)
    weights, seen = np.zeros(SLOTS), np.full(SLOTS, 1e-2)
    steps = [model.step, model.start]
    grown = [np.full((2, 2), 1.0), np.full(2, 1.0)]
    bias, bias_seen = model.bias, 1.0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), 128):
            docs = np.sort(order[a : a + 128])
            sizes = (first[docs + 1] - first[docs]).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            pick = np.repeat(first[docs] - at[:-1], sizes) + np.arange(at[-1])
            if not len(pick):
                continue
            part, tag = slots[pick], tags[pick]
            p, joint, begin = marginals(weights[part].sum(1) + bias, at, steps[0], steps[1], pairs=True)
            g = np.bincount(part.ravel(), np.repeat(tag - p, part.shape[1]), SLOTS)
            touched = np.flatnonzero(g)
            g = g[touched] - 1e-3 * weights[touched]
            seen[touched] += g * g
            weights[touched] += rate * g / np.sqrt(seen[touched])
            g = (tag - p).sum()
            bias_seen += g * g
            bias += rate * g / np.sqrt(bias_seen)
            t = tag.astype(int)
            head = np.zeros(len(t), bool)
            head[at[:-1][sizes > 0]] = True
            later = np.flatnonzero(~head)
            true = np.bincount(t[later - 1] * 2 + t[later], minlength=4).reshape(2, 2)
            for k, g in enumerate((true - joint, np.bincount(t[head], minlength=2) - begin)):
                grown[k] += g * g
                steps[k] += rate * g / np.sqrt(grown[k])
    model = Model(weights.astype(np.float32), float(bias), steps[0], steps[1], model.document)
    x = []
    for a in range(0, len(y), 128):
        at = first[a : a + 129]
        x.append(document_numbers(marginals(model.weights[slots[at[0] : at[-1]]].sum(1) + bias, at - at[0], *steps), at - at[0]))
    x = np.concatenate(x)
    model.document = _logistic(x, y.astype(np.float64))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * w), -2, 2)
    return w


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on a bounded sample of the labelled documents; labels has a row per labelled key."""
    part = lambda value, most: labels.filter(F.col(label) == value).orderBy(F.xxhash64(key), key).limit(most)
    chosen = part(1, MOST_TOXIC).unionByName(part(0, MOST_CLEAN)).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key").orderBy("_key").collect()
    return fit([r["_text"] or "" for r in rows], [r["_label"] == 1 for r in rows])


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in carry (if None, all but text and those named like outputs), score (0 to 1) and toxic_spans: code points, ends exclusive."""
    carry = [c for c in docs.columns if c not in (text, "score", "toxic_spans")] if carry is None else carry
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", SPANS)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b in slices(utf8(batch.column(0))[1], SLICE_BYTES):
                part = batch.slice(a, b - a)
                slots, s, e, first, data, offsets = word_features(part.column(0))
                p = marginals(m.weights[slots].sum(1, dtype=np.float64) + m.bias, first, m.step, m.start)
                scores = 1 / (1 + np.exp(-np.clip(document_numbers(p, first) @ m.document, -30, 30)))
                hits, found = np.flatnonzero(p >= 0.5), [[] for _ in range(b - a)]
                if len(hits):
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    doc = np.searchsorted(first, hits, "right") - 1
                    head = chars[offsets[doc]]
                    for d, x, y, q in zip(doc.tolist(), (chars[s[hits]] - head).tolist(), (chars[e[hits]] - head).tolist(), p[hits].tolist(), strict=True):
                        found[d].append({"start": x, "end": y, "probability": q})
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(scores, pa.float64()), pa.array(found, kind)], names=schema.names)

    return docs.select(docs[text].alias("_text"), *[docs[c] for c in carry]).mapInArrow(run, schema)
