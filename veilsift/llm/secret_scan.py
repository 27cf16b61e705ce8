r"""Secret scans through a trigram index: Boolean trigram queries from each regex, then verification.

Each rule's regex is parsed once into a Boolean query over case-folded byte trigrams that every match
must contain. Documents are indexed in segments, the slices of an Arrow batch of bounded bytes: for
each trigram that some rule asks for, a sorted posting list of the segment's documents. A rule's
candidates are the intersections and unions of its postings; only they are read with the regex. A
rule without mandatory trigrams, such as a run of hex digits, reads every document of the segment.
Index and documents share a task, so no text is shuffled and a lost executor costs its segments only.

Null and empty texts have no spans. Texts of any length are read whole; memory follows the segment,
at least one text. Repeated rows repeat their spans; empty tables give empty tables. Matches are
leftmost and non-overlapping per kind; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from re import _constants as C
from re import _parser as P

from .textcols import LOWER, slices, utf8


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group has at least least characters; group 0 is the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules first; the others follow published descriptions of credential formats.
RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("temporary_access", r"ASIA[A-Z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("browser_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,80}:[^\s/:@]{1,80}@[A-Za-z0-9.-]+"),
)

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SEGMENT_BYTES = 4 << 20
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

# A query is True (any document), a trigram as bytes, or ("and" | "or", parts).
_MOST_STRINGS = 64


def _both(op: str, parts: list):
    """and drops True parts; or is True if one part is."""
    if op == "or" and any(p is True for p in parts):
        return True
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of_strings(strings: set[bytes]):
    """The query that a match contains one of strings."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _fold(char: int, ignore_case: bool) -> set[bytes] | None:
    if ignore_case and char > 127:
        return None
    return {chr(char).encode().translate(LOWER.tobytes())}


def _one(op, arg, ignore_case: bool) -> tuple[set[bytes] | None, object]:
    """(all strings it can match or None, query) of one parsed item."""
    if op is C.LITERAL:
        return _fold(arg, ignore_case), True
    if op is C.IN:
        chars: set[bytes] = set()
        for kind, x in arg:
            codes = [x] if kind is C.LITERAL else range(x[0], x[1] + 1) if kind is C.RANGE and x[1] - x[0] < 16 else None
            if codes is None:
                return None, True
            for c in codes:
                folded = _fold(c, ignore_case)
                if folded is None:
                    return None, True
                chars |= folded
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op is C.SUBPATTERN:
        _, add, _, inner = arg
        return _sequence(inner, ignore_case or bool(add & re.IGNORECASE))
    if op is C.BRANCH:
        parts = [_sequence(x, ignore_case) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= _MOST_STRINGS:
            return set().union(*[s for s, _ in parts]), True
        return None, _both("or", [_of_strings(s) if s is not None else q for s, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        strings, q = _sequence(inner, ignore_case)
        if high == 1 and low == 0:
            return (strings | {b""}, True) if strings is not None else (None, True)
        if low == 0:
            return None, True
        if strings is not None and len(strings) == 1:
            repeated = {next(iter(strings)) * min(int(low), 40)}
            return (repeated, True) if low == high and low <= 40 else (None, _of_strings(repeated))
        return None, q if strings is None else _of_strings(strings)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {b""}, True
    return None, True


def _sequence(items, ignore_case: bool) -> tuple[set[bytes] | None, object]:
    run, found, whole = {b""}, [], True
    for op, arg in items:
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] > arg[0] == 1:
            strings, q = _sequence(arg[2], ignore_case)
            if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:  # one copy, then perhaps more: what follows has one before it
                found.append(_of_strings({a + b for a in run for b in strings}))
                run, whole = strings, False
                continue
        strings, q = _one(op, arg, ignore_case)
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        found += [_of_strings(run), q]
        run, whole = (strings if strings is not None else {b""}), False
    return (run, True) if whole else (None, _both("and", [*found, _of_strings(run)]))


@lru_cache(maxsize=256)
def trigram_query(pattern: str):
    """The Boolean trigram query of a regex; True if it has no mandatory trigrams."""
    parsed = P.parse(pattern)
    strings, q = _sequence(parsed, bool(parsed.state.flags & re.IGNORECASE))
    return _of_strings(strings) if strings is not None else q


def _trigrams(q) -> set[bytes]:
    return {q} if isinstance(q, bytes) else set() if q is True else set().union(*map(_trigrams, q[1]))


def build_postings(data: np.ndarray, offsets: np.ndarray, wanted: list[bytes]) -> dict[bytes, np.ndarray]:
    """Of each wanted trigram the sorted documents that hold it; data are case-folded UTF-8 bytes."""
    if len(data) < 3 or not wanted:
        return {t: np.zeros(0, np.int64) for t in wanted}
    codes = np.array([int.from_bytes(t, "big") for t in wanted], np.int32)
    number = np.zeros(1 << 24, np.int16)
    number[codes] = np.arange(1, len(codes) + 1)
    rolled = (data[:-2].astype(np.int32) << 16) | (data[1:-1].astype(np.int32) << 8) | data[2:]
    which = number[rolled]
    at = np.flatnonzero(which)
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[doc + 1]
    pairs = np.unique(which[at[inside]].astype(np.int64) * len(offsets) + doc[inside])
    term, doc = pairs // len(offsets), pairs % len(offsets)
    cuts = np.searchsorted(term, np.arange(1, len(codes) + 2))
    return {t: doc[cuts[i] : cuts[i + 1]] for i, t in enumerate(wanted)}


def candidates(q, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """The documents of a segment of n that a query admits."""
    if q is True:
        return np.arange(n)
    if isinstance(q, bytes):
        return postings[q]
    parts = [candidates(p, postings, n) for p in q[1]]
    if q[0] == "or":
        return np.unique(np.concatenate(parts))
    parts.sort(key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True)
    return out


def matches(text: str, rule: Rule, regex: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_batch(column: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """Of each text its spans as (start, rule number, end), sorted."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(_trigrams, queries)))
    regexes = [re.compile(r.pattern) for r in rules]
    data, offsets = utf8(column)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    for a, b in slices(offsets, SEGMENT_BYTES):
        part, at = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        postings = build_postings(part, at, wanted)
        admitted = [candidates(q, postings, b - a) for q in queries]
        for doc in np.unique(np.concatenate(admitted)):
            found[a + doc] = []
        texts: dict[int, str] = {}
        for k, docs in enumerate(admitted):
            for doc in docs.tolist():
                if doc not in texts:
                    texts[doc] = data[offsets[a + doc] : offsets[a + doc + 1]].tobytes().decode("utf-8", "replace")
                found[a + doc] += [(s, k, e) for s, e in matches(texts[doc], rules[k], regexes[k])]
    for spans in found:
        spans.sort()
    return found


def find_secrets(docs: DataFrame, text: str = "text", carry: list[str] | None = None, out: str = "secrets", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns in carry (if None, all but text and one named like out) and an array of spans, by start, then rule order."""
    carry = [c for c in docs.columns if c not in (text, out)] if carry is None else carry
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(out, SPANS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in doc] for doc in scan_batch(batch.column(0), rules)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(spans, _SPAN_ARROW)], names=[*carry, out])

    return docs.select(docs[text].alias("_text"), *[docs[c] for c in carry]).mapInArrow(scan, schema)


def redact(docs: DataFrame, text: str = "text", length: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; length is set to the new length if named."""
    at, where = docs.columns.index(text), docs.columns.index(length) if length else -1

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, columns = scan_batch(batch.column(at), rules), batch.columns
            if any(spans):
                texts = columns[at].to_pylist()
                for i, doc in enumerate(spans):
                    if doc:
                        texts[i] = _replaced(texts[i], doc, rules)
                columns[at] = pa.array(texts, columns[at].type)
                if length:
                    sizes = [len(t) if doc and t is not None else n for t, doc, n in zip(texts, spans, columns[where].to_pylist(), strict=True)]
                    columns[where] = pa.array(sizes, columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(clean, docs.schema)


def _replaced(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """Overlapping spans are replaced as one, by the first one's kind."""
    out, done = [], 0
    for start, k, end in spans:
        if start >= done:
            out += [text[done:start], f"<{rules[k].kind}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])
