"""Shredding HTML into one array of nodes per document.

A document's nodes stay in its row, so every later check is an expression over that array and needs no
shuffle. Nodes are numbered in document order; an element's end is the number of its last descendant,
so "inside" is a comparison of numbers. Parsing uses the standard library with the common repairs: void
elements, implied html, head and body, and end tags that p, li, td, tr and others may leave out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape, unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .styles import Sheet

NODE = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("kind", T.StringType()),  # element, text, raw (of style, script, template) or comment
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        # of an element: what style sheets and its own style say about it, in order; null for nothing
        T.StructField("styles", T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))),
    ]
)
NODES = T.ArrayType(NODE)
_ARROW = pa.list_(pa.struct([("pos", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("styles", pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])))]))

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = set("base link meta title style script noscript template".split())
RAW = {"style", "script", "template"}
CLOSES = {
    "p": set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": {"li"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
}
FENCE = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "p": {"body"}}


REFERENCE = re.compile(r"(&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")


def as_written(raw: str, text: str) -> str | None:
    """A piece of text to write for raw, what a page has of it: whole references as characters, other ampersands (&amp without
    a semicolon, &am, &) as they stand. None if that reads as another text than raw, or if there is no such ampersand."""
    pieces = REFERENCE.split(raw)
    known = [k % 2 == 1 and (p[1] == "#" or p[1:] in html5) for k, p in enumerate(pieces)]
    if not any("&" in p for p, whole in zip(pieces, known, strict=True) if not whole):
        return None
    out = "".join(escape(unescape(p), quote=False) if whole else p.replace("<", "&lt;").replace(">", "&gt;") for p, whole in zip(pieces, known, strict=True))
    return out if unescape(raw) == text == unescape(out) else None


class Shredder(HTMLParser):
    def __init__(self, html: str = "") -> None:
        """With html, which is to be fed whole, texts with ampersands that begin no whole reference have it as written, too."""
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.html, self.lines = html, [0, *(m.end() for m in re.finditer("\n", html))]

    def _add(self, kind: str, tag: str | None, attrs: list | None, text: str | None) -> int:
        pos = len(self.nodes)
        self.nodes.append({"pos": pos, "end": pos, "parent": self.open[-1] if self.open else -1, "kind": kind, "tag": tag, "attrs": attrs, "text": text})
        return pos

    def _is_open(self, tag: str) -> bool:
        return any(self.nodes[i]["tag"] == tag for i in self.open)

    def _close_to(self, depth: int) -> None:
        last = len(self.nodes) - 1
        while len(self.open) > depth:
            self.nodes[self.open.pop()]["end"] = last

    def _start(self, tag: str, attrs: list) -> None:
        self.open.append(self._add("element", tag, attrs, None))

    def _imply(self, tag: str | None, text: bool = False) -> None:
        if tag == "html":
            return
        if not self.open:
            self._start("html", [])
        seen = {n["tag"] for n in self.nodes if n["kind"] == "element"} if len(self.open) == 1 else {"body"}
        if len(self.open) == 1 and tag not in ("head", "body"):
            if tag in HEAD_ONLY and "body" not in seen:
                if "head" not in seen:
                    self._start("head", [])
            elif "body" not in seen or text:
                if "body" not in seen:
                    self._start("body", [])
        elif len(self.open) == 2 and self.nodes[self.open[1]]["tag"] == "head" and tag not in HEAD_ONLY and tag != "head":
            self._close_to(1)
            if tag != "body" and not any(n["tag"] == "body" for n in self.nodes):
                self._start("body", [])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body", "head") and self._is_open(tag):
            known = dict(self.nodes[next(i for i in self.open if self.nodes[i]["tag"] == tag)]["attrs"])
            self.nodes[next(i for i in self.open if self.nodes[i]["tag"] == tag)]["attrs"] = [*known.items(), *[a for a in attrs if a[0] not in known]]
            return
        self._imply(tag)
        for i in range(len(self.open) - 1, 0, -1):
            above = self.nodes[self.open[i]]["tag"]
            if tag in CLOSES.get(above, ()):
                self._close_to(i)
                break
            if tag in CLOSES and above in FENCE.get(tag, ()) or above in ("table", "body"):
                break
        self._start(tag, [(k, v if v is not None else "") for k, v in dict(reversed(attrs)).items()][::-1])
        if tag in VOID:
            self.open.pop()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]]["tag"] == tag:
                self._close_to(i)
                return

    def handle_data(self, data: str) -> None:
        parent = self.nodes[self.open[-1]]["tag"] if self.open else None
        if parent in RAW:
            self._add("raw", parent, None, data)
        elif data.strip() or len(self.open) > 2 or parent == "body":
            if parent not in ("title", "noscript") or not data.strip():
                if data.strip():
                    self._imply(None, True)
            pos = self._add("text", None, None, data)
            if self.html:
                line, column = self.getpos()
                start = self.lines[line - 1] + column
                end = self.html.find("<", start)
                raw = self.html[start : end if end >= 0 else None]
                if "&" in raw and (written := as_written(raw, data)):
                    self.nodes[pos]["written"] = written

    def handle_comment(self, data: str) -> None:
        self._add("comment", None, None, data)


def parse(html: str | None, written: bool = False) -> list[dict]:
    """The nodes of one document; an empty list for blank input or input that cannot be parsed. With written, texts have their
    ampersands for serialise as the page has them."""
    if not html or not html.strip():
        return []
    s = Shredder(html if written and "&" in html else "")
    try:
        s.feed(html)
        s.close()
    except Exception:  # one bad document must not end the job
        return []
    s._close_to(0)
    return s.nodes


def styled(nodes: list[dict]) -> list[dict]:
    """The nodes, elements with what style sheets and their own style say about them."""
    sheet = Sheet([n["text"] for n in nodes if n["kind"] == "raw" and n["tag"] == "style"])
    for n in nodes:
        told = sheet.of(n["tag"], dict(n["attrs"])) if n["kind"] == "element" else []
        n["styles"] = [{"k": k, "v": v} for k, v in told] or None
    return nodes


def shred(docs: DataFrame, html: str = "html", out: str = "nodes", took: str | None = None) -> DataFrame:
    """docs with the column out: the nodes of each document; and with the column took, if named: the milliseconds that took."""
    more = [T.StructField(took, T.DoubleType())] if took else []
    schema = T.StructType([*docs.schema.fields, T.StructField(out, NODES), *more])
    at = docs.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from time import perf_counter

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                nodes, times = [], []
                for text in part.column(at).to_pylist():
                    start = perf_counter()
                    nodes.append(styled(parse(text)))
                    times.append(1000 * (perf_counter() - start))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nodes, _ARROW), *([pa.array(times, pa.float64())] if took else [])], names=schema.names)

    return docs.mapInArrow(run, schema)


def serialise(nodes: list[dict], gone: set[int], attrs: dict[int, list[tuple[str, str]]] | None = None) -> str:
    """HTML of the nodes, without comments and without the subtrees that start at the numbers in gone.

    A text is written as the page has it where it says so, but not in front of another text, which could finish a reference.
    """
    out: list[str] = []
    closing: list[tuple[int, str]] = []
    skip, before = -1, None
    for n in nodes:
        while closing and closing[-1][0] < n["pos"]:
            out.append(f"</{closing.pop()[1]}>")
        if n["pos"] <= skip:
            continue
        if n["pos"] in gone:
            skip = n["end"]
        elif n["kind"] == "element":
            kept = attrs.get(n["pos"], n["attrs"]) if attrs is not None else n["attrs"]
            out.append("<" + n["tag"] + "".join(f' {k}="{escape(v)}"' for k, v in kept) + ">")
            if n["tag"] not in VOID:
                closing.append((n["end"], n["tag"]))
        elif n["kind"] == "raw":
            out.append(n["text"])
        elif n["kind"] == "text":
            if before and before[0] == len(out):
                out[-1] = escape(before[1], quote=False)
            out.append(n.get("written") or escape(n["text"], quote=False))
            before = (len(out), n["text"])
    out += [f"</{t}>" for _, t in reversed(closing)]
    return "".join(out)
