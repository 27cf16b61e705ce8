"""A document's style sheet as an index from what a selector names to its declarations, in the order of the rules.

An element asks the index for its tag, id, classes and attributes, so applying a sheet takes time in proportion to
the elements and to the rules that match, not to their product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Declarations = list[tuple[str, str]]

# Properties that the hiding checks read.
PROPERTIES = {"display", "visibility", "opacity", "font-size", "color", "background", "background-color", "position", "left", "top", "right", "bottom", "text-indent", "overflow", "overflow-y", "height", "width", "clip"}

# What comments and rules look like, and the parts of a selector that are left out.
COMMENT = re.compile(r"/\*.*?\*/", re.S)
RULE = re.compile(r"([^{@][^{]*)\{([^}]+)\}")
PSEUDO = re.compile(r"::?[\w-]+.*$", re.S)

# The forms of a selector with the one or two names in them, tried in this order.
SELECTORS = [
    ("id", re.compile(r"#(.*)()", re.S)),
    ("class", re.compile(r"\.(.*)()", re.S)),
    ("tag_class", re.compile(r"([^.]*)\.(.*)", re.S)),
    ("tag_id", re.compile(r"([^#]*)#(.*)", re.S)),
    ("attr", re.compile(r"\[(\w[\w-]*)\]()", re.A)),
    ("attr_is", re.compile(r"\[(\w[\w-]*)=[\"']?([^\"']+)[\"']?\]", re.A)),
    ("tag", re.compile(r"(.*)()", re.S)),
]


def declarations(body: str) -> Declarations:
    """(property, value) of a declaration list in order, as far as the hiding checks read them."""
    out = []
    for part in body.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in PROPERTIES:
            out.append((name, re.sub(r"\s*!important\s*$", "", value.strip()).strip()))
    return out


def classify(selector: str) -> tuple[str, str, str] | None:
    """(form, name, second name) of a simple selector without its pseudo parts; None for what is never matched, that is
    nothing and combinations."""
    s = PSEUDO.sub("", selector).strip()
    if not s or re.search(r"[\s>+~]", s):
        return None
    for form, expression in SELECTORS:
        if found := expression.fullmatch(s):
            return form, found[1].lower() if form.startswith("tag") else found[1], found[2]
    return None


class Sheet:
    """The rules of style blocks. Within a block a repeated selector adds declarations; a later block's selector replaces
    those of earlier blocks but keeps its place. Nested blocks leak: after the first, inner rules read as outer ones."""

    def __init__(self, blocks: list[str]) -> None:
        rules: dict[str, Declarations] = {}
        for css in blocks:
            own: dict[str, Declarations] = {}
            for selectors, body in RULE.findall(COMMENT.sub("", css)):
                told = declarations(body)
                for selector in filter(None, map(str.strip, selectors.split(","))):
                    own.setdefault(selector, []).extend(told)
            rules.update(own)
        self.index: dict[tuple[str, str, str], list[tuple[int, Declarations]]] = {}
        for place, (selector, told) in enumerate(rules.items()):
            if told and (key := classify(selector)):
                self.index.setdefault(key, []).append((place, told))

    def _asked(self, tag: str, attrs: dict[str, str]) -> Iterator[tuple[str, str, str]]:
        yield "tag", tag, ""
        if "id" in attrs:
            yield "id", attrs["id"], ""
            yield "tag_id", tag, attrs["id"]
        for name in dict.fromkeys(attrs.get("class", "").split()):
            yield "class", name, ""
            yield "tag_class", tag, name
        for name, value in attrs.items():
            yield "attr", name, ""
            yield "attr_is", name, value

    def of(self, tag: str, attrs: dict[str, str]) -> Declarations:
        """Declarations that apply to an element: of all matching rules in order, then its own."""
        hits = [hit for key in self._asked(tag, attrs) for hit in self.index.get(key, ())] if self.index else []
        ruled = [d for _, told in sorted(hits, key=lambda h: h[0]) for d in told]
        return ruled + declarations(attrs["style"]) if "style" in attrs else ruled
