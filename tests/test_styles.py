"""The index of style rules against every rule for every element, and pages with very many of both."""

import random
import re
import time

from veilsift.operators import scan
from veilsift.sources.html import parse, styled
from veilsift.sources.styles import Sheet, classify, declarations


def plain(blocks, tag, attrs):
    """Each rule tried in turn."""
    rules = {}
    for css in blocks:
        own = {}
        for names, body in re.findall(r"([^{@][^{]*)\{([^}]+)\}", re.sub(r"(?s)/\*.*?\*/", "", css)):
            for s in names.split(","):
                if s.strip():
                    own[s.strip()] = own.get(s.strip(), []) + declarations(body)
        rules.update(own)
    out = []
    for s, told in rules.items():
        if not (key := classify(s)):
            continue
        form, a, b = key
        fits = {
            "tag": tag == a, "id": attrs.get("id") == a, "class": a in attrs.get("class", "").split(), "tag_class": tag == a and b in attrs.get("class", "").split(), "tag_id": tag == a and attrs.get("id") == b,
            "attr": a in attrs, "attr_is": attrs.get(a) == b,
        }
        out += told if fits[form] else []
    return out + declarations(attrs.get("style", ""))


def test_index_finds_what_trying_every_rule_finds():
    r = random.Random(2)
    selectors = ["p", "B", ".x", ".y", ".x.y", "#i", "p.x", "P.y", "b#i", "p#i", "[hidden]", "[data-k]", "[data-k=v]", "[data-k='v w']", "p:hover", ".x::before", "p b", "p>b", "*", "", "a, .x , b"]
    for _ in range(400):
        blocks = ["".join(f"{r.choice(selectors)}{{{r.choice(['display:none', 'opacity:0;color:red', 'margin:0', 'top:1px !important'])}}}" for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 3))]
        attrs = {k: v for k, v in {"class": r.choice(["x", "y x", "x.y", ""]), "id": r.choice(["i", "j"]), "hidden": "", "data-k": r.choice(["v", "v w"]), "style": "Width: 0"}.items() if r.random() < 0.5}
        for tag in ("p", "b"):
            assert Sheet(blocks).of(tag, attrs) == plain(blocks, tag, attrs)


def test_forms_of_selectors():
    assert classify(" P.c:hover ") == ("tag_class", "p", "c") and classify("[a-b=\"c\"]") == ("attr_is", "a-b", "c")
    assert classify("a b") is None and classify("::before") is None and classify("a~b") is None


def test_many_rules_and_elements(spark):
    rules = "".join(f".c{i}{{display:{'none' if i % 2 else 'block'}}} #i{i}{{opacity:0}}" for i in range(1000))
    body = "".join(f"<p class='c{i % 1000}'>text number {i}</p>" for i in range(10_000))
    start = time.time()
    assert sum(bool(n["styles"]) for n in styled(parse(f"<style>{rules}</style>{body}"))) == 10_000
    assert time.time() - start < 5
    page = spark.createDataFrame([(1, f"<style>{rules}</style>{body}")], "page_id int, html string")
    start = time.time()
    assert scan.scan_pages(page).first().threat_count == 5000
    assert time.time() - start < 60
