"""Sanitising leaves ampersands that begin no whole reference as the page has them, unless that would read differently."""

import pytest

from veilsift.operators import scan
from veilsift.sources.html import parse, serialise, shred

CASES = {
    "<h1>a &amp; b &amp</h1>": "<h1>a &amp; b &amp</h1>", "<h1>x &am</h1>": "<h1>x &am</h1>", "<h1>x & y &</h1>": "<h1>x & y &</h1>", "<h1>&quo</h1>": "<h1>&quo</h1>", "<h1>&quot</h1>": "<h1>&quot</h1>",
    "<p>&copy; &middot; &quot; &lt;b&gt; &#65; &amp</p>": "<p>© · \" &lt;b&gt; A &amp</p>", "<p>\n&foo; > &amp\n</p>": "<p>\n&foo; &gt; &amp\n</p>",
    "<p>&am<!-- c -->p;</p>": "<p>&amp;amp;</p>", "<p>&l<i style='display:none'>xyz</i>t;</p>": "<p>&amp;lt;</p>", "<p>&am&#112;;</p>": "<p>&amp;amp;</p>", "<p>&lt<b>x</b></p>": "<p>&lt<b>x</b></p>",
}


def test_references_as_written(spark):
    got = {r.html: r.sanitized for r in scan.sanitize_html(spark.createDataFrame([(h,) for h in CASES], "html string")).collect()}
    assert got == {h: f"<html><body>{want}</body></html>" for h, want in CASES.items()}


@pytest.mark.parametrize("html", [*CASES, "a &am\n<br>b &lt", "&<", "<title>&am</title>&amp", "<script>a&&b</script>&", "x &am</>p; y", "<a href='?a=1&b=2'>&b</a>"])
def test_written_texts_read_the_same(html):
    texts = lambda h: "".join(n["text"] for n in parse(h) if n["kind"] in ("text", "raw"))
    assert texts(serialise(parse(html, written=True), set())) == texts(html)
    assert [n | {"written": None} for n in parse(html)] == [n | {"written": None} for n in parse(html, written=True)]


def test_shredding_leaves_them_out(spark):
    df = shred(spark.createDataFrame([("<p>&am</p>",)], "html string"), "html", "nodes")
    assert df.selectExpr("nodes.text").first().text[-1] == "&am"


def test_whole_scan_writes_them_too(spark):
    docs = spark.createDataFrame([(1, "<html><head><title>a &am</title></head><body><p>b &amp</p></body></html>"), (2, "a &am b")], "id int, content string")
    docs = docs.selectExpr("*", "cast(null as binary) raw", "if(id = 1, 'text/html', 'text/plain') content_type", "cast(null as string) filename", "false deep")
    got = {r.id: r.sanitized_content for r in scan.scan(docs).collect()}
    assert got == {r.id: r.content for r in docs.collect()}
