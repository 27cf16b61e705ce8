import numpy as np
import pytest
from pyspark.sql import functions as F

from veilsift.functions import text as tx
from veilsift.operators import generators, unicode_checks
from veilsift.sources import files

BITS = "".join(f"{ord(c):08b}" for c in "Hello!").replace("1", "​").replace("0", "‌")


def test_unicode_threats(spark):
    rows = {
        "message": (f"cover {BITS}", ["zero_width_chars"]), "seven in a long text": ("word " * 100 + "​" * 7, []), "eight": ("word " * 100 + "​" * 8, ["zero_width_chars"]), "dense": ("ab​", ["zero_width_chars"]),
        "selector": ("x️y", ["variation_selector"]), "cyrillic": ("pаypal", ["homoglyph"]), "pure cyrillic": ("привет", ["homoglyph"]), "full width": ("ＡＢＣ", ["homoglyph"]),
        "arabic with latin": ("abc مر", ["homoglyph"]), "accents": ("déjà vu ñ ß", []), "ascii": ("plain", []), "blank": (" \n", []), "null": (None, []), "only invisible": ("​‌", ["zero_width_chars"]),
        "all": (f"{BITS}️а", ["zero_width_chars", "variation_selector", "homoglyph"]), "supplementary": ("x\U000e0101", ["variation_selector"]),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "k string, text string")
    got = {r.k: [t.type for t in r.t] for r in df.select("k", unicode_checks.unicode_threats(F.col("text")).alias("t")).collect()}
    assert got == {k: t for k, (_, t) in rows.items()}


def test_functions(spark):
    def val(text, f):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v

    assert val(f"a{BITS}b", tx.decode_zero_width) == "Hello!" and val("a​b", tx.decode_zero_width_message) == ""
    assert [(s.pos, s.name) for s in val("a︀b\U000e0100", tx.selectors)] == [(1, "VS1"), (3, "VS17")]
    assert val("рауＡα", tx.sanitize_text) == "payAα" and val("a​b️­", tx.sanitize_text) == "ab"
    assert val("abc где αβ", tx.mixed_scripts) == ["cyrillic", "greek"] and val("где", tx.mixed_scripts) == []
    assert [val(c, tx.detect_script) for c in ("a", "я", "1", "あ", "中")] == ["latin", "cyrillic", "other", "other_letter", "cjk"]
    assert val("é", tx.nfc) == "é" and val("a b​", tx.visible_count) == 3
    assert val("​x‌​", lambda c: tx.type_summary(tx.zero_width_chars(c))) == "2× ZERO WIDTH SPACE, 1× ZERO WIDTH NON-JOINER"


def test_generated_texts_are_told_apart(spark):
    df = generators.unicode_texts(spark, 30)
    got = df.select("expected_safe", "subtype", (F.size(unicode_checks.unicode_threats(F.col("text"))) == 0).alias("safe")).collect()
    assert all(r.expected_safe == r.safe for r in got), [r for r in got if r.expected_safe != r.safe]
    coded = spark.createDataFrame([("Hi there",)], "t string").select(tx.decode_zero_width(generators.encode_zero_width(F.col("t"))).alias("v")).first().v
    assert coded == "Hi there"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<p>é</p>")
    (tmp_path / "in/b.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "in/c").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 9)
    (tmp_path / "in/d.bin").write_bytes(b"x")
    got = {r.filename: r for r in files.read_documents(spark, str(tmp_path / "in")).collect()}
    assert got["a.html"].content == "<p>é</p>" and got["a.html"].raw is None
    assert got["b.txt"].content is None and got["b.txt"].content_type == "text/plain"
    assert got["c"].content_type == "image/png" and got["d.bin"].content_type == "application/octet-stream"
    with pytest.raises(Exception, match="(?i)path"):
        files.read_documents(spark, str(tmp_path / "none")).collect()
    (tmp_path / "m.json").write_text('[{"file":"a.html","expected_safe":true},{"file":"zzz","expected_safe":false}]')
    assert [r.file for r in files.read_manifest(spark, str(tmp_path / "m.json"), str(tmp_path / "in")).collect()] == ["a.html"]
    (tmp_path / "conf.txt").write_text("# head\n0441 ; 0063 ; MA # es\n0444 ; 0444 ; MA\nbad line\n")
    assert files.read_confusables(spark, str(tmp_path / "conf.txt")) == {"с": "c"}
    df = spark.createDataFrame([("a", ["x", "y"], "n, m")], "k string, types array<string>, notes string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "csv")).first()) == ("a", "x|y", "n; m")
    files.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().k == "a"
    assert files.newest(spark, str(tmp_path), "*.txt").endswith("conf.txt") and r"\toprule" in files.latex_table(df.select("k"), "c", "l")


def test_base64(spark):
    df = spark.createDataFrame([("aGk=", None, "image/png"), ("%%%", None, "image/png"), ("aGk=", None, "text/plain")], "content string, raw binary, content_type string")
    got = files.from_base64(df.coalesce(1)).collect()
    assert bytes(got[0].raw) == b"hi" and got[0].content is None and got[1].raw is None and got[2].content == "aGk=" and np.all([r.raw is None for r in got[1:]])
