"""Character checks over text columns: invisible characters, selectors, look-alike letters, scripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import SCRIPTS, ZERO_WIDTH, confusables

ZERO_WIDTH_CLASS = "[" + "".join(f"\\x{{{c:04X}}}" for c in ZERO_WIDTH) + "]"
SELECTOR_CLASS = r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"


def _suspicious_class() -> str:
    """The characters that some check looks for, none of them ASCII, as few ranges; a look at an ASCII character ends at the first."""
    single = [*ZERO_WIDTH, *map(ord, confusables())]
    ranges = [(c, c) for c in single] + [(0xFE00, 0xFE0F), (0xE0100, 0xE01EF)] + [(low, high) for name, low, high in SCRIPTS if name != "latin"]
    merged: list[list[int]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return "[\\x{80}-\\x{10FFFF}&&[" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in merged) + "]]"


SUSPICIOUS_CLASS = _suspicious_class()
#: What (?U)\s matches.
WHITE_SPACE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
ONE, ZERO = "​", "‌"


def let(value: Column, body) -> Column:
    """Evaluates value once and uses it in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def zero_width_chars(text: Column) -> Column:
    """The invisible characters of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({ZERO_WIDTH_CLASS})"), 1)


def visible_count(text: Column) -> Column:
    """Characters outside the control categories and the invisible ones; white space counts."""
    return F.length(F.regexp_replace(text, r"[\p{C}\x{2028}\x{2029}]", ""))


def zero_width_density(zero_width: Column, visible: Column) -> Column:
    """Invisible characters for each hundred visible ones; 100 if there are only invisible ones."""
    return F.when(visible > 0, zero_width * 100.0 / visible).when(zero_width > 0, F.lit(100.0)).otherwise(F.lit(0.0))


def decode_zero_width(text: Column) -> Column:
    """The message in U+200B (1) and U+200C (0), eight bits a character; printable ones only, empty if fewer than four."""
    bits = F.translate(F.regexp_replace(text, f"[^{ONE}{ZERO}]", ""), ONE + ZERO, "10")

    def decoded(b: Column) -> Column:
        code = lambda i: F.conv(F.substring(b, i * 8 + 1, F.lit(8)), 2, 10).cast("int")
        codes = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.length(b) / 8).cast("int") - 1), code), lambda c: c.between(32, 126))
        return F.when(F.length(b) < 8, F.lit("")).otherwise(let(F.array_join(F.transform(codes, lambda c: F.char(c)), ""), lambda s: F.when(F.length(s) >= 4, s).otherwise(F.lit(""))))

    return let(bits, decoded)


def decode_zero_width_message(text: Column) -> Column:
    """decode_zero_width of texts with eight invisible characters at least, else empty."""
    return F.when(F.size(zero_width_chars(text)) >= 8, decode_zero_width(text)).otherwise(F.lit(""))


def type_summary(found: Column, most: int = 4) -> Column:
    """Counts of the first kinds of invisible characters, in order of first sight."""
    name = F.create_map(*[x for c, n in ZERO_WIDTH.items() for x in (F.lit(chr(c)), F.lit(n))])
    count = lambda all_of, k: F.concat(F.size(F.filter(all_of, lambda x: x == k)).cast("string"), F.lit("× "), F.element_at(name, k))
    return let(found, lambda all_of: F.array_join(F.transform(F.slice(F.array_distinct(all_of), 1, most), lambda k: count(all_of, k)), ", "))


def selector_chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({SELECTOR_CLASS})"), 1)


def code_point(ch: Column) -> Column:
    return F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("int")


def selectors(text: Column) -> Column:
    """(pos, name) of the variation selectors: VS1 to VS16, then VS17 to VS256."""
    chars = F.transform(F.split(text, ""), lambda ch, i: F.struct(i.alias("pos"), ch.alias("ch")))
    hits = F.filter(chars, lambda x: x["ch"].rlike(SELECTOR_CLASS))
    number = lambda c: F.when(c < 0xE0100, c - 0xFE00 + 1).otherwise(c - 0xE0100 + 17)
    return F.transform(hits, lambda x: F.struct(x["pos"].alias("pos"), F.concat(F.lit("VS"), number(code_point(x["ch"])).cast("string")).alias("name")))


def _tables(extra: dict[str, str] | None) -> tuple[str, str]:
    table = confusables(extra)
    return "".join(table), "".join(table.values())


def confusable_count(text: Column, extra: dict[str, str] | None = None) -> Column:
    return F.length(text) - F.length(F.translate(text, _tables(extra)[0], ""))


def normalize(text: Column, extra: dict[str, str] | None = None) -> Column:
    """Look-alike characters replaced by what they look like."""
    return F.translate(text, *_tables(extra))


def confusable_samples(text: Column, most: int = 6, extra: dict[str, str] | None = None) -> Column:
    """(pos, ch, looks_like) of the first look-alike characters."""
    table = confusables(extra)
    chars = F.transform(F.split(text, ""), lambda ch, i: F.struct(i.alias("pos"), ch.alias("ch"), F.translate(ch, *_tables(extra)).alias("looks_like")))
    return F.slice(F.filter(chars, lambda x: x["ch"].isin(list(table))), 1, most)


def detect_script(ch: Column) -> Column:
    """The first script whose range holds the character, else other_letter or other."""
    cp, out = code_point(ch), F.when(ch.rlike(r"^\p{L}$"), "other_letter").otherwise("other")
    for name, low, high in reversed(SCRIPTS):
        out = F.when(cp.between(low, high), name).otherwise(out)
    return out


def mixed_scripts(text: Column) -> Column:
    """Sorted names of the other scripts among a text's letters, if it has a Latin letter."""
    has = lambda low, high: text.rlike(f"[\\p{{L}}&&[\\x{{{low:X}}}-\\x{{{high:X}}}]]")
    others = F.array_compact(F.array(*[F.when(has(low, high), F.lit(name)) for name, low, high in sorted(SCRIPTS) if name != "latin"]))
    latin = next(x for x in SCRIPTS if x[0] == "latin")
    return F.when(has(*latin[1:]), others).otherwise(F.array().cast("array<string>"))


def may_be_suspicious(text: Column) -> Column:
    """Whether a text holds any character that some check of this module looks for."""
    return text.rlike(SUSPICIOUS_CLASS)


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, f"{ZERO_WIDTH_CLASS}|{SELECTOR_CLASS}", "")


def sanitize_text(text: Column, normalize_letters: bool = True) -> Column:
    """Without invisible characters and selectors; look-alike letters replaced unless told otherwise."""
    clean = strip_invisible(text)
    return normalize(clean) if normalize_letters else clean


def nfc(text: Column) -> Column:
    """Unicode normalisation form C; Spark has no built-in expression for it."""
    @F.pandas_udf("string")
    def form_c(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return form_c(text)
