"""Instruction patterns: families of phrases, and the detectors that look for each.

Words are separated by white space in the Unicode sense; Java needs (?U) for that. RE2, which DuckDB
uses, has no such flag, so sql() gives the same expression with ASCII white space only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import let

# Family, regular expression, detectors that use it.
PHRASES = [
    ("ignore", r"ignore\s+(previous|above|all|prior)\s+(instructions?|prompts?|context)", "css html"),
    ("ignore", r"ignore\s+(previous|all|prior)", "image"),
    ("ignore", r"ignore\s+(previous|above|all|prior)\s+(instructions?|prompts?)", "clean"),
    ("system", r"system\s*:", "css html image clean"),
    ("you are", r"you\s+are\s+(now|a)\s", "css"),
    ("you are", r"you\s+are\s+(now|an|a)\s", "html"),
    ("you are", r"you\s+are\s+(now|a\s)", "image clean"),
    ("override", r"override\s+(safety|filter|restriction|all|previous)", "css"),
    ("override", r"override\s+(safety|filter|restriction|all|previous|instructions?)", "html"),
    ("override", r"override\s+(safety|filter|instruction)", "image"),
    ("override", r"override\s+(safety|filter)", "clean"),
    ("important", r"important\s*:", "css image clean"),
    ("important", r"\bimportant\b.*?:", "html"),
    ("instruction", r"instruction\s*:", "css html image"),
    ("disregard", r"disregard\s+(all|previous|above|prior)", "css html"),
    ("disregard", r"disregard", "image clean"),
    ("forget", r"forget\s+(previous|above|prior|all)", "css html"),
    ("forget", r"forget\s+previous", "image clean"),
    ("new instructions", r"new\s+instructions?\s*:", "css"),
    ("new instructions", r"new\s+instructions?", "html image"),
    ("act as", r"act\s+as\s+(if|a\s)", "css html"),
    ("act as", r"act\s+as\s", "image clean"),
    ("pretend", r"pretend\s+(to\s+be|you\s+are)", "css html image"),
    ("pretend", r"pretend\s+to\s+be", "clean"),
    ("roleplay", r"roleplay\s+as\s", "css html"),
    ("roleplay", r"roleplay\s+as", "image"),
    ("your new role", r"your\s+new\s+role", "css image"),
    ("your new role", r"your\s+new\s+(role|task|purpose)", "html"),
    ("your task", r"your\s+task\s+is", "css"),
    ("you must", r"you\s+must\s+(now|immediately)", "css html"),
    ("secret instructions", r"(confidential|hidden|secret)\s+instructions?\s*:", "css html"),
    ("chat markers", r"\[inst\]", "html"),
    ("chat markers", r"\[system\]", "html"),
    ("chat markers", r"<\|system\|>", "html"),
    ("chat markers", r"<\|user\|>", "html"),
    ("chat markers", r"<\|im_start\|>", "html"),
]


#: Letters that match an ASCII letter where case is ignored, and that letter; lower() alone doesn't make one of them.
ALIKE = ("İıſK", "iisk")


def _expression(detector: str) -> str:
    return "|".join(expression for _, expression, detectors in PHRASES if detector in detectors.split())


def pattern(detector: str) -> str:
    return ("(?iU)" if detector == "image" else "(?isU)") + _expression(detector)


def sql(detector: str) -> str:
    """The pattern for an engine with RE2 syntax, as the body of a quoted SQL string."""
    return ("(?i)" if detector == "image" else "(?is)") + _expression(detector).replace("'", "''")


def _literals(expression: str) -> list[str]:
    """The words or marks with which an expression begins; every match holds one of them."""
    plain = re.sub(r"\\b", "", expression)
    if plain.startswith("("):
        return plain[1 : plain.index(")")].split("|")
    return [re.match(r"(?:\\\W|[a-z<])+", plain)[0].replace("\\", "")]


def gates(detector: str) -> list[tuple[list[str], str, str]]:
    """(literals, expression, where) of a detector: an expression is looked for only in texts that hold one of its literals.

    where is "text", or "before the last colon" for expressions that end in anything up to a colon: they match if the
    rest matches before the last one, which takes one look at the text instead of one for each time the rest occurs.
    """
    kept: dict[tuple[str, ...], list[str]] = {}
    out = []
    for _, expression, detectors in PHRASES:
        if detector in detectors.split():
            if expression.endswith(".*?:"):
                out.append((_literals(expression), expression.removesuffix(".*?:"), "before the last colon"))
            else:
                kept.setdefault(tuple(_literals(expression)), []).append(expression)
    return [(list(k), "|".join(v), "text") for k, v in kept.items()] + out


def instructs(text: Column, detector: str) -> Column:
    """Whether a text holds one of a detector's phrases; null for null. Takes time in proportion to the text."""
    flags = "(?iU)" if detector == "image" else "(?isU)"

    def found(t: Column, low: Column) -> Column:
        out = F.lit(False)
        for literals, expression, where in gates(detector):
            held = F.lit(False)
            for x in literals:
                held = held | low.contains(x)
            place = t if where == "text" else F.substring(t, F.lit(1), F.length(t) - F.length(F.substring_index(t, ":", -1)))
            out = out | F.when(held, place.rlike(flags + expression)).otherwise(False)
        return out

    # The lower-case copy is made of the variable, so that of a constant text the plan holds no second constant as long.
    return F.when(text.isNotNull(), let(text, lambda t: let(F.lower(F.translate(t, *ALIKE)), lambda low: found(t, low))))


def instructs_sql(detector: str, text: str) -> str:
    """instructs() over a column named text, in Spark SQL."""
    flags, low = "(?iU)" if detector == "image" else "(?isU)", f"lower(translate({text}, '{ALIKE[0]}', '{ALIKE[1]}'))"
    tests = []
    for literals, expression, where in gates(detector):
        place = text if where == "text" else f"substring({text}, 1, length({text}) - length(substring_index({text}, ':', -1)))"
        tests.append("((" + " OR ".join(f"contains({low}, r'{x}')" for x in literals) + f") AND {place} RLIKE r'{flags}{expression}')")
    return "(" + " OR ".join(tests) + ")"
