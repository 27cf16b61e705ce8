"""Verdicts as text for agents, and as the JSON envelope of a tool result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _threat_lines(threats: Column, indent: str) -> Column:
    line = lambda t, i: F.concat(F.lit(indent), (i + 1).cast("string"), F.lit(". ["), F.upper(t["severity"]), F.lit("] "), t["label"], F.lit(": "), t["plain_summary"])
    return F.array_join(F.transform(threats, line), "\n")


def report(safe: Column, confidence: Column, threats: Column, source: Column) -> Column:
    """A verdict in lines: source, verdict, confidence as a percentage, threats."""
    head = F.array(F.concat(F.lit("Source: "), source), F.when(safe, "Verdict: SAFE").otherwise("Verdict: UNSAFE"), F.concat(F.lit("Confidence: "), F.format_string("%.0f%%", confidence * 100)))
    tail = F.when(F.size(threats) > 0, F.array(F.concat(F.lit("Threats: "), F.size(threats).cast("string")), _threat_lines(threats, "  ")))
    return F.array_join(F.concat(head, F.coalesce(tail, F.array().cast("array<string>"))), "\n")


def brief(safe: Column, threats: Column) -> Column:
    """A verdict in one paragraph."""
    return F.when(safe, F.lit("SAFE: no threats detected.")).otherwise(F.concat(F.lit("UNSAFE: "), F.size(threats).cast("string"), F.lit(" threat(s).\n"), _threat_lines(threats, "- ")))


def envelope(safe: Column, text: Column, result: Column) -> Column:
    """A tool result: the summary, the result as JSON text, and whether it is an error (it is none)."""
    item = lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"))
    return F.to_json(F.struct(F.array(item(text), item(F.to_json(result))).alias("content"), F.lit(False).alias("isError")))
