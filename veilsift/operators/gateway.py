"""Gateway policy: which responses are inspected, which verdicts raise an alert, and what is served."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import SEVERITIES, severity_rank
from .scan import has_critical


@dataclass(frozen=True)
class Policy:
    block_critical: bool = True
    sanitize: bool = True
    threshold: str = "medium"
    content_types: list[str] = field(default_factory=list)


def should_intercept(content_type: Column, policy: Policy) -> Column:
    """The listed types, or else text and images."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    if policy.content_types:
        return F.exists(F.array(*[F.lit(t) for t in policy.content_types]), lambda t: kind.contains(t))
    return kind.startswith("text/") | kind.startswith("image/")


def should_alert(threats: Column, policy: Policy) -> Column:
    """Whether a threat reaches the threshold; an unknown threshold counts as medium."""
    least = SEVERITIES.index(policy.threshold) if policy.threshold in SEVERITIES else 1
    return F.exists(threats, lambda t: severity_rank(t["severity"]) >= least)


def decide(responses: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """responses (content_type, threats, sanitized_content, body) with intercepted, alert, action, status and served body."""
    seen = should_intercept(F.col("content_type"), policy)
    threats = F.col("threats")
    block = seen & has_critical(threats) & F.lit(policy.block_critical)
    clean = seen & (F.size(threats) > 0) & F.col("sanitized_content").isNotNull() & F.lit(policy.sanitize)
    reason = F.array_join(F.transform(F.slice(threats, 1, 3), lambda t: t["plain_summary"]), "; ")
    action = F.when(block, "block").when(clean, "sanitize").otherwise("pass")
    return responses.withColumns({
        "intercepted": seen, "alert": seen & should_alert(threats, policy), "action": action, "status": F.when(block, 403).otherwise(200),
        "served": F.when(block, F.concat(F.lit("<h1>Blocked</h1><p>"), reason, F.lit("</p>"))).when(clean, F.col("sanitized_content")).otherwise(F.col("body")),
    })


def enforcement(safe: Column, sanitized: Column) -> Column:
    """The label shown for a verdict."""
    return F.when(safe, "allow").when(sanitized.isNotNull(), "sanitize").otherwise("block/review")


def counters(decided: DataFrame) -> DataFrame:
    """Inspected, alerted and blocked responses."""
    return decided.agg(F.count_if("intercepted").alias("scanned"), F.count_if("alert").alias("threats"), F.count_if(F.col("action") == "block").alias("blocked"))
