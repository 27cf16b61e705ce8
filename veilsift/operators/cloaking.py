"""Cloaking: the same address fetched as a person's browser and as a bot, compared by their text blocks.

Fetches come as a table (url, ua_class: human or agent, status, content_type, body, error); network
access stays outside the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import THREAT_TYPE, no_threats, threat
from ..sources.html import shred
from .html_checks import element_text

BLOCK_TAGS = ["p", "div", "span", "li", "h1", "h2", "h3", "h4", "section"]
# Parts of user agents that give bots away.
BOTS = ["python-requests", "python-httpx", "curl/", "wget/", "go-http-client", "bot", "spider", "crawler", "googlebot", "gptbot"]
LEAST = 0.05


def is_bot(agent: Column) -> Column:
    return F.coalesce(F.lower(agent).rlike("|".join(BOTS)), F.lit(False))


def fetchable(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def blocks(nodes: Column) -> Column:
    """Distinct first 200 characters of the texts, longer than 20, of block elements."""
    found = F.transform(F.filter(nodes, lambda n: (n["kind"] == "element") & n["tag"].isin(BLOCK_TAGS)), lambda n: element_text(nodes, n))
    return F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) > 20), lambda t: F.left(t, F.lit(200))))


def divergence(a: Column, b: Column) -> Column:
    """One minus the share of common members; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def exclusive(agent: Column, human: Column) -> Column:
    """Members of agent's blocks that human's lack, longest first, then by text."""
    order = lambda x, y: F.when(F.length(x) > F.length(y), -1).when(F.length(x) < F.length(y), 1).when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.array_sort(F.array_except(agent, human), order)


def readable() -> Column:
    """Whether a fetch is a successful one of a web address with a body."""
    return fetchable(F.col("url")) & F.col("error").isNull() & (F.coalesce("status", F.lit(200)) < 400) & (F.length(F.coalesce("body", F.lit(""))) > 0)


def page_blocks(fetches: DataFrame) -> DataFrame:
    """(url, ua_class, blocks) of the successful fetches of web addresses with a body."""
    shredded = shred(fetches.filter(readable()).select("url", "ua_class", "body"), "body", "_nodes")
    return shredded.select("url", "ua_class", blocks(F.col("_nodes")).alias("blocks"))


def most_blocks(ua: str) -> Column:
    """An aggregate over the fetches of an address: the longest block list of one side, null where there is none."""
    there = F.when(F.col("ua_class") == ua, F.col("blocks"))
    return F.max_by(there, F.when(there.isNotNull(), F.size("blocks")))


def compared(pairs: DataFrame, out: str = "threats") -> DataFrame:
    """pairs (url, human, agent: the block lists of both fetches) with divergence_score, exclusive_blocks and the column out, no threats where one list is null."""
    pairs = pairs.withColumn("divergence_score", divergence(F.col("agent"), F.col("human"))).withColumn("exclusive_blocks", exclusive(F.col("agent"), F.col("human")))
    detail = F.concat(F.lit("Agents and people get different content, divergence "), F.format_string("%.2f", "divergence_score"), F.lit("; for agents only: "), F.array_join(F.slice("exclusive_blocks", 1, 3), " | "))
    found = threat("dynamic_cloaking", detail, F.lit("User-agent dependent content"), "flagged", F.col("url"))
    cloaked = (F.col("divergence_score") >= LEAST) & (F.size("exclusive_blocks") > 0)
    return pairs.withColumn(out, F.when(cloaked, F.array(found)).otherwise(no_threats()).cast(f"array<{THREAT_TYPE}>"))


def compare(fetches: DataFrame) -> DataFrame:
    """A row per address fetched both ways: divergence_score, exclusive_blocks and threats.

    Both fetches of an address meet in one aggregation by address, so the fetch table is shuffled once.
    """
    both = page_blocks(fetches).groupBy("url").agg(most_blocks("human").alias("human"), most_blocks("agent").alias("agent"))
    return compared(both.filter("human is not null and agent is not null")).select("url", "divergence_score", "exclusive_blocks", "threats")


def scan_fetches(fetches: DataFrame) -> DataFrame:
    """The whole check of fetched addresses: a failed fetch is one threat; a page's own scan and its cloaking otherwise.

    Each body is parsed once, for its blocks and for its scan, and sent once to the other fetches of its address.
    """
    from .scan import file_name, scan, verdict

    human, no = F.col("ua_class") == "human", F.lit(False)
    failed = F.coalesce(human & (F.col("error").isNotNull() | (F.col("status") >= 400)), no)
    seen = fetches.filter(human | (F.col("ua_class") == "agent")).withColumns({"_failed": failed, "_read": F.coalesce(readable(), no)})
    own = human & ~F.col("_failed")
    seen = shred(seen.select("url", "ua_class", "status", "error", "content_type", "_failed", "_read", F.when(own | F.col("_read"), F.col("body")).alias("body")), "body", "_nodes", "_ms")
    docs = seen.select(
        "url", "ua_class", "status", "error", "_failed", F.when(F.col("_read"), blocks(F.col("_nodes"))).alias("blocks"), "_nodes", "_ms",
        F.lit(None).cast("string").alias("content"), F.when(own, F.encode("body", "UTF-8")).alias("raw"), F.when(own, F.col("content_type")).alias("content_type"), F.when(own, file_name(F.col("url"))).alias("filename"), no.alias("deep"),
    )
    address = Window.partitionBy("url")
    told = scan(docs, shredded=("_nodes", "_ms")).select("url", "ua_class", "status", "error", "_failed", "blocks", "threats", "sanitized_content")
    met = told.withColumns({"human": most_blocks("human").over(address), "agent": most_blocks("agent").over(address), "_lost": F.max("_failed").over(address)}).drop("blocks")
    kept = met.filter(human & (F.col("_failed") | ~F.col("_lost") | F.col("url").isNull()))
    why = F.coalesce("error", F.concat(F.lit("status "), F.col("status").cast("string")))
    lost = F.array(threat("fetch_failure", F.concat(F.lit("Could not fetch: "), why), F.lit("HTTP fetch"), "flagged", F.col("url"))).cast(f"array<{THREAT_TYPE}>")
    whole = compared(kept, "_cloaking").select("url", "_failed", F.when(F.col("_failed"), lost).otherwise(F.concat("threats", "_cloaking")).alias("threats"), F.when(~F.col("_failed"), F.col("sanitized_content")).alias("sanitized_content"))
    judged = verdict(whole)
    return judged.withColumn("confidence", F.when(F.col("_failed"), F.lit(0.98)).otherwise(F.col("confidence"))).drop("_failed")
