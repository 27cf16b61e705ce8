"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Each metric is computed once per document from its whole text; each rule compares one metric with a
bound. A null text counts as empty. Empty texts have no words and fail the length rules. Very long
texts are handled in one row; memory follows that text. Repeated rows give repeated results; an
empty table gives an empty table. Input columns keep their names; the metrics live in one struct
column whose name the caller gives, so clashing names are impossible but for that one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcols import SPACE_CLASS, WORD_CLASS, let, words

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he this are or his from at an have which you but had they has we been were".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}


@dataclass(frozen=True)
class Rule:
    """A document fails when its metric lies outside [low, high]; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. The first two restate the base rules; the others follow published web-corpus filters.
RULES = (
    Rule("too_short", "n_words", low=20),
    Rule("repeated_windows", "repeat_ratio", high=0.3),
    Rule("word_length", "mean_word_chars", low=2, high=14),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("word_runs", "word_run_ratio", high=0.3),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("bullet_lines", "bullet_ratio", high=0.9),
    Rule("ellipsis_lines", "ellipsis_ratio", high=0.3),
)

WINDOW = 8


def _repeat_words(ws: Column) -> Column:
    """Words inside a window of 8 words that occurs at least twice in the text.

    Window fingerprints decide cheaply that a text repeats nothing; only other texts compare the
    windows themselves, sorted next to each other.
    """
    n = F.size(ws)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))

    def exact(ws: Column) -> Column:
        keyed = F.sort_array(F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice(ws, i, WINDOW), " ").alias("w"), i.alias("i"))))
        return let(keyed, hits)

    def hits(keyed: Column) -> Column:
        m = F.size(keyed)
        same = lambda i, j: F.element_at(keyed, i)["w"] == F.element_at(keyed, j)["w"]
        found = F.filter(F.sequence(F.lit(1), m), lambda i: ((i > 1) & same(i, F.greatest(i - 1, F.lit(1)))) | ((i < m) & same(i, F.least(i + 1, m))))
        return let(F.sort_array(F.transform(found, lambda i: F.element_at(keyed, i)["i"])), covered)

    def covered(at: Column) -> Column:
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i + WINDOW - acc["end"])).alias("n"), (i + WINDOW).alias("end"))
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]

    prints = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    repeats = let(prints, lambda p: F.size(F.array_distinct(p)) < F.size(p))
    return F.when(n < WINDOW + 1, F.lit(0)).when(repeats, exact(ws)).otherwise(F.lit(0))


def metrics(text: Column) -> Column:
    """One struct of counts and ratios of a whole text."""
    text = F.coalesce(text, F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})

    def of_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
            F.size(F.filter(ws, lambda w, i: (i > 0) & (w == F.element_at(ws, F.greatest(i, F.lit(1)))))).cast("long").alias("n_word_runs"),
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(ls, lambda x: x.rlike(rf"^{SPACE_CLASS}*[-*•]"))).cast("long").alias("n_bullets"),
            F.size(F.filter(ls, lambda x: x.rlike(rf"(\.\.\.|…){SPACE_CLASS}*$"))).cast("long").alias("n_ellipses"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))
    counts = F.struct(let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))

    def ratios(c: Column) -> Column:
        w, ln = c["w"], c["l"]
        part = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
        return F.struct(
            *[w[k].alias(k) for k in ("n_words", "word_chars", "n_repeat_words", "n_stop_words", "n_word_runs")],
            *[ln[k].alias(k) for k in ("n_lines", "n_dup_lines", "n_bullets", "n_ellipses")],
            c["n_symbols"].alias("n_symbols"),
            part(w["word_chars"], w["n_words"]).alias("mean_word_chars"),
            part(c["n_symbols"], w["n_words"]).alias("symbol_ratio"),
            part(w["n_stop_words"], w["n_words"]).alias("stop_ratio"),
            part(w["n_repeat_words"], w["n_words"]).alias("repeat_ratio"),
            part(w["n_word_runs"], w["n_words"]).alias("word_run_ratio"),
            part(ln["n_dup_lines"], ln["n_lines"]).alias("dup_line_ratio"),
            part(ln["n_bullets"], ln["n_lines"]).alias("bullet_ratio"),
            part(ln["n_ellipses"], ln["n_lines"]).alias("ellipsis_ratio"),
        )

    return let(counts, ratios)


def failed_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that the metrics in m break, in table order."""
    broken = []
    for r in rules:
        tests = [m[r.metric] < r.low] * (r.low is not None) + [m[r.metric] > r.high] * (r.high is not None)
        broken.append(F.when(tests[0] if len(tests) == 1 else tests[0] | tests[1], F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def assess(docs: DataFrame, text: str = "text", out: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a struct column out: the metrics, base_failed, failed (names) and kept."""

    def judged(m: Column) -> Column:
        base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        return F.struct(m.alias("metrics"), base.alias("base_failed"), failed_rules(m, rules).alias("failed"))

    judge = let(metrics(F.col(text)), judged)
    final = let(judge, lambda j: F.struct(j["metrics"].alias("metrics"), j["base_failed"].alias("base_failed"), j["failed"].alias("failed"), (~j["base_failed"] & (F.size(j["failed"]) == 0)).alias("kept")))
    return docs.withColumn(out, final)


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns only."""
    judged = assess(docs.select(F.struct("*").alias("row")).withColumn("text", F.col("row")[text]), "text", "quality", rules)
    return judged.filter(F.col("quality.kept")).select("row.*")
