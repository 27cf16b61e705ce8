"""The queries over the operators of this package, and the same results in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, learned_ann, parity_join, piece_codec, prefix_trie, quality_rules, radix_dedup, secret_scan, source_mix, substring_dedup, token_table, tokenizer_files, tool_links, toxic_spans
from .staging import checkpoint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.assess(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "q")
    m = [F.col(f"q.metrics.{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *m, F.col("q.base_failed").alias("base_failed"), F.col("q.kept").alias("kept"))


def _sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def quality_sql() -> str:
    """One row per document: the metrics, base_failed and kept."""
    stop = _sql_list(sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws}))
    tests = []
    for r in quality_rules.RULES:
        tests += [f"{r.metric} < {r.low}"] * (r.low is not None) + [f"{r.metric} > {r.high}"] * (r.high is not None)
    return rf"""
    WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base),
    g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
    d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
    r AS (SELECT doc_id, sum(least(8, coalesce(i - before, 8))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM d) GROUP BY doc_id),
    m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
                 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
                 len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop,
                 len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_runs,
                 len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets,
                 len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses
          FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
    q AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
                 coalesce(n_stop / nullif(n_words, 0), 0) AS stop_ratio, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_ratio,
                 coalesce(n_runs / nullif(n_words, 0), 0) AS word_run_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
                 coalesce(n_bullets / nullif(n_lines, 0), 0) AS bullet_ratio, coalesce(n_ellipses / nullif(n_lines, 0), 0) AS ellipsis_ratio FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR {' OR '.join(tests)}) AS kept
    FROM q"""


ORACLE["op4_quality_rules"] = quality_sql()


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = checkpoint(table(spark, sf_dir, "documents").select("doc_id", "source", source_mix.size_in_words(F.col("text")).alias("size")))
    return source_mix.allocate(sizes).select("doc_id", "size", F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"), F.col("mix.taken").alias("taken"))


MIX_SQL = r"""
    WITH d AS (SELECT doc_id, source, size, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
          FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents)),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS n FROM d GROUP BY source),
    w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 1.5 * (sum(source_size) OVER ())::DOUBLE AS total, (2 * source_size)::DOUBLE AS most FROM s),
    c AS (SELECT *, most / weight < (total - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS capped
          FROM w WINDOW b AS (ORDER BY most / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, (total - coalesce(sum(most) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER () AS level FROM c),
    t AS (SELECT source, source_size, coalesce(source_size::DOUBLE / nullif(n, 0), 0.0) AS mean, CASE WHEN capped THEN most ELSE weight * level END AS target FROM l),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
    n AS (SELECT *, greatest(0.0, target - whole * source_size) AS need, coalesce(greatest(0.0, target - whole * source_size) / nullif(source_size, 0), 0) AS rest FROM p),
    r AS (SELECT d.doc_id, d.size, n.source, n.source_size, n.target, n.whole, n.need, n.rest, (u / (1.0 - u)) / nullif(rest / (1.0 - rest) * (2.0::DOUBLE * size / nullif(size + mean, 0)), 0) AS q FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
    k AS (SELECT *, CASE WHEN rest <= 0 OR size <= 0 THEN 281474976710655 ELSE floor(q / (1.0 + q) * 281474976710656.0)::BIGINT END AS rank FROM r),
    a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, coalesce(doc_id::VARCHAR, ''), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM k)
    SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN rest > 0 AND prior + size / 2 <= need THEN 1 ELSE 0 END))::BIGINT AS taken FROM a"""
ORACLE["op9_source_mix"] = MIX_SQL


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    base = ("assign", "access", "hex")
    of = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, of), ",")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        F.size("secrets").cast("long").alias("n_spans"),
    )


@query
def op3_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_table.write_tables(table(spark, sf_dir, "documents"), tokenizer_files.path("byte_bpe_50k.json"))
    stored = token_table.read_tables(spark, shards)
    return stored.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def piece_digests(encoded: DataFrame, *carry: str) -> DataFrame:
    return encoded.select(
        *carry,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.element_at("ends", -1).cast("long").alias("n_source_bytes"),
        F.xxhash64("begins", "ends").alias("spans_hash"),
    )


@query
def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_files.path("piece_bpe_32k.model"), "text", ["doc_id"])
    return piece_digests(encoded, "doc_id")


@query
def op8_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_groups(table(spark, sf_dir, "documents"), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id", "n_links")


@query
def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out & F.col("toxic").isNotNull())
    model = toxic_spans.train(docs, labels)
    scored = toxic_spans.score(docs, model, "text", ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").cast("long").alias("n_spans"))


@query
def op6_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = learned_ann.fit(vectors)
    return learned_ann.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), model, 10)


def link_digests(linked: DataFrame) -> DataFrame:
    counts = ("n_calls", "n_linked", "n_invalid", "n_unordered")
    return linked.select(F.col("conv").alias("conv_id"), "turn", "role", "kind", *counts, "link", "anchor_turn", "level", F.sha2("message", 256).alias("message_sha256"))


@query
def op5_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain conversations and, under the numbers below zero, the same with turns made into calls and results."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return link_digests(tool_links.link(turns.unionByName(tool_links.seeded(turns.withColumn("conv_id", -1 - F.col("conv_id"))))))


@query
def tool_links_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_digests(tool_links.link(tool_links.seeded(table(spark, sf_dir, "conversations"))))


ORACLE["op5_tool_links"] = """
    SELECT conv_id, turn, role, 'text' AS kind, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_invalid, 0::BIGINT AS n_unordered,
           NULL::VARCHAR AS link, turn AS anchor_turn, 0::INT AS level,
           sha256('{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"conversation":' || conv_id || ',"role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}') AS message_sha256
    FROM conversations"""
ORACLE["tool_links_seeded"] = """
    WITH c AS (SELECT *, regexp_extract(coalesce(text, ''), '[A-Za-z]+') AS word, CASE WHEN role = 'assistant' THEN 'call' WHEN role = 'user' AND turn > 0 THEN 'result' ELSE 'text' END AS kind FROM conversations),
    k AS (SELECT conv_id, turn FROM c WHERE kind = 'call'), r AS (SELECT conv_id, turn FROM c WHERE kind = 'result' AND turn % 4 <> 2),
    j AS (SELECT c.*, k2.turn AS needed, r1.turn AS answer, k1.turn AS owner, CASE WHEN k1.turn % 5 <> 3 THEN 0 WHEN k3.turn IS NOT NULL THEN 1 END AS owner_level
          FROM c LEFT JOIN k k2 ON k2.conv_id = c.conv_id AND k2.turn = c.turn - 2 LEFT JOIN r r1 ON r1.conv_id = c.conv_id AND r1.turn = c.turn + 1
                 LEFT JOIN k k1 ON k1.conv_id = c.conv_id AND k1.turn = c.turn - 1 LEFT JOIN k k3 ON k3.conv_id = c.conv_id AND k3.turn = c.turn - 3),
    m AS (SELECT *, CASE WHEN turn % 5 <> 3 THEN 0 WHEN needed IS NOT NULL THEN 1 END AS own_level, kind = 'result' AND turn % 4 <> 2 AND owner IS NOT NULL AS is_linked FROM j)
    SELECT conv_id, turn, CASE WHEN kind = 'result' THEN 'tool' ELSE role END AS role, kind, (kind = 'call')::BIGINT AS n_calls,
           CASE kind WHEN 'call' THEN (answer IS NOT NULL)::BIGINT WHEN 'result' THEN is_linked::BIGINT ELSE 0 END AS n_linked,
           (kind = 'call' AND turn % 3 = 0)::BIGINT AS n_invalid, (kind = 'call' AND own_level IS NULL)::BIGINT AS n_unordered,
           CASE WHEN kind = 'result' THEN CASE WHEN is_linked THEN 'linked' ELSE 'orphan' END END AS link,
           CASE WHEN is_linked THEN turn - 1 ELSE turn END AS anchor_turn, (CASE WHEN kind = 'result' THEN 1 + CASE WHEN is_linked THEN coalesce(owner_level, 0) ELSE 0 END ELSE 0 END)::INT AS level,
           sha256(CASE kind
             WHEN 'text' THEN '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"conversation":' || conv_id || ',"role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}'
             WHEN 'result' THEN '{"content":"' || word || '","conversation":' || conv_id || ',"role":"tool","tool_call_id":"c' || CASE WHEN turn % 4 = 2 THEN 'x' ELSE (turn - 1)::VARCHAR END || '","turn":' || turn || '}'
             ELSE '{"content":null,"conversation":' || conv_id || ',"role":"assistant","tool_calls":[{"arguments":"{\\"limit\\":' || CASE WHEN turn % 3 = 0 THEN '\\"ten\\"' ELSE '10' END || ',\\"query\\":\\"' || word || '\\"}","depends_on":['
                  || CASE WHEN turn % 5 = 3 THEN '"c' || (turn - 2) || '"' ELSE '' END || '],"id":"c' || turn || '","level":' || coalesce(own_level::VARCHAR, 'null') || ',"name":"search"}],"turn":' || turn || '}' END) AS message_sha256
    FROM m"""
ORACLE["op5_tool_links"] += f" UNION ALL SELECT * FROM ({ORACLE['tool_links_seeded'].replace('FROM conversations', 'FROM (SELECT -1 - conv_id AS conv_id, turn, role, text FROM conversations)')})"


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose id is divisible by 7 move on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLE["op13_hard_negatives"] = """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
    SELECT * FROM n WHERE rank <= 5"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation starts with up to five turns of the first one of its hundred."""
    borrowed = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), borrowed, F.col("conv") - F.col("conv") % 100)


ORACLE["op12_prefix_trie"] = """
    WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
    g AS (SELECT c, count(*) AS n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1))))) % 6 AS h FROM t GROUP BY c),
    b AS (SELECT g.c, t.p, t.r, t.x FROM g JOIN t ON t.c = g.c - g.c % 100 AND t.p <= g.h UNION ALL SELECT g.c, t.p, t.r, t.x FROM g JOIN t ON t.c = g.c AND t.p > g.h),
    o AS (SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY p) AS d FROM b),
    s AS (SELECT c, d, length(x) AS chars, list(sha256(r) || sha256(x)) OVER (PARTITION BY c ORDER BY d) AS k FROM o
          UNION ALL SELECT c, 0 AS d, 0 AS chars, [] AS k FROM g),
    e AS (SELECT c, max(d) AS last FROM s GROUP BY c),
    f AS (SELECT s.c, s.d, s.chars, sha256(array_to_string(k, ',')) AS k, sha256(array_to_string(k[:-2], ',')) AS up, d = last AS ends FROM s JOIN e ON e.c = s.c),
    n AS (SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM f GROUP BY d, k),
    h AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
    w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * chars AS weight FROM n LEFT JOIN h ON h.d = n.d AND h.k = n.k),
    u AS (SELECT f.d, f.k, sum(w.weight) AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves
          FROM w JOIN f AS v ON v.c = w.c AND v.d = w.d JOIN f ON f.c = v.c AND f.d <= v.d GROUP BY f.d, f.k)
    SELECT w.c AS conv_id, w.d AS depth, q.c AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
    FROM w JOIN u ON u.d = w.d AND u.k = w.k LEFT JOIN w AS q ON w.d > 0 AND q.d = w.d - 1 AND q.k = w.up"""


@query
def op11_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = radix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
