"""Chat formatting with linked tool calls, with DataFrame operations only.

Input rows are turns: a conversation, a turn number, a role and a text. An assistant text that is a JSON
object with `tool_calls`, a list of {id, name, arguments, depends_on}, holds calls; a text of role tool
that is a JSON object with `tool_call_id` is a result. Every other text is plain content.

Calls and results are joined on conversation and call id. A call id belongs to its first call; later
calls with it are duplicates. A result belongs to its call if that call stands before it; the first such
result answers the call, later ones are repeated. Calls are ordered topologically: a call's level is 0
without dependencies, else one more than its dependencies' largest; calls in a cycle, behind one, or
behind an unknown id have no level. Arguments are checked against the schema of the call's tool, and
messages are written as JSON with keys in code point order and no white space.

Nulls: a null text is empty content, a null role stays null; turns without conversation or turn number
are formatted but never linked. Malformed JSON is plain content. Rows that repeat a conversation
and turn are messages each, and each lists the calls of all of them. Empty tables give empty tables. No conversation is gathered
in one place: all steps are joins on (conversation, id) or work on single rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import checkpoint


CALLS = "struct<content: string, tool_calls: array<struct<id: string, name: string, arguments: string, depends_on: array<string>>>>"
RESULT = "struct<tool_call_id: string, content: string>"


@dataclass(frozen=True)
class Parameter:
    """kind: string, integer, number, boolean, array or object."""

    name: str
    kind: str
    required: bool = False


#: The tools of the production query.
TOOLS: dict[str, tuple[Parameter, ...]] = {
    "search": (Parameter("query", "string", True), Parameter("limit", "integer")),
    "fetch": (Parameter("url", "string", True),),
    "calculate": (Parameter("expression", "string", True), Parameter("digits", "integer")),
}

# JSON types as Spark names them in a variant's schema.
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def canonical(text: Column) -> Column:
    """A JSON text with sorted keys and no white space; null if it is not JSON."""
    return F.to_json(F.try_parse_json(text))


def argument_errors(name: Column, arguments: Column, tools: dict[str, tuple[Parameter, ...]]) -> Column:
    """Sorted error names of one call: unknown_tool, not_an_object, missing:, type: and unknown: parameters."""
    value = F.try_parse_json(arguments)
    keys = F.coalesce(F.map_keys(F.from_json(arguments, "map<string,string>")), F.array().cast("array<string>"))
    an_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    per_tool = F.array(F.lit("unknown_tool"))
    for tool, parameters in sorted(tools.items()):
        known = F.array(*[F.lit(p.name) for p in parameters]) if parameters else F.array().cast("array<string>")
        tests = []
        for p in parameters:
            there = F.array_contains(keys, p.name)
            kind = F.schema_of_variant(F.try_variant_get(value, f"$['{p.name}']", "variant"))
            tests.append(F.when(~there, F.lit(f"missing:{p.name}") if p.required else None).when(~F.coalesce(kind, F.lit("VOID")).rlike(f"^({_KINDS[p.kind]})$"), F.lit(f"type:{p.name}")))
        wrong = F.concat(F.array_compact(F.array(*tests)), F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown:"), k)))
        per_tool = F.when(name == tool, F.when(~an_object, F.array(F.lit("not_an_object"))).otherwise(F.array_sort(wrong))).otherwise(per_tool)
    return per_tool


def parse(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, kind, content, calls, result_id) of each row; kind is text, call or result."""
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    looks = F.ltrim("text").startswith("{")
    calls = F.when((F.col("role") == "assistant") & looks, F.from_json("text", CALLS))
    result = F.when((F.col("role") == "tool") & looks, F.from_json("text", RESULT))
    t = t.withColumn("c", calls).withColumn("r", result)
    is_call, is_result = F.coalesce(F.size("c.tool_calls"), F.lit(0)) > 0, F.col("r.tool_call_id").isNotNull()
    kind = F.when(is_call, "call").when(is_result, "result").otherwise("text")
    content = F.when(is_call, F.col("c.content")).when(is_result, F.col("r.content")).otherwise(F.col("text"))
    return t.select("conv", "turn", "role", kind.alias("kind"), content.alias("content"), F.when(is_call, F.col("c.tool_calls")).alias("calls"), F.when(is_result, F.col("r.tool_call_id")).alias("result_id"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv, id, level) of the calls (conv, id, depends_on) that can be ordered. A round places all calls whose dependencies are placed."""
    edges = calls.select("conv", "id", F.explode(F.array_distinct("depends_on")).alias("needs"))
    if edges.isEmpty():
        return calls.select("conv", "id", F.lit(0).alias("level"))
    edges = checkpoint(edges)
    placed = checkpoint(calls.join(edges.select("conv", "id").distinct(), ["conv", "id"], "left_anti").select("conv", "id", F.lit(0).alias("level")))
    new = placed
    while not new.isEmpty():
        ready = edges.join(placed.select("conv", F.col("id").alias("needs"), "level"), ["conv", "needs"], "left")
        ready = ready.groupBy("conv", "id").agg(F.bool_and(F.col("level").isNotNull()).alias("all"), (F.max("level") + 1).alias("level")).filter("all")
        new = checkpoint(ready.join(placed.select("conv", "id"), ["conv", "id"], "left_anti").select("conv", "id", F.col("level").cast("int").alias("level")))
        placed = placed.unionByName(new)
    return placed


def link(turns: DataFrame, tools: dict[str, tuple[Parameter, ...]] = TOOLS, **columns: str) -> DataFrame:
    """A row per turn: conv, turn, role, kind, n_calls, n_linked, n_invalid, n_unordered, link (of a result: linked,
    repeated or orphan), anchor_turn and level, by which messages are ordered, and message, canonical JSON."""
    parsed = parse(turns, **columns)
    plain = parsed.filter("kind = 'text'")
    some = checkpoint(parsed.filter("kind <> 'text'"))
    calls = some.filter("kind = 'call'").select("conv", "turn", F.posexplode("calls").alias("pos", "call")).select("conv", "turn", "pos", "call.*")
    calls = calls.filter("conv is not null and turn is not null")
    owners = calls.filter("id is not null").groupBy("conv", "id").agg(F.min_by(F.struct("turn", "pos", "depends_on"), F.struct("turn", "pos")).alias("o")).select("conv", "id", F.col("o.turn").alias("call_turn"), F.col("o.pos").alias("call_pos"), "o.depends_on")
    placed = levels(owners.select("conv", "id", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")))
    results = some.filter("kind = 'result'").select("conv", F.col("result_id").alias("id"), F.col("turn").alias("result_turn"))
    answers = results.hint("shuffle_hash").join(owners.select("conv", "id", "call_turn"), ["conv", "id"]).filter("result_turn > call_turn").groupBy("conv", "id").agg(F.min("result_turn").alias("answer_turn"))
    owners = checkpoint(owners.join(placed, ["conv", "id"], "left").join(answers, ["conv", "id"], "left").select("conv", "id", "call_turn", "call_pos", "level", "answer_turn"))

    own = F.col("call_turn").eqNullSafe(F.col("turn")) & F.col("call_pos").eqNullSafe(F.col("pos"))
    told = calls.join(owners, ["conv", "id"], "left").withColumn("own", own).withColumn("errors", argument_errors(F.col("name"), F.col("arguments"), tools))
    message = F.struct(F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw")))).alias("arguments"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"), "id", "level", "name")
    item = F.struct(F.coalesce(F.when(F.col("own"), F.col("level")), F.lit(2**31 - 1)).alias("at"), "pos", message.alias("m"), F.when(F.col("own"), F.col("answer_turn")).isNotNull().alias("linked"), (F.size("errors") > 0).alias("bad"), (~F.col("own") | F.col("level").isNull()).alias("loose"))
    by_turn = told.groupBy("conv", "turn").agg(F.sort_array(F.collect_list(item)).alias("items"))
    joined = some.filter("kind = 'call'").join(by_turn, ["conv", "turn"], "left")
    count = lambda test: F.coalesce(F.size(F.filter("items", test)), F.lit(0)).cast("long")
    called = joined.select(
        "conv", "turn", "role", "kind", F.size("calls").cast("long").alias("n_calls"), count(lambda x: x["linked"]).alias("n_linked"), count(lambda x: x["bad"]).alias("n_invalid"), count(lambda x: x["loose"]).alias("n_unordered"),
        F.lit(None).cast("string").alias("link"), F.col("turn").alias("anchor_turn"), F.lit(0).alias("level"),
        F.to_json(F.struct("content", F.col("conv").alias("conversation"), "role", F.transform(F.coalesce("items", F.array()), lambda x: x["m"]).alias("tool_calls"), "turn"), {"ignoreNullFields": "false"}).alias("message"),
    )
    answered = some.filter("kind = 'result'").join(owners.withColumnRenamed("id", "result_id"), ["conv", "result_id"], "left")
    linked = F.when(F.col("call_turn") < F.col("turn"), F.when(F.col("answer_turn") == F.col("turn"), "linked").otherwise("repeated")).otherwise("orphan")
    answered = answered.withColumn("link", linked).select(
        "conv", "turn", "role", "kind", F.lit(0).cast("long").alias("n_calls"), (F.col("link") == "linked").cast("long").alias("n_linked"), F.lit(0).cast("long").alias("n_invalid"), F.lit(0).cast("long").alias("n_unordered"),
        "link", F.when(F.col("link") == "linked", F.col("call_turn")).otherwise(F.col("turn")).alias("anchor_turn"), (F.coalesce(F.when(F.col("link") == "linked", F.col("level")), F.lit(0)) + 1).cast("int").alias("level"),
        F.to_json(F.struct("content", F.col("conv").alias("conversation"), "role", F.col("result_id").alias("tool_call_id"), "turn"), {"ignoreNullFields": "false"}).alias("message"),
    )
    none = F.lit(0).cast("long")
    said = plain.select(
        "conv", "turn", "role", "kind", none.alias("n_calls"), none.alias("n_linked"), none.alias("n_invalid"), none.alias("n_unordered"), F.lit(None).cast("string").alias("link"), F.col("turn").alias("anchor_turn"), F.lit(0).alias("level"),
        F.to_json(F.struct("content", F.col("conv").alias("conversation"), "role", "turn"), {"ignoreNullFields": "false"}).alias("message"),
    )
    return said.unionByName(called).unionByName(answered)


def seeded(turns: DataFrame) -> DataFrame:
    """Turns of plain conversations made into calls and results, so that every row of a table exercises the links.

    Assistant turns become calls of search, with their first word as query; turn % 5 = 3 depends on the call two
    turns before. User turns after the first become results of the turn before; turn % 4 = 2 names an unknown call.
    """
    word = F.coalesce(F.regexp_extract("text", r"[A-Za-z]+", 0), F.lit(""))
    depends = F.when(F.col("turn") % 5 == 3, F.concat(F.lit('"c'), (F.col("turn") - 2).cast("string"), F.lit('"'))).otherwise(F.lit(""))
    limit = F.when(F.col("turn") % 3 == 0, F.lit('"ten"')).otherwise(F.lit("10"))
    call = F.concat(F.lit('{"content": null, "tool_calls": [{"name": "search", "id": "c'), F.col("turn").cast("string"), F.lit('", "depends_on": ['), depends, F.lit('], "arguments": {"query": "'), word, F.lit('", "limit": '), limit, F.lit("}}]}"))
    answer = F.concat(F.lit('{"tool_call_id": "c'), F.when(F.col("turn") % 4 == 2, "x").otherwise((F.col("turn") - 1).cast("string")), F.lit('", "content": "'), word, F.lit('"}'))
    a, u = F.col("role") == "assistant", (F.col("role") == "user") & (F.col("turn") > 0)
    return turns.select("conv_id", "turn", F.when(u, "tool").otherwise(F.col("role")).alias("role"), F.when(a, call).when(u, answer).otherwise(F.col("text")).alias("text"))
