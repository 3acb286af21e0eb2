"""Chat formatting with tool-call linking, in DataFrame functions.

A turn's text may be a JSON message that calls tools, ``{"content": ..., "tool_calls":
[{"id", "name", "arguments": {...}}]}``, or one that answers a call, ``{"tool_call_id",
"content"}``; any other text is plain content. Calls and results are hash-joined by
conversation and identifier, arguments are validated against the tools' schemas, and each
turn is serialised as canonical JSON: keys in code-point order, no spaces.

Turns are ordered topologically: a result never stands before its call, and a call that
names another call's identifier as an argument never before that call's result. Only
conversations in which a turn stands before one it depends on are ordered in rounds, one
for each link of the longest chain; their rows of calls and results are narrow, and no window
runs over a conversation, so one that holds a third of all turns doesn't meet in one task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import settle

_MESSAGE = "content string, tool_call_id string, tool_calls array<struct<id:string,name:string,arguments:map<string,variant>>>"


def _typed_fits(kind: str, v: str) -> str:
    """SQL test of one argument, a VARIANT ``v`` that isn't missing, by its JSON type."""
    of = f"schema_of_variant({v})"
    return {
        "string": f"{of} = 'STRING'",
        "integer": f"CASE WHEN {of} = 'BIGINT' THEN true WHEN {of} LIKE 'DECIMAL%' THEN to_json({v}) rlike '^-?[0-9]+$' WHEN {of} IN ('DOUBLE', 'FLOAT') THEN try_variant_get({v}, '$', 'double') % 1 = 0 ELSE false END",
        "number": f"({of} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {of} LIKE 'DECIMAL%')",
        "boolean": f"{of} = 'BOOLEAN'",
        "object": f"{of} LIKE 'OBJECT%'",
        "array": f"{of} LIKE 'ARRAY%'",
    }[kind]


def _typed_in(values: list, v: str) -> str:
    """SQL test whether a VARIANT equals one of JSON values."""
    texts = [x for x in values if isinstance(x, str)]
    others = [json.dumps(int(x) if isinstance(x, float) and x.is_integer() else x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in values if not isinstance(x, str)]
    text = f"try_variant_get({v}, '$', 'string') IN ({', '.join(map(_quoted, texts))})" if texts else "false"
    other = f"to_json({v}) IN ({', '.join(map(_quoted, others))})" if others else "false"
    return f"if(schema_of_variant({v}) = 'STRING', {text}, {other})"


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def argument_errors(tools: dict[str, dict]) -> str:
    """SQL for the sorted errors of a call ``c`` (name, arguments) against JSON-schema-like tools.

    A tool is ``{"properties": {name: {"type": ..., "enum": [...]}}, "required": [...]}``, one
    branch of the expression each.
    """
    cases = []
    for tool, schema in sorted(tools.items()):
        tests = []
        for name, spec in sorted(schema.get("properties", {}).items()):
            v = f"element_at(c.arguments, {_quoted(name)})"
            fits = _typed_fits(spec.get("type", "string"), v)
            tests.append(f"if({v} IS NOT NULL AND NOT ({fits}), {_quoted('type:' + name)}, NULL)")
            if "enum" in spec:
                tests.append(f"if({v} IS NOT NULL AND NOT ({_typed_in(spec['enum'], v)}), {_quoted('enum:' + name)}, NULL)")
        for name in sorted(schema.get("required", [])):
            tests.append(f"if(element_at(c.arguments, {_quoted(name)}) IS NULL, {_quoted('missing:' + name)}, NULL)")
        known = ", ".join(map(_quoted, schema.get("properties", {}))) or "''"
        extra = f"transform(filter(map_keys(c.arguments), k -> k NOT IN ({known})), k -> concat('unknown:', k))"
        cases.append(f"WHEN c.name = {_quoted(tool)} THEN array_sort(concat(array_compact(array({', '.join(tests) or 'cast(NULL as string)'})), coalesce({extra}, cast(array() as array<string>))))")
    return f"CASE {' '.join(cases)} ELSE array('unknown_tool') END" if cases else "array('unknown_tool')"


def canonical_json(**fields: Column) -> Column:
    """One JSON object of the fields, sorted by name; nulls are left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def _whole_message() -> Column:
    """The message in ``text`` with all its fields and JSON types, keys in order; the turn's role counts before its own."""
    entries = "map_entries(try_cast(try_parse_json(text) AS map<string,variant>))"
    merged = f"if(role IS NULL, {entries}, array_append(filter({entries}, e -> e.key <> 'role'), struct('role' AS key, cast(role AS variant) AS value)))"
    return F.expr(f"to_json(map_from_entries(array_sort({merged}, (a, b) -> CASE WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END)))")


def _dependencies(tooled: DataFrame, calls: DataFrame) -> DataFrame:
    """``conv_id, before, before_turn, after, after_turn``: rows of calls and results, and those that must come first."""
    results = tooled.where("answers IS NOT NULL").select("conv_id", F.col("answers").alias("call_id"), F.col("row").alias("result"), F.col("turn").alias("result_turn"))
    answered = results.join(calls, ["conv_id", "call_id"]).select("conv_id", F.col("call").alias("before"), F.col("call_turn").alias("before_turn"), F.col("result").alias("after"), F.col("result_turn").alias("after_turn"))
    texts = "transform(map_values(c.arguments), v -> if(schema_of_variant(v) = 'STRING', try_variant_get(v, '$', 'string'), NULL))"
    named = tooled.where("calls IS NOT NULL").select("conv_id", "turn", "row", F.explode("calls").alias("c")).select("conv_id", "turn", "row", F.explode(F.expr(f"array_distinct(array_compact({texts}))")).alias("call_id"))
    named = named.join(calls, ["conv_id", "call_id"]).where("call <> row").join(results, ["conv_id", "call_id"], "left")
    named = named.select("conv_id", F.coalesce("result", "call").alias("before"), F.coalesce("result_turn", "call_turn").alias("before_turn"), F.col("row").alias("after"), F.col("turn").alias("after_turn"))
    return answered.unionByName(named).where("before <> after").distinct()


def _places(edges: DataFrame) -> DataFrame:
    """``row, order_turn, order_step, cyclic`` of the rows that don't simply stand at their turn.

    A row stands at its turn, or one step behind the last row it depends on if that comes
    later. Rows in or behind a circle of dependencies stay at their turns.
    """
    place = "row long, turn long, place struct<turn: long, step: int>"
    against = edges.where("before_turn >= after_turn").select("conv_id").distinct()
    edges = settle(edges.join(against, "conv_id", "left_semi"))
    nodes = edges.selectExpr("before AS row", "before_turn AS turn").unionByName(edges.selectExpr("after AS row", "after_turn AS turn")).distinct()
    own = F.struct(F.col("turn").cast("long").alias("turn"), F.lit(0).alias("step"))
    todo = settle(nodes.join(edges.select(F.col("after").alias("row")).distinct(), "row", "left_semi"))
    placed = settle(nodes.join(todo, "row", "left_anti").select("row", "turn", own.alias("place")))
    if todo.isEmpty():
        return edges.sparkSession.createDataFrame([], place).selectExpr("row", "place.turn AS order_turn", "place.step AS order_step", "false AS cyclic")
    while True:
        waiting = edges.join(placed.select(F.col("row").alias("before")), "before", "left_anti").select(F.col("after").alias("row")).distinct()
        ready = todo.join(waiting, "row", "left_anti")
        last = edges.join(placed.select(F.col("row").alias("before"), "place"), "before").groupBy(F.col("after").alias("row")).agg(F.max(F.struct(F.col("place.turn").alias("turn"), (F.col("place.step") + 1).alias("step"))).alias("last"))
        new = settle(ready.join(last, "row").select("row", "turn", F.greatest(own, "last").alias("place")))
        if new.isEmpty():
            break
        placed, todo = settle(placed.unionByName(new)), settle(todo.join(new.select("row"), "row", "left_anti"))
    done = placed.select("row", F.col("place.turn").alias("order_turn"), F.col("place.step").alias("order_step"), F.lit(False).alias("cyclic"))
    return done.unionByName(todo.select("row", F.col("turn").cast("long").alias("order_turn"), F.lit(0).alias("order_step"), F.lit(True).alias("cyclic")))


def format_chat(turns: DataFrame, tools: dict[str, dict] | None = None) -> DataFrame:
    """Linked, validated, ordered and serialised turns of ``turns`` (conv_id, turn, role, text).

    Returns a row for each turn: ``conv_id, turn, role, order_turn, order_step`` (sort by
    these, then ``turn``), ``n_calls, n_linked`` (calls with a result), ``link`` (for results:
    ``linked``, or ``orphan`` without a call of that id), ``errors`` (``call id:error``,
    sorted) and ``message``, the canonical JSON with all fields and values of the text's (1.0
    as 1; whole numbers beyond 38 digits as doubles). A result stands at its own turn, or right
    behind its call if that comes later; a call of which an argument is another call's
    identifier likewise behind that call's results, or the call itself if it has none. Rows in
    or behind a circle of these stay at their turns, with the error ``:cycle``.

    Arguments are tested by their JSON types; an explicit null has none that fits. Of calls
    that share an id in a conversation the first turn's counts. Calls without an id stay, with
    the error ``:no_id``, and so do the calls of a turn that is itself a result, with
    ``:mixed``. A message that repeats a key in one object is read as far as it can be, with
    ``:unreadable``. A null text has null content, an empty one an empty string; a null role
    is null; turns with null keys link with nothing; repeated rows stay repeated; text that
    isn't a JSON message of these kinds is content, whatever it holds. Other columns don't
    pass through. An empty table has no rows.
    """
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("m", F.when(F.col("text").rlike(r'(?s)^\s*\{.*"(tool_calls|tool_call_id)"\s*:'), F.from_json("text", _MESSAGE)))
    rows = rows.withColumn("calls", F.expr("filter(m.tool_calls, c -> c IS NOT NULL)")).withColumn("answers", F.col("m.tool_call_id"))
    linked = F.col("calls").isNotNull() | F.col("answers").isNotNull()
    zero, no_link = F.lit(0).cast("long"), F.lit(None).cast("string")
    plain = rows.where(~linked).select("conv_id", "turn", "role", F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"), zero.alias("n_calls"), zero.alias("n_linked"), no_link.alias("link"), F.lit("").alias("errors"), canonical_json(content=F.col("text"), role=F.col("role")).alias("message"))
    tooled = rows.where(linked).withColumn("row", F.xxhash64("conv_id", "turn", "role", "text"))
    calls = tooled.where("calls IS NOT NULL").select("conv_id", "turn", "row", F.explode("calls.id").alias("call_id")).where("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "row")).alias("first"))
    calls = calls.select("conv_id", "call_id", F.col("first.turn").alias("call_turn"), F.col("first.row").alias("call"))
    places = _places(settle(_dependencies(tooled, calls)))
    # calls to their results and results to their calls, on the rows of either only
    results = tooled.where("answers IS NOT NULL").select("conv_id", F.col("answers").alias("call_id")).distinct()
    done = tooled.where("calls IS NOT NULL").select("conv_id", "row", F.explode(F.expr("array_distinct(calls.id)")).alias("call_id")).distinct().join(results, ["conv_id", "call_id"]).groupBy("row").agg(F.count("*").alias("n_linked"))
    made = calls.select(F.col("conv_id").alias("at"), F.col("call_id").alias("of"), "call")
    tooled = tooled.join(made, (F.col("conv_id") == F.col("at")) & (F.col("answers") == F.col("of")), "left").join(done, "row", "left").join(places, "row", "left")
    whole = _whole_message()
    some = F.to_json(F.expr("struct(m.content as content, role, m.tool_call_id as tool_call_id, calls as tool_calls)"))
    wrong = F.expr(f"flatten(transform(calls, c -> transform({argument_errors(tools or {})}, e -> concat(coalesce(c.id, ''), ':', e))))")
    kept = F.expr("array_compact(array(if(exists(calls, c -> c.id IS NULL), ':no_id', NULL), if(calls IS NOT NULL AND answers IS NOT NULL, ':mixed', NULL), if(cyclic, ':cycle', NULL)))")
    errors = F.concat(F.coalesce(wrong, F.array().cast("array<string>")), kept, F.when(whole.isNull(), F.array(F.lit(":unreadable"))).otherwise(F.array().cast("array<string>")))
    link = F.when(F.col("answers").isNotNull(), F.when(F.col("call").isNull(), "orphan").otherwise("linked"))
    tooled = tooled.select("conv_id", "turn", "role", F.coalesce(F.col("order_turn").cast(rows.schema["turn"].dataType), "turn").alias("order_turn"), F.coalesce("order_step", F.lit(0)).alias("order_step"), F.coalesce(F.size("calls"), F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_linked", zero).alias("n_linked"), link.alias("link"), F.array_join(F.array_sort(errors), ",").alias("errors"), F.coalesce(whole, some).alias("message"))
    return plain.unionByName(tooled)
