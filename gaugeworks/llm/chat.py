"""Tool-call linking: calls meet their results by identifier, in DataFrame operations only.

Each call is joined with its result by a hash join on (conversation, call id), placed by
topological level (the number of calls that must come before it, found by pointer doubling along
``after``), its arguments are checked against the tool's schema, and the pair is written as
canonical JSON: keys in the order of their UTF-16 code units (as RFC 8785 has it), no spaces, numbers
without trailing zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import written

#: Schema types and what the engine calls the type of a parsed value.
TYPES = {"string": "STRING", "integer": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|DECIMAL.*", "array": "ARRAY.*", "object": "OBJECT.*"}

#: tool -> {argument: (type, required) or (type, required, allowed values as JSON texts)}
Schemas = dict[str, dict[str, tuple]]


def quoted(text: Column) -> Column:
    """A text as a JSON string; null as JSON null."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.coalesce(F.when(text.isNotNull(), whole.substr(F.lit(6), F.length(whole) - 6)), F.lit("null"))


def canonical(arguments: Column) -> Column:
    """JSON text in canonical form, null where it does not parse (repeated keys included)."""
    return F.to_json(F.try_parse_json(arguments))


def _is(value: Column, kind: str) -> Column:
    """Whether a parsed value has a schema type. An integer is a number without a fraction, however
    it is written (1, 1.0, 1e3) and however long: JSON has no other notion of it."""
    ok = F.schema_of_variant(value).rlike(f"^({TYPES[kind]})$")
    if kind != "integer":
        return ok
    exact = F.try_variant_get(value, "$", "decimal(38,18)")
    rest = F.when(exact.isNotNull(), exact % 1 == 0).otherwise(F.try_variant_get(value, "$", "double") % 1 == 0)
    return ok & F.coalesce(rest, F.lit(False))


def problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call: '' or codes joined by ';'.

    ``schemas`` is bounded by the tools in use. Codes: unknown_tool, not_an_object,
    missing:<argument>, type:<argument>, value:<argument> (not an allowed one), and after these
    unexpected:<argument> for each argument that the schema doesn't name, in code point order.
    """
    parsed = F.try_parse_json(arguments)
    not_object = F.coalesce(~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(True))
    given = F.array_sort(F.map_keys(F.from_json(F.to_json(parsed), "map<string,string>")))
    by_tool = F.lit("unknown_tool")
    for tool, fields in schemas.items():
        found = []
        for field, (kind, required, *allowed) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            absent = F.when(value.isNull(), F.lit(f"missing:{field}" if required else None).cast("string"))
            wrong = F.when(value.isNotNull() & ~_is(value, kind), F.lit(f"type:{field}"))
            other = F.when(value.isNotNull() & ~F.to_json(value).isin(*allowed[0]), F.lit(f"value:{field}")) if allowed else F.lit(None).cast("string")
            found.append(F.coalesce(absent, wrong, other))
        known = F.array(*(F.lit(f) for f in fields)).cast("array<string>")
        more = F.transform(F.array_except(given, known), lambda x: F.concat(F.lit("unexpected:"), x))
        listed = F.array_compact(F.concat(F.array(*found).cast("array<string>"), more))
        by_tool = F.when(name == tool, F.when(not_object, F.lit("not_an_object")).otherwise(F.array_join(listed, ";"))).otherwise(by_tool)
    return by_tool


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) by pointer doubling along ``after``; level null on a cycle.

    A call whose predecessor does not exist is a root (level 0). A chain of n calls takes log2(n)
    rounds; rows leave when their pointer reaches a root. Calls on a cycle, or behind one, never
    leave: they are what remains after as many rounds as the number of calls has binary digits.
    """
    ids = calls.select("conv_id", "call_id", "after")
    known = ids.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    met = ids.join(known, ids.conv_id.eqNullSafe(known.c) & (ids.after == known.i), "left")
    at = written(met.select("conv_id", "call_id", F.col("i").alias("to"), F.when(F.col("i").isNull(), 0).otherwise(1).cast("long").alias("steps")), "chat-levels")
    done, open_rows, rounds = at.where("to is null"), at.where("to is not null"), 0
    n = open_rows.count()
    limit = max(n, 1).bit_length() + 1
    left = n
    while left and rounds < limit:
        every = done.unionByName(open_rows).select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("to").alias("next"), F.col("steps").alias("more"))
        hop = open_rows.join(every, open_rows.conv_id.eqNullSafe(every.c) & (open_rows["to"] == every.i))
        hop = written(hop.select("conv_id", "call_id", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "chat-levels")
        done, open_rows = done.unionByName(hop.where("to is null")), hop.where("to is not null")
        left, rounds = open_rows.count(), rounds + 1
    found = done.select("conv_id", "call_id", F.col("steps").alias("level"))
    return found.unionByName(open_rows.select("conv_id", "call_id", F.lit(None).cast("long").alias("level")))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call id, and per result id without a call.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (call id or null);
    ``results``: conv_id, call_id, turn, content. Returned: conv_id, call_id, turn, level, status
    (linked, unanswered, orphan, early when the result's turn is not after the call's), problems,
    n_calls, n_results and json. Within a conversation the order (level, turn, call_id) puts every
    call after its predecessor.

    Defined results: of several calls or results with one id the earliest turn counts (ties: the
    smallest row) and n_calls, n_results tell how many there were; rows without a call id cannot
    be linked: they count as calls or results of the id null of their conversation; arguments
    that are not JSON are quoted as text, those of any length are kept whole; integers beyond 64
    bits are integers; empty tables give empty results; extra columns, also ones named like the
    result's, are ignored.
    """
    key = ["conv_id", "call_id"]
    calls = calls.groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("x"), F.count("*").alias("n_calls"))
    calls = written(calls.select(*key, "x.*", "n_calls"), "chat-calls")
    results = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("y"), F.count("*").alias("n_results"))
    results = results.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("y.turn").alias("answered"), F.col("y.content").alias("content"), "n_results")
    placed = levels(calls.where("call_id is not null")).select(F.col("conv_id").alias("lc"), F.col("call_id").alias("li"), "level")
    calls = calls.join(placed, calls.conv_id.eqNullSafe(placed.lc) & (calls.call_id == placed.li), "left")
    both = calls.join(results, calls.conv_id.eqNullSafe(results.rc) & calls.call_id.eqNullSafe(results.ri), "full_outer")
    is_call = F.col("n_calls").isNotNull()
    status = F.when(~is_call, "orphan").when(F.col("call_id").isNull() | F.col("n_results").isNull(), "unanswered").when(F.col("answered") <= F.col("turn"), "early").otherwise("linked")
    conv = F.coalesce("conv_id", "rc")
    call = F.coalesce("call_id", "ri")
    both = both.select(
        conv.alias("conv_id"), call.alias("call_id"), F.coalesce("turn", "answered").alias("turn"), "level", status.alias("status"),
        F.when(is_call, problems(F.col("name"), F.col("arguments"), schemas)).alias("problems"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        "name", "arguments", "content",
    )
    args = F.coalesce(canonical(F.col("arguments")), quoted(F.col("arguments")))
    pieces = ['{"arguments":', args, ',"call_id":', quoted(F.col("call_id")), ',"conversation":', F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), ',"name":', quoted(F.col("name")), ',"result":', quoted(F.col("content")), ',"status":', quoted(F.col("status")), "}"]
    json = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in pieces))
    return both.withColumn("json", json).drop("name", "arguments", "content")
