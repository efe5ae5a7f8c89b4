"""Trajectories: tool names as of a result, statistics, spoken turns, rewards, call records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.extract import stripped
from gaugeworks.functions.text import word_count

#: Tokens that end a conversation and are no speech. Fixed values.
PROTOCOL_MARKERS = ("###STOP###", "###TRANSFER###", "###OUT-OF-SCOPE###")
#: Tools whose results are documents. Fixed values.
RETRIEVAL_TOOLS = ("kb_search", "grep", "search_kb", "kb_grep")


def is_spoken(role: Column, content: Column) -> Column:
    body = stripped(F.coalesce(content, F.lit("")))
    return role.isin("assistant", "user") & (body != "") & ~body.isin(*PROTOCOL_MARKERS)


def spoken_stats(turns: DataFrame, by: str) -> DataFrame:
    """Messages, spoken turns and spoken words per conversation, from one row per turn."""
    said = is_spoken(F.col("role"), F.col("text"))
    return turns.groupBy(by).agg(
        F.count("*").alias("n_messages"), F.sum(said.cast("int")).alias("spoken_turns"),
        F.sum(F.when(said, word_count(F.col("text"))).otherwise(0)).alias("spoken_words"))


def tool_names_as_of(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each result with the tool name of the latest earlier call of its id.

    ``calls``: conv, index, call_id, name; ``results``: conv, index, call_id, one row per result. The
    union of both is read in order with the last name carried along: linear in the rows, however
    many calls and results share an id (a conversation's, so a bounded group).
    """
    every = calls.select("conv", "call_id", "index", "name", F.lit(1).alias("rank")).unionByName(results.select("conv", "call_id", "index", F.lit(None).cast("string").alias("name"), F.lit(0).alias("rank")))
    order = Window.partitionBy("conv", "call_id").orderBy("index", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("name", F.last("name", True).over(order)).where("rank = 0").select("conv", "call_id", "index", "name")


def is_retrieval(name: Column, error: Column) -> Column:
    return F.lower(name).isin(*RETRIEVAL_TOOLS) & ~F.coalesce(error, F.lit(False))


def nested_stats(turns: Column) -> Column:
    """Statistics of a trajectory's array of turns: a struct. Calls count for the user on user
    turns and for the agent on all others; document ids keep the order in which they appear."""
    none = F.expr("array()").cast("array<string>")
    spoken = F.filter(turns, lambda t: is_spoken(t["role"], t["content"]))
    calls = lambda keep: F.flatten(F.transform(F.filter(turns, keep), lambda t: F.coalesce(F.transform(t["tool_calls"], lambda c: c["name"]), none)))
    found = lambda t: F.transform(F.filter(t["tool_results"], lambda r: r["doc_ids"].isNotNull()), lambda r: r["doc_ids"])
    docs = F.flatten(F.flatten(F.transform(turns, lambda t: F.coalesce(found(t), F.expr("array()").cast("array<array<string>>")))))
    errors = lambda t: F.size(F.filter(t["tool_results"], lambda r: F.coalesce(r["error"], F.lit(False))))
    return F.struct(
        F.size(turns).alias("n_messages"), F.size(spoken).alias("spoken_turns"),
        F.aggregate(spoken, F.lit(0), lambda s, t: s + word_count(t["content"])).alias("spoken_words"),
        calls(lambda t: t["role"] != "user").alias("agent_tools"), calls(lambda t: t["role"] == "user").alias("user_tools"),
        F.aggregate(turns, F.lit(0), lambda s, t: s + F.coalesce(F.greatest(errors(t), F.lit(0)), F.lit(0))).alias("tool_errors"), F.array_distinct(docs).alias("doc_ids"),
    )


def unscored_basis(basis: Column, breakdown: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_except(basis, F.map_keys(breakdown))))


def normal_reward(breakdown: Column, hit_max_steps: Column) -> Column:
    """struct(breakdown, graded, nl_assertion_present): keys by their upper-case last segment."""
    keyed = F.transform_keys(breakdown, lambda k, _: F.upper(F.substring_index(k, ".", -1)))
    return F.struct(keyed.alias("breakdown"), ((F.size(F.map_keys(breakdown)) > 0) & ~hit_max_steps).alias("graded"), F.array_contains(F.map_keys(keyed), "NL_ASSERTION").alias("nl_assertion_present"))


def turn_calls(trajectories: DataFrame) -> DataFrame:
    """Call records from the usage that turns carry; turns without usage give none."""
    turns = trajectories.select("key", "attempt", F.explode("turns").alias("t"))
    usage = turns.where("t.usage is not null")
    return usage.select(
        F.col("key").alias("item_id"), F.lit("trajectory").alias("role"), "attempt", F.coalesce("t.usage.prompt_tokens", F.lit(0)).alias("prompt_tokens"),
        F.coalesce("t.usage.completion_tokens", F.lit(0)).alias("completion_tokens"), F.lit(0).cast("long").alias("reasoning_tokens"),
        F.lit("unavailable").alias("reasoning_source"), F.coalesce("t.generation_time_s", F.lit(0.0)).alias("latency_s"), F.lit(True).alias("ok"))


def quality_checks(pairs: DataFrame) -> DataFrame:
    """Violations per rule of a labelled pair relation."""
    rules = {
        "id is null": F.col("id").isNull(), "label not 1 or 2": ~F.coalesce(F.col("correct_response").isin(1, 2), F.lit(False)),
        "criterion is null": F.col("criterion").isNull(), "unknown gap": ~F.coalesce(F.col("gap").isin("narrow_low", "narrow_high", "wide"), F.lit(False)),
    }
    tests = F.array(*(F.struct(F.lit(name).alias("rule"), bad.cast("int").alias("bad")) for name, bad in rules.items()))
    checked = pairs.select(F.explode(tests).alias("t")).groupBy("t.rule").agg(F.sum("t.bad").cast("long").alias("violations"))
    repeated = pairs.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("violations"))
    return checked.unionByName(repeated.select(F.lit("id repeats").alias("rule"), "violations"))


#: Fields of a message that have columns of their own. Fixed values.
MODELLED = ("role", "content", "tool_calls", "turn_idx")
_FIELDS = "map<string,variant>"


def split_message(message: Column) -> Column:
    """struct(role, content, tool_calls, turn_idx, modelled, extra) of a message's JSON text.

    modelled and extra hold the fields with and without columns as JSON, so that the message can be
    rebuilt exactly; an empty list of tool calls is none.
    """
    fields = F.from_json(message, _FIELDS)
    get = lambda k: F.try_element_at(fields, F.lit(k))
    calls = F.to_json(get("tool_calls"))
    return F.struct(
        F.try_variant_get(get("role"), "$", "string").alias("role"), F.try_variant_get(get("content"), "$", "string").alias("content"),
        F.when(calls != "[]", calls).alias("tool_calls"), F.try_variant_get(get("turn_idx"), "$", "int").alias("turn_idx"),
        F.to_json(F.map_filter(fields, lambda k, _: k.isin(*MODELLED))).alias("modelled"),
        F.to_json(F.map_filter(fields, lambda k, _: ~k.isin(*MODELLED))).alias("extra"),
    )


def rebuilt_message(parts: Column) -> Column:
    """The message of ``split_message`` as canonical JSON text."""
    return F.to_json(F.parse_json(F.to_json(F.map_concat(F.from_json(parts["modelled"], _FIELDS), F.from_json(parts["extra"], _FIELDS)))))


def same_json(a: Column, b: Column) -> Column:
    """Whether two JSON texts hold the same value, whatever their spacing and order of keys."""
    return F.to_json(F.try_parse_json(a)) == F.to_json(F.try_parse_json(b))
