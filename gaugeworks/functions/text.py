"""Text assembly: clipping, one-line forms, keys, prompts, and transcripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions.extract import stripped

#: How roles are named in a transcript. Fixed values.
SPEAKERS = {"assistant": "Agent", "user": "Customer", "system": "System"}


def clip(text: Column, limit: int) -> Column:
    """Cut at ``limit`` characters, with a note of how many are missing; 0 cuts nothing."""
    if limit <= 0:
        return text
    cut = F.concat(F.substring(text, 1, limit), F.lit("\n[... truncated, "), F.length(text) - limit, F.lit(" more characters]"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def one_line(text: Column, limit: int) -> Column:
    """White space collapsed; cut at the last space if that is past half the limit."""
    flat = stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    cut = F.substring(flat, 1, limit)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    word = F.when((F.instr(cut, " ") > 0) & (space > limit // 2), cut.substr(F.lit(1), space)).otherwise(cut)
    return F.when(F.length(flat) > limit, F.concat(F.regexp_replace(word, "[ ,;:]+$", ""), F.lit(" ..."))).otherwise(flat)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def tail(path: Column, separator: str) -> Column:
    """The last segment of a path or of an enumeration's name."""
    return F.substring_index(path, separator, -1)


def attempt_suffix(attempt: Column) -> Column:
    return F.when(attempt > 1, F.concat(F.lit(".a"), attempt)).otherwise(F.lit(""))


def error_text(kind: Column, message: Column) -> Column:
    return F.concat(kind, F.lit(": "), F.substring(message, 1, 200))


def speaker(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in SPEAKERS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, role), role)


def turn_lines(turn: Column, tool_chars: int = 600) -> Column:
    """The transcript lines of one turn struct (index, role, content, tool_calls, tool_results)."""
    n = F.concat(F.lit("["), turn["index"] + 1, F.lit("] "))
    content = stripped(F.coalesce(turn["content"], F.lit("")))
    who = speaker(turn["role"])
    none = F.expr("array()").cast("array<string>")
    calls = F.coalesce(F.transform(turn["tool_calls"], lambda c: F.concat(n, who, F.lit(" calls "), c["name"], F.lit("("), F.coalesce(c["arguments"], F.lit("")), F.lit(")"))), none)

    def result(r: Column) -> Column:
        head = F.concat(n, F.when(F.coalesce(r["error"], F.lit(False)), "Tool error").otherwise("Tool result"), F.lit(" -> "), speaker(r["requestor"]), F.lit(": "))
        return F.concat(head, clip(stripped(F.coalesce(r["content"], F.lit(""))), tool_chars))

    results = F.coalesce(F.transform(turn["tool_results"], result), none)
    said = F.when(content != "", F.array(F.concat(n, who, F.lit(": "), content))).when(F.size(calls) == 0, F.array(F.concat(n, who, F.lit(": [empty message]")))).otherwise(none)
    return F.when(turn["role"] == "tool", results).otherwise(F.concat(said, calls))


def transcript(turns: Column, tool_chars: int = 600) -> Column:
    """One conversation as text, tool traffic inline; a conversation's turns are one array value."""
    return F.array_join(F.flatten(F.transform(turns, lambda t: turn_lines(t, tool_chars))), "\n")


def sections(**parts: Column) -> Column:
    """Titled sections, those without text left out."""
    shown = [F.when(stripped(F.coalesce(body, F.lit(""))) != "", F.concat(F.lit(f"## {title.replace('_', ' ')}\n"), body)) for title, body in parts.items()]
    return F.concat_ws("\n\n", *shown)


def scoring_prompt(criterion: Column, description: Column, prompt: Column, response: Column) -> Column:
    """What an evaluator is asked: one criterion, one response, a score from 0 to 1 as JSON."""
    return sections(
        Task=F.concat(F.lit("Score the response on the criterion "), criterion, F.lit(" from 0 to 1. Reply with JSON holding reasoning and score.")),
        Criterion=description, Conversation_context=prompt, Response=response,
    )


def pairwise_prompt(criterion: Column, description: Column, prompt: Column, a: Column, b: Column) -> Column:
    """What a judge is asked: which of two responses is better, without any hint of the label."""
    return sections(
        Task=F.concat(F.lit("Decide which response is better on the criterion "), criterion, F.lit(". Reply with JSON holding reasoning and answer, A or B.")),
        Criterion=description, Conversation_context=F.coalesce(prompt, F.lit("(not recorded)")), Response_A=a, Response_B=b,
    )


def context_key(context: Column) -> Column:
    """16 hexadecimal digits that tell contexts apart by domain, task, policy, persona,
    instructions, tool names and documents; purpose and tool schemas play no part."""
    none = F.expr("array()").cast("array<string>")
    names = lambda tools: F.coalesce(F.array_sort(F.transform(tools, lambda t: t["name"])), none)
    return F.substring(F.sha2(F.to_json(F.struct(
        names(context["agent_tools"]).alias("agent_tools"), context["domain"].alias("domain"), context["policy"].alias("policy"),
        F.array_sort(context["required_documents"]).alias("required_documents"), context["task_id"].alias("task_id"),
        context["user_instructions"].alias("user_instructions"), context["user_persona"].alias("user_persona"), names(context["user_tools"]).alias("user_tools"),
    )), 256), 1, 16)
