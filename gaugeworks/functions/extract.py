"""Reading scores, verdicts, reasoning and usage out of model replies, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a reply states its score, in order of precedence. Group 1 is the number. Runs of
# spaces and stars are taken possessively: nothing that follows could begin within them.
SCORE_PATTERNS = (
    r'(?i)"score"\s*:\s*"?(-?\d*\.?\d+)',
    r'(?i)\bscore\b\s*+\**+\s*+[:=]\s*+\**+\s*+"?(-?\d*\.?\d+)',
    r'(?i)\bscore\b[^.\n]{0,40}?\bis\s+"?(-?\d*\.?\d+)',
    r'(?i)\bcriterion\b[^.\n]{0,40}?\bis\s+"?(-?\d*\.?\d+)',
)
# Where a reply states its verdict.
ANSWER_PATTERNS = (
    r'(?i)"answer"\s*:\s*"?([AB])\b',
    r'(?i)\banswer\b\s*+\**+\s*+[:=]\s*+\**+\s*+"?([AB])\b',
)
# Fixed value: a block of reasoning inside the content.
THINK = r"(?s)<think>(.*?)(?:</think>|$)"


#: White space by Unicode's notion. Fixed values.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space at either end, by Unicode's notion of it; linear in the text."""
    return F.trim(text, F.lit(SPACES))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row however often the body names it: plain
    columns are copied into each place, and every level of nesting multiplies the copies."""
    return F.transform(F.array(value), body)[0]


def outermost_braces(text: Column) -> Column:
    """From the first opening brace to the last closing one, null if they don't enclose anything."""
    def of(t: Column) -> Column:
        first, back = F.instr(t, "{"), F.instr(F.reverse(t), "}")
        last = F.length(t) - back + 1
        return F.when((first > 0) & (back > 0) & (last > first), t.substr(first, last - first + 1))

    return once(text, of)


def lenient_json(text: Column) -> Column:
    """A variant from the text itself, else from its fenced block, else from its outermost braces.

    With a fence (three parts or more) only the fenced text is searched for braces. Null where
    nothing parses.
    """
    def inside(inner: Column) -> Column:
        return stripped(F.when(F.instr(inner, "\n") > 0, F.regexp_replace(inner, r"(?s)^[^\n]*\n", "")).otherwise(inner))

    def of(whole: Column) -> Column:
        fenced = once(F.split(whole, "```"), lambda parts: F.when(F.size(parts) >= 3, once(F.try_element_at(parts, F.lit(2)), inside)))
        rest = once(fenced, lambda f: F.coalesce(F.try_parse_json(f), F.try_parse_json(outermost_braces(F.coalesce(f, whole)))))
        return F.coalesce(F.try_parse_json(whole), rest)

    return once(stripped(text), of)


def json_object(text: Column) -> Column:
    """lenient_json where it is an object; a bare number or list is no answer."""
    return once(lenient_json(text), lambda parsed: F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed))


def _in_range(value: Column) -> Column:
    return F.when((value >= 0) & (value <= 1), value)


def extract_score(reply: Column) -> Column:
    """The score in [0, 1] that a reply states, or null; out of range is rejected, never clamped.

    A parsed object's score wins; then, pattern by pattern, the last match in range.
    """
    stated = once(F.try_variant_get(json_object(reply), "$.score", "double"), _in_range)
    found = [
        F.try_element_at(F.filter(F.transform(F.regexp_extract_all(reply, F.lit(p), F.lit(1)), lambda x: x.try_cast("double")), lambda x: (x >= 0) & (x <= 1)), F.lit(-1))
        for p in SCORE_PATTERNS
    ]
    return F.coalesce(stated, *found)


def extract_verdict(reply: Column) -> Column:
    """A or B, or null: a parsed object's answer, else the last match of the first pattern that
    matches at all."""
    said = once(F.upper(stripped(F.try_variant_get(json_object(reply), "$.answer", "string"))), lambda x: F.when(x.isin("A", "B"), x))
    found = [F.upper(F.try_element_at(F.regexp_extract_all(reply, F.lit(p), F.lit(1)), F.lit(-1))) for p in ANSWER_PATTERNS]
    return F.coalesce(said, *found)


def chosen_side(verdict: Column, a_is_response_1: Column) -> Column:
    """1 or 2: what a verdict means after the order of presentation is undone."""
    return once(verdict, lambda v: F.when(v == "A", F.when(a_is_response_1, 1).otherwise(2)).when(v == "B", F.when(a_is_response_1, 2).otherwise(1)))


def split_reasoning(content: Column, separate: Column) -> Column:
    """struct(content, reasoning): blocks of thought leave the content and join the reasoning."""
    inside = F.array_join(F.regexp_extract_all(content, F.lit(THINK), F.lit(1)), "")
    return F.struct(
        F.coalesce(F.regexp_replace(content, THINK, ""), F.lit("")).alias("content"),
        F.concat(F.coalesce(separate, F.lit("")), F.coalesce(inside, F.lit(""))).alias("reasoning"),
    )


def derived_reasoning_tokens(completion: Column, content_chars: Column, reasoning_chars: Column) -> Column:
    """The completion's tokens split by characters, rounding half to even, within the completion."""
    chars = content_chars + reasoning_chars
    part = F.bround(F.try_divide(completion * reasoning_chars, chars)).cast("long")
    return F.when((completion <= 0) | (chars <= 0), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(completion, part)))


def usage_count(value: Column) -> Column:
    """An optional count, numbers written as text included."""
    return F.coalesce(value.cast("string").try_cast("bigint"), F.lit(0))


def level_map(reply: Column, levels: tuple[str, ...]) -> Column:
    """level -> stripped text of a generator's reply; '' for a missing level."""
    def texts(parsed: Column) -> Column:
        return F.array(*(F.coalesce(stripped(F.try_variant_get(parsed, f"$.{x}", "string")), F.lit("")) for x in levels))

    return F.map_from_arrays(F.array(*(F.lit(x) for x in levels)), once(json_object(reply), texts))


def all_levels_filled(instructions: Column, levels: tuple[str, ...]) -> Column:
    wanted = F.array(*(F.lit(x) for x in levels))
    return once(instructions, lambda held: F.forall(wanted, lambda x: F.coalesce(stripped(F.try_element_at(held, x)), F.lit("")) != ""))


def retrieved_documents(content: Column) -> Column:
    """struct(docs, failed) of a retrieval tool's text: numbered blocks that hold an ID line.

    A block runs to the next numbered line. failed: nothing could be read although the text is long
    (200 characters) or names ids; a short text without ids is an empty result.
    """
    whole = stripped(F.coalesce(content, F.lit("")))
    blocks = F.regexp_extract_all(whole, F.lit(r"(?ms)^[ \t]*\d+\..*?(?=^[ \t]*\d+\.|\z)"), F.lit(0))
    field = lambda b, p: F.nullif(F.regexp_extract(b, p, 1), F.lit(""))
    docs = F.transform(
        F.filter(blocks, lambda b: b.rlike(r"(?m)^[ \t]*ID:[ \t]*\S")),
        lambda b: F.struct(
            field(b, r"^[ \t]*(\d+)\.").try_cast("int").alias("rank"), field(b, r"(?m)^[ \t]*ID:[ \t]*(\S+)").alias("doc_id"),
            F.nullif(stripped(F.regexp_extract(b, r"^[ \t]*\d+\.[ \t]*([^\n]*)", 1)), F.lit("")).alias("title"),
            field(b, r"(?m)^[ \t]*Score:[ \t]*([-\d.eE+]+)").try_cast("double").alias("score"),
            stripped(F.regexp_extract(b, r"(?ms)^[ \t]*Content:[ \t]*(.*)", 1)).alias("content"),
        ),
    )
    unread = (F.length(whole) >= 200) | (F.instr(whole, "ID:") > 0)
    return F.struct(docs.alias("docs"), ((F.size(docs) == 0) & unread).alias("failed"))
