"""Queries on replies, transcripts and blind datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import extract, text
from gaugeworks.operators import trajectory
from gaugeworks.plans import adapters as a
from gaugeworks.plans.adapters import Tables, sql
from gaugeworks.sources.sinks import answer_rows, blind
from gaugeworks.streaming.calls import windowed


def labelled(t: Tables) -> DataFrame:
    """Parts as full pair records."""
    return t.part.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("criterion_name"), F.lit("d").alias("criterion_description"), F.col("p_brand").alias("prompt"),
        F.col("p_name").alias("response_1"), F.reverse("p_name").alias("response_2"), (F.col("p_size") % 2 + 1).cast("int").alias("correct_response"),
        F.lit("+").alias("positive_hint"), F.lit("-").alias("negative_hint"), F.concat(F.lit("g"), F.col("p_size")).alias("group_id"), F.array(F.lit("bad"), F.lit("good")).alias("levels"),
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("org/model-"), F.col("p_size") % 3)).alias("agent_1"), F.lit("x/y/other").alias("agent_2"),
        F.struct(F.col("p_brand").alias("domain"), F.col("p_type").alias("task_id"), F.lit("policy").alias("policy"), F.lit("p").alias("task_purpose"), F.lit("u").alias("user_persona"), F.lit("i").alias("user_instructions")).alias("context"))


def blind_rows(t: Tables) -> DataFrame:
    return blind(labelled(t)).select("id", "criterion_name", "prompt", "response_1", "response_2", F.col("context.domain").alias("domain"), F.size(F.array(F.col("context.*"))).alias("context_fields"))


def as_of(t: Tables) -> DataFrame:
    """A user's clicks and views are calls of a tool by amount, purchases the results."""
    e = t.events.select(F.col("user_id").alias("conv"), F.col("event_id").alias("index"), (F.col("event_id") % 7).alias("call_id"), "event_type")
    calls = e.where("event_type in ('click', 'view')").withColumnRenamed("event_type", "name")
    return trajectory.tool_names_as_of(calls, e.where("event_type = 'purchase'").drop("event_type"))


def turn_arrays(t: Tables) -> DataFrame:
    """Conversations as nested trajectories; a system turn stands for a tool call of the agent."""
    none = "cast(null as array<struct<id:string,requestor:string,content:string,error:boolean,doc_ids:array<string>>>)"
    turn = F.struct(
        F.col("turn").cast("int").alias("index"), "role", F.col("text").alias("content"),
        F.when(F.col("role") == "system", F.array(F.struct(F.lit("c").alias("id"), F.lit("lookup").alias("name"), F.lit("").alias("arguments")))).alias("tool_calls"),
        F.expr(none).alias("tool_results"))
    return t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def nested_stats(t: Tables) -> DataFrame:
    s = turn_arrays(t).select("conv_id", trajectory.nested_stats(F.col("turns")).alias("s"))
    return s.select("conv_id", F.col("s.n_messages").alias("n_messages"), F.col("s.spoken_turns").alias("spoken_turns"), F.col("s.spoken_words").alias("spoken_words"), F.size("s.agent_tools").alias("agent_calls"), F.size("s.user_tools").alias("user_calls"))


def clipped(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.clip(F.col("text"), 600)).alias("clipped"), F.length(text.one_line(F.col("text"), 80)).alias("line_length"))


def rewards(t: Tables) -> DataFrame:
    """Order status and priority as reward keys."""
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.create_map(F.concat(F.lit("kind."), F.lower("o_orderstatus")), F.lit(1.0)).alias("breakdown"), (F.col("o_orderkey") % 5 == 0).alias("hit"), F.array(F.lit("kind.z"), F.lit("kind.f"), F.lit("kind.a")).alias("basis"))
    r = trajectory.normal_reward(F.col("breakdown"), F.col("hit"))
    return o.select("id", F.map_keys(r["breakdown"])[0].alias("key"), r["graded"].alias("graded"), F.array_join(trajectory.unscored_basis(F.col("basis"), F.col("breakdown")), ",").alias("unscored"))


QUERIES = {
    "extract_score": (
        lambda t: a.replies(t).select("doc_id", extract.extract_score(F.col("reply")).alias("score")),
        "select doc_id, case when n_chars % 5 in (0, 1) then (n_chars % 10) / 10.0e0 end score from documents",
    ),
    "extract_verdict": (
        lambda t: a.replies(t).select("doc_id", extract.extract_verdict(F.col("reply")).alias("verdict")),
        "select doc_id, case when n_chars % 5 in (2, 3) then case when n_chars % 2 = 0 then 'A' else 'B' end end verdict from documents",
    ),
    "think_split": (
        lambda t: a.replies(t).select("doc_id", extract.split_reasoning(F.col("reply"), F.lit(None).cast("string")).alias("s")).select("doc_id", F.length("s.content").alias("content_chars"), F.col("s.reasoning").alias("reasoning")),
        sql("replies", "select doc_id, cast(length(reply) - length(lang) - 15 as int) content_chars, lang reasoning from replies join documents using (doc_id)"),
    ),
    "blind_split": (blind_rows, "select cast(p_partkey as varchar) id, p_type criterion_name, p_brand prompt, p_name response_1, reverse(p_name) response_2, p_brand \"domain\", 4 context_fields from part"),
    "answer_split": (
        lambda t: answer_rows(labelled(t)).select("id", "correct_response", "group_id", F.array_join("levels", "/").alias("levels"), "agent"),
        "select cast(p_partkey as varchar) id, cast(p_size % 2 + 1 as int) correct_response, 'g' || p_size group_id, 'bad/good' levels, case when p_size % 3 = 0 then 'other' else 'model-' || (p_size % 3) end agent from part",
    ),
    "tool_name_asof": (
        as_of,
        """with e as (select user_id conv, event_id "index", event_id % 7 call_id, event_type from events)
           select r.conv, r.call_id, r."index", arg_max(c.event_type, c."index") as name from e r left join e c on r.conv = c.conv and r.call_id = c.call_id and c.event_type in ('click', 'view') and c."index" < r."index" where r.event_type = 'purchase' group by all""",
    ),
    "trajectory_stats": (
        lambda t: trajectory.spoken_stats(a.turns(t), "conv_id"),
        r"""select conv_id, count(*) n_messages, cast(sum((role in ('assistant', 'user') and trim(text) <> '')::int) as bigint) spoken_turns, cast(sum(case when role in ('assistant', 'user') then len(regexp_extract_all(text, '\S+')) else 0 end) as bigint) spoken_words from conversations group by conv_id""",
    ),
    "nested_stats": (
        nested_stats,
        r"""select conv_id, cast(count(*) as int) n_messages, cast(sum((role <> 'system' and trim(text) <> '')::int) as int) spoken_turns, cast(sum(case when role <> 'system' then len(regexp_extract_all(text, '\S+')) else 0 end) as int) spoken_words,
            cast(sum((role = 'system')::int) as int) agent_calls, 0 user_calls from conversations group by conv_id""",
    ),
    "render_transcript": (
        lambda t: turn_arrays(t).select("conv_id", F.md5(text.transcript(F.col("turns"))).alias("digest")),
        r"""select conv_id, md5(string_agg('[' || (turn + 1) || '] ' || case role when 'assistant' then 'Agent' when 'user' then 'Customer' else 'System' end || ': ' || trim(text, ' ' || chr(9) || chr(10) || chr(13)) || case when role = 'system' then chr(10) || '[' || (turn + 1) || '] System calls lookup()' else '' end, chr(10) order by turn)) digest from conversations group by conv_id""",
    ),
    "clip_text": (
        clipped,
        r"""with f as (select doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) flat from documents), c as (select *, substr(flat, 1, 80) cut, 80 - (position(' ' in reverse(substr(flat, 1, 80)))) space from f)
            select doc_id, md5(case when length(text) > 600 then substr(text, 1, 600) || chr(10) || '[... truncated, ' || (length(text) - 600) || ' more characters]' else text end) clipped,
            cast(case when length(flat) > 80 then length(regexp_replace(case when position(' ' in cut) > 0 and space > 40 then substr(cut, 1, space) else cut end, '[ ,;:]+$', '')) + 4 else length(flat) end as int) line_length from c""",
    ),
    "reward_normal": (
        rewards,
        "select o_orderkey id, o_orderstatus key, o_orderkey % 5 <> 0 graded, case when o_orderstatus = 'F' then 'kind.a,kind.z' else 'kind.a,kind.f,kind.z' end unscored from orders",
    ),
    "quality_checks": (
        lambda t: trajectory.quality_checks(a.pairs(t)),
        sql("pairs", """select rule, cast(0 as bigint) violations from (select unnest(['id is null', 'label not 1 or 2', 'criterion is null', 'unknown gap', 'id repeats']) rule)
            where (select count(*) from pairs where id is null or correct_response not in (1, 2) or criterion is null or gap not in ('narrow_low', 'narrow_high', 'wide')) = 0 and (select count(*) - count(distinct id) from pairs) = 0"""),
    ),
    "event_windows": (
        lambda t: windowed(t.events).select("window_start", "event_type", "n", F.round("total", 6).alias("total")),
        "select date_trunc('hour', ts) window_start, event_type, count(*) n, round(sum(value), 6) total from events group by all",
    ),
}
