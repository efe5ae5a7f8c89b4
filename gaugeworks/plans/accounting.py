"""Queries on call records: tokens, latency, service time, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.extract import derived_reasoning_tokens
from gaugeworks.operators import keyed, usage
from gaugeworks.plans import adapters as a
from gaugeworks.plans.adapters import Tables, sql
from gaugeworks.plans.evaluation import rounded, runs

WALL = 3600.0


def summaries(t: Tables) -> DataFrame:
    return usage.summarize(a.calls(t), ["label"], F.lit(WALL))


def scored_tasks(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The full grid of scoring tasks, and the log of those that were called."""
    log = a.scores(t)
    tasks = a.pairs(t).select("id").crossJoin(F.broadcast(a.labels(t))).withColumn("side", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return tasks, log


def todo_counts(t: Tables) -> DataFrame:
    return keyed.todo(*scored_tasks(t), ["label", "id", "side", "run"]).groupBy("label", "side", "run").agg(F.count("*").alias("n"))


def carried(t: Tables) -> DataFrame:
    """Fresh rows for the labels with an F line status, prior rows (all labels) carried for others."""
    every = runs(t).groupBy("label").agg(F.count("score_1").alias("n_scored"))
    fresh = every.where("label like '%F'").withColumn("wall_s", F.lit(1.0))
    return keyed.carry(fresh, every.withColumn("n_scored", F.lit(0).cast("long")))


def last_calls(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "value")
    return keyed.latest(rows, ["user_id", "event_type"], "event_id")


def lost_costs(t: Tables) -> DataFrame:
    """Users stand for runs; those that never signed up never finished. The first run is current."""
    checkpoints = t.events.select(F.col("user_id").alias("run_id"), F.get_json_object("props", "$.k").cast("long").alias("total_tokens"))
    finished = t.events.where("event_type = 'signup'").select(F.col("user_id").alias("run_id")).distinct()
    lost = keyed.recovered(checkpoints, finished, 0)
    return lost.agg(F.count("*").alias("n_calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("lost_tokens"))


def reasoning_share(t: Tables) -> DataFrame:
    e = t.documents.select("doc_id", (F.col("n_chars") % 97).cast("long").alias("completion"), (F.col("doc_id") % 13).alias("content"), (F.col("n_chars") % 29).alias("reasoning"))
    return e.select("doc_id", derived_reasoning_tokens(F.col("completion"), F.col("content"), F.col("reasoning")).alias("reasoning_tokens"))


def service_by_map(t: Tables) -> DataFrame:
    """Per-user maps of service time by role, summed by role over all users."""
    per = usage.item_stage_matrix(a.calls(t)).select("stage_s")
    return usage.sum_maps(per, "stage_s")


_RANK = "list_extract(list_sort(list(latency_s) filter (ok)), cast(least(count(*) filter (ok) - 1, floor({p} * count(*) filter (ok))) + 1 as int))"
_USAGE = """select {by} count(*) n_calls, cast(sum(ok::int) as bigint) n_ok, cast(sum((not ok)::int) as bigint) n_error, cast(sum(prompt_tokens) as bigint) prompt_tokens, cast(sum(completion_tokens) as bigint) completion_tokens,
  cast(sum(reasoning_tokens) as bigint) reasoning_tokens, cast(sum(content_chars) as bigint) content_chars, cast(sum(prompt_tokens + completion_tokens) as bigint) total_tokens, round(sum(latency_s), 9) service_s,
  round(avg(latency_s) filter (ok), 9) latency_mean_s, case when count(*) filter (reasoning_source = 'derived') = count(*) then 'derived' when count(*) filter (reasoning_source = 'derived') = 0 then 'reported' else 'mixed' end reasoning_source,
  round(""" + _RANK.format(p="0.5") + ", 9) latency_p50_s, round(" + _RANK.format(p="0.95") + """, 9) latency_p95_s, round(coalesce(sum(reasoning_tokens) / nullif(sum(completion_tokens), 0), 0), 9) reasoning_share,
  cast(sum(completion_tokens) - sum(reasoning_tokens) as bigint) visible_tokens, round(sum(prompt_tokens + completion_tokens) / nullif(sum(ok::int), 0), 9) tokens_per_ok_call, round(sum(latency_s) / 3600.0e0, 9) concurrency, round(sum(completion_tokens) / 3600.0e0, 9) out_tps
  from calls {group}"""

QUERIES = {
    "usage_summary": (lambda t: rounded(usage.summarize(a.calls(t), [], F.lit(WALL))), sql("calls", _USAGE.format(by="", group=""))),
    "usage_by_label": (lambda t: rounded(summaries(t)), sql("calls", _USAGE.format(by="label,", group="group by label"))),
    "usage_by_role": (lambda t: rounded(usage.summarize(a.calls(t), ["role"], F.lit(WALL))), sql("calls", _USAGE.format(by="role,", group="group by role"))),
    "usage_pooled": (
        lambda t: rounded(usage.pooled_report(a.calls(t), F.lit(WALL))),
        sql("calls", "select label, count(*) n_calls, cast(sum(prompt_tokens + completion_tokens) as bigint) total_tokens, round(sum(latency_s), 9) service_s, round(sum(latency_s) / 3600.0e0, 9) concurrency from calls group by grouping sets ((), (label))"),
    ),
    "usage_merge": (
        lambda t: rounded(usage.merge_summaries(summaries(t), []).select("n_calls", "n_ok", "n_error", "total_tokens", "service_s", "reasoning_share")),
        sql("calls", "select count(*) n_calls, cast(sum(ok::int) as bigint) n_ok, cast(sum((not ok)::int) as bigint) n_error, cast(sum(prompt_tokens + completion_tokens) as bigint) total_tokens, round(sum(latency_s), 9) service_s, round(sum(reasoning_tokens) / sum(completion_tokens), 9) reasoning_share from calls"),
    ),
    "item_stage_matrix": (
        lambda t: rounded(usage.item_stage_matrix(a.calls(t)).select("item_id", F.col("stage_s")["trajectory"].alias("trajectory_s"), F.col("stage_tokens")["judge1"].alias("judge1_tokens"), F.size("stage_s").alias("stages"), "service_s", "total_tokens", "n_error", "retries")),
        sql("calls", """select item_id, round(sum(latency_s) filter (role = 'trajectory'), 9) trajectory_s, cast(sum(prompt_tokens + completion_tokens) filter (role = 'judge1') as bigint) judge1_tokens, cast(count(distinct role) as int) stages, round(sum(latency_s), 9) service_s,
            cast(sum(prompt_tokens + completion_tokens) as bigint) total_tokens, cast(sum((not ok)::int) as bigint) n_error, cast(sum((attempt > 1)::int) as bigint) retries from calls group by item_id"""),
    ),
    "stage_service": (lambda t: rounded(usage.stage_service(a.calls(t))), sql("calls", "select role, round(sum(latency_s), 9) service_s from calls group by role")),
    "stage_service_by_map": (lambda t: rounded(service_by_map(t)), sql("calls", "select role, round(sum(latency_s), 9) stage_s from calls group by role")),
    "untimed_calls": (lambda t: usage.untimed(a.calls(t)), sql("calls", "select role, count(*) untimed_calls from calls where ok and prompt_tokens + completion_tokens > 0 and latency_s = 0 group by role")),
    "chain_median": (
        lambda t: rounded(usage.chain_median(usage.item_stage_matrix(a.calls(t)).select("item_id", F.round("service_s", 6).alias("service_s")))),
        sql("calls", """, items as (select round(sum(latency_s), 6) s from calls group by item_id having round(sum(latency_s), 6) > 0)
            select round(min(s), 9) least_s, round(max(s), 9) greatest_s, round(list_extract(list_sort(list(s)), cast(least(count(*) - 1, floor(0.5 * count(*))) + 1 as int)), 9) median_s from items"""),
    ),
    "circuit_breaker": (
        lambda t: usage.breaker(a.calls(t).withColumn("label", F.concat_ws("/", "label", "item_id")), 2),
        sql("calls", "select label || '/' || item_id label, cast(sum(ok::int) as bigint) ok_n, cast(sum((not ok)::int) as bigint) err_n, sum(ok::int) = 0 and sum((not ok)::int) >= 2 tripped from calls group by 1"),
    ),
    "todo_tasks": (
        todo_counts,
        sql("pairs scores", """, tasks as (select l.label, p.id, s.side, r.run from (select distinct l_returnflag || l_linestatus label from lineitem) l, pairs p, (select unnest([1, 2]) side) s, (select unnest([0, 1, 2]) run) r)
            select label, side, run, count(*) n from tasks t where not exists (select 1 from scores s where s.label = t.label and s.id = t.id and s.side = t.side and s.run = t.run and s.score is not null) group by all"""),
    ),
    "carry_rows": (
        carried,
        sql("pairs scores runs", "select label, case when label like '%F' then count(score_1) else 0 end n_scored, case when label like '%F' then 1.0e0 end wall_s from runs group by label"),
    ),
    "latest_votes": (last_calls, "select user_id, event_type, max(event_id) event_id, arg_max(value, event_id) as value from events group by user_id, event_type"),
    "lost_costs": (lost_costs, "select count(*) n_calls, cast(coalesce(sum(cast(props ->> '$.k' as bigint)), 0) as bigint) lost_tokens from events where user_id not in (select user_id from events where event_type = 'signup') and user_id <> 0"),
    "derived_reasoning": (
        reasoning_share,
        """select doc_id, cast(case when n_chars % 97 <= 0 or (doc_id % 13) + (n_chars % 29) <= 0 then 0 else greatest(0, least(n_chars % 97, round_even(((n_chars % 97) * (n_chars % 29)) / ((doc_id % 13) + (n_chars % 29)), 0))) end as bigint) reasoning_tokens from documents""",
    ),
}
