"""The driver's tables read as relations of the model, each with the SQL text of the same relation.

Customers are pairs, line items are scoring calls and draws, orders are cells and rated pairs,
events are call records. Every adapter reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The parquet tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def pick(number: Column, *names: str) -> Column:
    """The name at ``number`` modulo the count of names."""
    return F.element_at(F.array(*(F.lit(n) for n in names)), (number % len(names) + 1).cast("int"))


GAP_NAMES = ("narrow_low", "narrow_high", "wide")


def side_by_side(large: DataFrame, key: str, other: DataFrame, other_key: str, rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Both dealt by their keys into partitions of about ``rows`` rows of the large one, so that a task's
    memory in their join stays the same however large they are: Spark sizes partitions by compressed
    bytes, and sorted keys compress well. Tables of few rows are left to Spark."""
    n = -(-large.count() // rows)
    if n <= large.sparkSession.sparkContext.defaultParallelism:
        return large, other
    return large.repartition(n, key), other.repartition(n, other_key)


def pairs(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    nation = t.nation.select("n_nationkey", F.col("n_name").alias("domain"))
    return t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("id"), F.col("c_mktsegment").alias("criterion"), "domain", pick(key, *GAP_NAMES).alias("gap"),
        F.concat(F.lit("agent"), key % 4).alias("agent"), (key % 2 + 1).cast("int").alias("correct_response"))


def scores(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("label"))
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("id"))
    lines, orders = side_by_side(lines, "l_orderkey", orders, "o_orderkey")
    cells = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        "label", "id", (F.col("l_partkey") % 2 + 1).cast("int").alias("side"), (F.col("l_linenumber") % 3).cast("int").alias("run"))
    cells = cells.agg(F.sum("l_partkey").alias("s"), F.count("*").alias("n"))
    return cells.select("label", "id", "side", "run", F.when(F.col("n") % 3 != 0, (F.col("s") % 21) / 20).alias("score"))


def labels(t: Tables) -> DataFrame:
    return t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("label")).distinct()


def annotations(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("r")).agg(F.sum("l_suppkey").alias("s"), F.sum("l_partkey").alias("p"))
    return per.select(
        "id", F.concat(F.lit("panel_"), F.col("r") % 2).alias("panel"), F.concat(F.lit("annotator_"), F.col("r")).alias("annotator"),
        (F.col("s") % 2 + 1).cast("int").alias("judge_preference"), F.when(F.col("p") % 7 != 0, (F.col("p") % 3 * 50).cast("int")).alias("confidence"))


def answer_key(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("correct_response"),
                           pick(F.col("o_custkey"), "kept", "judge1_reject", "judge2_reject").alias("filter_outcome"))


def calls(t: Tables) -> DataFrame:
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    ok = e % 11 != 0
    return t.events.select(
        F.col("event_type").alias("label"), F.concat(F.lit("item"), F.col("user_id")).alias("item_id"), pick(e, "trajectory", "judge1", "score").alias("role"),
        (e % 3 + 1).cast("int").alias("attempt"), F.when(ok, 10 * k).otherwise(0).alias("prompt_tokens"), F.when(ok, k).otherwise(0).alias("completion_tokens"),
        F.when(ok, F.floor(k / 2)).otherwise(0).alias("reasoning_tokens"), F.when(~ok, "").otherwise(pick(e, "derived", "reported")).alias("reasoning_source"),
        F.when(ok, 4 * k).otherwise(0).alias("content_chars"), F.when(e % 13 == 0, 0.0).otherwise(F.col("value")).alias("latency_s"), ok.alias("ok"))


def cells(t: Tables) -> DataFrame:
    key = F.concat_ws(".", "o_orderpriority", "o_orderstatus", F.concat(F.lit("t"), F.col("o_orderkey")))
    return t.orders.select(key.alias("key"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("domain"), F.col("o_orderstatus").alias("criterion"), pick(F.col("o_custkey"), *GAP_NAMES).alias("gap"))


def draws(t: Tables) -> DataFrame:
    """Up to seven draws per cell; a judge without a vote is a failed draw, an absent second vote
    follows a rejection."""
    per = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("attempt")).agg(F.sum("l_suppkey").alias("s"), F.sum("l_partkey").alias("p"))
    per = per.join(cells(t), F.col("l_orderkey") == F.col("number"))
    return per.select(
        "key", "attempt", F.concat_ws("#", "key", "attempt").alias("pair_id"), (F.col("number") % 2 + 1).cast("int").alias("intent"),
        F.when(F.col("p") % 19 != 0, (F.col("s") % 2 + 1).cast("int")).alias("judge1"), F.when(F.col("p") % 17 != 0, (F.col("p") % 2 + 1).cast("int")).alias("judge2"))


def turns(t: Tables) -> DataFrame:
    return t.conversations


def replies(t: Tables) -> DataFrame:
    """Documents as replies: their text, then a verdict in one of five forms by length."""
    n = F.col("n_chars")
    tenth = F.concat(F.lit("0."), n % 10)
    side = F.when(n % 2 == 0, "A").otherwise("B")
    tail = (
        F.when(n % 5 == 0, F.concat(F.lit("\nScore: "), tenth)).when(n % 5 == 1, F.concat(F.lit("\nThe score might be 0.9. **Score:** "), tenth))
        .when(n % 5 == 2, F.concat(F.lit("\nanswer = "), side)).when(n % 5 == 3, F.concat(F.lit("\nThe answer: A or **Answer:** "), side)).otherwise(F.lit("\nscore: 42"))
    )
    return t.documents.select("doc_id", F.concat(F.lit("<think>"), F.col("lang"), F.lit("</think>"), F.col("text"), tail).alias("reply"))


#: The same relations in SQL, by name; a query's twin takes those that it needs.
SQL = {
    "pairs": """pairs as (select c_custkey id, c_mktsegment criterion, n_name "domain", list_extract(['narrow_low','narrow_high','wide'], cast(c_custkey % 3 + 1 as int)) gap,
        'agent' || (c_custkey % 4) agent, cast(c_custkey % 2 + 1 as int) correct_response from customer join nation on c_nationkey = n_nationkey)""",
    "scores": """scores as (select label, id, side, run, case when n % 3 <> 0 then (s % 21) / 20.0e0 end score from (
        select l_returnflag || l_linestatus label, o_custkey id, cast(l_partkey % 2 + 1 as int) side, cast(l_linenumber % 3 as int) run, cast(sum(l_partkey) as bigint) s, count(*) n
        from lineitem join orders on l_orderkey = o_orderkey group by all))""",
    "runs": """grid as (select l.label, p.*, r.run from (select distinct label from scores where score is not null) l, pairs p, (select unnest([0, 1, 2]) run) r),
      sides as (select label, id, run, max(score) filter (side = 1) score_1, max(score) filter (side = 2) score_2 from scores group by all),
      runs as (select g.*, score_1, score_2, case when score_1 > score_2 then 1 when score_2 > score_1 then 2 end higher_score,
        coalesce(case when score_1 > score_2 then 1 when score_2 > score_1 then 2 end = correct_response, false) correct,
        (score_1 is null or score_2 is null) is_error, score_1 is not null scored from grid g left join sides s on g.label = s.label and g.id = s.id and g.run = s.run)""",
    "annotations": """annotations as (select id, 'panel_' || (r % 2) panel, 'annotator_' || r annotator, cast(s % 2 + 1 as int) judge_preference, case when p % 7 <> 0 then cast(p % 3 * 50 as int) end confidence
        from (select l_orderkey id, l_linenumber r, cast(sum(l_suppkey) as bigint) s, cast(sum(l_partkey) as bigint) p from lineitem group by all))""",
    "answer_key": """answer_key as (select o_orderkey id, cast(o_orderkey % 2 + 1 as int) correct_response, list_extract(['kept','judge1_reject','judge2_reject'], cast(o_custkey % 3 + 1 as int)) filter_outcome from orders)""",
    "arms": """arms as (select unnest(['D0', 'D1', 'D2']) arm)""",
    "majority": """per_value as (select id, judge_preference v, count(*) n from annotations group by all),
      majority as (select id, cast(sum(n) as bigint) votes, case when max(n) * 2 > sum(n) then max_by(v, n) end majority from per_value group by id)""",
    "calls": """raw_calls as (select *, event_id % 11 <> 0 ok_, cast(props ->> '$.k' as bigint) k from events),
      calls as (select event_type label, 'item' || user_id item_id, list_extract(['trajectory','judge1','score'], cast(event_id % 3 + 1 as int)) role, cast(event_id % 3 + 1 as int) attempt,
        case when ok_ then 10 * k else 0 end prompt_tokens, case when ok_ then k else 0 end completion_tokens, case when ok_ then k // 2 else 0 end reasoning_tokens,
        case when not ok_ then '' else list_extract(['derived','reported'], cast(event_id % 2 + 1 as int)) end reasoning_source, case when ok_ then 4 * k else 0 end content_chars,
        case when event_id % 13 = 0 then 0.0e0 else value end latency_s, ok_ ok from raw_calls)""",
    "cells": """cells as (select o_orderpriority || '.' || o_orderstatus || '.t' || o_orderkey key, o_orderkey number, o_orderpriority "domain", o_orderstatus criterion, list_extract(['narrow_low','narrow_high','wide'], cast(o_custkey % 3 + 1 as int)) gap from orders)""",
    "draws": """draws as (select key, attempt, key || '#' || attempt pair_id, cast(number % 2 + 1 as int) intent, case when p % 19 <> 0 then cast(s % 2 + 1 as int) end judge1, case when p % 17 <> 0 then cast(p % 2 + 1 as int) end judge2
        from (select l_orderkey, l_linenumber attempt, cast(sum(l_suppkey) as bigint) s, cast(sum(l_partkey) as bigint) p from lineitem group by all) join cells on l_orderkey = number),
      judged as (select *, case when judge1 is null then 'failed' when judge1 <> intent then 'judge1_reject' when judge2 is null then 'failed' when judge2 <> intent then 'judge2_reject' else 'kept' end verdict from draws)""",
    "outcomes": """stops as (select key, min(attempt) filter (verdict in ('kept', 'failed')) stop, max(attempt) last_ from judged where attempt <= 3 group by key),
      outcomes as (select s.key, case when j.verdict in ('kept', 'failed') then j.verdict else 'rejected' end state, j.attempt from stops s join judged j on s.key = j.key and j.attempt = coalesce(stop, last_))""",
    "replies": r"""replies as (select doc_id, '<think>' || lang || '</think>' || text || case n_chars % 5 when 0 then chr(10) || 'Score: 0.' || (n_chars % 10) when 1 then chr(10) || 'The score might be 0.9. **Score:** 0.' || (n_chars % 10)
        when 2 then chr(10) || 'answer = ' || case when n_chars % 2 = 0 then 'A' else 'B' end when 3 then chr(10) || 'The answer: A or **Answer:** ' || case when n_chars % 2 = 0 then 'A' else 'B' end else chr(10) || 'score: 42' end reply from documents)""",
}


def sql(needs: str, body: str) -> str:
    """``body`` after the named relations; a body that begins with a comma adds relations."""
    return "with " + ",\n".join(SQL[n] for n in needs.split()) + "\n" + body
