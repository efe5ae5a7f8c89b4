"""Queries on the generation pipeline: planning, cascade, retention, dataset building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import cascade, keyed, planning
from gaugeworks.plans import adapters as a
from gaugeworks.plans.adapters import Tables, sql
from gaugeworks.plans.evaluation import rounded


def outcome_cells(t: Tables) -> DataFrame:
    return cascade.outcomes(a.draws(t), 2).select("key", "state", "attempt").join(a.cells(t), "key")


def nested(t: Tables) -> DataFrame:
    return cascade.nested_outcomes(a.draws(t), [0, 1, 2]).groupBy("state", "retries").agg(F.count("*").alias("n"))


def grid(t: Tables) -> DataFrame:
    domains = t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("domain")).agg(F.count("*").cast("int").alias("n_tasks"))
    return planning.cell_grid(domains, t.customer.select(F.col("c_mktsegment").alias("criterion")).distinct())


def balanced(t: Tables) -> DataFrame:
    return planning.balanced_gaps(a.cells(t).select("key", "criterion"), "seed")


def index_and_files(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The index of three-draw outcomes, with holes, and the files of all draws, some unreadable."""
    won = cascade.judged(a.draws(t)).select("key", "attempt", "pair_id")
    index = outcome_cells(t).join(won, ["key", "attempt"])
    index = index.select("key", "state", "attempt", "number", F.when(F.col("number") % 23 != 0, F.col("pair_id")).alias("pair_id"))
    files = a.draws(t).join(a.cells(t).select("key", "number"), "key").where("(number + attempt) % 29 <> 0")
    shifted = F.when(F.col("number") % 31 == 0, F.concat("pair_id", F.lit("x"))).otherwise(F.col("pair_id"))
    return index.drop("number"), files.select("key", "attempt", shifted.alias("id"), (F.col("number") % 37 != 0).alias("readable"))


def resolved(t: Tables) -> DataFrame:
    return cascade.resolve_pairs(*index_and_files(t))


def dry_run(t: Tables) -> DataFrame:
    """Phases that a resume would run, from artifacts of which each cell has some."""
    c = a.cells(t)
    index = outcome_cells(t).where("number % 3 = 0").select("key", "state")
    instructions = c.where("number % 2 = 0").select("key")
    trajectories = c.where("number % 5 < 3").select("key", F.explode(F.sequence(F.lit(1), (F.col("number") % 5).cast("int") + 1)).alias("level"))
    found = c.where("number % 7 = 0").select("key")
    votes = c.where("number % 4 = 0").select("key", F.lit("judge1").alias("judge"), F.lit(1).alias("side"))
    return cascade.pending_tallies(cascade.pending(c.select("key"), index, instructions, trajectories, found, votes))


def stored_plan(t: Tables) -> DataFrame:
    fresh = balanced(t).withColumn("agent", planning.hashed_choice(F.col("key"), ["alpha", "beta", "gamma"]))
    index = a.cells(t).where("number % 6 = 0").select("key", F.col("gap").alias("gap_name"), F.lit("stored").alias("agent"))
    return planning.with_prior(fresh, index).groupBy("agent").agg(F.count("*").alias("n"))


def slots(t: Tables) -> DataFrame:
    pairs = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("better"), F.col("p_brand").alias("worse"), F.lit("good").alias("better_level"), F.lit("bad").alias("worse_level"))
    out = planning.assign_slots(pairs, planning.hashed_coin(F.concat(F.lit("seed:"), F.col("id"))))
    return out.select("id", "response_1", "response_2", F.array_join("levels", "/").alias("levels"), "correct_response")


def sides(t: Tables) -> DataFrame:
    """Suppliers as contexts: an order's odd lines are its worse trajectory, the even ones the better."""
    lines = t.lineitem.groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("odd")).agg(F.min("l_suppkey").alias("s"))
    level = F.when(F.col("odd") == 1, "bad").otherwise("ok")
    rows = lines.select(F.col("l_orderkey").alias("key"), F.concat_ws("-", "l_orderkey", "odd").alias("trajectory_id"), level.alias("level"), F.lit("bad").alias("worse_level"), F.lit("ok").alias("better_level"), (F.col("s") % 3).alias("context_key"))
    return planning.join_sides(rows)


def roster(t: Tables) -> DataFrame:
    rows = t.supplier.select(F.concat(F.lit("eval"), F.col("s_suppkey")).alias("label"), a.pick(F.col("s_nationkey"), "openai", "vertex", "local").alias("provider"), (F.col("s_suppkey") % 2 == 0).alias("via_gateway"))
    return planning.roster_resolution(rows, ["gateway-1"], ["local"])


def looked_up(t: Tables) -> DataFrame:
    """Cells with their pair's label: an unknown id would be an error, not a missing row."""
    answers = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("correct_response"))
    dataset = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("criterion"), F.lit(0).alias("correct_response"))
    return keyed.attach_answers(dataset, answers)


QUERIES = {
    "cascade_outcome": (lambda t: outcome_cells(t).select("key", "state", "attempt"), sql("cells draws outcomes", "select key, state, attempt from outcomes")),
    "outcome_counts": (lambda t: outcome_cells(t).groupBy("state").agg(F.count("*").alias("n")), sql("cells draws outcomes", "select state, count(*) n from outcomes group by state")),
    "nested_retries": (
        nested,
        sql("cells draws", """, r as (select unnest([0, 1, 2]) retries), s as (select key, retries, min(attempt) filter (verdict in ('kept', 'failed')) stop, max(attempt) last_ from judged, r where attempt <= retries + 1 group by all)
            select case when j.verdict in ('kept', 'failed') then j.verdict else 'rejected' end state, count(*) n, retries from s join judged j on s.key = j.key and j.attempt = coalesce(stop, last_) group by all"""),
    ),
    "winning_draw": (lambda t: cascade.winning_draws(a.draws(t)), sql("cells draws", "select key, min(attempt) attempt, arg_min(pair_id, attempt) pair_id from judged where verdict = 'kept' group by key")),
    "rejects": (
        lambda t: cascade.judged(a.draws(t)).where("verdict like '%reject'").groupBy("verdict", "attempt").agg(F.count("*").alias("n")),
        sql("cells draws", "select verdict, attempt, count(*) n from judged where verdict like '%reject' group by all"),
    ),
    "strata": (
        lambda t: rounded(cascade.strata(outcome_cells(t))),
        sql("cells draws outcomes", """, long_ as (select state, attempt, unnest(['criterion', 'domain', 'gap']) axis, unnest([criterion, domain, gap]) "value" from outcomes join cells using (key))
            select axis, "value", count(*) cells, cast(sum(greatest(1, attempt)) as bigint) attempts, cast(sum((state = 'kept')::int) as bigint) kept, cast(sum((state = 'rejected')::int) as bigint) rejected, cast(sum((state = 'failed')::int) as bigint) failed,
            round(avg((state = 'kept')::int), 9) retention, round(sum(greatest(1, attempt)) / nullif(sum((state = 'kept')::int), 0), 9) attempts_per_kept from long_ group by all"""),
    ),
    "cell_grid": (
        grid,
        """with d as (select n_name "domain", count(*) n from nation join customer on n_nationkey = c_nationkey group by 1), c as (select distinct c_mktsegment criterion from customer)
           select "domain", criterion, cast(i as int) task_index, "domain" || '.' || criterion || '.t' || i key from (select "domain", unnest(range(n)) i from d), c""",
    ),
    "gap_balance": (
        lambda t: planning.gap_counts(balanced(t)),
        sql("cells", ", n as (select row_number() over (partition by criterion order by sha256('seed:' || criterion || ':' || key)) - 1 i from cells) select list_extract(['narrow_low','narrow_high','wide'], cast(i % 3 + 1 as int)) gap_name, count(*) n from n group by 1"),
    ),
    "gap_assignment": (
        lambda t: balanced(t).select("key", "criterion", "gap_name"),
        sql("cells", "select key, criterion, list_extract(['narrow_low','narrow_high','wide'], cast((row_number() over (partition by criterion order by sha256('seed:' || criterion || ':' || key)) - 1) % 3 + 1 as int)) gap_name from cells"),
    ),
    "stored_plan": (
        stored_plan,
        sql("cells", "select case when number % 6 = 0 then 'stored' else list_extract(['alpha','beta','gamma'], cast(cast('0x' || substr(md5(key), 1, 8) as bigint) % 3 + 1 as int)) end agent, count(*) n from cells group by 1"),
    ),
    "resolve_pairs": (
        resolved,
        sql("cells draws outcomes", """, ix as (select o.key, o.attempt, case when number % 23 <> 0 then pair_id end pair_id from outcomes o join cells c using (key) join judged j on o.key = j.key and o.attempt = j.attempt where state = 'kept'),
            f as (select key, attempt, case when number % 31 = 0 then pair_id || 'x' else pair_id end id, number % 37 <> 0 readable from draws join cells using (key) where (number + attempt) % 29 <> 0)
            select ix.key, ix.attempt, pair_id, case when pair_id is null then 'kept without id' when f.id is null then 'missing file' when not readable then 'unreadable file' when f.id <> pair_id then 'id not in file' end problem from ix left join f on ix.key = f.key and ix.attempt = f.attempt"""),
    ),
    "dry_run": (
        dry_run,
        sql("cells draws outcomes", """, open_ as (select number, number % 7 = 0 has_pair from cells c left join outcomes o on c.key = o.key and number % 3 = 0 where state is null or state = 'failed'),
            p as (select unnest(list_filter([case when not has_pair and number % 2 <> 0 then 'P1' end, case when not has_pair and not number % 5 in (1, 2) then 'P2' end, case when not has_pair then 'P3' end, case when number % 4 <> 0 then 'P4' end, 'P5'], lambda x: x is not null)) phase from open_)
            select phase, count(*) n from p group by phase"""),
    ),
    "slot_assignment": (
        slots,
        """with c as (select *, cast('0x' || substr(md5('seed:' || p_partkey), 1, 8) as bigint) % 2 = 1 coin from part)
           select p_partkey id, case when coin then p_name else p_brand end response_1, case when coin then p_brand else p_name end response_2, case when coin then 'good/bad' else 'bad/good' end levels, case when coin then 1 else 2 end correct_response from c""",
    ),
    "side_join": (
        sides,
        """with l as (select l_orderkey k, l_linenumber % 2 n, min(l_suppkey) % 3 s from lineitem group by 1, 2), p as (select k, max(s) filter (n = 1) a, max(s) filter (n = 0) b from l group by k)
           select k as key, case when a is not null then k || '-1' end worse, case when b is not null then k || '-0' end better, case when a is null or b is null then 'incomplete' when a <> b then 'context differs' end problem from p""",
    ),
    "roster_resolution": (
        roster,
        """with r as (select 'eval' || s_suppkey label, list_extract(['openai','vertex','local'], cast(s_nationkey % 3 + 1 as int)) provider, s_suppkey % 2 = 0 via_gateway from supplier)
           select *, case when provider = 'local' then 'run' when via_gateway then 'rerouted' else 'dropped' end status, case when provider = 'local' then '' when via_gateway then 'via gateway-1' else 'no credential for ' || provider end note from r""",
    ),
    "attach_answers": (looked_up, "select o_orderkey id, o_orderstatus criterion, cast(o_orderkey % 2 + 1 as int) correct_response from orders"),
}
