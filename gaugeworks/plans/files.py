"""Queries that write the model's files from the driver's tables and read them back.

Small files (nations, suppliers' rosters) are put down by name, logs and relations by the sinks.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import text
from gaugeworks.operators import keyed, metrics, reporting, trajectory
from gaugeworks.plans import adapters as a
from gaugeworks.plans.adapters import Tables, sql
from gaugeworks.plans.evaluation import runs
from gaugeworks.plans.generation import outcome_cells
from gaugeworks.sources import readers, sinks
from gaugeworks.sources.shared import fresh_folder, put_text
from gaugeworks.sources.sweep import Answer, staged, sweep


def nations(t: Tables) -> list:
    """All 25 nations, a table of fixed size."""
    return sorted(t.nation.collect(), key=lambda r: r.n_nationkey)


def put_files(t: Tables, tag: str, files: dict[str, object]) -> str:
    """JSON files by name in a new folder."""
    root = fresh_folder(t.spark, tag)
    for name, held in files.items():
        put_text(t.spark, f"{root}/{name}", held if isinstance(held, str) else json.dumps(held))
    return root


def array_scan(t: Tables) -> DataFrame:
    by_region: dict[int, list] = {}
    for r in nations(t):
        by_region.setdefault(r.n_regionkey, []).append({"id": str(r.n_nationkey), "criterion_name": r.n_name, "unknown": 1, "levels": ["bad", "ok"]})
    root = put_files(t, "pairs", {f"{k}.json": v for k, v in by_region.items()})
    return readers.json_array(t.spark, f"{root}/*.json", "id string, criterion_name string, prompt string, levels array<string>").select("id", "criterion_name", "prompt", F.array_join("levels", "/").alias("levels"))


def log_progress(t: Tables) -> DataFrame:
    """Events as scores in three appends by number modulo 3: the last append of a task wins."""
    path = fresh_folder(t.spark, "log")
    e = t.events.select(F.col("event_type").alias("label"), F.col("user_id").cast("string").alias("id"), F.lit("k").alias("key"), F.lit(0).alias("run"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 21 / 20).alias("score"), "event_id")
    for k in range(3):
        sinks.append_log(e.where(F.col("event_id") % 3 == k).orderBy("event_id").drop("event_id"), path)
    return readers.log_progress(readers.call_log(t.spark, path))[0].select("label", "id", "score")


def results_scan(t: Tables) -> DataFrame:
    files: dict[str, list] = {}
    for r in nations(t):
        run = {"run": 0, "score_1": r.n_nationkey / 4, "score_2": None, "correct": r.n_nationkey % 2 == 0}
        files.setdefault(f"m{r.n_regionkey}.results.json", []).append({"id": r.n_name, "criterion_name": "c", "correct_response": 1, "runs": [run, run | {"run": 1}]})
    return readers.flat_runs(readers.results(t.spark, put_files(t, "results", files))).select("label", "id", "run", "score_1", "correct")


def annotator_scan(t: Tables) -> DataFrame:
    files: dict[str, list] = {}
    for r in nations(t):
        files.setdefault(f"panel_{r.n_regionkey % 2}/annotator_{r.n_regionkey}.json", []).append({"id": r.n_name, "criterion_name": "c", "judge_preference": r.n_nationkey % 2 + 1, "confidence": 50})
    return readers.annotations(t.spark, put_files(t, "study", files)).select("panel", "annotator", "id", "judge_preference", "confidence")


def votes_scan(t: Tables) -> DataFrame:
    votes = [{"id": r.n_name, "judge": "judge1", "side": r.n_regionkey % 2 + 1} for r in nations(t)]
    return readers.votes(t.spark, put_files(t, "votes", {"judge_votes.json": {"votes": votes}}) + "/judge_votes.json").select("id", "judge", "side")


def index_scan(t: Tables) -> DataFrame:
    """An index of which one file is missing: its relation is empty, not an error."""
    root = put_files(t, "index", {"pair_index.json": [{"key": r.n_name, "state": "kept", "attempt": r.n_regionkey} for r in nations(t)]})
    schema = "key string, state string, attempt int"
    return readers.or_empty(t.spark, f"{root}/pair_index.json", schema).unionByName(readers.or_empty(t.spark, f"{root}/none.json", schema))


def criteria_scan(t: Tables) -> DataFrame:
    root = put_files(t, "criteria", {"criteria.json": [{"name": r.n_name, "description": f"region {r.n_regionkey}"} for r in nations(t)]})
    told = readers.criteria(t.spark, f"{root}/criteria.json").withColumn("instructions", F.create_map(F.lit("bad"), F.concat(F.lit("not "), F.col("description"))))
    return reporting.baseline_instruction(told, "bad")


def pair_scan(t: Tables) -> DataFrame:
    """Draws in both layouts: a file of pairs/ wins over its namesake; concatenated afterwards."""
    files = {}
    for r in nations(t):
        name = f"d.c.t{r.n_nationkey}{'.a2' if r.n_regionkey else ''}.pairs.json"
        files[name] = [{"id": f"root-{r.n_name}"}]
        if r.n_nationkey % 2:
            files[f"pairs/{name}"] = [{"id": f"sub-{r.n_name}"}, {"id": f"more-{r.n_name}"}]
    root = put_files(t, "draws", files)
    out = fresh_folder(t.spark, "dataset")
    sinks.concat_pairs(t.spark, root, out)
    return t.spark.read.schema("id string").json(out)


def point_draw(t: Tables) -> DataFrame:
    files = {f"pairs/d.c.t{r.n_nationkey}.a2.pairs.json": [{"id": f"{r.n_name}-{i}"} for i in (3, 1, 2)] for r in nations(t)}
    return readers.point_lookup(readers.pair_files(t.spark, put_files(t, "draws", files)), "d.c.t7", 2).select("id", "file")


def trajectory_scan(t: Tables) -> DataFrame:
    files = {f"trajectories/{r.n_name}.json": {"trajectory_id": r.n_name, "level": "ok"} for r in nations(t)}
    files |= {"trajectories/dataset.json": {}, "trajectories/x.pairs.json": {}, "lost.json": {"trajectory_id": "not read"}}
    return readers.trajectories(t.spark, put_files(t, "tr", files)).select("trajectory_id", "level", "file")


def simulation_scan(t: Tables) -> DataFrame:
    root = put_files(t, "sims", {"s.json": [{"id": r.n_name, "task_id": str(r.n_regionkey)} for r in nations(t)]})
    tasks = t.region.select(F.col("r_regionkey").cast("string").alias("task_id"), F.col("r_name").alias("purpose"))
    return readers.simulations(t.spark, f"{root}/s.json", "id string, task_id string", tasks)


def stored_votes(t: Tables) -> DataFrame:
    """A keyed store after two batches, the second with repeated keys: the last by number stays."""
    path = fresh_folder(t.spark, "store")
    o = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    for half in (0, 1):
        sinks.replace(keyed.upsert(sinks.relation(t.spark, path) if half else o.limit(0), o.where(F.col("seq") % 2 == half), ["id"], "seq"), path)
    return sinks.relation(t.spark, path)


def accounting(t: Tables) -> DataFrame:
    """Checkpoints of four runs, one finished: what the killed ones spent."""
    path = fresh_folder(t.spark, "accounting")
    for run in range(4):
        sinks.put_accounting(t.events.where(F.col("event_id") % 4 == run).select(F.get_json_object("props", "$.k").cast("long").alias("total_tokens")), f"run{run}", path)
    sinks.clear_accounting(t.spark, "run1", path)
    lost = keyed.recovered(t.spark.read.parquet(path), t.spark.createDataFrame([("run2",)], "run_id string"), "run0")
    return lost.groupBy("run_id").agg(F.sum("total_tokens").alias("lost_tokens"))


def published(t: Tables) -> DataFrame:
    """Stage usage assigned to artifacts; the summary and the records dumped beside it."""
    path = fresh_folder(t.spark, "artifacts")
    sinks.replace(t.supplier.select(F.col("s_suppkey").alias("item_id"), F.lit(-1).cast("long").alias("tokens")), path)
    spent = t.lineitem.groupBy(F.col("l_suppkey").alias("item_id")).agg(F.count("*").alias("tokens")).where("item_id % 2 = 0")
    sinks.publish_stage_usage(sinks.relation(t.spark, path), spent, path)
    out = sinks.smoke_path(path, 3)
    sinks.dump_usage(sinks.relation(t.spark, path), spent.agg(F.sum("tokens").alias("tokens")), out)
    return t.spark.read.schema("item_id long, tokens long").json(f"{out}/records").crossJoin(t.spark.read.schema("total long, tokens long").json(f"{out}/summary").select(F.col("tokens").alias("total")))


def having(t: Tables) -> DataFrame:
    return readers.having_artifact(a.cells(t).select("key", "number"), outcome_cells(t).where("state = 'kept'"), ["key"]).select("number")


def roster_results(t: Tables) -> DataFrame:
    """Results of a roster in its order with their usage, absent for some; others are ignored."""
    summary, path = metrics.summary(runs(t)).select("label", "n_scored"), fresh_folder(t.spark, "results")
    summary.write.parquet(path)  # a row per label, of which roster and usage are made
    results = t.spark.read.schema(summary.schema).parquet(path)
    roster = results.select("label").where("label <> 'NF'").withColumn("position", F.length("label") - F.ascii("label"))
    usage = results.where("label like '%O'").select("label", (F.col("n_scored") * 2).alias("n_calls"))
    return reporting.of_roster(roster, reporting.with_usage(results, usage))


def lost(t: Tables) -> DataFrame:
    return reporting.lost_pairs(a.calls(t).where("not ok").select("label", F.col("item_id").alias("id")))


def messages(t: Tables) -> DataFrame:
    """Conversations as open records: modelled fields apart from extra ones, and rebuilt exactly."""
    m = t.conversations.select("conv_id", "turn", F.to_json(F.struct("role", F.col("text").alias("content"), F.col("turn").alias("turn_idx"), F.struct(F.length("text").alias("chars")).alias("meta"))).alias("m"))
    m = m.withColumn("p", trajectory.split_message(F.col("m")))
    return m.select("conv_id", "turn", F.col("p.role").alias("role"), F.col("p.turn_idx").alias("turn_idx"), F.col("p.extra").alias("extra"), trajectory.same_json(F.col("m"), trajectory.rebuilt_message(F.col("p"))).alias("same"))


def errors(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.error_text(F.col("source"), F.col("text"))).alias("digest"))


def stub(attempt: int):
    """A service that is down for every fifth response at first, and never finds a score in every seventh."""
    def score(label: str, prompt: str, response: str) -> Answer:
        n = int(response)
        if n % 7 == 0:
            raise ValueError("no score")
        if n % 5 == 0 and attempt == 1:
            raise RuntimeError("down")
        return Answer(n % 21 / 20, 10, n % 3)

    return score


def swept(t: Tables) -> DataFrame:
    """A sweep over all suppliers that fails, is resumed, and is run once more over a complete log."""
    lane = a.pick(F.col("s_nationkey"), "fast", "slow", "other")
    tasks = t.supplier.select(F.lit("m").alias("label"), lane.alias("lane"), F.col("s_suppkey").alias("id"), F.lit("response_1").alias("key"), F.lit(0).alias("run"), F.lit("p").alias("prompt"), F.col("s_suppkey").cast("string").alias("response"))
    path = fresh_folder(t.spark, "sweep")
    sweep(tasks.where("s_suppkey % 2 = 0"), stub, path, {"fast": 3, "slow": 1}, passes=1)
    for passes in (2, 2):
        log = sweep(tasks, stub, path, {"fast": 3, "slow": 1}, {"slow": 10_000.0}, passes)
    last = readers.log_progress(log)[0].select("id", "score")
    spent = log.groupBy("id").agg(F.count("*").alias("calls"), F.sum("usage.prompt_tokens").alias("prompt_tokens"), F.max_by("usage.error", "seq").alias("error"))  # of the last call
    return spent.join(last, "id", "left").select("id", "calls", "prompt_tokens", "error", "score")


def staged_redraws(t: Tables) -> DataFrame:
    """The cascade run stage by stage, re-drawing only what a judge rejected."""
    draws = a.draws(t)
    cells = a.cells(t).select("key")  # one that is never drawn stays open and has no outcome
    draw = lambda open_cells, attempt: draws.where(F.col("attempt") == attempt).join(open_cells, "key", "left_semi")
    return staged(cells, draw, lambda d: d, fresh_folder(t.spark, "staged"), 2).select("key", "state", "attempt")


def report_table(t: Tables) -> DataFrame:
    rows = metrics.commitment(runs(t))
    return reporting.table_lines(rows, [("label", 6, None), ("acc_pct", 8, 1), ("errs", 6, 0)], [F.col("label")])


def set_forms(t: Tables) -> DataFrame:
    """Customers without orders, and per nation the segments that its customers lack."""
    idle = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    every = t.customer.agg(F.collect_set("c_mktsegment").alias("all"))
    per = idle.groupBy("c_nationkey").agg(F.count("*").alias("idle"), F.collect_set("c_mktsegment").alias("own"))
    return per.crossJoin(F.broadcast(every)).select("c_nationkey", "idle", F.array_join(F.array_sort(F.array_except("all", "own")), ",").alias("lacking"))


QUERIES = {
    "json_array_scan": (array_scan, "select cast(n_nationkey as varchar) id, n_name criterion_name, cast(null as varchar) prompt, 'bad/ok' levels from nation"),
    "log_progress": (log_progress, "select event_type label, cast(user_id as varchar) id, arg_max((event_id % 21) / 20.0e0, (event_id % 3) * 1000000000000 + event_id) score from events where event_id % 4 <> 0 group by all"),
    "results_scan": (results_scan, "select 'm' || n_regionkey label, n_name id, run, n_nationkey / 4.0e0 score_1, n_nationkey % 2 = 0 correct from nation, (select unnest([0, 1]) run)"),
    "annotator_scan": (annotator_scan, "select 'panel_' || (n_regionkey % 2) panel, 'annotator_' || n_regionkey annotator, n_name id, cast(n_nationkey % 2 + 1 as int) judge_preference, 50 confidence from nation"),
    "votes_scan": (votes_scan, "select n_name id, 'judge1' judge, cast(n_regionkey % 2 + 1 as int) side from nation"),
    "index_scan": (index_scan, "select n_name key, 'kept' state, n_regionkey attempt from nation"),
    "criteria_scan": (criteria_scan, "select n_name as name, 'not region ' || n_regionkey instruction from nation"),
    "pair_scan": (pair_scan, "select case when n_nationkey % 2 = 1 then 'sub-' else 'root-' end || n_name id from nation union all select 'more-' || n_name from nation where n_nationkey % 2 = 1"),
    "point_draw": (point_draw, "select n_name || '-3' id, 'd.c.t7.a2.pairs.json' file from nation where n_nationkey = 7"),
    "trajectory_scan": (trajectory_scan, "select n_name trajectory_id, 'ok' as level, n_name || '.json' file from nation"),
    "simulation_scan": (simulation_scan, "select n_name id, cast(n_regionkey as varchar) task_id, r_name purpose from nation join region on n_regionkey = r_regionkey"),
    "stored_votes": (stored_votes, "select o_custkey id, max(o_orderkey) seq, arg_max(o_orderstatus, o_orderkey) o_orderstatus from (select *, max(o_orderkey % 2) over (partition by o_custkey) m from orders) where o_orderkey % 2 = m group by 1"),
    "accounting_recovery": (accounting, "select 'run3' run_id, cast(sum(cast(props ->> '$.k' as bigint)) as bigint) lost_tokens from events where event_id % 4 = 3"),
    "published_usage": (published, "with u as (select l_suppkey, count(*) n from lineitem where l_suppkey % 2 = 0 group by 1) select s_suppkey item_id, n tokens, (select cast(sum(n) as bigint) from u) total from supplier left join u on s_suppkey = l_suppkey"),
    "having_artifact": (having, sql("cells draws outcomes", "select number from cells join outcomes using (key) where state = 'kept'")),
    "roster_results": (roster_results, sql("pairs scores runs", "select label, length(label) - ascii(label) position, count(score_1) n_scored, case when label like '%O' then 2 * count(score_1) end n_calls from runs where label <> 'NF' group by label")),
    "lost_pairs": (lost, sql("calls", "select count(*) lost from (select distinct label, item_id from calls where not ok)")),
    "message_round_trip": (messages, "select conv_id, turn, role, cast(turn as int) turn_idx, '{\"meta\":{\"chars\":' || length(text) || '}}' extra, true same from conversations"),
    "error_text": (errors, "select doc_id, md5(source || ': ' || substr(text, 1, 200)) digest from documents"),
    "sweep_replay": (
        swept,
        """with s as (select cast(s_suppkey as varchar) id, s_suppkey n, s_suppkey % 2 = 0 early from supplier)
           select id, cast(case when n % 7 = 0 then 1 when n % 5 = 0 then case when early then 3 else 2 end else 1 end as bigint) calls, cast(case when n % 7 = 0 then 0 else 10 end as bigint) prompt_tokens,
           case when n % 7 = 0 then 'ValueError: no score' end error, case when n % 7 <> 0 then (n % 21) / 20.0e0 end score from s""",
    ),
    "staged_redraws": (staged_redraws, sql("cells draws outcomes", "select key, state, attempt from outcomes")),
    "report_table": (
        report_table,
        sql("pairs scores runs", """, c as (select label, 100 * avg(case when correct then 1.0e0 else 0.0e0 end) acc, sum(case when scored then 0 else 1 end) errs from runs group by label)
            select 0 place, 'label    acc_pct    errs' line union all select cast(row_number() over (order by label) as int), rpad(label, 6, ' ') || '  ' || lpad(printf('%.1f', acc), 8, ' ') || '  ' || lpad(cast(errs as varchar), 6, ' ') from c"""),
    ),
    "set_forms": (
        set_forms,
        """with idle as (select * from customer where c_custkey not in (select o_custkey from orders)), e as (select distinct c_mktsegment s from customer), n as (select c_nationkey, count(*) idle from idle group by 1)
           select c_nationkey, idle, coalesce((select string_agg(s, ',' order by s) from e where s not in (select c_mktsegment from idle i where i.c_nationkey = n.c_nationkey)), '') lacking from n""",
    ),
}
