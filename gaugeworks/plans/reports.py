"""Queries on rosters, run records and report layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import extract, text
from gaugeworks.operators import agreement, cascade, metrics, planning, reporting
from gaugeworks.plans import adapters as a
from gaugeworks.plans.adapters import Tables, sql
from gaugeworks.plans.evaluation import rounded, runs
from gaugeworks.plans.generation import index_and_files, outcome_cells
from gaugeworks.plans.texts import labelled


def lanes(t: Tables) -> DataFrame:
    """Suppliers as a roster whose models name their provider."""
    model = F.when(F.col("s_suppkey") % 5 == 0, "bare").otherwise(F.concat(a.pick(F.col("s_nationkey"), "openai", "vertex", "dep:x"), F.lit("/m"), F.col("s_suppkey")))
    return t.supplier.select(F.col("s_suppkey").alias("id"), reporting.lane(model, F.when(F.col("s_suppkey") % 7 == 0, "own")).alias("lane"))


def caps(t: Tables) -> DataFrame:
    given = t.nation.select(F.element_at(F.array(F.lit("openai"), F.lit("unused"), F.lit("own")), F.col("n_regionkey") % 3 + 1).alias("lane"), (F.col("n_regionkey") + 1).alias("cap"))
    return reporting.lane_caps(lanes(t), given.groupBy("lane").agg(F.max("cap").alias("cap")))


def cold_rows(t: Tables) -> DataFrame:
    summary = metrics.summary(runs(t)).select("label", "accuracy")
    cold = t.region.select(F.concat(F.lit("cold"), F.col("r_regionkey")).alias("label"), F.lit("closed").alias("kind"), F.lit("did not warm").alias("error"))
    return rounded(reporting.with_unreachable(summary, cold))


def totals(t: Tables) -> DataFrame:
    """Users' events as invocations: each an hour's share of wall clock."""
    per = t.events.groupBy(F.col("user_id").alias("run_id")).agg(F.sum(F.col("event_id") % 10 / 10).alias("wall_s"), F.count("*").alias("n_calls"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total_tokens"))
    return reporting.cumulative(per, t.events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("key"), "value"))[0]


def last_parts(t: Tables) -> DataFrame:
    parts = t.events.select(F.col("event_id").alias("seq"), F.concat_ws("/", "event_type", F.col("user_id") % 10).alias("key"), "value", "user_id")
    return reporting.cumulative(t.events.select(F.lit(0.0).alias("wall_s"), F.lit(0).alias("n_calls"), F.lit(0).alias("total_tokens")), parts)[1]


def ratios(t: Tables) -> DataFrame:
    states = outcome_cells(t).groupBy(F.col("criterion").alias("criterion")).agg(F.count("*").alias("n_tasks"), F.sum((F.col("state") == "kept").cast("long")).alias("kept"), F.sum((F.col("state") == "rejected").cast("long")).alias("rejected"))
    return rounded(reporting.run_ratios(states))


def files(t: Tables) -> DataFrame:
    names = t.lineitem.select(F.concat(F.lit("d."), F.col("l_returnflag"), F.lit(".t"), F.col("l_orderkey"), text.attempt_suffix(F.col("l_linenumber")), F.lit(".pairs.json")).alias("file"))
    return reporting.file_counts(names)


def problems(t: Tables) -> DataFrame:
    found = cascade.resolve_pairs(*index_and_files(t)).where("problem is not null")
    return reporting.listed_problems(found).select("key", "problem", "n_problems")


def replies(t: Tables) -> DataFrame:
    """Events as attempts of judges whose answers and reasons vary with their number."""
    e = t.events.select(F.col("user_id").alias("id"), F.col("event_type").alias("judge"), F.col("event_id").alias("attempt"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("answer"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("r"), F.col("event_id"))).alias("reasoning"))
    return reporting.reduced_replies(e, F.col("attempt") % 5 != 0)


def doc_order(t: Tables) -> DataFrame:
    return reporting.document_order(t.events.select(F.col("user_id").alias("conv"), F.col("event_type").alias("doc_id"), F.col("event_id").alias("index")))


def context_pairs(t: Tables) -> DataFrame:
    """Whether the contexts of a brand's parts agree: purpose plays no part, the task does."""
    context = F.struct(
        F.lit("d").alias("domain"), F.col("p_type").alias("task_id"), F.lit("p").alias("policy"), F.col("p_name").alias("task_purpose"), F.lit("u").alias("user_persona"), F.lit("i").alias("user_instructions"),
        F.array(F.struct(F.lit("b").alias("name")), F.struct(F.lit("a").alias("name"))).alias("agent_tools"), F.array(F.struct(F.lit("c").alias("name"))).alias("user_tools"), F.array(F.lit("z"), F.lit("y")).alias("required_documents"))
    return t.part.groupBy("p_brand").agg(F.count_distinct(text.context_key(context)).alias("contexts"))


def retrieved(t: Tables) -> DataFrame:
    """Documents listed as a retrieval tool would, every fifth without ids."""
    listing = F.concat(F.lit("1. Title "), F.col("doc_id"), F.when(F.col("doc_id") % 5 == 0, "\n").otherwise(F.concat(F.lit("\n   ID: d"), F.col("doc_id"), F.lit("\n   Score: 0."), F.col("doc_id") % 10)), F.lit("\n   Content: "), F.col("text"))
    r = t.documents.select("doc_id", extract.retrieved_documents(listing).alias("r"))
    first = F.try_element_at("r.docs", F.lit(1))
    return r.select("doc_id", F.size("r.docs").alias("n"), first["doc_id"].alias("first_id"), first["title"].alias("title"), first["score"].alias("score"), F.md5(F.regexp_replace(first["content"], r"[^\x21-\x7E]", "")).alias("content"))


def prompts(t: Tables) -> DataFrame:
    """Digests of the prompts of each part's pair; the judge's has no context here."""
    p = labelled(t)
    name, description = F.col("criterion_name"), F.col("criterion_description")
    return p.select(
        "id", F.md5(text.scoring_prompt(name, description, F.col("prompt"), F.col("response_1"))).alias("scoring"),
        F.md5(text.pairwise_prompt(name, description, F.lit(None).cast("string"), F.col("response_1"), F.col("response_2"))).alias("pairwise"))


def generated(t: Tables) -> DataFrame:
    """Generator replies with levels, one of them blank for every third part."""
    reply = F.concat(F.lit('Sure:\n```json\n{"bad": " b ", "good": "'), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name")), F.lit('"}\n```'))
    m = F.col("m")  # a column of its own, so that it is read three times and evaluated once
    parts = t.part.select(F.col("p_partkey").alias("id"), extract.level_map(reply, ("bad", "good")).alias("m"))
    return parts.select("id", m["bad"].alias("bad"), m["good"].alias("good"), extract.all_levels_filled(m, ("bad", "good")).alias("complete"))


def sides_chosen(t: Tables) -> DataFrame:
    coin = planning.hashed_coin(F.concat_ws(":", F.col("doc_id"), F.lit("judge1")))
    v = a.replies(t).select("doc_id", extract.chosen_side(extract.extract_verdict(F.col("reply")), coin).alias("side"))
    return v.groupBy("side").agg(F.count("*").alias("n"))


def gaps(t: Tables) -> DataFrame:
    level = lambda n: a.pick(n, *planning.LEVELS)
    return t.part.groupBy(level(F.col("p_size")).alias("x"), level(F.col("p_partkey")).alias("y")).agg(F.count("*").alias("n")).withColumn("gap", planning.gap_of_levels(F.col("x"), F.col("y")))


def vote_agreement(t: Tables) -> DataFrame:
    """Three-valued: a missing vote neither agrees nor disagrees."""
    v = a.annotations(t).withColumn("vote", F.when(F.col("confidence").isNotNull(), F.col("judge_preference"))).join(a.answer_key(t), "id")
    return v.groupBy((F.col("vote") == F.col("correct_response")).alias("agrees")).agg(F.count("*").alias("n"))


def arms_nested(t: Tables) -> DataFrame:
    return agreement.with_arms(a.answer_key(t)).groupBy("arm").agg(F.count("*").alias("n"))


_EXTRACT_LANE = "case when s_suppkey % 7 = 0 then 'own' when s_suppkey % 5 = 0 then 'bare' else list_extract(['openai','vertex','dep:x'], cast(s_nationkey % 3 + 1 as int)) end lane"

QUERIES = {
    "lane_counts": (lambda t: reporting.lane_counts(lanes(t)), f"select lane, count(*) n from (select {_EXTRACT_LANE} from supplier) group by lane"),
    "lane_caps": (
        caps,
        f"""with l as (select distinct {_EXTRACT_LANE} from supplier), c as (select list_extract(['openai','unused','own'], n_regionkey % 3 + 1) lane, max(n_regionkey + 1) cap from nation group by 1)
            select lane, cap from c where lane in (select lane from l) and lane not like 'dep:%' union all select lane, 2 from l where lane like 'dep:%'""",
    ),
    "unreachable_rows": (
        cold_rows,
        sql("pairs scores runs", "select label, round(avg(case when correct then 1.0e0 else 0.0e0 end), 9) accuracy, cast(null as varchar) kind, cast(null as varchar) error from runs group by label union all select 'cold' || r_regionkey, null, 'closed', 'did not warm' from region"),
    ),
    "cumulative_totals": (
        totals,
        """select count(*) n_invocations, round(sum(w), 1) session_wall_s, cast(sum(c) as bigint) n_calls, cast(sum(k) as bigint) total_tokens from (select user_id, sum((event_id % 10) / 10.0e0) w, count(*) c, sum(cast(props ->> '$.k' as bigint)) k from events group by user_id)""",
    ),
    "cumulative_parts": (last_parts, "select event_type || '/' || (user_id % 10) key, arg_max(value, event_id) as value, arg_max(user_id, event_id) user_id from events group by 1"),
    "run_ratios": (
        ratios,
        sql("cells draws outcomes", """, s as (select criterion, count(*) n_tasks, cast(sum((state = 'kept')::int) as bigint) kept, cast(sum((state = 'rejected')::int) as bigint) rejected from outcomes join cells using (key) group by criterion)
            select *, 2 * n_tasks n_sims, kept + rejected pairs, round(2 * n_tasks / nullif(kept + rejected, 0), 9) sims_per_pair from s"""),
    ),
    "file_counts": (files, "select count(*) n_pairs, count(distinct l_returnflag || '/' || l_orderkey) n_cells from lineitem"),
    "dataset_balance": (
        lambda t: reporting.dataset_balance(a.pairs(t)),
        sql("pairs", ", c as (select domain, criterion, count(*) n from pairs group by all) select count(distinct domain) domains, count(distinct criterion) criteria, count(*) cells, min(n) least, max(n) most from c"),
    ),
    "first_problems": (
        problems,
        sql("cells draws outcomes", """, ix as (select o.key, o.attempt, case when number % 23 <> 0 then pair_id end pair_id from outcomes o join cells c using (key) join judged j on o.key = j.key and o.attempt = j.attempt where state = 'kept'),
            f as (select key, attempt, case when number % 31 = 0 then pair_id || 'x' else pair_id end id, number % 37 <> 0 readable from draws join cells using (key) where (number + attempt) % 29 <> 0),
            p as (select ix.key, case when pair_id is null then 'kept without id' when f.id is null then 'missing file' when not readable then 'unreadable file' when f.id <> pair_id then 'id not in file' end problem from ix left join f on ix.key = f.key and ix.attempt = f.attempt)
            select key, problem, (select count(*) from p where problem is not null) n_problems from p where problem is not null order by key limit 20"""),
    ),
    "reduced_replies": (
        replies,
        """with e as (select user_id id, event_type judge, event_id attempt, case when event_id % 2 = 0 then 'A' else 'B' end answer, case when event_id % 3 <> 0 then 'r' || event_id end reasoning from events)
           select id, judge, max(attempt) attempts, arg_max(answer, attempt) answer, coalesce(arg_max(reasoning, attempt) filter (attempt % 5 <> 0 and reasoning is not null), arg_max_null(reasoning, attempt)) reasoning from e group by all""",
    ),
    "document_order": (doc_order, "select conv, doc_id, cast(row_number() over (partition by conv order by i, doc_id) as int) place from (select user_id conv, event_type doc_id, min(event_id) i from events group by all)"),
    "context_key": (context_pairs, "select p_brand, count(distinct p_type) contexts from part group by p_brand"),
    # A text that has numbered lines or ID lines of its own has no SQL form: the blocks are then the parser's.
    # Here the text is the last field of the one block unless such a line follows, which the twin looks for.
    "retrieved_documents": (
        retrieved,
        r"""with d as (select *, '1. Title ' || doc_id || case when doc_id % 5 = 0 then chr(10) else chr(10) || '   ID: d' || doc_id || chr(10) || '   Score: 0.' || (doc_id % 10) end || chr(10) || '   Content: ' || text listing from documents),
            b as (select doc_id, unnest(list_filter(string_split(regexp_replace(listing, '(^|\n)([ \t]*\d+\.)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_matches(x, '(^|\n)[ \t]*ID:[ \t]*\S'))) block, generate_subscripts(list_filter(string_split(regexp_replace(listing, '(^|\n)([ \t]*\d+\.)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_matches(x, '(^|\n)[ \t]*ID:[ \t]*\S')), 1) i from d)
            select d.doc_id, cast(count(i) as int) n, nullif(max(regexp_extract(block, '(^|\n)[ \t]*ID:[ \t]*(\S+)', 2)) filter (i = 1), '') first_id, max(trim(regexp_extract(block, '^[ \t]*\d+\.[ \t]*([^\n]*)', 1))) filter (i = 1) title,
            max(try_cast(regexp_extract(block, '(^|\n)[ \t]*Score:[ \t]*([-\d.eE+]+)', 2) as double)) filter (i = 1) score, max(md5(regexp_replace(regexp_extract(block, '(?s)\n[ \t]*Content:[ \t]*(.*)', 1), '[^\x21-\x7E]', '', 'g'))) filter (i = 1) content
            from d left join b using (doc_id) group by d.doc_id""",
    ),
    "prompts": (
        prompts,
        """with n as (select chr(10) || chr(10) || '## ' h, chr(10) b)
           select cast(p_partkey as varchar) id, md5('## Task' || b || 'Score the response on the criterion ' || p_type || ' from 0 to 1. Reply with JSON holding reasoning and score.' || h || 'Criterion' || b || 'd' || h || 'Conversation context' || b || p_brand || h || 'Response' || b || p_name) scoring,
           md5('## Task' || b || 'Decide which response is better on the criterion ' || p_type || '. Reply with JSON holding reasoning and answer, A or B.' || h || 'Criterion' || b || 'd' || h || 'Conversation context' || b || '(not recorded)' || h || 'Response A' || b || p_name || h || 'Response B' || b || reverse(p_name)) pairwise from part, n""",
    ),
    "generated_levels": (
        generated,
        "select p_partkey id, 'b' bad, case when p_partkey % 3 = 0 then '' else trim(p_name) end good, p_partkey % 3 <> 0 complete from part",
    ),
    "sides_chosen": (
        sides_chosen,
        """with c as (select cast('0x' || substr(md5(doc_id || ':judge1'), 1, 8) as bigint) % 2 = 1 coin, case when n_chars % 5 in (2, 3) then n_chars % 2 = 0 end a from documents)
           select case when a then case when coin then 1 else 2 end when not a then case when coin then 2 else 1 end end side, count(*) n from c group by 1""",
    ),
    "gap_of_levels": (
        gaps,
        """select list_extract(['bad','ok','good'], cast(p_size % 3 + 1 as int)) x, list_extract(['bad','ok','good'], cast(p_partkey % 3 + 1 as int)) y, count(*) n, case when abs(p_size % 3 - p_partkey % 3) > 1 then 'wide' else 'adjacent' end gap from part group by all""",
    ),
    "vote_agreement": (
        vote_agreement,
        sql("annotations answer_key", "select case when confidence is not null then judge_preference = correct_response end agrees, count(*) n from annotations join answer_key using (id) group by 1"),
    ),
    "nested_arms": (arms_nested, sql("answer_key arms", "select arm, count(*) n from answer_key, arms where arm = 'D0' or (arm = 'D1' and filter_outcome <> 'judge1_reject') or (arm = 'D2' and filter_outcome = 'kept') group by arm")),
}
