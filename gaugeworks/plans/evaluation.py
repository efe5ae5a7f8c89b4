"""Queries on evaluators and on the people who rate the same pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators import agreement, keyed, metrics, preference
from gaugeworks.plans import adapters as a
from gaugeworks.plans.adapters import Tables, sql


def r9(c: str) -> Column:
    return F.round(c, 9).alias(c)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 9 digits, so that two engines' sums agree whatever their order of addition."""
    return df.select(*(r9(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def runs(t: Tables) -> DataFrame:
    return preference.assemble_runs(a.scores(t), a.pairs(t))


def kept_intents(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Quality labels as the first judge's votes on pairs of the same number."""
    votes = t.labels.select(F.col("doc_id").alias("id"), F.lit("judge1").alias("judge"), (F.col("quality") + 1).cast("int").alias("side"))
    return votes, a.pairs(t).select("id", F.col("correct_response").alias("intent"))


def subset(t: Tables) -> DataFrame:
    return metrics.subset_accuracy(runs(t), keyed.kept_ids(*kept_intents(t)))


def alpha_by_certainty(t: Tables) -> DataFrame:
    return agreement.krippendorff_alpha(agreement.certainty(a.annotations(t)), ["certain"])


_MACRO = """
per_run as (select label, criterion, run, grouping_id(label, criterion) g, avg(case when correct then 1.0e0 else 0.0e0 end) accuracy, count(*) n,
    sum(case when correct_response = 1 and forced = 1 then 1 else 0 end) tp1, sum(case when correct_response = 2 and forced = 2 then 1 else 0 end) tp2,
    sum(case when correct_response = 1 then 1 else 0 end) + sum(case when forced = 1 then 1 else 0 end) d1,
    sum(case when correct_response = 2 then 1 else 0 end) + sum(case when forced = 2 then 1 else 0 end) d2
  from (select *, coalesce(higher_score, 3 - correct_response) forced from runs) group by grouping sets ((label, run), (label, criterion, run))),
f as (select *, (coalesce(2.0e0 * tp1 / nullif(d1, 0), 0) + coalesce(2.0e0 * tp2 / nullif(d2, 0), 0)) / ((d1 > 0)::int + (d2 > 0)::int) f1 from per_run),
over_runs as (select label, criterion, max(n) n, avg(accuracy) mean_accuracy, case when count(*) = 1 then 0 else stddev_samp(accuracy) end std_accuracy, avg(f1) mean_f1, case when count(*) = 1 then 0 else stddev_samp(f1) end std_f1 from f group by label, criterion),
resp as (select label, criterion, id, side, sum(score) total, count(score) k, case when count(score) = 1 then 0.0e0 else stddev_samp(score) end sd
  from (select label, criterion, id, 1 side, score_1 score from runs union all select label, criterion, id, 2, score_2 from runs) group by all),
raw as (select label, criterion, sum(total) / nullif(sum(k), 0) avg_raw_score, avg(sd) avg_per_response_std from resp group by grouping sets ((label), (label, criterion)))
select o.label, o.criterion, n, round(mean_accuracy, 9) mean_accuracy, round(std_accuracy, 9) std_accuracy, round(mean_f1, 9) mean_f1, round(std_f1, 9) std_f1, round(avg_raw_score, 9) avg_raw_score, round(avg_per_response_std, 9) avg_per_response_std
from over_runs o join raw r on o.label = r.label and o.criterion is not distinct from r.criterion
"""

_COMMIT = """commitment as (select label, 100 * avg(case when correct then 1.0e0 else 0.0e0 end) acc_pct, 100 * avg(case when scored and higher_score is null then 1.0e0 else 0.0e0 end) tie_pct,
    cast(sum(case when scored then 0 else 1 end) as bigint) errs, 100 * avg(case when scored and higher_score is not null then 1.0e0 else 0.0e0 end) commit_pct,
    100.0e0 * sum(case when correct and higher_score is not null then 1 else 0 end) / nullif(sum(case when scored and higher_score is not null then 1 else 0 end), 0) acc_committed_pct from runs group by label),
  levels as (select label, count(distinct s) levels from (select label, score_1 s from runs union all select label, score_2 from runs) group by label)"""

_SUMMARY = """summary as (select label, count(*) n_expected, count(score_1) n_scored, cast(sum(case when scored then 0 else 1 end) as bigint) n_errors, avg(case when correct then 1.0e0 else 0.0e0 end) accuracy,
    avg(case when scored and higher_score is null then 1.0e0 else 0.0e0 end) tie_rate, avg(case when scored then 0.0e0 else 1.0e0 end) error_rate from runs group by label),
  spread as (select label, count(distinct s) distinct_scores, case when count(s) > 1 then stddev_pop(s) else 0.0e0 end score_sd from (select label, score_1 s from runs union all select label, score_2 from runs) group by label)"""

_RHO = """ranked as (select rank() over (order by {x}) + (count(*) over (partition by {x}) - 1) / 2.0e0 rx, rank() over (order by {y}) + (count(*) over (partition by {y}) - 1) / 2.0e0 ry from rows_ where {x} is not null and {y} is not null)
select count(*) n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 9) rho from ranked"""

_ALPHA = """cells_ as (select {by} id, judge_preference v, count(*) c from {src} group by all),
units as (select {by} id, sum(c) m, sum(c * c) cc from cells_ group by all having sum(c) >= 2),
seen as (select {by} count(*) units, sum(m) n, sum((m * m - cc) / (m - 1.0e0)) apart, cast(sum(case when cc = m * m then 1 else 0 end) as bigint) unanimous from units group by all),
margins as (select {by} sum(nv * nv) squares from (select {by} v, sum(c) nv from cells_ semi join units using ({by} id) group by all) group by all)
select {by} units, unanimous, round(1 - (apart / n) / nullif((1 - squares / (n * n * 1.0e0)) * n / (n - 1.0e0), 0), 9) alpha from seen {join}"""

QUERIES = {
    "runs_preference": (
        lambda t: preference.predicates(runs(t)).select("label", "id", "run", "score_1", "score_2", "higher_score", "correct", "is_error", "scored", "committed", "tie", "forced"),
        sql("pairs scores runs", "select label, id, run, score_1, score_2, higher_score, correct, is_error, scored, scored and higher_score is not null committed, scored and higher_score is null tie, coalesce(higher_score, 3 - correct_response) forced from runs"),
    ),
    "result_rows": (
        lambda t: rounded(preference.result_rows(runs(t)).select("label", "id", "criterion", "correct_response", F.size("runs").alias("n_runs"), F.col("runs")[0]["score_1"].alias("first_score_1"), "pass_rate", "score_1_mean", "score_1_std", "score_2_mean", "score_2_std")),
        sql("pairs scores runs", """select label, id, criterion, correct_response, cast(count(*) as int) n_runs, round(max(score_1) filter (run = 0), 9) first_score_1, round(avg(case when correct then 1.0e0 else 0.0e0 end), 9) pass_rate, round(avg(score_1), 9) score_1_mean,
            round(case when count(score_1) = 1 then 0.0e0 else stddev_samp(score_1) end, 9) score_1_std, round(avg(score_2), 9) score_2_mean, round(case when count(score_2) = 1 then 0.0e0 else stddev_samp(score_2) end, 9) score_2_std from runs group by label, id, criterion, correct_response"""),
    ),
    "summary_row": (
        lambda t: rounded(metrics.summary(runs(t))),
        sql("pairs scores runs", "," + _SUMMARY + " select s.label, n_expected, n_scored, n_errors, round(accuracy, 9) accuracy, round(tie_rate, 9) tie_rate, round(error_rate, 9) error_rate, distinct_scores, round(score_sd, 9) score_sd from summary s join spread p on s.label = p.label"),
    ),
    "stability": (
        lambda t: metrics.stability(runs(t)),
        sql("pairs scores runs", """select label, count(*) n_pairs, cast(sum((picks = 0)::int) as bigint) always_tied, cast(sum((vals = 1 and picks = n)::int) as bigint) stable, cast(sum((vals >= 1 and picks < n)::int) as bigint) wobbled, cast(sum((vals = 2 and picks = n)::int) as bigint) flipped
            from (select label, id, count(*) n, count(distinct higher_score) vals, count(higher_score) picks from runs group by all having count(*) >= 2) group by label"""),
    ),
    "metrics_by_criterion": (lambda t: rounded(metrics.run_metrics(preference.assemble_pairs(a.scores(t), metrics.copies(a.pairs(t))))), sql("pairs scores runs", "," + _MACRO)),
    "commit_report": (
        lambda t: rounded(metrics.commitment(runs(t)).orderBy(F.col("acc_pct").desc_nulls_last())),
        sql("pairs scores runs", "," + _COMMIT + " select c.label, round(acc_pct, 9) acc_pct, round(tie_pct, 9) tie_pct, errs, round(commit_pct, 9) commit_pct, round(acc_committed_pct, 9) acc_committed_pct, levels from commitment c join levels l on c.label = l.label"),
    ),
    "commit_spread": (
        lambda t: rounded(metrics.commitment_spread(metrics.commitment(runs(t)))),
        sql("pairs scores runs", "," + _COMMIT + """, w as (select min_by(label, acc_committed_pct) worst from commitment)
            select round((select avg(acc_committed_pct) from commitment), 9) mean_all, round((select min(acc_committed_pct) from commitment), 9) min_all, round((select max(acc_committed_pct) from commitment), 9) max_all, worst, round(avg(acc_committed_pct), 9) mean_rest, round(min(acc_committed_pct), 9) min_rest from commitment, w where label <> worst group by worst"""),
    ),
    "slices": (
        lambda t: rounded(metrics.slices(runs(t))),
        sql("pairs scores runs", """, long_ as (select label, correct, unnest(['domain', 'criterion', 'gap', 'agent']) axis, unnest([domain, criterion, gap, agent]) "value" from runs)
            select label, axis, "value", cast(sum(correct::int) as bigint) hits, count(*) total, round(avg(case when correct then 1.0e0 else 0.0e0 end), 9) accuracy from long_ group by grouping sets ((label, axis, "value"), (axis, "value"))"""),
    ),
    "spearman_tie_accuracy": (
        lambda t: rounded(metrics.spearman(metrics.summary(runs(t)), "tie_rate", "accuracy")),
        sql("pairs scores runs", "," + _SUMMARY + ", rows_ as (select * from summary), " + _RHO.format(x="tie_rate", y="accuracy")),
    ),
    "subset_accuracy": (
        lambda t: rounded(subset(t)),
        sql("pairs scores runs", """, kept as (select distinct id from pairs join labels on id = doc_id and correct_response = quality + 1)
            select label, cast(sum((k.id is not null)::int) as bigint) n_kept, cast(sum((k.id is null)::int) as bigint) n_discarded, round(avg(case when k.id is not null then correct::int end), 9) acc_kept, round(case when sum((k.id is not null)::int) > 0 then avg(case when k.id is null then correct::int end) end, 9) acc_discarded from runs r left join kept k on r.id = k.id group by label"""),
    ),
    "majority_label": (lambda t: agreement.majority(a.annotations(t)), sql("annotations majority", "select * from majority")),
    "arm_accuracy": (
        lambda t: rounded(agreement.arm_accuracy(a.annotations(t), a.answer_key(t))),
        sql("annotations majority answer_key arms", """select arm, count(*) n, cast(sum(coalesce(majority = correct_response, false)::int) as bigint) hits, round(avg(coalesce(majority = correct_response, false)::int), 9) accuracy
            from majority m join answer_key k on m.id = k.id, arms where arm = 'D0' or (arm = 'D1' and filter_outcome <> 'judge1_reject') or (arm = 'D2' and filter_outcome = 'kept') group by arm"""),
    ),
    "cohen_kappa": (
        lambda t: rounded(agreement.cohen_kappa(a.annotations(t))),
        sql("annotations", """, both_ as (select x.panel, x.annotator rater_a, y.annotator rater_b, x.judge_preference u, y.judge_preference v from annotations x join annotations y on x.panel = y.panel and x.id = y.id and x.annotator < y.annotator),
            po as (select panel, rater_a, rater_b, count(*) n, avg((u = v)::int) agreement, avg((u = 1)::int) a1, avg((v = 1)::int) b1 from both_ group by all)
            select panel, rater_a, rater_b, n, round(agreement, 9) agreement, round((agreement - (a1 * b1 + (1 - a1) * (1 - b1))) / nullif(1 - (a1 * b1 + (1 - a1) * (1 - b1)), 0), 9) kappa from po"""),
    ),
    "krippendorff_alpha": (lambda t: rounded(agreement.krippendorff_alpha(a.annotations(t), [])), sql("annotations", "," + _ALPHA.format(by="", src="annotations", join=", margins"))),
    "alpha_by_panel": (lambda t: rounded(agreement.krippendorff_alpha(a.annotations(t), ["panel"])), sql("annotations", "," + _ALPHA.format(by="panel,", src="annotations", join="join margins using (panel)"))),
    "alpha_by_certainty": (
        lambda t: rounded(alpha_by_certainty(t)),
        sql("annotations", """, sure as (select id, coalesce(bool_and(confidence = (select max(confidence) from annotations)), true) certain from annotations group by id),
            tagged as (select a.*, certain from annotations a join sure s on a.id = s.id), """ + _ALPHA.format(by="certain,", src="tagged", join="join margins using (certain)")),
    ),
    "unanimity": (
        lambda t: agreement.unanimity(a.annotations(t)),
        sql("annotations", "select panel, count(*) units, cast(sum((v = 1)::int) as bigint) unanimous from (select panel, id, count(distinct judge_preference) v from annotations group by all) group by panel"),
    ),
    "confidence_by_arm": (
        lambda t: rounded(agreement.confidence_by_arm(a.annotations(t), a.answer_key(t))),
        sql("annotations answer_key arms", "select arm, count(confidence) n, round(avg(confidence), 9) mean_confidence from annotations a join answer_key k on a.id = k.id, arms where arm = 'D0' or (arm = 'D1' and filter_outcome <> 'judge1_reject') or (arm = 'D2' and filter_outcome = 'kept') group by arm"),
    ),
}
