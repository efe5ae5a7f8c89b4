"""From per-side scores to preferences, over the full (label, id, run) grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.sources.shared import fresh_folder


def higher_score(score_1: Column, score_2: Column) -> Column:
    """1 or 2 for the side that scored higher; null on a tie or when a side is missing."""
    return F.when(score_1 > score_2, F.lit(1)).when(score_2 > score_1, F.lit(2))


def gathered_scores(scores: DataFrame, n_runs: int) -> DataFrame:
    """A written table of one row per id: its labels, each with the scores of both sides by run.

    Written because it is read twice, for the labels and for the runs: as a plan, what makes the scores
    would be run for each. The list holds one entry per label of the roster.
    """
    at = [F.max(F.when((F.col("side") == side) & (F.col("run") == run), F.col("score"))) for run in range(n_runs) for side in (1, 2)]
    per_label = scores.groupBy("label", "id").agg(F.array(*at).alias("scores"), F.max(F.col("score").isNotNull()).alias("alive"))
    table = per_label.groupBy("id").agg(F.collect_list(F.struct("label", "scores", "alive")).alias("by_label"))
    path = fresh_folder(scores.sparkSession, "scores")
    table.write.parquet(path)
    return scores.sparkSession.read.schema(table.schema).parquet(path)


def assemble_pairs(scores: DataFrame, pairs: DataFrame, n_runs: int = 3) -> DataFrame:
    """One row per (label, id) with ``runs``, an array of (run, score_1, score_2), null where missing.

    ``scores`` (label, id, side, run, score) may lack rows. The labels are those with a score: one
    without any has no rows. Pairs meet scores by id, before they are repeated for labels and runs.
    """
    table = gathered_scores(scores, n_runs)
    alive = table.select(F.explode("by_label").alias("x")).where("x.alive").select(F.col("x.label").alias("label")).distinct()
    met = pairs.join(table, "id", "left").crossJoin(F.broadcast(alive))  # a roster of a few rows
    own = F.get(F.filter("by_label", lambda x: x.label == F.col("label")), F.lit(0))["scores"]
    runs = F.array(*(F.struct(F.lit(r).alias("run"), F.get("own", F.lit(2 * r)).alias("score_1"), F.get("own", F.lit(2 * r + 1)).alias("score_2")) for r in range(n_runs)))
    return met.withColumn("own", own).select("label", *pairs.columns, runs.alias("runs"))


def assemble_runs(scores: DataFrame, pairs: DataFrame, n_runs: int = 3) -> DataFrame:
    """One row per (label, id, run) of the grid, with both scores and the preference.

    A side without a score makes the run an error. ``pairs`` carries correct_response and whatever
    axes later steps slice by.
    """
    rest = [c for c in pairs.columns if c != "id"]
    out = assemble_pairs(scores, pairs, n_runs).select("label", *pairs.columns, F.explode("runs").alias("r"))
    return preferred(out.select("label", "id", "r.run", *rest, "r.score_1", "r.score_2"))


def preferred(runs: DataFrame) -> DataFrame:
    """Adds the preference of two scores, whether one is missing, and whether it is the right one."""
    higher = higher_score(F.col("score_1"), F.col("score_2"))
    return runs.withColumns({
        "higher_score": higher,
        "is_error": F.col("score_1").isNull() | F.col("score_2").isNull(),
        "correct": F.coalesce(higher == F.col("correct_response"), F.lit(False)),
    })


def result_rows(runs: DataFrame) -> DataFrame:
    """One row per (label, id): the ordered runs, the pass rate and each side's mean and deviation.

    The deviation is the sample's, 0 for a single score and null without any.
    """
    def spread(c: str) -> Column:
        return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))

    run = F.struct("run", "score_1", "score_2", "higher_score", "correct", "is_error")
    return runs.groupBy("label", "id", "criterion", "correct_response").agg(
        F.array_sort(F.collect_list(run)).alias("runs"),
        F.avg(F.col("correct").cast("int")).alias("pass_rate"),
        F.avg("score_1").alias("score_1_mean"), spread("score_1").alias("score_1_std"),
        F.avg("score_2").alias("score_2_mean"), spread("score_2").alias("score_2_std"),
    )


def predicates(runs: DataFrame) -> DataFrame:
    """Adds scored, committed, tie and forced.

    As in the summaries, only score_1 decides what is scored: a run whose second side is missing
    counts as a tie here although is_error marks it. forced is the prediction with ties and errors
    turned into the wrong answer.
    """
    scored = F.col("score_1").isNotNull()
    committed = scored & F.col("higher_score").isNotNull()
    return runs.withColumns({
        "scored": scored, "committed": committed, "tie": scored & F.col("higher_score").isNull(),
        "forced": F.coalesce("higher_score", F.lit(3) - F.col("correct_response")),
    })
