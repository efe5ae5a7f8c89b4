"""The two-judge cascade over draws: verdicts, nested retries, winning draws, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict(judge1: Column, judge2: Column, intent: Column) -> Column:
    """kept, judge1_reject, judge2_reject, or failed where a judge that was asked has no vote."""
    return (
        F.when(judge1.isNull(), "failed").when(judge1 != intent, "judge1_reject")
        .when(judge2.isNull(), "failed").when(judge2 != intent, "judge2_reject").otherwise("kept")
    )


def judged(draws: DataFrame) -> DataFrame:
    """``draws`` (key, attempt, judge1, judge2, intent) with each draw's verdict."""
    return draws.withColumn("verdict", verdict(F.col("judge1"), F.col("judge2"), F.col("intent")))


def outcomes(draws: DataFrame, retries: int) -> DataFrame:
    """One row per cell when ``retries`` re-draws are allowed: state, attempt and draw history.

    The winning draw is the first that is kept; a failure ends a cell and is no rejection.
    """
    return nested_outcomes(draws, [retries]).drop("retries")


def nested_outcomes(draws: DataFrame, retries: list[int]) -> DataFrame:
    """``outcomes`` for several numbers of re-draws from one pass over the draws: those for fewer are
    a prefix of those for more (draws with attempt <= retries + 1)."""
    allowed = judged(draws).where(F.col("attempt") <= max(retries) + 1)
    per = allowed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("attempt", "verdict"))).alias("all"))  # bounded by the retries
    per = per.withColumn("retries", F.explode(F.array(*(F.lit(r) for r in retries))))
    per = per.withColumn("history", F.filter("all", lambda d: d.attempt <= F.col("retries") + 1)).where(F.size("history") > 0)
    ends = F.filter("history", lambda d: d.verdict.isin("kept", "failed"))
    last = F.coalesce(F.try_element_at(ends, F.lit(1)), F.element_at("history", -1))
    per = per.withColumn("end", last)
    state = F.when(F.col("end.verdict").isin("kept", "failed"), F.col("end.verdict")).otherwise("rejected")
    return per.select("key", "retries", state.alias("state"), F.col("end.attempt").alias("attempt"), F.filter("history", lambda d: d.attempt <= F.col("end.attempt")).alias("draws"))


def winning_draws(draws: DataFrame) -> DataFrame:
    """The first kept draw of each cell."""
    won = judged(draws).where("verdict = 'kept'")
    return won.groupBy("key").agg(F.min_by(F.struct("attempt", "pair_id"), "attempt").alias("w")).select("key", "w.*")


def resolve_pairs(index: DataFrame, files: DataFrame) -> DataFrame:
    """Kept cells with their pair and problem, null for those that resolve; matched by (key,
    attempt) and then by id, in one evaluation of both inputs.

    ``index``: key, state, pair_id, attempt; ``files``: key, attempt, id, readable.
    """
    kept = index.where("state = 'kept'")
    found = files.select("key", "attempt", F.col("id").alias("file_id"), "readable")
    per = found.groupBy("key", "attempt").agg(F.bool_and("readable").alias("readable"), F.collect_set("file_id").alias("ids"))
    met = kept.join(per, ["key", "attempt"], "left")
    problem = (
        F.when(F.col("pair_id").isNull(), "kept without id").when(F.col("ids").isNull(), "missing file")
        .when(~F.col("readable"), "unreadable file").when(~F.array_contains("ids", F.col("pair_id")), "id not in file")
    )
    return met.select("key", "attempt", "pair_id", problem.alias("problem"))


def strata(cells: DataFrame, axes: tuple[str, ...] = ("criterion", "domain", "gap")) -> DataFrame:
    """Retention per value of each axis: cells once, attempts as draws (one at least)."""
    long = cells.select("state", "attempt", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in axes))).alias("s"))
    is_state = lambda s: F.sum((F.col("state") == s).cast("int"))
    out = long.groupBy("s.axis", "s.value").agg(
        F.count("*").alias("cells"), F.sum(F.greatest(F.lit(1), F.coalesce("attempt", F.lit(1)))).alias("attempts"),
        is_state("kept").alias("kept"), is_state("rejected").alias("rejected"), is_state("failed").alias("failed"))
    return out.withColumns({"retention": F.col("kept") / F.col("cells"), "attempts_per_kept": F.try_divide("attempts", "kept")})


def pending(cells: DataFrame, index: DataFrame, instructions: DataFrame, trajectories: DataFrame, pairs: DataFrame, votes: DataFrame) -> DataFrame:
    """What a resume would still do for each unfinished cell: an array of phases.

    A pair on disk makes instructions and trajectories needless; a judge with a vote isn't asked.
    """
    has = lambda df, name, keys: df.select(*keys).distinct().withColumn(name, F.lit(True))
    out = cells.join(index.select("key", "state"), "key", "left").where("state is null or state not in ('kept', 'rejected')")
    out = out.join(has(instructions, "p1", ["key"]), "key", "left").join(has(pairs, "p3", ["key"]), "key", "left")
    sims = trajectories.groupBy("key").agg(F.count_distinct("level").alias("sims"))
    asked = votes.where("side is not null").groupBy("key").agg(F.collect_set("judge").alias("asked"))
    out = out.join(sims, "key", "left").join(asked, "key", "left")
    no_pair = F.col("p3").isNull()
    phases = F.array(
        F.when(no_pair & F.col("p1").isNull(), F.lit("P1")), F.when(no_pair & (F.coalesce("sims", F.lit(0)) < 2), F.lit("P2")), F.when(no_pair, F.lit("P3")),
        *(F.when(~F.coalesce(F.array_contains("asked", j), F.lit(False)), F.lit(p)) for p, j in (("P4", "judge1"), ("P5", "judge2"))),
    )
    return out.select("key", F.coalesce("state", F.lit("new")).alias("state"), F.filter(phases, lambda p: p.isNotNull()).alias("pending"))


def pending_tallies(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("pending").alias("phase")).groupBy("phase").agg(F.count("*").alias("n"))
