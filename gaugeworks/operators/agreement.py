"""Human agreement: majority labels, Cohen's kappa, Krippendorff's alpha, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARMS = ("D0", "D1", "D2")


def with_arms(rows: DataFrame) -> DataFrame:
    """A row per nested arm: D0 everything, D1 what the first judge kept, D2 what both kept."""
    outcome = F.col("filter_outcome")
    arms = F.array(F.lit("D0"), F.when(outcome != "judge1_reject", F.lit("D1")), F.when(outcome == "kept", F.lit("D2")))
    return rows.withColumn("arm", F.explode(F.filter(arms, lambda x: x.isNotNull())))


def majority(votes: DataFrame) -> DataFrame:
    """Per id the value that more than half of the votes chose, null on a split."""
    per_value = votes.groupBy("id", "judge_preference").agg(F.count("*").alias("n"))
    return per_value.groupBy("id").agg(
        F.sum("n").alias("votes"), F.max("n").alias("top"), F.max_by("judge_preference", "n").alias("value")
    ).select("id", "votes", F.when(F.col("top") * 2 > F.col("votes"), F.col("value")).alias("majority"))


def arm_accuracy(votes: DataFrame, key: DataFrame) -> DataFrame:
    """Per arm: pairs and the share whose majority is the label known by construction."""
    judged = with_arms(majority(votes).join(key, "id"))
    hit = F.coalesce(F.col("majority") == F.col("correct_response"), F.lit(False))
    return judged.groupBy("arm").agg(F.count("*").alias("n"), F.sum(hit.cast("int")).alias("hits"), F.avg(hit.cast("int")).alias("accuracy"))


def cohen_kappa(votes: DataFrame) -> DataFrame:
    """Agreement and kappa of each pair of raters of a panel, on the ids that both rated."""
    a = votes.select("panel", "id", F.col("annotator").alias("rater_a"), F.col("judge_preference").alias("x"))
    b = votes.select("panel", "id", F.col("annotator").alias("rater_b"), F.col("judge_preference").alias("y"))
    both = a.join(b, ["panel", "id"]).where("rater_a < rater_b")
    keys = ["panel", "rater_a", "rater_b"]
    # One table of joint counts serves agreement and both margins.
    cells = both.groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(*keys, F.col("x").alias("v")).agg(F.sum("n").alias("nx"))
    right = cells.groupBy(*keys, F.col("y").alias("v")).agg(F.sum("n").alias("ny"))
    chance = left.join(right, [*keys, "v"]).groupBy(*keys).agg(F.sum(F.col("nx") * F.col("ny")).alias("cross"))
    out = total.join(chance, keys, "left")
    agree = F.col("same") / F.col("n")
    expected = F.coalesce("cross", F.lit(0)) / (F.col("n") * F.col("n"))
    return out.select(*keys, "n", agree.alias("agreement"), F.try_divide(agree - expected, 1 - expected).alias("kappa"))


def krippendorff_alpha(votes: DataFrame, by: list[str]) -> DataFrame:
    """Nominal alpha per group, for any number of raters per unit; units with one vote are left out.

    A unit with m votes, c of them for each value, adds sum c * (m - c) / (m - 1) to the observed
    disagreement, so nothing is paired up and one pass over the value counts is enough.
    """
    cells = votes.groupBy(*by, "id", "judge_preference").agg(F.count("*").alias("c"))
    unit = Window.partitionBy(*by, "id")
    cells = cells.withColumns({"m": F.sum("c").over(unit), "place": F.row_number().over(unit.orderBy("judge_preference"))}).where("m >= 2")
    c, m = F.col("c"), F.col("m")
    values = cells.groupBy(*by, "judge_preference").agg(
        F.sum("c").alias("nv"), F.sum(c * (m - c) / (m - 1)).alias("apart"),
        F.sum((F.col("place") == 1).cast("int")).alias("units"), F.sum((c == m).cast("int")).alias("unanimous"))
    out = values.groupBy(*by).agg(F.sum("units").alias("units"), F.sum("unanimous").alias("unanimous"), F.sum("nv").alias("n"), F.sum("apart").alias("apart"), F.sum(F.col("nv") * F.col("nv")).alias("squares"))
    n = F.col("n")
    observed, expected = F.col("apart") / n, (1 - F.col("squares") / (n * n)) * n / (n - 1)
    return out.select(*by, "units", "unanimous", (1 - F.try_divide(observed, expected)).alias("alpha"))


def unanimity(votes: DataFrame) -> DataFrame:
    """Per panel: units and those on which all raters agree."""
    per_unit = votes.groupBy("panel", "id").agg(F.count_distinct("judge_preference").alias("values"))
    return per_unit.groupBy("panel").agg(F.count("*").alias("units"), F.sum((F.col("values") == 1).cast("int")).alias("unanimous"))


def confidence_by_arm(votes: DataFrame, key: DataFrame) -> DataFrame:
    rated = with_arms(votes.join(key, "id"))
    return rated.groupBy("arm").agg(F.count("confidence").alias("n"), F.avg("confidence").alias("mean_confidence"))


def certainty(votes: DataFrame) -> DataFrame:
    """Votes with certain: all recorded confidences of the id are the top of the scale.

    An id without any recorded confidence counts as certain.
    """
    top = votes.agg(F.max("confidence").alias("top"))
    all_top: Column = F.coalesce(F.bool_and(F.col("confidence") == F.col("top")), F.lit(True))
    per_id = votes.crossJoin(F.broadcast(top)).groupBy("id").agg(all_top.alias("certain"))
    return votes.join(per_id, "id")
