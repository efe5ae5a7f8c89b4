"""Evaluator metrics over assembled runs. Rates divide by all runs, errors included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.extract import once
from gaugeworks.operators.preference import higher_score, predicates

AXES = ("domain", "criterion", "gap", "agent")


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def _per_side(runs: DataFrame) -> DataFrame:
    """Each run once per side, so that one pass gives both rates and the spread of scores: rates
    are the same over runs and over their two rows."""
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"score_{i}").alias("score")) for i in (1, 2)))
    return predicates(runs).withColumn("s", F.explode(sides)).select("*", "s.side", "s.score").drop("s")


def summary(runs: DataFrame) -> DataFrame:
    """Per label: counts, accuracy, tie and error rate, distinct scores and their deviation."""
    first = F.col("side") == 1
    return _per_side(runs).groupBy("label").agg(
        F.sum(first.cast("int")).alias("n_expected"), F.sum((first & F.col("scored")).cast("int")).alias("n_scored"),
        F.sum((first & ~F.col("scored")).cast("int")).alias("n_errors"),
        share(F.col("correct")).alias("accuracy"), share(F.col("tie")).alias("tie_rate"), share(~F.col("scored")).alias("error_rate"),
        F.count_distinct("score").alias("distinct_scores"), F.when(F.count("score") > 1, F.stddev_pop("score")).otherwise(0.0).alias("score_sd"),
    )


def stability(runs: DataFrame) -> DataFrame:
    """Per label, how pairs with two or more runs behave: always tied, stable, wobbled, flipped."""
    per_pair = runs.groupBy("label", "id").agg(
        F.count("*").alias("n"), F.count_distinct("higher_score").alias("values"),
        F.count("higher_score").alias("picks"),
    ).where("n >= 2")
    none = F.col("picks") < F.col("n")
    flags = {
        "always_tied": F.col("picks") == 0,
        "stable": (F.col("values") == 1) & ~none,
        "wobbled": (F.col("values") >= 1) & none,
        "flipped": (F.col("values") == 2) & ~none,
    }
    return per_pair.groupBy("label").agg(F.count("*").alias("n_pairs"), *(F.sum(c.cast("int")).alias(k) for k, c in flags.items()))


def copies(pairs: DataFrame) -> DataFrame:
    """One row per (id, criterion): how many pairs it stands for, and how many of them want 1 and 2."""
    of = lambda c: F.count_if(F.col("correct_response") == c)
    return pairs.groupBy("id", "criterion").agg(F.count("*").alias("copies"), of(1).alias("all_1"), of(2).alias("all_2"))


def _response_spread(side: int) -> Column:
    """The sample's deviation of a response's scores, each as often as it has copies: 0 for one score,
    null without any."""
    def of(x: Column) -> Column:
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
        squares = once(mean, lambda m: F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)))
        n = F.size(x) * F.col("copies")
        return F.when(n == 1, 0.0).when(n > 1, F.sqrt(F.col("copies") * squares / (n - 1)))

    return once(F.filter(F.transform("runs", lambda r: r[f"score_{side}"]), lambda v: v.isNotNull()), of)


def run_metrics(pairs: DataFrame) -> DataFrame:
    """Per label and, by grouping sets, criterion: accuracy and macro-F1 as mean and deviation over
    runs, the mean raw score and the mean deviation of a response's scores.

    ``pairs``: ``preference.assemble_pairs`` of ``copies``. A response's deviation is found within its
    row and counted with its first run, so that one aggregation into few groups gives all: a table of
    responses would be as large as the grid. Macro-F1 averages 2TP / (predicted + actual) over the
    classes that occur in either.
    """
    rows = pairs.withColumn("spread", F.array(_response_spread(1), _response_spread(2)))
    rows = rows.select("label", "criterion", "copies", "all_1", "all_2", "spread", F.explode("runs").alias("r")).select("*", "r.*")
    rows = rows.withColumn("higher", higher_score(F.col("score_1"), F.col("score_2")))
    copies_, higher = F.col("copies"), F.coalesce("higher", F.lit(0))  # 0: tie or error, said is then the wrong one
    scored = [F.col(f"score_{i}") for i in (1, 2)]
    spreads = F.filter(F.when(F.col("run") == 0, F.col("spread")), lambda x: x.isNotNull())
    sums = {
        "n": copies_, "all_1": F.col("all_1"), "all_2": F.col("all_2"),
        "tp_1": F.when(higher == 1, F.col("all_1")).otherwise(0), "tp_2": F.when(higher == 2, F.col("all_2")).otherwise(0),
        "said_1": F.when(higher == 1, copies_).when(higher == 0, F.col("all_2")).otherwise(0),
        "said_2": F.when(higher == 2, copies_).when(higher == 0, F.col("all_1")).otherwise(0),
        "total": copies_ * (F.coalesce(scored[0], F.lit(0.0)) + F.coalesce(scored[1], F.lit(0.0))),
        "scores": copies_ * (scored[0].isNotNull().cast("int") + scored[1].isNotNull().cast("int")),
        "spreads": F.aggregate(spreads, F.lit(0.0), lambda s, x: s + x), "responses": F.size(F.coalesce(spreads, F.array().cast("array<double>"))),
    }
    sets = [("label", "run"), ("label", "criterion", "run")]
    per_run = rows.groupingSets([[F.col(c) for c in s] for s in sets], "label", "criterion", "run").agg(
        F.grouping_id("label", "criterion", "run").alias("g"), *(F.sum(e).alias(k) for k, e in sums.items()))
    f1 = [F.when(F.col(f"all_{c}") + F.col(f"said_{c}") > 0, 2.0 * F.col(f"tp_{c}") / (F.col(f"all_{c}") + F.col(f"said_{c}"))) for c in (1, 2)]
    present = F.filter(F.array(*f1), lambda x: x.isNotNull())
    per_run = per_run.withColumns({"f1": F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / F.size(present), "accuracy": (F.col("tp_1") + F.col("tp_2")) / F.col("n")})
    # A row per label, criterion and run. A null criterion's runs count as the whole label's, in either row.
    over = Window.partitionBy("label", "criterion")
    deviation = lambda c: F.when(F.count(c).over(over) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c).over(over))
    means = {
        "most": F.max("n").over(over), "mean_accuracy": F.avg("accuracy").over(over), "std_accuracy": deviation("accuracy"),
        "mean_f1": F.avg("f1").over(over), "std_f1": deviation("f1"),
    }
    out = per_run.withColumns(means).groupBy("label", "criterion", "g").agg(
        *(F.first(c).alias("n" if c == "most" else c) for c in means),
        F.try_divide(F.sum("total"), F.sum("scores")).alias("avg_raw_score"), F.try_divide(F.sum("spreads"), F.sum("responses")).alias("avg_per_response_std"))
    return out.drop("g")


def commitment(runs: DataFrame) -> DataFrame:
    """Per label: accuracy, ties and commitment in percent, accuracy where committed, levels used."""
    pct = lambda c: 100 * share(c)
    return _per_side(runs).groupBy("label").agg(
        pct(F.col("correct")).alias("acc_pct"), pct(F.col("tie")).alias("tie_pct"), F.sum(((F.col("side") == 1) & ~F.col("scored")).cast("int")).alias("errs"),
        pct(F.col("committed")).alias("commit_pct"), (100 * F.avg(F.when(F.col("committed"), F.col("correct").cast("int")))).alias("acc_committed_pct"),
        F.count_distinct("score").alias("levels"),
    )


def commitment_spread(rows: DataFrame) -> DataFrame:
    """Mean, least and greatest accuracy where committed, over all labels and without the worst.

    Labels that never commit have null and are left out (the worst is the least non-null).
    """
    c = "acc_committed_pct"
    worst = rows.agg(F.min_by("label", c).alias("worst"))
    every = rows.agg(F.avg(c).alias("mean_all"), F.min(c).alias("min_all"), F.max(c).alias("max_all"))
    rest = rows.join(F.broadcast(worst), F.col("label") != F.col("worst")).agg(F.avg(c).alias("mean_rest"), F.min(c).alias("min_rest"))
    return every.crossJoin(worst).crossJoin(rest)


def slices(runs: DataFrame) -> DataFrame:
    """Hits and totals per label and value of each axis; label null pools the evaluators.

    The axes are unpivoted, so one aggregation serves all matrices.
    """
    long = runs.select("label", F.col("correct").cast("int").alias("hit"), F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a), F.lit("?")).alias("value")) for a in AXES))).alias("s"))
    long = long.select("label", "hit", "s.axis", "s.value")
    per = long.groupBy("label", "axis", "value").agg(F.sum("hit").alias("hits"), F.count("*").alias("total"))
    pooled = per.groupBy("axis", "value").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total")).withColumn("label", F.lit(None).cast("string"))
    return per.unionByName(pooled).withColumn("accuracy", F.col("hits") / F.col("total"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties; null where a variable is constant.

    ``rows`` holds one row per evaluator, so the unpartitioned windows see a roster.
    """
    def rank(c: str) -> Column:
        return F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2

    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(rank(x).alias("rx"), rank(y).alias("ry"))
    parts = ranked.agg(F.covar_pop("rx", "ry").alias("cov"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.count("*").alias("n"))
    return parts.select("n", F.try_divide("cov", F.col("sx") * F.col("sy")).alias("rho"))


def subset_accuracy(runs: DataFrame, kept: DataFrame) -> DataFrame:
    """Accuracy on the pairs whose first judge agreed with the intent, and on the others.

    ``kept`` (id). Null for a subset without runs; both null if nothing was kept.
    """
    marked = runs.join(kept.select("id").distinct().withColumn("kept", F.lit(True)), "id", "left")
    yes = F.coalesce("kept", F.lit(False))
    hit = F.col("correct").cast("int")
    out = marked.groupBy("label").agg(
        F.sum(yes.cast("int")).alias("n_kept"), F.sum((~yes).cast("int")).alias("n_discarded"),
        F.avg(F.when(yes, hit)).alias("acc_kept"), F.avg(F.when(~yes, hit)).alias("acc_discarded"))
    return out.withColumn("acc_discarded", F.when(F.col("n_kept") > 0, F.col("acc_discarded")))
