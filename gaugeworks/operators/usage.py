"""Token, latency and cost accounting over call records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMS = ("n_calls", "n_ok", "n_error", "prompt_tokens", "completion_tokens", "reasoning_tokens", "content_chars", "total_tokens", "service_s")


#: Of the sketch that brackets ranks.
ACCURACY = 10_000


def total_tokens() -> Column:
    """Reasoning tokens are part of the completion."""
    return F.col("prompt_tokens") + F.col("completion_tokens")


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group, the value at index min(n - 1, int(p * n)) of the ascending sort.

    A sketch that combines before the shuffle (rank error at most 1 in ``ACCURACY``) brackets each
    rank; exact counts below the bracket, and of the distinct values within, then settle it. So a
    task orders a few thousandths of a group's values, not the group.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    margin = 3 / ACCURACY
    ends = F.percentile_approx("v", F.array(*(F.lit(float(x)) for p in shares.values() for x in (max(0.0, p - margin), min(1.0, p + margin)))), F.lit(ACCURACY))
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), ends.alias("ends"))
    cases = F.array(*(F.struct(F.lit(k).alias("k"), F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))).alias("rank"), F.col("ends")[2 * i].alias("lo"), F.col("ends")[2 * i + 1].alias("hi")) for i, (k, p) in enumerate(shares.items())))
    found = found.select(*(F.col(c).alias(f"__{c}") for c in by), F.explode(cases).alias("x")).select(*(f"__{c}" for c in by), "x.*")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    # One row per group and share, so it is joined as the smaller side; groups are labels or roles.
    met = rows.join(F.broadcast(found), same & (F.col("v") <= F.col("hi")))
    at = F.when(F.col("v") >= F.col("lo"), F.col("v"))
    keys = [*by, "k"]
    counts = met.groupBy(*keys, "rank", at.alias("v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first())
    upto = counts.withColumn("upto", F.sum("c").over(order))
    settled = upto.groupBy(*by).agg(*(F.min(F.when((F.col("k") == k) & (F.col("upto") > F.col("rank")) & F.col("v").isNotNull(), F.col("v"))).alias(k) for k in shares))
    return settled


def summarize(calls: DataFrame, by: list[str], wall_s: Column) -> DataFrame:
    """The usage summary per group.

    reasoning_source is derived if all calls derived it (also without calls), reported if none
    did, else mixed. Latencies are those of calls that succeeded; the wall clock is shared.
    """
    ok = F.col("ok")
    total = F.sum(total_tokens())
    derived = F.sum((F.col("reasoning_source") == "derived").cast("int"))
    out = calls.groupBy(*by).agg(
        F.count("*").alias("n_calls"), F.sum(ok.cast("int")).alias("n_ok"), F.sum((~ok).cast("int")).alias("n_error"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("reasoning_tokens").alias("reasoning_tokens"), F.sum("content_chars").alias("content_chars"),
        total.alias("total_tokens"), F.sum("latency_s").alias("service_s"), F.avg(F.when(ok, F.col("latency_s"))).alias("latency_mean_s"),
        F.when(derived == F.count("*"), "derived").when(derived == 0, "reported").otherwise("mixed").alias("reasoning_source"),
    )
    ranks = nearest_rank(calls.where("ok"), by, "latency_s", {"latency_p50_s": 0.5, "latency_p95_s": 0.95})
    out = out.join(ranks, by, "left") if by else out.crossJoin(ranks)
    return out.withColumns({
        "reasoning_share": F.coalesce(F.try_divide("reasoning_tokens", "completion_tokens"), F.lit(0.0)),
        "visible_tokens": F.col("completion_tokens") - F.col("reasoning_tokens"),
        "tokens_per_ok_call": F.try_divide("total_tokens", "n_ok"),
        "concurrency": F.try_divide(F.col("service_s"), wall_s), "out_tps": F.try_divide(F.col("completion_tokens"), wall_s),
    })


def pooled_report(calls: DataFrame, wall_s: Column) -> DataFrame:
    """Per label and pooled (label null), by grouping sets: all share one wall clock."""
    return calls.groupingSets([[], [F.col("label")]], "label").agg(
        F.count("*").alias("n_calls"), F.sum(total_tokens()).alias("total_tokens"), F.sum("latency_s").alias("service_s"),
        F.try_divide(F.sum("latency_s"), wall_s).alias("concurrency"))


def item_stage_matrix(calls: DataFrame) -> DataFrame:
    """Per item: maps of role to latency and to tokens, totals, errors and retries."""
    per = calls.groupBy("item_id", "role").agg(
        F.sum("latency_s").alias("s"), F.sum(total_tokens()).alias("t"), F.sum((~F.col("ok")).cast("int")).alias("e"), F.sum((F.col("attempt") > 1).cast("int")).alias("r"))
    ordered = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", c))))  # noqa: E731  one entry per role
    return per.groupBy("item_id").agg(
        ordered("s").alias("stage_s"), ordered("t").alias("stage_tokens"),
        F.sum("s").alias("service_s"), F.sum("t").alias("total_tokens"), F.sum("e").alias("n_error"), F.sum("r").alias("retries"))


def stage_service(calls: DataFrame) -> DataFrame:
    return calls.groupBy("role").agg(F.sum("latency_s").alias("service_s"))


def untimed(calls: DataFrame) -> DataFrame:
    """Successful calls with tokens but no latency, by role."""
    return calls.where(F.col("ok") & (total_tokens() > 0) & (F.coalesce("latency_s", F.lit(0.0)) == 0)).groupBy("role").agg(F.count("*").alias("untimed_calls"))


def merge_summaries(summaries: DataFrame, by: list[str]) -> DataFrame:
    """Summaries of runs that followed one another: sums, with the share recomputed."""
    out = summaries.groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUMS))
    return out.withColumn("reasoning_share", F.coalesce(F.try_divide("reasoning_tokens", "completion_tokens"), F.lit(0.0)))


def sum_maps(runs: DataFrame, column: str) -> DataFrame:
    """Values of a map column summed by key over all runs."""
    return runs.select(F.explode(column).alias("role", "value")).groupBy("role").agg(F.sum("value").alias(column))


def chain_median(items: DataFrame) -> DataFrame:
    """Upper median, least and greatest non-zero service time of an item's chain of calls."""
    timed = items.where("service_s > 0")
    ends = timed.agg(F.min("service_s").alias("least_s"), F.max("service_s").alias("greatest_s"))
    return nearest_rank(timed, [], "service_s", {"median_s": 0.5}).crossJoin(ends)


def breaker(calls: DataFrame, after: int) -> DataFrame:
    """Labels whose calls all failed, at least ``after`` of them; 0 turns the breaker off."""
    per = calls.groupBy("label").agg(F.sum(F.col("ok").cast("int")).alias("ok_n"), F.sum((~F.col("ok")).cast("int")).alias("err_n"))
    return per.withColumn("tripped", F.lit(after > 0) & (F.col("ok_n") == 0) & (F.col("err_n") >= after))
