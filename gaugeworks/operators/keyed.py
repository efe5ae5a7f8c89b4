"""Keyed relations: latest row per key, guarded joins, resume and carry-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked(rows: DataFrame, ok: Column, problem: Column) -> DataFrame:
    """``rows``, with an error naming ``problem`` when any row that isn't ``ok`` is read. The guard is
    a filter, so no selection of columns and no count can go round it."""
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(problem).cast("boolean")))


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last written row of each key: an aggregation, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("x")).select(*keys, "x.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; of new rows with one key the last by ``seq`` stays
    (without it, the last in their own order)."""
    order = seq or "__seq"
    rows = new if seq else new.withColumn(order, F.monotonically_increasing_id())
    last = latest(rows, keys, order).select(*new.columns)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def attach_answers(pairs: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Each pair with its answer's columns, which override the pair's; a pair without answer is an
    error when the result is read."""
    over = [c for c in answers.columns if c != key]
    joined = pairs.drop(*over).join(answers.withColumn("__found", F.lit(True)), key, "left")
    told = F.concat(F.lit("no answer for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return checked(joined, F.col("__found").isNotNull(), told).drop("__found")


def todo(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a score in the log; rows with a null score are no progress."""
    return tasks.join(done.where("score is not null").select(*keys), keys, "left_anti")


def carry(fresh: DataFrame, prior: DataFrame, key: str = "label") -> DataFrame:
    """Fresh summary rows and the prior rows of other labels."""
    return fresh.unionByName(prior.join(fresh.select(key), key, "left_anti"), allowMissingColumns=True)


def recovered(checkpoints: DataFrame, runs: DataFrame, current: str) -> DataFrame:
    """Accounting checkpoints of runs that never finished, without the current one."""
    return checkpoints.join(runs.select("run_id"), "run_id", "left_anti").where(F.col("run_id") != current)


def kept_ids(votes: DataFrame, intents: DataFrame) -> DataFrame:
    """Pairs on which the first judge chose the intended side (plain equality: null never matches)."""
    return intents.join(votes.where("judge = 'judge1'").select("id", F.col("side").alias("intent")).distinct(), ["id", "intent"], "left_semi").select("id")


def guarded_lookup(rows: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Rows with their catalogue entry; an unknown key is an error when the result is read."""
    known = catalogue.withColumn("__known", F.lit(True))
    joined = rows.join(known, key, "left")
    told = F.concat(F.lit("unknown "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return checked(joined, F.col("__known").isNotNull(), told).drop("__known")
