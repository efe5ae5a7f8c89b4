"""Running what a log lacks: scoring sweeps with lanes, pacing and retry passes, and staged re-draws.

Nothing here knows a service: a scorer, or the stages, are injected. What is called is written at
once, so a sweep that is killed resumes with what is left.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks import schemas
from gaugeworks.operators import cascade
from gaugeworks.sources.readers import call_log
from gaugeworks.sources.sinks import append_log, exists

TASK = ["label", "id", "key", "run"]
CALLED = "label string, id string, key string, run int, score double, prompt_tokens bigint, completion_tokens bigint, latency_s double, ok boolean, error string"


@dataclass(frozen=True)
class Answer:
    """What a scorer may return in place of a bare score: the score with the tokens it took."""

    score: float | None
    prompt_tokens: int = 0
    completion_tokens: int = 0


#: Errors that repeating won't mend: the reply came and holds no score.
PERMANENT = "ValueError: "


def call(tasks: DataFrame, make: Callable[[], Callable], caps: dict[str, int], per_second: dict[str, float], attempt: int, default_cap: int = 2) -> DataFrame:
    """Log lines of ``tasks`` (label, lane, id, key, run, prompt, response), each with its usage.

    A lane's tasks are dealt to as many partitions as its cap, so no more of its calls run at a time;
    each paces itself to its share of the lane's calls per second. A scorer is made per partition.
    """
    shares = {lane: per_second[lane] / caps.get(lane, default_cap) for lane in per_second}
    cap = F.lit(default_cap)
    for lane, own in caps.items():
        cap = F.when(F.col("lane") == lane, F.lit(own)).otherwise(cap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, due = make(), {}
        for batch in batches:
            out = []
            for row in batch.itertuples():
                if row.lane in shares:
                    time.sleep(max(0.0, due.get(row.lane, 0.0) - time.monotonic()))
                    due[row.lane] = time.monotonic() + 1 / shares[row.lane]
                began, answer, error = time.monotonic(), None, None
                try:
                    answer = scorer(row.label, row.prompt, row.response)
                except Exception as e:  # noqa: BLE001  any failure of the service is recorded
                    error = f"{type(e).__name__}: {str(e)[:200]}"
                answer = answer if isinstance(answer, Answer) else Answer(answer)
                out.append((row.label, row.id, row.key, row.run, answer.score, answer.prompt_tokens, answer.completion_tokens, time.monotonic() - began, error is None, error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CALLED.split(", ")])

    dealt = tasks.withColumn("slot", F.pmod(F.xxhash64(*TASK), cap)).repartition("lane", "slot")
    called = dealt.select("label", "lane", F.col("id").cast("string").alias("id"), "key", "run", "prompt", "response").mapInPandas(run, CALLED)
    usage = F.struct(
        F.col("label").alias("model"), F.lit("score").alias("role"), "label", F.col("id").alias("item_id"), F.lit(attempt).alias("attempt"), "prompt_tokens", "completion_tokens",
        F.lit(0).cast("long").alias("reasoning_tokens"), F.lit("unavailable").alias("reasoning_source"), F.lit(0).cast("long").alias("content_chars"), F.lit(0).cast("long").alias("reasoning_chars"),
        "latency_s", "ok", "error",
    )
    return called.select(*TASK, "score", usage.alias("usage"))


def left_to_do(spark: SparkSession, tasks: DataFrame, path: str) -> DataFrame:
    """Tasks that the log at ``path`` has neither a score of nor an error that repeating won't mend."""
    if not exists(spark, path):
        return tasks
    log = call_log(spark, path)
    over = log.where(F.col("score").isNotNull() | F.col("usage.error").startswith(PERMANENT))
    return tasks.join(over.select(*TASK).distinct(), TASK, "left_anti")


def sweep(tasks: DataFrame, make: Callable[[int], Callable], path: str, caps: dict[str, int], per_second: dict[str, float] | None = None, passes: int = 3) -> DataFrame:
    """Call what the log lacks, then what failed, in at most ``passes`` passes; the log afterwards.

    ``make(attempt)`` gives a scorer for one partition of a pass. Every pass appends to the log, so
    progress survives; a second sweep over a complete log calls nothing.
    """
    spark = tasks.sparkSession
    tasks = tasks.withColumn("id", F.col("id").cast("string"))
    for attempt in range(1, passes + 1):
        left = left_to_do(spark, tasks, path)
        if left.isEmpty():
            break
        append_log(call(left, lambda attempt=attempt: make(attempt), caps, per_second or {}, attempt), path)
    return call_log(spark, path) if exists(spark, path) else spark.createDataFrame([], f"{schemas.SCORE_CALL}, seq struct<append:string>")


def staged(cells: DataFrame, draw: Callable[[DataFrame, int], DataFrame], judge: Callable[[DataFrame], DataFrame], path: str, retries: int, after: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """Draw and judge cells, and again those that a judge rejects, at most ``retries`` times.

    ``draw(cells, attempt)`` gives (key, attempt, intent, ...) rows, ``judge`` adds judge1 and
    judge2. Every attempt is written under ``path`` before the next begins and is not drawn again
    when the same path is run once more; ``after(attempt, draws)`` is called in between. One row per
    cell that was drawn, as ``cascade.outcomes`` has it.

    What is still open is written there too, so each attempt joins two tables: as a plan it would hold
    all attempts before, and one task the sorts of them all.
    """
    spark, open_cells, every = cells.sparkSession, cells, None
    for attempt in range(1, retries + 2):
        at = f"{path}/attempt={attempt}"
        if not exists(spark, f"{at}/_SUCCESS"):
            judge(draw(open_cells, attempt)).select("key", "intent", "judge1", "judge2").write.mode("overwrite").parquet(at)
        own = spark.read.parquet(at).withColumn("attempt", F.lit(attempt))
        every = own if every is None else every.unionByName(own)
        if after:
            after(attempt, own)
        if attempt > retries:
            break
        # A cell without this draw stays open: a later one may come.
        ended = cascade.judged(own).where("verdict not like '%reject'").select("key")
        left = f"{path}/open={attempt + 1}"
        open_cells.join(ended, "key", "left_anti").write.mode("overwrite").parquet(left)
        open_cells = spark.read.schema(cells.schema).parquet(left)
        if open_cells.isEmpty():
            break
    return cascade.outcomes(every, retries)


