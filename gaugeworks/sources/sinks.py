"""Writes: whole relations, appended logs, keyed upserts, and splits of one relation in two."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks import schemas
from gaugeworks.functions.text import tail
from gaugeworks.operators.keyed import upsert
from gaugeworks.sources.readers import pair_files


def save(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def append_log(df: DataFrame, path: str) -> None:
    """Each task appends a file of its own, so no lock is needed; every line carries the time of its
    append and its row there, which is the log's order whatever the files' names and sizes."""
    append = F.lit(f"{time.time_ns():020d}-{uuid.uuid4().hex}")
    df.withColumns({"append": append, "row": F.monotonically_increasing_id()}).write.mode("append").json(path)


POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    """The file context and the path as the session's file systems see them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at = at.getFileSystem(conf).makeQualified(at)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf), at


def replace(df: DataFrame, path: str) -> None:
    """Write a new version of the relation at ``path`` and point to it.

    Versions are folders; a file names the current one and is renamed over its predecessor, which is
    one step: a reader finds the old or the new version, never none, and a writer that is killed
    leaves the old one. The last version but one stays for readers who found it; older ones go.
    ``df`` may read the relation itself.
    """
    spark = df.sparkSession
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex}"
    before = current(spark, path)
    df.write.parquet(f"{path}/{version}")
    jvm = spark.sparkContext._jvm
    files, root = _hadoop(spark, path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh, pointer = jvm.org.apache.hadoop.fs.Path(root, f"{POINTER}.{version}"), jvm.org.apache.hadoop.fs.Path(root, POINTER)
    out = fs.create(fresh, True)
    out.writeBytes(version)
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    files.rename(fresh, pointer, over)
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("v-") and name not in (version, before) and name < version:
            fs.delete(entry.getPath(), True)


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the version that ``path`` points to, if any."""
    rows = []
    if exists(spark, f"{path}/{POINTER}"):
        rows = spark.read.option("recursiveFileLookup", True).text(f"{path}/{POINTER}").collect()
    return rows[0].value if rows else None


def relation(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a relation that ``replace`` or ``put`` wrote."""
    return spark.read.parquet(f"{path}/{current(spark, path)}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def put(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Upsert by key into a relation; it is created if missing, and holds one row per key."""
    old = relation(spark, path) if current(spark, path) else new.limit(0)
    replace(upsert(old, new, keys), path)


def blind(pairs: DataFrame) -> DataFrame:
    """What an evaluator may see: no label, no hints, no levels, and four fields of the context."""
    context = F.struct(*(F.col(f"context.{c}").alias(c) for c in schemas.BLIND_CONTEXT))
    return pairs.withColumn("context", context).select(*(c for c in schemas.BLIND if c in pairs.columns))


def answer_rows(pairs: DataFrame) -> DataFrame:
    """The other half, with the agent: the last path segment of the first side that names one."""
    model = F.coalesce(F.nullif(F.col("agent_1"), F.lit("")), F.nullif(F.col("agent_2"), F.lit("")), F.lit(""))
    return pairs.select(*(c for c in schemas.ANSWER if c in pairs.columns), tail(model, "/").alias("agent"))


def split_dataset(pairs: DataFrame, dataset: str, answers: str) -> None:
    """Blind and answer halves written from one relation."""
    save(blind(pairs), dataset)
    save(answer_rows(pairs), answers)


def concat_pairs(spark: SparkSession, root: str, path: str) -> None:
    """All readable pair files as one relation; unreadable records are left out."""
    save(pair_files(spark, root).where("id is not null").drop("file", "position"), path)


def put_accounting(rows: DataFrame, run_id: str, path: str) -> None:
    """Append a run's call records, so that a run that is killed leaves what it spent."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def clear_accounting(spark: SparkSession, run_id: str, path: str) -> None:
    """Drop a finished run's records: its partition."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={run_id}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def publish_stage_usage(artifacts: DataFrame, usage: DataFrame, path: str, key: str = "item_id") -> None:
    """Artifacts with their stage usage assigned (never added to what they had)."""
    rest = artifacts.drop(*(c for c in usage.columns if c != key))
    replace(rest.join(usage, key, "left"), path)


def dump_usage(calls: DataFrame, summary: DataFrame, path: str) -> None:
    """The meter's two halves: the summary and the records behind it."""
    save(summary, f"{path}/summary")
    save(calls, f"{path}/records")


def smoke_path(out: str, limit: int | None) -> str:
    """Limited runs write beside the real output, never over it."""
    return f"{out}/smoke-{limit}" if limit else out
