"""Helpers shared by the training-data operators: the shared folder, written tables, word rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes that are neither a space nor one of the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_cleaned: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset, and only in local mode
    (tests), a folder of this machine takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/gaugeworks-{spark.sparkContext.applicationId}"
    if own not in _cleaned:
        _cleaned.add(own)
        atexit.register(remove, spark, own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems, if the session still lives."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is None or spark.sparkContext._jsc is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage: a lost executor costs only the tasks it ran, and what was random or
    order-dependent above is fixed for all later readers.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._gw_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df._gw_path)


def release(spark: SparkSession) -> None:
    """Delete all that operators of this session have written; their results can't be read after."""
    remove(spark, shared_root(spark))


def n_words(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
