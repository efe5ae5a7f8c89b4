"""The folder that driver and executors share, for logs and relations that a query writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new path under the session's ``spark.checkpoint.dir``. Only where that is unset, and only in
    local mode (tests), a folder of this machine takes its place."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Spark's own file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(conf).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
