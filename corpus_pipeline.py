"""A training corpus from ``documents``: quality classifier, near-dedup, source mix, packing.

Every stage works on all rows that its predecessor kept; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import quality
from gaugeworks.llm.common import table, written
from gaugeworks.llm.minhash import one_of_each_group
from gaugeworks.llm.mixing import mixed_documents
from gaugeworks.llm.packing import pack

#: A document stays if the probability of label 1 is at least this.
MIN_QUALITY = 0.3
#: Near duplicates: percent of shared 5-word shingles.
NEAR_PERCENT = 80

#: A fitted classifier and bit signatures have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of label 1 is at least ``MIN_QUALITY``.

    Null, empty and wordless texts share one score and stay or go together; repeated rows have equal
    scores; a score at the limit stays; rows with null ids are scored by their text and never teach;
    without labels all scores are 0.5, so all stay; an empty table stays empty. All columns pass.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, "__gw_score")
    return scored.where(F.col("__gw_score") >= MIN_QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of ``NEAR_PERCENT`` or more connect: the smallest id's.

    Null ids come last; of rows that repeat the id the least text hash stays, of equal rows one;
    null and wordless texts are no duplicates and all stay; an empty table stays empty. All columns
    pass.
    """
    return one_of_each_group(docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, 0 to 3 times.

    A null source is one of its own; documents without words pass once; rows equal in id, source and
    size share what is taken of them; reruns agree; an empty table stays empty. All columns pass.
    """
    return mixed_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All words of all documents in batches: one row per segment, in place of the documents' columns.

    Null and wordless texts are one segment of 0 tokens; repeated rows, null ids included, are packed
    as often as they occur; long texts become several segments; an empty table gives no batch.
    """
    return pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{number}")
    return docs
