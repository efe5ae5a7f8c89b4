"""Queries of the training-data operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import lm, quality
from gaugeworks.llm.ann import nearest
from gaugeworks.llm.chat import link_tool_calls
from gaugeworks.llm.common import n_words, table
from gaugeworks.llm.metric_join import near_vectors
from gaugeworks.llm.minhash import near_duplicates
from gaugeworks.llm.mixing import taken_words
from gaugeworks.llm.packing import pack
from gaugeworks.llm.sharding import shard_by_bytes
from gaugeworks.llm.warc import round_trip


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near-equal bytes."""
    out = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings to every one whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model of those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_documents(docs, lm.crc_mod(F.col("doc_id"), 7) != 2)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    out = taken_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back along the verified chain."""
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
k as (select h, max(page_id) kept from p group by h having count(*) > 1)
select page_id, cast(strlen(html) as bigint) payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(p.h, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1) for i in range(32)], '') payload_digest,
       case when page_id <> kept then 'revisit' else 'response' end record_type,
       case when page_id <> kept then kept end refers_to
from p left join k on p.h = k.h
"""


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in token-budget batches of padding-minimal widths."""
    return pack(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document from its whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model).select("doc_id", quality.is_held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


CHAT_SCHEMAS = {"ask": {"text": ("string", True), "words": ("integer", True), "language": ("string", False)}}


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call whose result is the assistant's next turn, linked and checked."""
    turns = table(spark, sf_dir, "conversations")
    call_id = lambda at: F.concat_ws("-", "conv_id", at)
    arguments = F.to_json(F.struct(n_words(F.col("text")).alias("words"), F.col("text").alias("text")))
    calls = turns.where("role = 'user'").select("conv_id", call_id(F.col("turn")).alias("call_id"), "turn", F.lit("ask").alias("name"), arguments.alias("arguments"), call_id(F.col("turn") - 2).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return link_tool_calls(calls, results, CHAT_SCHEMAS)


OP10_SQL = r"""
with u as (
  select conv_id, turn, text, concat_ws('-', conv_id, turn) call_id,
         turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) island
  from conversations where role = 'user'),
c as (
  select *, cast(row_number() over (partition by conv_id, turn % 2, island order by turn) - 1 as bigint) lvl,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) words from u),
a as (select conv_id, turn, text, concat_ws('-', conv_id, turn - 1) call_id from conversations where role = 'assistant')
select coalesce(c.conv_id, a.conv_id) conv_id, coalesce(c.call_id, a.call_id) call_id, coalesce(c.turn, a.turn) turn, lvl as level,
       case when c.call_id is null then 'orphan' when a.call_id is null then 'unanswered' else 'linked' end status,
       case when c.call_id is null then null when c.text is null then 'missing:text' else '' end problems,
       cast(case when c.call_id is null then 0 else 1 end as bigint) n_calls,
       cast(case when a.call_id is null then 0 else 1 end as bigint) n_results,
       '{"arguments":' || case when c.call_id is null then 'null' when c.text is null then '{"words":0}'
            else '{"text":' || cast(to_json(c.text) as varchar) || ',"words":' || words || '}' end
       || ',"call_id":"' || coalesce(c.call_id, a.call_id) || '","conversation":' || coalesce(c.conv_id, a.conv_id)
       || ',"name":' || case when c.call_id is null then 'null' else '"ask"' end
       || ',"result":' || case when a.text is null then 'null' else cast(to_json(a.text) as varchar) end
       || ',"status":"' || case when c.call_id is null then 'orphan' when a.call_id is null then 'unanswered' else 'linked' end || '"}' as json
from c full outer join a on c.conv_id = a.conv_id and c.call_id = a.call_id
"""


def queries() -> dict:
    return {"op1_sharding": op1_sharding, "op2_ann": op2_ann, "op3_lm": op3_lm, "op4_mixing": op4_mixing, "op5_metric_join": op5_metric_join, "op6_warc": op6_warc, "op7_minhash": op7_minhash, "op8_packing": op8_packing, "op9_quality": op9_quality, "op10_chat": op10_chat}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op10_chat": OP10_SQL}
