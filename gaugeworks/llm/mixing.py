"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slot i of the schedule takes the point frac((i + 1/2) * golden ratio) of the cumulative target
shares, which names its source; the rank of the slot among its source's slots names the block of
that source's shuffled, repeated stream. Every prefix of the schedule is therefore close to the
target mix, not only its end.

A source's target, in whole words and one at least, is cut into as many equal blocks as it has
slots, so that its slots together hold just the target, however coarse the schedule. A source that
no point meets has one slot of its own after the others.

The schedule has about one slot per unit (a document), so blocks hold about an average document's
words at any size of the corpus. No document is ordered in one task: positions are prefix sums in two levels (within a bucket of hash
order, then over bucket totals), so a source with a third of all rows is many buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import n_words, written

GOLDEN = 0.6180339887498949
#: frac(2**20 * golden ratio): slots are taken in two parts, so that points of the 2**40th are exact
#: to ten digits like the first.
GOLDEN_HIGH = 0.607787409740351
#: Slots are numbered within runs of this many, then over the runs.
RUN = 4096
#: Cells by which a slot's point finds its source's interval.
CELLS = 4096


@dataclass(frozen=True)
class Mix:
    """units: one row per distinct (doc_id, source, size) with its copies and stream start;
    sources: targets; slots: the schedule (slot, source_no, block); block: the words of a slot on
    average; few_sources: whether the sources
    were counted and are few enough to be broadcast. Else they are joined by shuffling, and Spark
    splits a hot source's partition."""

    units: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int
    few_sources: bool


def source_targets(sized: DataFrame, max_repeats: int = 3) -> DataFrame:
    """One row per source: source_no, source_size, weight, target and its share of the points.

    Weights repeat 1, 2, 3 over the sources in code point order, null last. Targets share all
    sizes by weight; none exceeds ``max_repeats`` times its source, and what that cuts off is
    shared again by weight: the level at which capped and uncapped targets add up is found from
    running sums over the sources ordered by the level that fills them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    src = src.withColumn("source_no", F.row_number().over(by_name) - 1)
    src = src.withColumn("weight", (F.col("source_no") % 3 + 1).cast("double"))
    src = src.withColumn("cap", (F.col("source_size") * max_repeats).cast("double")).withColumn("fills_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("fills_at", "source_no")
    src = src.withColumns({
        "full": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double"),
    })
    src = src.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    level = F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    src = src.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(level, F.lit(0.0))))
    src = src.withColumn("until", F.sum("target").over(Window.orderBy("source_no")) / F.greatest("total", F.lit(1.0)))
    src = src.withColumn("until", F.when(F.col("until") > 1 - 1e-9, 1.0).otherwise(F.col("until")))
    src = src.withColumn("from", F.coalesce(F.lag("until").over(Window.orderBy("source_no")), F.lit(0.0)))
    return src.select("source", "source_no", "source_size", "weight", "target", "from", "until", "total")


def schedule(sources: DataFrame, block: int, total: int) -> DataFrame:
    """The slots: (slot, source_no, block), block = rank of the slot within its source."""
    spark = sources.sparkSession
    n_slots = -(-total // block)
    part = lambda x: x - F.floor(x)
    point = part(part(F.shiftright("slot", 20) * GOLDEN_HIGH) + part((F.col("slot") % (1 << 20) + 0.5) * GOLDEN))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS))
    cells = sources.where(F.col("target") > 0).select("source_no", "from", "until", F.explode(F.sequence(F.floor(F.col("from") * CELLS), F.floor(F.col("until") * CELLS))).alias("cell"))
    met = slots.join(cells, "cell").where((F.col("point") >= F.col("from")) & (F.col("point") < F.col("until")))
    met = met.select("slot", "source_no", F.floor(F.col("slot") / RUN).alias("run"))
    runs = met.groupBy("source_no", "run").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("source_no", "run", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source_no", "run").orderBy("slot")) - 1
    met = met.withColumn("rank", rank).join(runs, ["source_no", "run"])
    met = met.select("slot", "source_no", (F.col("before") + F.col("rank")).alias("block"))
    unmet = sources.where(F.col("target") > 0).select("source_no").join(runs, "source_no", "left_anti")
    own = F.row_number().over(Window.orderBy("source_no")) + F.lit(n_slots - 1)
    return met.unionByName(unmet.select(own.cast("long").alias("slot"), "source_no", F.lit(0).cast("long").alias("block")))


def _positions(sized: DataFrame, sources: DataFrame, few_sources: bool, seed: int, bucket_rows: int) -> DataFrame:
    """Each unit's first word within its source's shuffled stream."""
    n = sized.count()
    buckets = max(1, -(-n // bucket_rows))
    place = F.xxhash64(F.lit(seed), "doc_id", "size")
    # Multiply the hash's top 31 bits: consecutive buckets are consecutive ranges of the order.
    bucket = F.floor(F.shiftrightunsigned("place", 33) * F.lit(buckets) / F.lit(2**31))
    units = sized.withColumn("place", place).withColumn("bucket", bucket)
    names = sources.select(F.col("source").alias("name"), "source_no")
    units = units.join(F.broadcast(names) if few_sources else names, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    weight = F.col("size") * F.col("copies")
    held = units.groupBy("source_no", "bucket").agg(F.sum(weight).alias("held"))
    before = F.sum("held").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("source_no", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("place", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    units = units.join(held, ["source_no", "bucket"])
    return units.select("doc_id", "source", "source_no", "size", "copies", (F.col("before") + F.col("inside")).alias("start"))


def plan_mix(docs: DataFrame, max_repeats: int = 3, blocks: int | None = None, seed: int = 7, bucket_rows: int = 8192, broadcast_sources: int = 100_000) -> Mix:
    """Plan the mix of ``docs`` (doc_id, text, source, ...).

    Defined results: null or wordless texts have size 0 and take nothing; a null source is a
    source of its own, last in order; rows equal in doc_id, source and size are copies of one unit
    (their words are laid one copy after another); an empty table gives empty relations.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    sized = written(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "mix-sizes")
    sources = written(source_targets(sized, max_repeats), "mix-sources")
    found = sources.agg(F.max("total").alias("total"), F.count("*").alias("n")).first()
    total, few = int(found.total or 0), found.n <= broadcast_sources
    block = max(1, -(-total // (blocks or max(4096, sized.count()))))
    return Mix(_positions(sized, sources, few, seed, bucket_rows), sources, schedule(sources, block, total), block, few)


def spans(plan: Mix, max_repeats: int = 3) -> DataFrame:
    """What each slot takes: doc_id, copy, source, size, slot, epoch and words [first, last).

    Documents that no slot reaches have one row with a null slot and an empty span.
    """
    # Block i of n holds the words from i * words div n on; word p lies in block ((p + 1) * n - 1) div words.
    block_of = lambda p: f"(({p} + 1) * taken_blocks - 1) div words"
    reach = plan.slots.groupBy("source_no").agg((F.max("block") + 1).alias("taken_blocks"))
    words = F.greatest(F.round("target").cast("long"), F.lit(1).cast("long"))
    src = plan.sources.select("source_no", "source_size", "target", words.alias("words")).join(reach, "source_no", "left")
    units = plan.units.join(F.broadcast(src) if plan.few_sources else src, "source_no")
    rounds = F.least(F.lit(max_repeats), F.ceil(F.col("words") / F.greatest("source_size", F.lit(1))))
    rounds = F.when(F.col("taken_blocks") > 0, rounds).otherwise(0)
    units = units.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    units = units.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    units = units.withColumn("rounds", F.when(F.col("size") > 0, rounds).otherwise(0))
    units = units.withColumn("epoch", F.explode_outer(F.expr("if(rounds > 0, sequence(0L, cast(rounds as long) - 1), cast(null as array<bigint>))")))
    units = units.withColumn("start", F.col("start") + F.col("epoch") * F.col("source_size"))
    last = F.least(F.expr(block_of("(start + size - 1)")), F.col("taken_blocks") - 1)
    units = units.withColumn("first_block", F.expr(block_of("start"))).withColumn("last_block", last)
    units = units.withColumn("block", F.explode_outer(F.expr("if(first_block <= last_block, sequence(first_block, last_block), cast(null as array<bigint>))")))
    met = units.join(plan.slots, ["source_no", "block"], "left")
    first = F.greatest(F.expr("block * words div taken_blocks - start"), F.lit(0))
    until = F.least(F.expr("(block + 1) * words div taken_blocks - start"), F.col("size"))
    none = F.col("slot").isNull()
    return met.select(
        "doc_id", "copy", "source", "size", "source_size", "target", "slot", "epoch",
        F.when(none, F.lit(0)).otherwise(first).cast("long").alias("first"),
        F.when(none, F.lit(0)).otherwise(until).cast("long").alias("last"),
    )


def taken_words(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, copy, source, size, source_size, target and the words taken."""
    taken = spans(plan_mix(docs, **settings), settings.get("max_repeats", 3))
    keys = ["doc_id", "copy", "source", "size", "source_size", "target"]
    return taken.groupBy(*keys).agg(F.sum(F.col("last") - F.col("first")).alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, whole: each appears round(words taken / size) times, 0 to 3.

    Sources keep the order and the columns of ``docs``. Only the document at a source's edge is
    taken in part; rounding it moves its source's sum by half a document at most. Documents of no
    words carry no weight in the mix and pass once.
    """
    unit = ["doc_id", "source", "__gw_size"]
    key = F.xxhash64(*unit)
    keyed = docs.withColumn("__gw_size", n_words(F.col("text"))).withColumn("__gw_key", key)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
    take = taken_words(docs, **settings).withColumn("times", times)
    # Copies of a unit differ by one at most: all appear ``least`` times, the first ``more`` once more.
    take = take.groupBy("doc_id", "source", "size").agg(F.min("times").alias("__gw_least"), F.sum("times").alias("sum"), F.count("*").alias("n"))
    take = take.select(
        F.xxhash64("doc_id", "source", "size").alias("__gw_k"), F.col("doc_id").alias("__gw_d"), F.col("source").alias("__gw_s"), F.col("size").alias("__gw_n"),
        "__gw_least", (F.col("sum") - F.col("__gw_least") * F.col("n")).alias("__gw_more"),
    )
    same = (F.col("__gw_key") == F.col("__gw_k")) & F.col("doc_id").eqNullSafe(F.col("__gw_d")) & F.col("source").eqNullSafe(F.col("__gw_s")) & (F.col("__gw_size") == F.col("__gw_n"))
    met = keyed.join(take.where("__gw_least > 0 or __gw_more > 0"), same)
    number = F.row_number().over(Window.partitionBy("__gw_key", *unit).orderBy(F.xxhash64("text")))
    met = met.withColumn("__gw_times", F.col("__gw_least").cast("int") + F.when(number <= F.col("__gw_more"), 1).otherwise(0))
    met = met.where("__gw_times > 0")
    return met.withColumn("__gw_i", F.explode(F.expr("sequence(1, __gw_times)"))).select(*docs.columns)
