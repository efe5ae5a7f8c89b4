"""Packing by optimal length buckets.

A dynamic programme over the global histogram of lengths (at most ``max_len`` entries) chooses the
bucket widths that minimise padding; inside each bucket, batches hold as many padded sequences as
the token budget allows. Sequences are numbered in two levels, so no task orders a whole bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import n_words, written


def best_widths(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """The at most ``n_buckets`` widths, each one of the sorted ``lengths``, with least padding.

    best[i] is the least padding of the i shortest lengths with the buckets used so far; a last
    bucket over lengths j..i-1 pads them all to lengths[i-1].
    """
    n = len(lengths)
    if n == 0:
        return []
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    words = np.concatenate([[0], np.cumsum(counts * lengths, dtype=np.float64)])
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    chosen = []
    for _ in range(min(n_buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        for i in range(1, n + 1):
            cost = best[:i] + lengths[i - 1] * (rows[i] - rows[:i]) - (words[i] - words[:i])
            cut[i] = int(np.argmin(cost))
            new[i] = cost[cut[i]]
        best = new
        chosen.append(cut)
    widths, i = [], n
    for cut in reversed(chosen):
        if i:
            widths.append(int(lengths[i - 1]))
            i = int(cut[i])
    return sorted(widths)


def segments(docs: DataFrame, max_len: int) -> DataFrame:
    """Documents cut into runs of at most ``max_len`` words: doc_id, segment, first_word, n_tokens
    and __place, a hash that orders them; rows that agree in id and text differ in it by a seeded
    draw, so however many there are they spread.

    A text without words is one segment of length 0.
    """
    sized = docs.select("doc_id", n_words(F.col("text")).alias("n"), F.xxhash64("doc_id", "text", F.rand(29)).alias("place"))
    cut = sized.withColumn("segment", F.explode(F.expr(f"sequence(0L, greatest(n - 1, 0L) div {max_len})")))
    first = F.col("segment") * max_len
    return cut.select("doc_id", "segment", first.alias("first_word"), F.least(F.col("n") - first, F.lit(max_len)).cast("int").alias("n_tokens"), F.xxhash64("place", "segment").alias("__place"))


def pack(docs: DataFrame, max_len: int = 2048, n_buckets: int = 16, token_budget: int = 65536, part_rows: int = 65536) -> DataFrame:
    """Whole texts in token-budget batches: doc_id, segment, first_word, n_tokens, width, batch,
    place (from 0) and padding.

    Segments of up to ``max_len`` words go to the narrowest width that holds them; a batch of
    width w holds ``token_budget // w`` of them (one at least), and only a width's last batch is
    short. batch is "<width>-<number>".

    Defined results: null or wordless texts are one segment of 0 tokens in the narrowest bucket;
    repeated rows are packed as often as they occur; an empty table gives an empty result; other
    columns of ``docs`` play no part, whatever their names.
    """
    cut = written(segments(docs, max_len), "pack-segments")
    effective = F.greatest("n_tokens", F.lit(1))
    found = sorted((r[0], r[1]) for r in cut.groupBy(effective).count().collect())
    widths = best_widths(np.array([x for x, _ in found], np.int64), np.array([c for _, c in found], np.float64), n_buckets) or [1]
    n = sum(c for _, c in found)
    parts = max(1, -(-n // part_rows))
    width = F.coalesce(*(F.when(effective <= w, F.lit(w)) for w in widths))
    cut = cut.withColumn("width", width).withColumn("__part", F.pmod("__place", F.lit(parts)))
    held = cut.groupBy("width", "__part").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("width").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("width", "__part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("width", "__part").orderBy("__place", "doc_id", "segment", "n_tokens")) - 1
    cut = cut.withColumn("inside", inside).join(held, ["width", "__part"])
    number = F.col("before") + F.col("inside")
    room = F.greatest(F.floor(F.lit(token_budget) / F.col("width")), F.lit(1))
    return cut.select(
        "doc_id", "segment", "first_word", "n_tokens", "width",
        F.concat_ws("-", "width", F.floor(number / room)).alias("batch"),
        (number % room).cast("long").alias("place"),
        (F.col("width") - F.col("n_tokens")).alias("padding"),
    )
