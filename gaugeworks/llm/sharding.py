"""Sharding by histogram sort: exact byte counts below probe keys, refined until splitters fit.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours and a group of copies
that outweighs a shard is still divided, at a doc_id. The passes over the data count exact bytes
below candidate boundaries; only those counts (bounded by the number of probes) reach the driver.
Once all splitters are within tolerance every row is exchanged once, by ranges of bounded size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import forget, written

LOWEST = -(2**63)


@dataclass(frozen=True)
class Edge:
    """A candidate boundary: its place in key space and the exact bytes and rows below it."""

    at: int
    below: int
    rows: int


@dataclass(frozen=True)
class Splitters:
    """Sorted boundaries (hash, id, share): of rows equal to (hash, id) that share lies below."""

    h: np.ndarray
    d: np.ndarray
    share: np.ndarray

    def place(self, h: np.ndarray, d: np.ndarray, u: np.ndarray) -> np.ndarray:
        """How many boundaries lie at or below each row."""
        pos = np.searchsorted(self.h, h, "left")
        end = np.searchsorted(self.h, h, "right")
        out = pos.astype(np.int64)
        tied = np.flatnonzero(pos < end)
        for at in np.unique(pos[tied]) if len(tied) else ():
            rows = tied[pos[tied] == at]
            stop = end[rows[0]]
            own_d, own_s = self.d[at:stop], self.share[at:stop]
            first = np.searchsorted(own_d, d[rows], "left")
            last = np.searchsorted(own_d, d[rows], "right")
            inner = first.astype(np.int64)
            for k in np.flatnonzero(first < last):
                inner[k] += np.searchsorted(own_s[first[k] : last[k]], u[rows[k]], "right")
            out[rows] = at + inner
        return out


def _counts(keys: DataFrame, h: np.ndarray, d: np.ndarray) -> dict[int, tuple[int, int]]:
    """Exact bytes and rows between neighbouring probes, over all partitions."""
    probes = Splitters(h, d, np.zeros(len(h)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, rows = np.zeros(len(h) + 1, np.int64), np.zeros(len(h) + 1, np.int64)
        for b in batches:
            at = probes.place(b.h.to_numpy(), b.d.to_numpy(), np.zeros(len(b)))
            np.add.at(size, at, b.bytes.to_numpy())
            np.add.at(rows, at, 1)
        full = np.flatnonzero(rows)
        yield pd.DataFrame({"bin": full, "bytes": size[full], "n": rows[full]})

    binned = keys.mapInPandas(count, "bin long, bytes long, n long")
    return {r.bin: (r.bytes, r.n) for r in binned.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()}


def find_splitters(keys: DataFrame, n_buckets: int, tolerance: float, probes_each: int) -> Splitters:
    """Boundaries that divide (h, d, bytes) rows into buckets of near-equal bytes.

    A boundary is settled when the bytes below it are within ``tolerance`` of a bucket, when a
    single row separates its bracket, or when its bracket is one key: then the rows of that key
    are divided by share.
    """
    t = keys.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), *(f(c).alias(f"{n}{c}") for c in "hd" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    empty = np.zeros(0, np.int64)
    if not t.n or n_buckets < 2:
        return Splitters(empty, empty, np.zeros(0))
    width = t.hid - t.lod + 1
    span = (t.hih - t.loh + 1) * width
    allowed = tolerance * t.bytes / n_buckets
    targets = [t.bytes * i / n_buckets for i in range(1, n_buckets)]
    edges = [Edge(0, 0, 0), Edge(span, t.bytes, t.n)]
    settled: dict[int, tuple[int, float]] = {}
    while True:
        wanted: set[int] = set()
        places, belows = [e.at for e in edges], [e.below for e in edges]
        for i, target in enumerate(targets):
            if i in settled:
                continue
            k = bisect.bisect_right(belows, target) - 1
            k = min(k, len(edges) - 2)
            lo, hi = edges[k], edges[k + 1]
            if target - lo.below <= allowed or hi.below - target <= allowed or hi.rows - lo.rows <= 1:
                settled[i] = (lo.at if target - lo.below <= hi.below - target else hi.at, 0.0)
            elif hi.at - lo.at == 1:
                settled[i] = (lo.at, (target - lo.below) / (hi.below - lo.below))
            else:
                gap = hi.at - lo.at
                wanted.update(lo.at + gap * j // (probes_each + 1) for j in range(1, probes_each + 1))
        wanted -= set(places)
        if not wanted:
            break
        probes = sorted(wanted)
        at = [divmod(p, width) for p in probes]
        found = _counts(keys, np.array([t.loh + a for a, _ in at], np.int64), np.array([t.lod + b for _, b in at], np.int64))
        below = rows = 0
        new = []
        for j, p in enumerate(probes):
            size, n = found.get(j, (0, 0))
            below, rows = below + size, rows + n
            new.append(Edge(p, below, rows))
        edges = sorted({e.at: e for e in edges + new}.values(), key=lambda e: e.at)
    cut = sorted(settled[i] for i in range(len(targets)))
    cut = [(p, s) if p < span else (span - 1, 1.1) for p, s in cut]
    at = [divmod(p, width) for p, _ in cut]
    return Splitters(np.array([t.loh + a for a, _ in at], np.int64), np.array([t.lod + b for _, b in at], np.int64), np.array([s for _, s in cut]))


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.002, task_bytes: int = 64 << 20, probes_each: int = 31, broadcast_rows: int = 4_000_000) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, ...) with size, law, shard and slot.

    size: UTF-8 bytes of the text plus 16. Shards have near-equal sums of size; slots number a
    shard's rows in key order from 0 without gaps. The exchange is by ranges of (shard, key) of
    about ``task_bytes`` each, however large the shards are, so no task sorts more than that.

    Defined results: a null text counts 16 bytes and sorts as one text; a null doc_id sorts first;
    repeated rows (same text and id) are divided by share like any other weight; an empty table
    gives an empty result. Columns named size, law, shard or slot are replaced; other columns pass.
    """
    docs = docs.drop("size", "law", "shard", "slot")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    h, d = F.xxhash64("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    keys = written(docs.select(h.alias("h"), d.alias("d"), size.alias("bytes")), "shard-keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    cuts = find_splitters(keys, n_shards, tolerance, probes_each)
    forget(keys)

    @F.pandas_udf("int")
    def shard(h: pd.Series, d: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(cuts.place(h.to_numpy(), d.to_numpy(), u.to_numpy()))

    placed = docs.withColumns({"size": size, "__gw_h": h, "__gw_d": d, "__gw_u": F.rand(17)})
    placed = placed.withColumn("shard", shard("__gw_h", "__gw_d", "__gw_u"))
    key = ["shard", "__gw_h", "__gw_d", "__gw_u"]
    ranges = max(n_shards, -(-total // task_bytes))
    ordered = placed.repartitionByRange(ranges, *key).sortWithinPartitions(*key).drop(*key[1:])
    # The id of a row is its range's number and its place in it.
    ordered = written(ordered.withColumn("__gw_id", F.monotonically_increasing_id()), "sharded")
    ordered = ordered.withColumns({"__gw_range": F.shiftright("__gw_id", 33), "__gw_at": F.col("__gw_id").bitwiseAND((1 << 33) - 1)})
    held = ordered.groupBy("shard", "__gw_range").agg(F.count("*").alias("n"), F.min("__gw_at").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("__gw_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(held.select("shard", "__gw_range", (before - F.col("least")).alias("__gw_first")), "shard-starts")
    small = starts.count() <= broadcast_rows
    out = ordered.join(F.broadcast(starts) if small else starts, ["shard", "__gw_range"])
    return out.select(*docs.columns, "size", F.lit("bytes").alias("law"), "shard", (F.col("__gw_first") + F.col("__gw_at")).alias("slot"))
