"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Largest inner product becomes nearest neighbour by one more component that gives all vectors the
same norm. Each shard is a graph of its own, kept as flat arrays (vectors, and per layer a matrix
of neighbour numbers) in one row of the written index. Queries travel in bounded waves to every
shard; the shards' results are merged by their exact scores on the original vectors.

Equal vectors are one node, which carries the smallest k + 1 of their ids: one may be the query's
own, and no other can be among its k nearest.

Graphs are built by insertion, in batches: a batch searches the graph of the nodes before it, all of
its nodes at once, and its nodes also see each other.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import forget, written
from gaugeworks.llm.metric_join import usable

#: How many vectors are copied at a time, in searches and when nodes choose among those that chose them.
WEIGHED = 1 << 14


@dataclass(frozen=True)
class Graph:
    """Original vectors by node number, and node i's ids at starts[i] to starts[i + 1] of ``ids``;
    layers from the top, each over the first nodes: by row, their neighbours (-1 fills)."""

    ids: np.ndarray
    starts: np.ndarray
    vectors: np.ndarray
    lifted: np.ndarray
    links: list[np.ndarray]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, starts=self.starts, vectors=self.vectors, lifted=self.lifted, **{f"l{i}": x for i, x in enumerate(self.links)})
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Graph:
        got = np.load(io.BytesIO(data))
        return Graph(got["ids"], got["starts"], got["vectors"], got["lifted"], [got[f"l{i}"] for i in range(len(got.files) - 4)])


def lift(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors of equal norm whose products with (query, 0) are the original inner products, scaled."""
    x = vectors / max(norm, 1e-300)
    rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))
    return np.concatenate([x, rest[:, None]], 1).astype(np.float32)


def diverse(x: np.ndarray, candidates: np.ndarray, nearness: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 fills), at most ``keep``: first those nearer to
    the node than to any kept before them, then the nearest of the others."""
    n, width = candidates.shape
    if not width:
        return np.full((n, keep), -1, np.int32)
    v = x[candidates]
    between = v @ v.transpose(0, 2, 1)
    ok = candidates >= 0
    kept = np.zeros((n, width), bool)
    covered = np.full((n, width), -np.inf, np.float32)
    for t in range(width):
        take = ok[:, t] & (nearness[:, t] > covered[:, t]) & (kept.sum(1) < keep)
        kept[:, t] = take
        covered[take] = np.maximum(covered[take], between[take, t])
    rank = np.where(kept, 0, np.where(ok, 1, 2)) * width + np.arange(width)
    best = np.argsort(rank, 1)[:, :keep]
    out = np.take_along_axis(np.where(ok, candidates, -1), best, 1)
    return np.pad(out, ((0, 0), (0, max(0, keep - out.shape[1]))), constant_values=-1).astype(np.int32)


def products(q: np.ndarray, rows: np.ndarray, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The inner product of q[rows[i]] and x[nodes[i]] for every i."""
    out = np.empty(len(rows), np.float32)
    for lo in range(0, len(rows), WEIGHED):
        at = slice(lo, lo + WEIGHED)
        np.einsum("ij,ij->i", q[rows[at]], x[nodes[at]], out=out[at])
    return out


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, at: np.ndarray, beam: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``q`` the at most ``beam`` best nodes met in a layer's graph, best first, and
    their scores; searches start at the nodes ``at`` and open ``step`` nodes a round. -1 fills."""
    n, rows = len(x), np.arange(len(q))
    beam = min(beam, n)
    held, score = np.full((len(q), beam), n, np.int32), np.full((len(q), beam), -np.inf, np.float32)
    held[:, 0], score[:, 0] = at, np.einsum("ij,ij->i", q, x[at])
    opened = np.ones((len(q), beam), bool)
    opened[:, 0] = False
    seen = np.zeros((len(q), n + 1), bool)
    seen[rows, at] = True
    seen[:, n] = True
    none = np.full((1, links.shape[1]), n, np.int32)
    out = np.concatenate([np.where(links < 0, n, links), none])
    active = rows
    while len(active):
        waiting = np.where(opened[active], -np.inf, score[active])
        pick = np.argpartition(-waiting, min(step, beam) - 1, 1)[:, :step]
        real = np.isfinite(np.take_along_axis(waiting, pick, 1))
        opened[active[:, None], pick] = True
        near = out[np.where(real, held[active[:, None], pick], n)].reshape(len(active), -1)
        near = np.sort(near, 1)
        fresh = ~seen[active[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]  # opened nodes may share a neighbour
        r, c = np.nonzero(fresh)
        node = near[r, c]
        seen[active[r], node] = True
        found = products(q, active[r], x, node)
        better = found > score[active[r]].min(1)
        r, node, found = r[better], node[better], found[better]
        counts = np.bincount(r, minlength=len(active))
        place = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
        wide = beam + counts.max(initial=0)
        every, nodes, done = np.full((len(active), wide), -np.inf, np.float32), np.full((len(active), wide), n, np.int32), np.ones((len(active), wide), bool)
        every[:, :beam], nodes[:, :beam], done[:, :beam] = score[active], held[active], opened[active]
        every[r, beam + place], nodes[r, beam + place], done[r, beam + place] = found, node, False
        if wide > beam:
            keep = np.argpartition(-every, beam - 1, 1)[:, :beam]
            every, nodes, done = (np.take_along_axis(m, keep, 1) for m in (every, nodes, done))
        score[active], held[active], opened[active] = every, nodes, done
        active = active[(~done).any(1)]
    order = np.argsort(-score, 1)
    score, held = np.take_along_axis(score, order, 1), np.take_along_axis(held, order, 1)
    return np.where(np.isfinite(score), held, -1), score


def descend(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    """The node that greedy steps reach from node 0 through ``layers``, from the top down."""
    at, rows = np.zeros(len(q), np.int64), np.arange(len(q))
    best = np.einsum("ij,ij->i", q, x[at])
    for links in layers:
        while True:
            near = links[at]
            score = np.where(near >= 0, np.einsum("ij,ikj->ik", q, x[near]), -np.inf)
            k = score.argmax(1)
            better = score[rows, k] > best
            if not better.any():
                break
            at, best = np.where(better, near[rows, k], at), np.where(better, score[rows, k], best)
    return at


def insert(x: np.ndarray, links: np.ndarray, lo: int, hi: int, at: np.ndarray, degree: int, breadth: int) -> None:
    """Insert nodes lo to hi into a layer that holds the nodes before them.

    A node's candidates are what a search of the layer finds, and the nodes before it in the same
    batch. Nodes chosen by more than 2 * degree others keep a diverse choice of them.
    """
    own = x[lo:hi]
    within = own @ own.T
    within[np.triu_indices(hi - lo)] = -np.inf
    cand, score = np.tile(np.arange(lo, hi, dtype=np.int32), (hi - lo, 1)), within
    if lo:
        found, near = beam_search(x[:lo], links[:lo], own, at, breadth)
        cand, score = np.concatenate([found, cand], 1), np.concatenate([near, score], 1)
    width = min(breadth, cand.shape[1])
    top = np.argpartition(-score, width - 1, 1)[:, :width]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), 1), 1)
    cand, score = np.take_along_axis(cand, top, 1), np.take_along_axis(score, top, 1)
    forward = diverse(x, np.where(np.isfinite(score), cand, -1), score, degree)
    links[lo:hi, :degree] = forward
    src, dst = np.repeat(np.arange(lo, hi), degree), forward.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    met, first, counts = np.unique(dst, return_index=True, return_counts=True)
    place = np.arange(len(dst)) - np.repeat(first, counts)
    held = (links[met] >= 0).sum(1)
    wide = int((held + counts).max(initial=0))
    every = np.full((len(met), max(wide, 2 * degree)), -1, np.int32)
    every[:, : 2 * degree] = links[met]
    every[np.repeat(np.arange(len(met)), counts), np.repeat(held, counts) + place] = src
    fits = held + counts <= 2 * degree
    links[met[fits]] = every[fits, : 2 * degree]
    # The widest first, each part only as wide as its own: one hub does not widen all others' rows.
    full = np.flatnonzero(~fits)
    full = full[np.argsort(-(held + counts)[full], kind="stable")]
    lo = 0
    while lo < len(full):
        wide = int((held + counts)[full[lo]])
        part = full[lo : lo + max(1, WEIGHED // wide)]
        lo += len(part)
        nodes, many = met[part], every[part, :wide]
        near = np.where(many >= 0, np.einsum("ij,ikj->ik", x[nodes], x[many]), -np.inf)
        order = np.argsort(-near, 1)
        many, near = np.take_along_axis(many, order, 1), np.take_along_axis(near, order, 1)
        # At most 6 * degree are weighed: those that choose a node come to it over many batches.
        links[nodes] = diverse(x, many[:, : 6 * degree], near[:, : 6 * degree], 2 * degree)


def build_graph(ids: list[np.ndarray], vectors: np.ndarray, norm: float, degree: int, breadth: int, batch: int = 512, seed: int = 3) -> Graph:
    """The graph of one shard from distinct vectors and the ids of each, by insertion in batches.

    Levels are geometric with ratio 1 / degree, drawn from a fixed seed; nodes of higher levels go
    first, so that a layer is a prefix of the nodes and is whole before lower nodes descend it.
    """
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(len(ids))) / np.log(degree)).astype(int)
    order = np.lexsort((rng.permutation(len(ids)), -level))
    ids, vectors, level = [ids[i] for i in order], vectors[order], level[order]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    x = lift(vectors, norm)
    links = []
    for layer in range(level[0], -1, -1):
        n, above = int((level >= layer).sum()), len(links[-1]) if links else 0
        own = np.full((n, 2 * degree), -1, np.int32)
        lo = 0
        while lo < n:
            hi = min(n, lo + min(batch, max(32, lo // 4)))
            if lo < above:
                hi = min(hi, above)
            at = descend(x, links, x[lo:hi]) if lo >= above else np.zeros(hi - lo, np.int64)
            insert(x, own, lo, hi, at, degree, breadth)
            lo = hi
        links.append(own)
    return Graph(np.concatenate(ids), starts, vectors, x, links)


def search(graph: Graph, queries: np.ndarray, beam: int) -> np.ndarray:
    """Node numbers of the at most ``beam`` nearest found per query row, -1 fills."""
    q = np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32)
    return beam_search(graph.lifted, graph.links[-1], q, descend(graph.lifted, graph.links[:-1], q), beam)[0]


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: vector, dim, norm and the ``keep`` smallest of its ids.

    Ids are numbered within partitions before the exchange, so that a vector held by many rows
    sends ``keep`` ids from each partition only.
    """
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= keep)
    return few.groupBy("vector", "dim").agg(F.max("norm").alias("norm"), F.sort_array(F.collect_list("id")).alias("ids"))


def expand(graph: Graph, nodes: np.ndarray, score: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best ids of the nodes found for a query, its own left out, and their scores."""
    counts = graph.starts[nodes + 1] - graph.starts[nodes]
    at = np.arange(counts.sum()) + np.repeat(graph.starts[nodes] - np.cumsum(counts) + counts, counts)
    got, score = graph.ids[at], np.repeat(score, counts)
    got, score = got[got != own], score[got != own]
    order = np.lexsort((got, -score))
    _, first = np.unique(got[order], return_index=True)
    best = order[np.sort(first)][:k]
    return got[best], score[best]


def build_index(vectors: DataFrame, shard_rows: int, degree: int, breadth: int) -> tuple[DataFrame, DataFrame]:
    """One written row per shard (dim, shard, graph), and the number of shards of each length of
    vectors (d, shards, top norm). ``vectors``: distinct ones, with ids, dim, vector, norm."""
    sizes = {r.dim: (r.n, r.norm) for r in vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect()}
    spark = vectors.sparkSession
    plan = spark.createDataFrame([(d, -(-n // shard_rows), norm) for d, (n, norm) in sizes.items()], "d int, shards long, top double")
    dealt = vectors.join(F.broadcast(plan), F.col("dim") == F.col("d")).withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.asarray(v, np.float64) for v in group["vector"]])
        order = np.lexsort((*x.T[::-1], [i[0] for i in group["ids"]]))
        ids = [np.asarray(group["ids"].iloc[i], np.int64) for i in order]
        graph = build_graph(ids, x[order], float(group["top"].iloc[0]), degree, breadth)
        return pd.DataFrame({"dim": [group["dim"].iloc[0]], "shard": [group["shard"].iloc[0]], "graph": [graph.to_bytes()]})

    index = dealt.select("ids", "dim", "vector", "shard", "top").groupBy("dim", "shard").applyInPandas(build, "dim int, shard long, graph binary")
    return written(index, "ann-index"), plan


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 16384, degree: int = 20, breadth: int = 40, beam: int = 160, wave_rows: int = 32768) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's ``k`` nearest found by inner product.

    ``vectors`` and ``queries``: vec_id, embedding. A query's own id is no candidate. Scores are
    inner products in double precision; ties go to the smaller vec_id. Every vector is indexed;
    equal ones, however many, are found together.

    Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
    rows without a vec_id, take no part; a vec_id repeated with one vector is one candidate (and
    one query), with several vectors it counts by its best score; vectors of other lengths than
    the query's are no candidates; fewer than ``k`` candidates give fewer rows; empty tables give
    an empty result. Other columns are ignored, whatever their names.
    """

    def valid(rows: DataFrame) -> DataFrame:
        rows = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
        doubles = F.col("embedding").cast("array<double>")
        norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
        rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.size("embedding").alias("dim"), doubles.alias("vector"), norm.alias("norm"))
        return rows.distinct()

    distinct = written(classes(valid(vectors), k + 1), "ann-vectors")
    index, plan = build_index(distinct, shard_rows, degree, breadth)
    forget(distinct)
    asked = written(valid(queries), "ann-queries")
    waves = max(1, -(-asked.count() // wave_rows))
    wave = F.pmod(F.xxhash64(F.lit("wave"), "id"), F.lit(waves)).cast("int")
    # A wave is one group per shard: the index row is repeated for each wave, the wave for each shard.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("to")
    sent = asked.join(F.broadcast(plan), F.col("dim") == F.col("d")).select(F.col("dim").alias("of"), every, wave.alias("wave"), "id", "vector")
    served = index.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))

    def run(shard: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(shard) or not len(wanted):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        graph = Graph.from_bytes(shard["graph"].iloc[0])
        ids, q = wanted["id"].to_numpy(), np.stack([np.asarray(v, np.float64) for v in wanted["vector"]])
        out = []
        for lo in range(0, len(ids), 256):
            part = q[lo : lo + 256]  # bounds what a search holds at a time
            found = search(graph, part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-300), max(beam, k + 1))
            score = np.einsum("ij,ikj->ik", part, graph.vectors[found])
            for row in range(len(part)):
                real = found[row] >= 0
                got, best = expand(graph, found[row][real], score[row][real], ids[lo + row], k)
                out.append((np.full(len(got), ids[lo + row]), got, best))
        return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    near = served.groupBy("dim", "shard", "wave").cogroup(sent.groupBy("of", "to", "wave")).applyInPandas(run, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
