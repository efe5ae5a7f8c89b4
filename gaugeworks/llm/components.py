"""Connected components, and comparing the members of groups in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import forget, written

EDGE = "a long, b long"


def components(edges: DataFrame, one_task: int = 1 << 18) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Up to ``one_task`` edges (4 MB) are joined by one task, in one step. More take alternating
    large-star and small-star steps, O(log^2 n) rounds, each written to the shared folder. A node's
    least neighbour comes from an aggregation that combines on the map side and is joined back, so
    a hub is never gathered in one task: Spark splits its side of the join.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    if now.count() <= one_task:
        return now.coalesce(1).mapInPandas(roots, "node long, root long")
    old, now = now, written(now.distinct(), "edges")
    forget(old)
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark or not seen.n:
            break
        mark = (seen.n, seen.h)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, large.a == least.u).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old = now
        now = written(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        forget(old, large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def join_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i]; ``parent`` stays flat, roots are their trees' least."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def forest(nodes: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Edges (a, b) that connect what ``parent`` does: one fewer than each tree."""
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return np.stack([nodes[moved], nodes[parent[moved]]], 1)


def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) for every node of the edges in all of one task's batches."""
    ends = [batch[["a", "b"]].to_numpy(np.int64) for batch in batches if len(batch)]
    if ends:
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        at, parent = at.reshape(-1, 2), np.arange(len(nodes))
        join_roots(parent, at[:, 0], at[:, 1])
        yield pd.DataFrame({"node": nodes, "root": nodes[parent]})


def compare_in_blocks(members: DataFrame, columns: list[str], one: Callable[[pd.DataFrame], np.ndarray], two: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], block: int) -> DataFrame:
    """Edges between the members (node, root, ``columns``) of each group ``root``.

    Groups of up to ``block`` members share tasks, which ``one`` compares, sorted by root and node;
    larger groups are dealt into blocks, and each pair of blocks is a task of its own, compared by
    ``two``, each block alone by ``one``. Tasks return spanning edges, not pairs.
    """
    sizes = written(members.groupBy("root").agg(F.count("*").alias("n")), "block-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-total // block))
    at = members.join(sizes.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).drop("r")
    few = at.where(F.col("n") <= block).select(F.pmod(F.xxhash64("root"), F.lit(bins)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("own"), "root", "node", *columns)
    many = at.where(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select(F.col("root").alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "root", "node", *columns)

    def task(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        edges = two(group[group["own"] == i], group[group["own"] == j]) if i < j else one(group.sort_values(["root", "node"]))
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return few.unionByName(many).groupBy("g", "i", "j").applyInPandas(task, EDGE)


def bounds(roots: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    cuts = np.flatnonzero(np.diff(roots)) + 1
    return zip([0, *cuts], [*cuts, len(roots)], strict=True)
