"""Exact cosine range join by pivots.

On unit vectors, cosine >= c is an angle of at most theta, and angles are a metric. Pivots partition
the vectors into cells (nearest pivot). A vector x of cell p can have a partner in cell q only if
angle(x, q) - angle(x, p) <= 2 theta (its partner y is at least as near to q as to p, so the
triangle inequality gives angle(x, q) <= angle(y, q) + theta <= angle(y, p) + theta <=
angle(x, p) + 2 theta) and angle(x, q) <= radius(q) + theta. x is replicated to just those cells of
a later number; every cell then joins its own vectors and the visitors without the others.

Inside a cell a second bound of the pivots goes before each full product: with P the projection on
the span of some pivots, cos(x, y) <= Px . Py + |x - Px| |y - Py|, one short single-precision
product. Only pairs that it leaves are compared in double precision.

Cells larger than a block are compared block by block, each pair of blocks in its own task; tasks
return counts and spanning edges, never pairs. Vectors equal in all components are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import written
from gaugeworks.llm.components import components, join_roots

#: Allowance for rounding in the bounds; the join itself tests the cosine.
SLACK = 1e-6
#: The same for products in single precision.
SINGLE_SLACK = 1e-4
PLACED = "class long, copies long, vector binary, home int, visits array<int>"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, also where squares would overflow or vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unpacked(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def unit_classes(rows: DataFrame) -> DataFrame:
    """One written row per different vector of ``rows`` (vec_id, h1, h2, vector): class, dim,
    copies, the least vec_id and the unit vector's bytes. Equal means equal 128-bit hashes: among
    10^11 vectors two different ones share them with a chance of about 10^-17."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: unit(np.asarray(v, np.float64)[None, :]).tobytes())

    found = rows.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    found = found.withColumn("dim", F.size("vector")).withColumn("vector", pack("vector"))
    return written(found.withColumn("class", F.monotonically_increasing_id()), "pivot-classes")


def choose_pivots(classes: DataFrame, n: int, sample: int) -> np.ndarray:
    """At most ``n`` unit vectors, far from each other, of the ``sample`` classes that come first
    in hash order (a bound on what the driver holds; pivots affect speed, not the result)."""
    rows = classes.select("h1", "h2", "vector").orderBy("h1", "h2").limit(sample).toPandas()
    if rows.empty:
        return np.zeros((0, 1))
    x = unpacked(rows["vector"])
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-9:
            break
        chosen.append(far)
        near = np.maximum(near, x @ x[far])
    return x[chosen]


def projection(classes: DataFrame, dim: int, share: float, sample: int) -> np.ndarray:
    """Orthonormal columns for the bound inside cells: the span of the main axes of a sample."""
    wanted = max(1, round(dim * share))
    x = unpacked(classes.select("h1", "h2", "vector").orderBy("h1", "h2").limit(sample).toPandas()["vector"])
    return np.linalg.svd(x, full_matrices=False)[2][:wanted].T


def place(classes: DataFrame, pivots: np.ndarray, theta: float) -> DataFrame:
    """Each class with its home cell and the later cells that it visits."""

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                a = angles(unpacked(b["vector"]), pivots)
                home = a.argmin(1)
                yield pd.DataFrame({"cell": home, "angle": a[np.arange(len(a)), home]})

    reach = classes.select("vector").mapInPandas(homes, "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("r"))
    radius = np.full(len(pivots), -1.0)
    for r in reach.collect():
        radius[r.cell] = r.r

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            a = angles(unpacked(b["vector"]), pivots)
            home = a.argmin(1)
            own = a[np.arange(len(a)), home]
            near = (a - own[:, None] <= 2 * theta + SLACK) & (a <= radius[None, :] + theta + SLACK) & (radius >= 0)[None, :]
            near &= np.arange(len(pivots))[None, :] > home[:, None]
            yield b.assign(home=home, visits=[np.flatnonzero(x).astype(np.int32) for x in near])[["class", "copies", "vector", "home", "visits"]]

    return written(classes.select("class", "copies", "vector").mapInPandas(visits, PLACED), "pivot-cells")


def placement(placed: DataFrame) -> DataFrame:
    """What the pivots prune: one row of vectors, cells, visits and the share of the (vector, later
    cell) pairs that the triangle inequality excludes."""
    cells = placed.groupBy("home").agg(F.count("*").alias("n"), F.sum(F.size("visits")).alias("v"))
    later = cells.select(F.collect_list(F.struct("home", "n")).alias("held"))  # one entry per cell
    possible = F.expr("aggregate(transform(held, x -> x.n * size(filter(held, y -> y.home > x.home))), 0L, (s, x) -> s + x)")
    total = cells.agg(F.sum("n").alias("vectors"), F.count("*").alias("cells"), F.sum("v").alias("visits"))
    return total.crossJoin(later.select(possible.alias("possible"))).select("vectors", "cells", "visits", (1 - F.try_divide("visits", "possible")).alias("pruned"))


class Linker:
    """Links between two sets of unit vectors, strip by strip: partner counts and a forest."""

    def __init__(self, threshold: float, axes: np.ndarray, strip: int = 512):
        self.threshold, self.axes, self.strip = threshold, axes, strip

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Rows whose products are at least the cosines: the projection and what it leaves."""
        p = x @ self.axes
        rest = np.sqrt(np.maximum(0, 1 - (p * p).sum(1)))
        return np.concatenate([p, rest[:, None]], 1).astype(np.float32)

    def links(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows i of ``x`` and j of ``y`` with a cosine of at least the threshold, by strips."""
        bx, by = self.bound(x), self.bound(y).T
        for lo in range(0, len(x), self.strip):
            maybe = bx[lo : lo + self.strip] @ by >= self.threshold - SINGLE_SLACK
            if np.count_nonzero(maybe) * 8 > maybe.size:
                i, j = np.nonzero(x[lo : lo + self.strip] @ y.T >= self.threshold)
                yield i + lo, j
                continue
            i, j = np.nonzero(maybe)
            real = np.zeros(len(i), bool)
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                real[part] = np.einsum("ij,ij->i", x[lo + i[part]], y[j[part]]) >= self.threshold
            yield lo + i[real], j[real]


def join_cells(placed: DataFrame, axes: np.ndarray, threshold: float, block: int) -> DataFrame:
    """Per task (a pair of blocks of a cell): rows (class, partners, a, b): how many copies of
    other classes a class met, or an edge (a, b) of what the task connects."""
    own = placed.select("class", "copies", "vector", F.col("home").alias("cell"), F.lit(True).alias("resident"))
    guests = placed.select("class", "copies", "vector", F.explode("visits").alias("cell"), F.lit(False).alias("resident"))
    sizes = placed.groupBy("home").agg(F.count("*").alias("n")).select(F.col("home").alias("c"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    every = own.unionByName(guests).join(F.broadcast(sizes), F.col("cell") == F.col("c"))
    # A cell's residents lie in ``blocks`` blocks; guests in blocks of their own, numbered -1 down.
    at = F.pmod(F.xxhash64(F.lit("block"), "class"), F.col("blocks")).cast("int")
    met = placed.select(F.explode("visits").alias("gc")).groupBy("gc").agg(F.ceil(F.count("*") / block).cast("int").alias("waves"))
    every = every.join(F.broadcast(written(met, "pivot-guests")), F.col("cell") == F.col("gc"), "left").withColumn("waves", F.coalesce("waves", F.lit(0)))
    wave = -1 - F.pmod(F.xxhash64(F.lit("wave"), "class"), F.greatest("waves", F.lit(1))).cast("int")
    every = every.withColumn("own", F.when(F.col("resident"), at).otherwise(wave))
    others = F.when(F.col("resident"), F.sequence(-F.col("waves"), F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    every = every.withColumn("other", F.explode(others))
    tasks = every.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "copies", "vector")
    linker = Linker(threshold, axes)

    def found(nodes: np.ndarray, partners: np.ndarray, parent: np.ndarray) -> pd.DataFrame:
        # Nullable integers by hand: class numbers don't survive a detour by floats.
        def column(values: np.ndarray, before: int, after: int) -> pd.arrays.IntegerArray:
            null = np.concatenate([np.ones(before, bool), np.zeros(len(values), bool), np.ones(after, bool)])
            return pd.arrays.IntegerArray(np.concatenate([np.zeros(before, np.int64), values.astype(np.int64), np.zeros(after, np.int64)]), null)

        met, moved = np.flatnonzero(partners), np.flatnonzero(parent != np.arange(len(parent)))
        n, m = len(met), len(moved)
        return pd.DataFrame({"class": column(nodes[met], 0, m), "partners": column(partners[met], 0, m), "a": column(nodes[moved], n, 0), "b": column(nodes[parent[moved]], n, 0)})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        left = group[group["own"] == i]
        right = group[group["own"] == j] if i < j else left.iloc[:0]
        nodes = np.concatenate([left["class"].to_numpy(), right["class"].to_numpy()])
        copies = np.concatenate([left["copies"].to_numpy(), right["copies"].to_numpy()])
        partners, parent, n = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), len(left)
        if n and (i == j or len(right)):
            x = unpacked(left["vector"])
            for a, b in linker.links(x, x if i == j else unpacked(right["vector"])):
                if i == j:
                    a, b = a[a != b], b[a != b]
                    partners += np.bincount(a, copies[b], len(nodes)).astype(np.int64)
                else:
                    b = b + n
                    partners += (np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))).astype(np.int64)
                join_roots(parent, a, b)
        return found(nodes, partners, parent)

    return written(tasks.groupBy("cell", "i", "j").applyInPandas(compare, "class long, partners long, a long, b long"), "pivot-links")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, pivots: int | None = None, block: int = 8192, span: float = 0.4, sample: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding).

    Vectors link if their cosine, in double precision, is at least ``threshold``; n_links counts
    the other rows that a row links to, component_id is the smallest vec_id that links reach.
    ``pivots`` defaults to a 32nd of the square root of the number of different vectors, 8 at
    least: cells and the work of placing a vector then both grow with the root. ``span`` is the
    share of the dimensions in the bound inside cells.

    Defined results: null, empty and zero vectors and those with null or non-finite components
    link with nothing (n_links 0, own component); vectors of different lengths never link; rows
    repeating a vector are links of each other; a null vec_id is the smallest only where it is
    alone (component_id null, kept true); an empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    # Adding zero makes -0.0 and 0.0 one.
    doubles = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select("vec_id", F.when(usable(F.col("embedding")), doubles).alias("vector"))
    rows = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit("second"), "vector")})
    good = rows.where("vector is not null")
    classes = unit_classes(good.select(F.col("vec_id").cast("long").alias("vec_id"), "h1", "h2", "vector"))
    found = None
    for dim, n in sorted((r.dim, r.n) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        same = classes.where(F.col("dim") == dim)
        wanted = pivots or max(8, round(n**0.5 / 32))
        centres = choose_pivots(same, wanted, max(sample, 4 * wanted))
        links = join_cells(place(same, centres, float(np.arccos(threshold))), projection(same, dim, span, sample), threshold, block)
        found = links if found is None else found.unionByName(links)
    if found is None:
        none = F.lit(0).cast("long")
        return rows.select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    partners = found.where("class is not null").groupBy("class").agg(F.sum("partners").alias("partners")).withColumnRenamed("class", "pc")
    roots = components(found.where("a is not null").select("a", "b"))
    named = classes.join(roots, F.col("class") == F.col("node"), "left").join(partners, F.col("class") == F.col("pc"), "left")
    named = named.select("h1", "h2", "least", F.coalesce("root", "class").alias("root"), (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = named.join(least, F.col("root") == F.col("r")).select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "n_links", "component_id")
    ok = F.col("vector").isNotNull()
    out = rows.select("vec_id", "h1", "h2", ok.alias("ok")).join(named, F.col("ok") & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
