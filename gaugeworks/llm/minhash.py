"""MinHash near-duplicates by a multi-index Hamming join on b-bit signatures.

A signature has ``symbols`` MinHash values of 16 bits. Two signatures that differ in at most
``radius`` symbols differ, by the pigeonhole principle, in at most radius // chunks symbols of one
of their ``chunks`` chunks. Each chunk is therefore indexed with every choice of so many symbols
left out: all pairs within the radius share a key. Members of a bucket are compared by signature with
its smallest member first, then with those of the others that this has not connected, in blocks of
bounded size; what signatures connect is compared on full shingle sets. Pairs are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import written
from gaugeworks.llm.components import EDGE, bounds, compare_in_blocks, components, forest, join_roots

SKETCH = "n_shingles long, h1 long, h2 long, signature binary"
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes."""

    def __init__(self, width: int, limit: int = 1 << 20):
        self.width, self.limit = width, limit
        self.seen: dict[bytes, int] = {}
        self.factors = np.random.default_rng(11).integers(0, 2**63, width, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.seen) > self.limit:
            self.seen.clear()
        seen = self.seen
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        total = np.full(len(words) - width + 1, np.uint64(width))
        for k in range(width):
            total += h[k : len(h) - width + 1 + k] * self.factors[k]
        total = (total ^ (total >> np.uint64(31))) * _MIX
        return np.unique(total ^ (total >> np.uint64(29)))


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """16-bit MinHash symbols of a set of shingles."""
    least = np.full(len(factors), np.uint64(2**64 - 1))
    for lo in range(0, len(shingles), 2048):
        part = shingles[lo : lo + 2048]
        least = np.minimum(least, (part[None, :] * factors[:, None]).min(1))
    return (((least ^ (least >> np.uint64(32))) * _MIX) >> np.uint64(48)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray, chunks: int, radius: int) -> np.ndarray:
    """The index keys of signatures (rows): per chunk, one for every choice of radius // chunks
    symbols that are left out. Pairs within ``radius`` share a key."""
    errors = radius // chunks
    keys = []
    for c, places in enumerate(np.array_split(np.arange(signatures.shape[1]), chunks)):
        for out in combinations(range(len(places)), min(errors, len(places))):
            kept = [p for i, p in enumerate(places) if i not in out]
            key = np.full(len(signatures), np.uint64(c * 1_000_003 + sum(1 << i for i in out) + 1))
            for p in kept:
                key = (key ^ signatures[:, p].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys.append(key)
    return np.stack(keys, 1).view(np.int64)


def sketches(docs: DataFrame, shingle_words: int, symbols: int) -> DataFrame:
    """``docs`` (doc_id, text) as written rows: doc_id, text_hash, n_shingles, h1 and h2 (a 128-bit
    hash of the whole shingle set) and signature."""
    factors = np.random.default_rng(5).integers(0, 2**63, symbols, np.uint64) * np.uint64(2) + np.uint64(1)

    @F.pandas_udf(SKETCH)
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shingle_words)
        for texts in batches:
            rows = []
            for text in texts:
                found = shingler(text)
                own = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                rows.append((len(found), int(own[0]), int(own[1]), signature(found, factors).tobytes() if len(found) else b""))
            yield pd.DataFrame(rows, columns=["n_shingles", "h1", "h2", "signature"])

    made = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sketch("text").alias("s"))
    return written(made.select("doc_id", "text_hash", "s.*"), "minhash-sketches")


def unpacked(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint16).reshape(len(signatures), -1)


def bucket_comparers(radius: int):
    """Edges between members of buckets (root) whose signatures differ in at most ``radius``
    symbols; members of one ``tag`` are connected already and not compared."""

    def one(group: pd.DataFrame) -> np.ndarray:
        own, bucket, tag = unpacked(group["signature"]), group["root"].to_numpy(), group["tag"].to_numpy()
        parent, n = np.arange(len(group)), len(group)
        for step in range(1, max((hi - lo for lo, hi in bounds(bucket)), default=0)):
            i = np.flatnonzero((bucket[step:] == bucket[: n - step]) & (tag[step:] != tag[: n - step]))
            i = i[(own[i] != own[i + step]).sum(1) <= radius]
            join_roots(parent, i, i + step)
        return forest(group["node"].to_numpy(), parent)

    def two(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
        left, right = unpacked(x["signature"]), unpacked(y["signature"])
        tag_x, tag_y = x["tag"].to_numpy(), y["tag"].to_numpy()
        tags, counts = np.unique(np.concatenate([tag_x, tag_y]), return_counts=True)
        most, parent = tags[counts.argmax()], np.arange(len(x) + len(y))
        # Rows of the commonest tag need only the other block's rows of other tags.
        for rows, columns in ((np.flatnonzero(tag_x != most), np.arange(len(y))), (np.flatnonzero(tag_x == most), np.flatnonzero(tag_y != most))):
            for lo in range(0, len(rows), 256):
                part = rows[lo : lo + 256]
                apart = np.zeros((len(part), len(columns)), np.uint16)
                for k in range(left.shape[1]):
                    apart += left[part, k][:, None] != right[columns, k][None, :]
                i, j = np.nonzero((apart <= radius) & (tag_x[part][:, None] != tag_y[columns][None, :]))
                join_roots(parent, part[i], len(x) + columns[j])
        return forest(np.concatenate([x["node"].to_numpy(), y["node"].to_numpy()]), parent)

    return one, two


def similar_signatures(classes: DataFrame, chunks: int, radius: int, block: int) -> DataFrame:
    """(node, root) of what pairs of signatures within the radius connect.

    Every pair within the radius shares a bucket. There each member is compared with the smallest;
    buckets whose other members this leaves in several components are compared among themselves,
    one of those with equal members (by 128 bits of sums of hashes) for all.
    """

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.iloc[lo : lo + 1024]
                yield pd.DataFrame({"node": part["class"].to_numpy(), "keys": list(chunk_keys(unpacked(part["signature"]), chunks, radius))})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.loc[(unpacked(batch["x"]) != unpacked(batch["y"])).sum(1) <= radius, ["a", "b"]]

    own = classes.select("class", "signature")
    keyed = own.mapInPandas(index, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    hubs = written(hubs.select(F.col("key").alias("k"), "hub"), "minhash-hubs")
    met = written(keyed.join(hubs, F.col("key") == F.col("k")).where("node <> hub").select("key", "node", "hub"), "minhash-met")
    stars = met.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = stars.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    close = written(stars.select("a", "b", "x", "y").mapInPandas(near, EDGE), "minhash-stars")
    tags = written(components(close), "minhash-tags").toDF("n", "tag")
    members = met.select("key", "node").join(tags, F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("tag", "node").alias("tag"))
    held = members.groupBy("key").agg(F.min("tag").alias("least"), F.max("tag").alias("most"), *(F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)))
    several = held.where("least <> most").groupBy("s1", "s2").agg(F.min("key").alias("root"))
    several = written(several.select("root"), "minhash-open")
    rest = members.join(several, F.col("key") == F.col("root")).select("root", "node", "tag").join(own, F.col("node") == F.col("class")).drop("class")
    more = compare_in_blocks(rest, ["tag", "signature"], *bucket_comparers(radius), block)
    return components(close.unionByName(more))


def set_comparers(shingle_words: int, percent: int):
    """Edges between texts of a group whose shingle sets have 100 * intersection >= percent * union."""

    def link(x: pd.Series, y: pd.Series | None) -> np.ndarray:
        shingler = Shingler(shingle_words)
        sets = [shingler(t) for t in (x if y is None else pd.concat([x, y]))]
        n, sizes = len(x), np.array([len(s) for s in sets], np.int64)
        if len(sets) == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            ok = 100 * both >= percent * (sizes.sum() - both)
            return np.array([[True, ok], [ok, True]]) if y is None else np.array([[ok]])
        _, columns, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), sizes)
        shared = uses[columns] > 1
        rows, columns = rows[shared], columns[shared]
        _, columns = np.unique(columns, return_inverse=True)
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        left, right = (slice(0, len(sets)),) * 2 if y is None else (slice(0, n), slice(n, len(sets)))
        both = np.zeros((len(sets[left]), len(sets[right])), np.float64)
        width = 4096
        for lo in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
            a, b = np.searchsorted(columns, [lo, lo + width])
            has = np.zeros((len(sets), width), np.float32)
            has[rows[a:b], columns[a:b] - lo] = 1
            both += has[left] @ has[right].T
        return 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)

    def one(group: pd.DataFrame) -> np.ndarray:
        nodes, parent = group["node"].to_numpy(), np.arange(len(group))
        for lo, hi in bounds(group["root"].to_numpy()):
            if hi - lo > 1:
                i, j = np.nonzero(np.triu(link(group["text"].iloc[lo:hi], None), 1))
                join_roots(parent, lo + i, lo + j)
        return forest(nodes, parent)

    def two(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
        parent = np.arange(len(x) + len(y))
        i, j = np.nonzero(link(x["text"], y["text"]))
        join_roots(parent, i, len(x) + j)
        return forest(np.concatenate([x["node"].to_numpy(), y["node"].to_numpy()]), parent)

    return one, two


def radius_for(percent: int, symbols: int, missed: float = 2e-5) -> int:
    """The least number of differing symbols that a pair of that similarity exceeds with a chance of
    at most ``missed``: a symbol differs with probability 1 - similarity (a little less, as 16 bits
    may agree by chance), so the count is binomial.
    """
    apart, radius, within = 1 - percent / 100, -1, 0.0
    while 1 - within > missed:
        radius += 1
        within += comb(symbols, radius) * apart**radius * (1 - apart) ** (symbols - radius)
    return radius


def group_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 85, symbols: int = 64, signature_block: int = 2048, set_block: int = 384, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, text_hash, n_shingles, group and component_id for every row of ``docs`` (doc_id,
    text); group names the component, null for texts without words, which are alone.

    Texts with equal shingle sets (equal in 128 bits of hash: among 10^11 sets two different ones are
    taken for one with a chance of about 10^-17) are one class. Classes whose sets have 100 * intersection >=
    percent * union are linked, on the full sets, if their signatures differ in at most
    ``radius_for(percent, symbols)`` symbols; chunks are as few as leave one error in each.
    """
    radius = radius_for(percent, symbols)
    chunks = radius // 2 + 1
    docs = docs.select("doc_id", "text")
    rows = sketches(docs, shingle_words, symbols)
    full = rows.where("n_shingles > 0")
    classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "minhash-classes")
    groups = written(similar_signatures(classes, chunks, radius, signature_block), "minhash-groups")
    # One row of each class that has company brings its text.
    named = classes.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("class").alias("node")).join(groups, "node")
    same = (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))
    bearers = full.select("h1", "h2", "doc_id", "text_hash").join(named, same).groupBy("node", "root").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"))
    bearers = written(bearers.select("node", "root", F.col("x.doc_id").alias("d"), F.col("x.text_hash").alias("h")), "minhash-bearers")
    small = bearers.count() <= broadcast_rows
    texts = docs.join(F.broadcast(bearers) if small else bearers, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h")))
    texts = written(texts.select("node", "root", "text").dropDuplicates(["node"]), "minhash-texts")
    found = written(components(compare_in_blocks(texts, ["text"], *set_comparers(shingle_words, percent), set_block)), "minhash-components")
    named = classes.join(found, F.col("class") == F.col("node"), "left").select("h1", "h2", "least", F.coalesce("root", "class").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = named.join(least, F.col("root") == F.col("r")).select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("root").alias("group"), "component_id")
    out = rows.select("doc_id", "text_hash", "n_shingles", "h1", "h2").join(named, same & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "group", component.alias("component_id"))


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id of the component, kept whether it is the row's own.

    Defined results: texts without words have no shingles and are components of their own; texts
    of fewer words than a shingle have one; rows repeating a doc_id share their component only if
    their texts link; a null doc_id is never the smallest unless it is alone (then component_id is
    null and kept true); an empty table gives an empty result. Other columns are ignored.
    """
    out = group_near_duplicates(docs, **settings).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame, broadcast_rows: int = 1_000_000, **settings) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id's, among rows of
    that id the one of the smallest text hash, of rows that repeat it any one. Texts without words
    all stay. All columns pass.

    Only what goes, or stays once, is joined: broadcast up to ``broadcast_rows`` rows, else shuffled.
    """
    rows = group_near_duplicates(docs, **settings).where("group is not null")
    own = rows.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    own = written(own, "minhash-members")
    first = own.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "text_hash")).alias("x")).select(F.col("group").alias("g"), "x")
    own = own.join(first, F.col("group") == F.col("g"))
    stays = F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("text_hash") == F.col("x.text_hash"))
    marked = own.select(F.col("doc_id").alias("__gw_d"), F.col("text_hash").alias("__gw_h"), stays.alias("__gw_once"), "n")
    marked = written(marked.where("not __gw_once or n > 1").drop("n"), "minhash-marked")
    small = marked.count() <= broadcast_rows
    hashed = docs.withColumn("__gw_hash", F.xxhash64("text"))
    met = hashed.join(F.broadcast(marked) if small else marked, F.col("doc_id").eqNullSafe(F.col("__gw_d")) & (F.col("__gw_hash") == F.col("__gw_h")), "left")
    free = met.where("__gw_once is null").select(*docs.columns)
    once = met.where("__gw_once").dropDuplicates(["doc_id", "__gw_hash"]).select(*docs.columns)
    return free.unionByName(once)
