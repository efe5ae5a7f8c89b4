"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word has a sparse random index vector, a function of its spelling alone. A word's vector is
its own index vector plus the sum of its neighbours' over all texts, in unit length; a document is the
mean of its words' vectors. Contexts are counted in one pass over the whole corpus, into a table of
fixed size. The network and its temperature are fitted on a bounded sample of labelled documents; every
document is scored over its whole text, wherever its executor runs.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Non-zero entries of an index vector.
ENTRIES = 4
#: Rows of the table of context vectors; words share them by hash, which bounds the model.
ROWS = 1 << 14


def index_entries(words: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its row in the context table, and the places and signs of its index vector."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    rows = (h % np.uint64(ROWS)).astype(np.int64)
    places, signs = np.empty((len(words), ENTRIES), np.int64), np.empty((len(words), ENTRIES), np.float32)
    for k in range(ENTRIES):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        places[:, k] = (h >> np.uint64(40)) % np.uint64(dim)
        signs[:, k] = np.where((h >> np.uint64(39)) & np.uint64(1), 1.0, -1.0)
    return rows, places, signs


_KIND = bytes.maketrans(bytes(range(256)), bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    """A word's shape, itself a word of the model: its runs of letters, capitals, digits and signs.

    Shapes give rare words something in common. The leading zero byte keeps them apart from words.
    """
    return b"\x00" + _RUN.sub(rb"\1", word.translate(_KIND))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


class Vocabulary:
    """Ids for words, and the vectors of the words met; emptied when it has ``limit`` words, so its
    size doesn't follow the input."""

    def __init__(self, table: np.ndarray, dim: int, limit: int = 1 << 17):
        self.table, self.dim, self.limit = table, dim, limit
        self.ids: dict[bytes, int] = {}
        self.vectors = np.zeros((1024, 2 * dim), np.float32)

    def _vectors(self, words: list[bytes]) -> np.ndarray:
        rows, places, signs = index_entries(words, self.dim)
        out = self.table[rows]
        for k in range(ENTRIES):
            out[np.arange(len(words)), places[:, k]] += signs[:, k]
        return out

    def look_up(self, words: list[bytes]) -> np.ndarray:
        if len(self.ids) > self.limit:
            self.ids.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if new:
            n = len(self.ids)
            while n + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            at = slice(n, n + len(new))
            self.vectors[at, : self.dim] = self._vectors(new)
            shapes = [shape(w) for w in new]
            kinds = {s: i for i, s in enumerate(dict.fromkeys(shapes))}
            self.vectors[at, self.dim :] = self._vectors(list(kinds))[[kinds[s] for s in shapes]]
            self.ids.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))


@dataclass
class Pooler:
    """Document vectors: the mean vector of the words and of their shapes, then the log length,
    the share of words that repeat their left neighbour, the share of distinct words, and 1 for
    texts that have words."""

    table: np.ndarray
    dim: int
    piece: int = 1 << 16

    @property
    def width(self) -> int:
        return 2 * self.dim + 4

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        known = Vocabulary(self.table, self.dim)
        out = np.zeros((len(texts), self.width), np.float32)
        for i, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            total, repeats = np.zeros(2 * self.dim), 0
            for at in range(0, len(words), self.piece):
                ids = known.look_up(words[at : at + self.piece])
                distinct, counts = np.unique(ids, return_counts=True)
                total += counts.astype(np.float32) @ known.vectors[distinct]
                repeats += int((ids[1:] == ids[:-1]).sum())
            n = len(words)
            different = len(distinct) if n <= self.piece else len(set(words))
            out[i, :-4] = total / n
            out[i, -4:] = np.log1p(n) / 10, repeats / n, different / n, 1.0
        return out


class Contexts:
    """Context counts by random indexing: a row sums the index vectors of the words within
    ``window`` places of the words that hash to it, and so for shapes. Sums are of whole numbers, so
    no order of addition changes them."""

    def __init__(self, dim: int, window: int = 2, limit: int = 1 << 17):
        self.dim, self.window, self.limit = dim, window, limit
        # One row more than the table's, for the gaps between texts.
        self.table = np.zeros((ROWS + 1) * dim)
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.shape_of = np.zeros(0, np.int64)
        gap = np.full(1, ROWS), np.zeros((1, ENTRIES), np.int64), np.zeros((1, ENTRIES))
        self.words, self.shapes, self.shape_ids = gap, gap, {b"": 0}

    def _grown(self, old: tuple, words: list[bytes]) -> tuple:
        # Signs have the table's type: numpy adds at places of another type twenty times slower.
        rows, places, signs = index_entries(words, self.dim)
        return tuple(np.concatenate(x) for x in zip(old, (rows, places, signs.astype(float)), strict=True))

    def add(self, texts: list[str | None]) -> None:
        """Count the neighbours of all words of ``texts``."""
        if len(self.ids) > self.limit:
            self._forget()
        flat: list[bytes] = []
        gap = [b""] * self.window  # no word is empty
        for text in texts:
            flat += words_of(text)
            flat += gap
        ids = self.ids
        ids.setdefault(b"", 0)
        new = [w for w in dict.fromkeys(flat) if w not in ids]
        if new:
            ids.update(zip(new, range(len(ids), len(ids) + len(new)), strict=True))
            self.words = self._grown(self.words, new)
            own = [shape(w) for w in new]
            fresh = [x for x in dict.fromkeys(own) if x not in self.shape_ids]
            if fresh:
                self.shape_ids.update(zip(fresh, range(len(self.shape_ids), len(self.shape_ids) + len(fresh)), strict=True))
                self.shapes = self._grown(self.shapes, fresh)
            known = self.shape_of if len(self.shape_of) else np.zeros(1, np.int64)
            self.shape_of = np.concatenate([known, np.array([self.shape_ids[x] for x in own], np.int64)])
        at = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
        for tokens, (rows, places, signs) in ((at, self.words), (self.shape_of[at] if len(self.shape_of) else at, self.shapes)):
            base = rows[tokens] * self.dim
            for step in range(1, min(self.window, len(tokens) - 1) + 1):
                for word, near in ((base[:-step], tokens[step:]), (base[step:], tokens[:-step])):
                    for k in range(ENTRIES):
                        np.add.at(self.table, word + places[near, k], signs[near, k])

    def counts(self) -> np.ndarray:
        return self.table[: ROWS * self.dim].reshape(ROWS, self.dim)


def unit_rows(counts: np.ndarray) -> np.ndarray:
    """Context vectors in unit length; rows without contexts stay zero."""
    norm = np.linalg.norm(counts, axis=1, keepdims=True)
    return (counts / np.maximum(norm, 1e-9)).astype(np.float32)


def corpus_contexts(docs: DataFrame, dim: int, task_bytes: int = 256 << 20) -> np.ndarray:
    """The context table of all texts of ``docs``.

    A task sends one row per table row that it met, summed on the map side; tasks take several
    partitions, about ``task_bytes`` of text, so what is sent stays a small part of the input. The
    driver receives the table, of fixed size.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Contexts(dim)
        for batch in batches:
            texts = batch["text"].tolist()
            for at in range(0, len(texts), 64):
                own.add(texts[at : at + 64])
        counts = own.counts()
        met = np.flatnonzero(counts.any(1))
        yield pd.DataFrame({"row": met, **{f"v{k}": counts[met, k] for k in range(dim)}})

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    columns = [f"v{k}" for k in range(dim)]
    sums = docs.select("text").coalesce(tasks).mapInPandas(count, "row long, " + ", ".join(f"{c} double" for c in columns))
    got = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    table = np.zeros((ROWS, dim))
    table[got["row"].to_numpy(np.int64)] = got[columns].to_numpy(float)
    return unit_rows(table)


@dataclass
class Network:
    """tanh layer and a logit, on standardised inputs; probability = sigmoid(logit / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.logits(x) / self.temperature, -40, 40)
        return 1 / (1 + np.exp(-z))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 1) -> Network:
    """Adam on the mean logistic loss with weight decay; a fifth of the rows sets the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    held, own = order[:cut], order[cut:] if len(y) > 1 else order
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    z, t = ((x - mean) / scale).astype(np.float64), y.astype(np.float64)
    rate = np.clip(t[own].mean(), 1e-3, 1 - 1e-3)
    parts = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.array(np.log(rate / (1 - rate)))]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(own)
        for at in range(0, len(shuffled), 128):
            rows = shuffled[at : at + 128]
            hid = np.tanh(z[rows] @ parts[0] + parts[1])
            p = 1 / (1 + np.exp(-np.clip(hid @ parts[2] + parts[3], -40, 40)))
            back = (p - t[rows]) / len(rows)
            inner = np.outer(back, parts[2]) * (1 - hid**2)
            grads = [z[rows].T @ inner + 1e-4 * parts[0], inner.sum(0), hid.T @ back + 1e-4 * parts[2], back.sum()]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                parts[k] = parts[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, *parts[:3], float(parts[3]))
    logits = net.logits(x[held])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.logaddexp(0, np.where(y[held] > 0, -logits, logits) / g).mean() for g in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class Model:
    pooler: Pooler
    network: Network

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities to 9 digits: beyond that they depend on how rows are batched."""
        return np.round(self.network.score(self.pooler.vectors(texts)), 9)


def is_held_out(doc_id="doc_id"):
    """crc32(doc_id as text) mod 5 is 0; such rows never teach."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 32 << 20, dim: int = 48) -> Model:
    """Fit on labelled rows that are not held out.

    At most ``max_rows`` documents in the order of a hash of their id, and of these as many whole
    texts as fit ``max_bytes`` (none longer than a 64th of it): the only part that does not grow with
    the input. Of rows that repeat an id the shortest text, then the least by hash, is taken; an id
    with several labels counts as 1 if any is 1; null labels are left out. Without both classes the
    score is the smoothed share of label 1 (0.5 without any row). Word vectors come from all texts.
    """
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    own = own.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"))
    # The sample is drawn from the labels alone, so that no text is shuffled to meet them.
    drawn = F.broadcast(own.orderBy(F.xxhash64("labelled"), "labelled").limit(max_rows))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = docs.select("doc_id", "text", size.alias("n"), F.xxhash64("text").alias("h")).where(size <= max_bytes // 64)
    rows = rows.join(drawn, F.col("doc_id") == F.col("labelled")).drop("labelled")
    # One row per drawn id, so ``max_rows`` at most come to the driver.
    one = rows.groupBy("doc_id").agg(F.min(F.struct("n", "h")).alias("x")).select("doc_id", "x.n", "x.h", F.xxhash64("doc_id").alias("place"))
    total, picked = 0, []
    for r in sorted(one.collect(), key=lambda r: (r.place, r.doc_id)):
        total += r.n
        if total > max_bytes:
            break
        picked.append((r.doc_id, r.n, r.h))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long, n int, h long"))
    got = rows.join(chosen, ["doc_id", "n", "h"], "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    got = sorted((r.doc_id, r.text or "", int(r.quality)) for r in got.collect())
    texts, y = [t for _, t, _ in got], np.array([q for _, _, q in got])
    pooler = Pooler(corpus_contexts(docs, dim), dim)
    x = pooler.vectors(texts) if texts else np.zeros((0, pooler.width), np.float32)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        width = x.shape[1]
        flat = Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
        return Model(pooler, flat)
    return Model(pooler, fit_network(x, y))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with ``column`` (0 to 1, higher: label 1 likelier), from the whole text alone.

    Null and wordless texts have the vector 0 and the score that the network gives it. A column of
    that name is replaced; all others pass. The model, of fixed size, is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pickle.loads(sent.value)
        for texts in batches:
            yield pd.Series(own.score(texts.tolist()), dtype="float64")

    return docs.withColumn(column, scored(F.col("text")))
