"""Deleted-interpolation language model over whole texts.

Word n-gram maximum-likelihood estimates of orders 1 to ``order`` and the uniform distribution are
mixed with weights that depend on how often the context was seen; the weights are learned by
expectation-maximisation on documents whose counts are held out.

Texts are read once, into chunks: rows that hold some million tokens as local ids. A chunk sends
one count per distinct n-gram (never one row per token), so a word of every document is one entry
per chunk. Counts are added in a tree: a merger takes one range of keys from a bounded number of
chunks, or of mergers below it, and sends its sums to at most as many ranges of the next level, until
one merger holds a range for the whole corpus; its sums go back down the same way, one count per
n-gram asked for. So messages grow with the chunks times the levels, not with their square, and a
merger's size is bounded. Chunks, what mergers keep, answers and what the weights are learned from
are written to the shared folder; the driver sees sums per bucket only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import forget, written

#: Local ids: 0 pads the front of a text, 1 ends it, words follow.
END, FIRST_WORD = 1, 2
#: Keys of the two, apart from any word's by all likelihood of a 64-bit hash.
PAD_KEY, END_KEY = 0x5851F42D4C957F2D, 0x14057B7EF767814F
#: Bits that keys of two and more words keep, the highest: an n-gram among 10^9 meets another's key with
#: a chance of about 10^-8, among 10^12 of 10^-5. Words keep all 64.
GRAM_BITS = np.uint64(0xFFFFFFFFFFFFFF00)
#: Context-frequency buckets: 0 for unseen, then one for each binary digit of the count.
BUCKETS = 48
#: How a document takes part: scored only, counted, or counted but held out for the weights.
SCORED, COUNTED, TUNING = 0, 1, 2

CHUNK = "tuning boolean, n_tokens long, n_counted long, n_tuning long, doc_ids binary, known binary, roles binary, lengths binary, tokens binary, words binary"
#: To a merger: the sender (a chunk, or a group of the level below), the order and range of keys as
#: the sender numbers them, its keys and counts.
PART = "grp long, k int, rng long, sender long, tuning boolean, part long, keys binary, counted binary, held binary"
#: Of a merger: parts for the next level, where each sender's keys are among its own (``at``), and at
#: the top answers (to a sender) and the number of distinct keys.
MERGED = "kind string, grp long, k int, rng long, sender long, tuning boolean, part long, keys binary, counted binary, held binary, at binary"
#: To a sender, for the keys that it sent as ``part``: its counts in range ``fine`` of this level.
ANSWER = "sender long, k int, part long, fine long, every binary, apart binary"
STATS = "buckets binary, chances binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def squeeze(a: np.ndarray) -> bytes:
    """An array as compressed bytes, all first bytes first: small numbers leave planes of zeros."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def crc_mod(doc_id: Column, by: int) -> Column:
    """crc32(doc_id as text) mod ``by``; of a null id, of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit key for an ordered pair of 64-bit keys."""
    z = (x * np.uint64(0x9E3779B97F4A7C15)) ^ ((y << np.uint64(31)) | (y >> np.uint64(33)))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


class _OpenChunk:
    """A chunk while documents are added."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.docs: list[tuple[int, int, int, int]] = []
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id: int, known: bool, text: str | None, role: int) -> None:
        words = (text or "").encode("utf-8", "replace").lower().split()
        ids = self.ids
        for w in words:
            if w not in ids:
                ids[w] = len(ids) + FIRST_WORD
        own = np.fromiter(map(ids.__getitem__, words), np.uint32, len(words))
        self.parts.append(np.append(own, np.uint32(END)))
        self.docs.append((doc_id, known, role, len(words) + 1))
        self.n += len(words) + 1

    def row(self, tuning: bool) -> pd.DataFrame:
        doc_ids, known, roles, lengths = (np.array(x) for x in zip(*self.docs, strict=True))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.ids), np.uint64, len(self.ids))
        words = np.concatenate([np.array([PAD_KEY, END_KEY], np.uint64), hashes])
        return pd.DataFrame({
            "tuning": [tuning], "n_tokens": [self.n], "n_counted": [int(lengths[roles == COUNTED].sum())], "n_tuning": [int(lengths[roles == TUNING].sum())],
            "doc_ids": [squeeze(doc_ids.astype(np.int64))], "known": [squeeze(known.astype(np.uint8))], "roles": [squeeze(roles.astype(np.uint8))],
            "lengths": [squeeze(lengths.astype(np.int64))], "tokens": [squeeze(np.concatenate(self.parts))], "words": [words.tobytes()],
        })


def chunks(docs: DataFrame, role: Column, chunk_tokens: int) -> DataFrame:
    """``docs`` (doc_id, text) as written chunk rows; tuning documents have chunks of their own."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_chunks = {False: _OpenChunk(), True: _OpenChunk()}
        for batch in batches:
            for doc_id, known, text, as_role in zip(batch["doc_id"], batch["known"], batch["text"], batch["role"], strict=True):
                tuning = as_role == TUNING
                open_chunks[tuning].add(doc_id, known, text, as_role)
                if open_chunks[tuning].n >= chunk_tokens:
                    yield open_chunks[tuning].row(tuning)
                    open_chunks[tuning] = _OpenChunk()
        for tuning, chunk in open_chunks.items():
            if chunk.docs:
                yield chunk.row(tuning)

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNotNull().alias("known"), "text", role.alias("role"))
    # The write fixes the ids, which depend on how rows were dealt to tasks.
    return written(rows.mapInPandas(build, CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks")


@dataclass
class Grams:
    """A chunk's n-grams by order: the key that ends at each token, and the key of its context."""

    keys: list[np.ndarray]
    contexts: list[np.ndarray]
    lengths: np.ndarray
    roles: np.ndarray

    def asked(self, k: int) -> np.ndarray:
        return np.unique(self.keys[k])


def grams(row, order: int) -> Grams:
    """The n-grams of a chunk.

    The context of order k at a token is the (k-1)-gram just before it, hence itself counted; the
    context of a text's first token is the start, which is as frequent as the end, so it has the
    end's key.
    """
    lengths, roles = expand(row.lengths, np.int64), expand(row.roles, np.uint8)
    tokens, words = expand(row.tokens, np.uint32), np.frombuffer(row.words, np.uint64)
    h = words[tokens]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    since = np.arange(len(tokens)) - np.repeat(starts, lengths)
    keys, contexts, level = [h], [], h
    for k in range(2, order + 1):
        before = np.concatenate([level[:1], level[:-1]])
        before[since == 0] = np.uint64(END_KEY)
        contexts.append(before)
        level = (_pair(before, h) + np.uint64(k)) & GRAM_BITS
        keys.append(level)
    return Grams(keys, contexts, lengths, roles)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _in_ranges(keys: np.ndarray, final: int, ranges: int) -> np.ndarray:
    """The range of each key at a level of ``ranges`` ranges, each a union of the ``final`` ones."""
    at = (keys >> np.uint64(32)) * np.uint64(final) >> np.uint64(32)
    return (at * np.uint64(ranges) // np.uint64(final)).astype(np.int64)


def _parts(keys: np.ndarray, counted: np.ndarray, held: np.ndarray, final: int, ranges: int) -> Iterator[tuple]:
    """Sorted keys and their counts cut by range: (range, packed keys, counted, held)."""
    at = _in_ranges(keys, final, ranges)
    cuts = np.flatnonzero(np.diff(at)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
        if lo < hi:
            yield int(at[lo]), squeeze(np.diff(keys[lo:hi], prepend=np.uint64(0))), squeeze(counted[lo:hi]), squeeze(held[lo:hi])


@dataclass(frozen=True)
class Level:
    """A level of mergers: how many groups of senders and how many ranges of keys."""

    groups: int
    ranges: int


def tree(n_chunks: int, final: int, fan: int) -> list[Level]:
    """Levels until one group is left; the last has all ``final`` ranges. There are two at least, so
    that a small corpus is counted as a large one is."""
    levels, groups, ranges = [], max(n_chunks, fan + 1), 1
    while True:
        groups, ranges = -(-groups // fan), min(final, ranges * fan)
        if groups == 1:
            return [*levels, Level(1, final)]
        levels.append(Level(groups, ranges))


def _count(all_chunks: DataFrame, order: int, levels: list[Level], fan: int) -> tuple[DataFrame, int]:
    """Answers: per chunk and range of the lowest level, the corpus counts of the chunk's distinct
    n-grams in key order; of tuning chunks also the counts without the tuning documents. And the
    number of distinct words that were counted."""
    final = levels[-1].ranges

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, ranges = levels[0].groups, levels[0].ranges
        for batch in batches:
            for row in batch.itertuples():
                g = grams(row, order)
                role = np.repeat(g.roles, g.lengths)
                for k in range(order):
                    asked, at = np.unique(g.keys[k], return_inverse=True)
                    counted = np.bincount(at[role == COUNTED], minlength=len(asked)).astype(np.uint64)
                    held = np.bincount(at[role == TUNING], minlength=len(asked)).astype(np.uint64)
                    # Consecutive ids would put a file's chunks in one group: spread them.
                    group = xxhash.xxh3_64_intdigest(int(row.chunk).to_bytes(8, "little")) % groups
                    yield pd.DataFrame([(group, k, r, row.chunk, row.tuning, r, *packed) for r, *packed in _parts(asked, counted, held, final, ranges)], columns=_names(PART))

    def merger(above: Level | None):
        def merge(batch: pd.DataFrame) -> pd.DataFrame:
            grp, k, rng = (int(batch[c].iloc[0]) for c in ("grp", "k", "rng"))
            keys = [np.cumsum(expand(x, np.uint64), dtype=np.uint64) for x in batch["keys"]]
            merged, at = np.unique(np.concatenate(keys), return_inverse=True)
            counted = np.bincount(at, np.concatenate([expand(x, np.uint64) for x in batch["counted"]]), len(merged)).astype(np.uint64)
            held = np.bincount(at, np.concatenate([expand(x, np.uint64) for x in batch["held"]]), len(merged)).astype(np.uint64)
            out, lo = [], 0
            for sender, tuning, part, own in zip(batch["sender"], batch["tuning"], batch["part"], keys, strict=True):
                mine = at[lo : lo + len(own)]
                lo += len(own)
                if above is None:
                    every = squeeze((counted + held)[mine])
                    out.append(("answer", grp, k, rng, sender, tuning, part, b"", every, squeeze(counted[mine]) if tuning else b"", b""))
                else:
                    out.append(("kept", grp, k, rng, sender, tuning, part, b"", b"", b"", squeeze(np.diff(mine, prepend=0).astype(np.uint32))))
            if above is None:
                out.append(("distinct", grp, k, int((counted + held > 0).sum()), 0, False, 0, b"", b"", b"", b""))
            else:
                for r, *packed in _parts(merged, counted, held, final, above.ranges):
                    out.append(("part", grp // fan, k, r, grp, True, rng, *packed, b""))
            return pd.DataFrame(out, columns=_names(MERGED))

        return merge

    def answered(kept: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(kept):
            return pd.DataFrame(columns=_names(ANSWER))
        found = found.sort_values("fine")
        every = np.concatenate([expand(x, np.uint64) for x in found["every"]])
        apart = np.concatenate([expand(x, np.uint64) for x in found["apart"]])
        out = []
        for row in kept.itertuples():
            at = np.cumsum(expand(row.at, np.uint32), dtype=np.int64)
            out.append((row.sender, row.k, row.part, row.rng, squeeze(every[at]), squeeze(apart[at]) if row.tuning else b""))
        return pd.DataFrame(out, columns=_names(ANSWER))

    parts, merged = all_chunks.mapInPandas(send, PART), []
    for above in [*levels[1:], None]:
        merged.append(written(parts.groupBy("grp", "k", "rng").applyInPandas(merger(above), MERGED), "lm-merged"))
        parts = merged[-1].where("kind = 'part'").drop("kind", "at")
    distinct = merged[-1].where("kind = 'distinct' and k = 0").agg(F.sum("rng")).first()[0] or 0
    answers = merged[-1].where("kind = 'answer'").select("sender", "k", "part", F.col("rng").alias("fine"), F.col("counted").alias("every"), F.col("held").alias("apart"))
    for own in reversed(merged[:-1]):
        # A merger (group, range) sent the next level several finer ranges: it takes all answers to them.
        own = own.where("kind = 'kept'").select("grp", "k", "rng", "sender", "tuning", "part", "at")
        answers = written(own.groupBy("grp", "k", "rng").cogroup(answers.groupBy("sender", "k", "part")).applyInPandas(answered, ANSWER), "lm-answers")
    forget(*merged)
    return answers.select("sender", "k", "part", "every", "apart"), distinct


def _looked_up(g: Grams, answers: pd.DataFrame, column: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By order, the count of the n-gram at each token and of its context."""
    counts, own, found = [], [], answers.sort_values("part")
    for k in range(len(g.keys)):
        mine = found[found["k"] == k]
        own.append(g.asked(k))
        counts.append(np.concatenate([expand(x, np.uint64) for x in mine[column]]).astype(np.int64))
    grams_at = [counts[k][np.searchsorted(own[k], g.keys[k])] for k in range(len(g.keys))]
    contexts_at = []
    for k, keys in enumerate(g.contexts):
        contexts_at.append(counts[k][np.searchsorted(own[k], keys)] if k == 0 else _in_order(own, counts, keys, k))
    return grams_at, contexts_at


def _in_order(own: list[np.ndarray], counts: list[np.ndarray], keys: np.ndarray, k: int) -> np.ndarray:
    """Counts of contexts of ``k + 1`` words; a start is found among the words."""
    out = counts[0][np.searchsorted(own[0], np.full(len(keys), END_KEY, np.uint64))]
    at = np.minimum(np.searchsorted(own[k], keys), len(own[k]) - 1)
    return np.where(own[k][at] == keys, counts[k][at], out)


def _chances(grams_at: list[np.ndarray], contexts_at: list[np.ndarray], n: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token's longest context, and the estimates of all orders (uniform first)."""
    every = np.empty((len(grams_at) + 1, len(grams_at[0])))
    every[0] = 1 / (distinct + 1)
    every[1] = grams_at[0] / max(n, 1)
    for k in range(1, len(grams_at)):
        every[k + 1] = grams_at[k] / np.maximum(contexts_at[k - 1], 1)
    longest = contexts_at[-1] if contexts_at else np.zeros(len(grams_at[0]), np.int64)
    bucket = np.where(longest > 0, np.floor(np.log2(np.maximum(longest, 1))).astype(np.int64) + 1, 0)
    return np.minimum(bucket, BUCKETS - 1), every


def learn_weights(stats: DataFrame, order: int, rounds: int, prior: float = 1.0) -> np.ndarray:
    """Mixture weights by bucket (rows) and order (columns), by expectation-maximisation.

    Each round is one pass over the written estimates; it sends a sum per bucket and order. One
    pseudo-token per order keeps all weights positive, also in buckets without held-out tokens.
    """
    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))
    for _ in range(rounds):
        now = weights

        def expect(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = np.zeros(now.shape)
            for batch in batches:
                for packed, chances in zip(batch["buckets"], batch["chances"], strict=True):
                    bucket = expand(packed, np.uint8).astype(np.int64)
                    share = np.frombuffer(chances, np.float32).reshape(order + 1, -1).astype(float) * now[bucket].T
                    share /= share.sum(0)
                    for k in range(order + 1):
                        total[:, k] += np.bincount(bucket, weights=share[k], minlength=BUCKETS)
            yield pd.DataFrame([(b, k, total[b, k]) for b, k in zip(*np.nonzero(total), strict=True)], columns=["bucket", "k", "n"])

        sums = np.full(weights.shape, prior)
        for r in stats.mapInPandas(expect, "bucket int, k int, n double").groupBy("bucket", "k").agg(F.sum("n").alias("n")).collect():
            sums[r.bucket, r.k] += r.n
        weights = sums / sums.sum(1, keepdims=True)
        if np.abs(weights - now).max() < 1e-3:
            break
    return weights


def score_documents(docs: DataFrame, teaches: Column, order: int = 2, tuning_one_in: int = 20, chunk_tokens: int = 1_200_000, range_tokens: int = 1_500_000, fan: int = 128, rounds: int = 12) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score.

    ``teaches`` marks the training rows; of these one in ``tuning_one_in`` (by a hash of the id)
    teaches the weights, its counts held out meanwhile; the final estimates use all training rows.
    Tokens are the words, A-Z in lower case, and one end per text. base_score is the sum of
    log10((c + 1) / (N + V + 1)), score the model's log10 probability of the text.

    Words are told apart by 64-bit hashes, n-grams of two and more words by 56-bit ones. Defined results: a null or empty text is
    its end alone; a null id stays null; repeated rows are counted and scored each; with no
    training row only the uniform distribution over one unknown word is left (base 0); an empty
    table gives an empty result. Other columns are ignored.
    """
    tunes = F.pmod(F.xxhash64(F.lit("tuning"), "doc_id"), F.lit(tuning_one_in)) == 0
    role = F.when(~teaches, SCORED).when(tunes, TUNING).otherwise(COUNTED)
    all_chunks = chunks(docs, role, chunk_tokens)
    t = all_chunks.agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens"), F.sum("n_counted").alias("counted"), F.sum("n_tuning").alias("tuning")).first()
    counted, n = t.counted or 0, (t.counted or 0) + (t.tuning or 0)
    answers, distinct = _count(all_chunks, order, tree(t.chunks, max(1, -(-(t.tokens or 0) // range_tokens)), fan), fan)

    def estimate(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        for row in left.itertuples():
            bucket, every = _chances(*_looked_up(grams(row, order), right, "apart"), counted, distinct)
            return pd.DataFrame({"buckets": [squeeze(bucket.astype(np.uint8))], "chances": [every.astype(np.float32).tobytes()]})
        return pd.DataFrame({"buckets": [], "chances": []})

    tuning = all_chunks.where("tuning").groupBy("chunk").cogroup(answers.where("length(apart) > 0").groupBy("sender"))
    stats = written(tuning.applyInPandas(estimate, STATS), "lm-tuning")
    weights = learn_weights(stats, order, rounds)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        for row in left.itertuples():
            g = grams(row, order)
            grams_at, contexts_at = _looked_up(g, right, "every")
            bucket, every = _chances(grams_at, contexts_at, n, distinct)
            mixed = np.einsum("kt,tk->t", every, weights[bucket])
            starts = np.concatenate([[0], np.cumsum(g.lengths)[:-1]])
            seen = grams_at[0]
            return pd.DataFrame({
                "doc_id": pd.arrays.IntegerArray(expand(row.doc_ids, np.int64), expand(row.known, np.uint8) == 0), "held_out": g.roles == SCORED, "n_tokens": g.lengths,
                "n_known": np.add.reduceat((seen > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(np.log10((seen + 1) / (n + distinct + 1)), starts),
                "score": np.add.reduceat(np.log10(mixed), starts),
            })
        return pd.DataFrame(columns=[c.split()[0] for c in SCORES.split(", ")])

    scored = all_chunks.groupBy("chunk").cogroup(answers.groupBy("sender")).applyInPandas(score, SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
