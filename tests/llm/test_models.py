"""Language model, classifier, search, vector join and near-dedup against brute force."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeworks.llm import ann, common, components, lm, metric_join, minhash, quality, registry
from tests.llm.test_native import awkward, docs, empty  # noqa: F401  fixtures

SF = "/root/testdata/sf0.001"


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 2000 + i) for i in range(300)]
    want = union_find({x for e in links for x in e if e[0] != e[1]}, links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_take_one_step(spark, monkeypatch):
    """A few edges write one table, however long their chains; rounds give the same components."""
    rng = np.random.default_rng(4)
    path = rng.permutation(900) + 10**10
    links = [(int(a), int(b)) for a, b in zip(path, path[1:], strict=False)] * 2 + [(7, 7), (3, None), (1, 2), (-4, 2)]
    edges = spark.createDataFrame(links, "a long, b long")
    tables = []
    monkeypatch.setattr(components, "written", lambda df, tag: (tables.append(tag), common.written(df, tag))[1])
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert tables == ["edges"]
    assert got == {int(n): 10**10 for n in path} | {1: -4, 2: -4, -4: -4}
    rounds = {r.node: r.root for r in components.components(edges, one_task=1500).collect()}
    assert rounds == got and len(tables) > 3


def words(text):
    return (text or "").encode().lower().split()


def brute_model(rows, teaches):
    seen = Counter()
    for d, t in rows:
        if teaches(d):
            seen.update([*words(t), None])
    return seen, sum(seen.values()), len(seen)


def test_levels_of_the_tree():
    for n, final, fan in ((1, 1, 4), (3, 9, 4), (70, 60, 4), (5000, 4000, 16), (10**7, 8 * 10**6, 128)):
        levels = lm.tree(n, final, fan)
        assert levels[-1] == lm.Level(1, final) and levels[0].groups * fan >= n
        assert all(a.groups <= b.groups * fan and b.ranges <= a.ranges * fan for a, b in zip(levels, levels[1:]))


@pytest.mark.parametrize(("chunk_tokens", "fan"), [(700, 128), (150, 3), (100, 2)])
def test_base_score_and_counts(docs, chunk_tokens, fan):  # noqa: F811
    out = lm.score_documents(docs, lm.crc_mod(F.col("doc_id"), 7) != 2, chunk_tokens=chunk_tokens, range_tokens=200, fan=fan, tuning_one_in=4).collect()
    plain = lm.score_documents(docs, lm.crc_mod(F.col("doc_id"), 7) != 2, tuning_one_in=4).collect()
    scores = [sorted((str(r.doc_id), r.n_tokens, round(r.score, 5)) for r in x) for x in (out, plain)]
    assert scores[0] == scores[1]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    teaches = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2
    seen, n, v = brute_model(rows, teaches)
    want = Counter((d, len(words(t)) + 1, sum(seen[w] > 0 for w in [*words(t), None]), round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6), not teaches(d)) for d, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), r.held_out) for r in out) == want
    assert {r.train_tokens for r in out} == {n} and all(r.score < 0 and math.isfinite(r.score) for r in out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_estimates_are_relative_frequencies(spark, order):
    """With one weight on the longest context, the score is the product of relative frequencies."""
    texts = [(0, "a b a b a c"), (1, "a b"), (2, "b a c")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = lm.score_documents(rows, F.lit(True), order=order, tuning_one_in=10**9, rounds=0).orderBy("doc_id").collect()
    grams, contexts, n = Counter(), Counter(), 0
    for _, t in texts:
        seq = ["<"] * (order - 1) + t.split() + [">"]
        for i in range(order - 1, len(seq)):
            n += 1
            for k in range(1, order + 1):
                grams[tuple(seq[i - k + 1 : i + 1])] += 1
                contexts[tuple(seq[i - k + 1 : i])] += 1
    distinct = sum(len(g) == 1 for g in grams)
    for r, (_, t) in zip(got, texts, strict=True):
        seq, total = ["<"] * (order - 1) + t.split() + [">"], 0.0
        for i in range(order - 1, len(seq)):
            parts = [1 / (distinct + 1)] + [grams[tuple(seq[i - k + 1 : i + 1])] / contexts[tuple(seq[i - k + 1 : i])] for k in range(1, order + 1)]
            total += math.log10(sum(parts) / (order + 1))
        assert r.score == pytest.approx(total)


def test_learned_weights_raise_held_out_probability(spark):
    docs_ = common.table(spark, SF, "documents").select("doc_id", "text")
    teaches = lm.crc_mod(F.col("doc_id"), 7) != 2
    total = lambda rounds: lm.score_documents(docs_, teaches, rounds=rounds, tuning_one_in=5).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    flat, learned = total(0), total(12)
    assert learned[0] > flat[0] and learned[0] > learned[1]


def test_language_model_of_nothing(spark, empty):  # noqa: F811
    assert lm.score_documents(empty, F.lit(True)).count() == 0
    one = lm.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score, one.held_out) == (3, 0, 0, 0.0, True)


def test_classifier_on_held_out_labels(spark):
    root = SF.replace("0.001", "0.01")
    docs_, labels = common.table(spark, root, "documents"), common.table(spark, root, "labels")
    model = quality.fit(docs_, labels)
    scored = quality.score(docs_, model).join(labels.withColumnRenamed("doc_id", "l"), F.col("doc_id") == F.col("l"))
    rows = scored.where(quality.is_held_out()).select("quality", "score").collect()
    right = sum((r.score >= 0.3) == (r.quality == 1) for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_classifier_edge_cases(spark, docs, empty):  # noqa: F811
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, None), (None, 1), (5, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.score for r in out.where("doc_id in (200, 201, 202)").collect()} == {out.where("doc_id = 200").first().score}
    assert quality.score(empty, model).count() == 0
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).where("score <> 0.5").count() == 0
    assert quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).where("score <= 0.5").count() == 0


def texts_of_words():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"W{x}!" if x % 3 else f"w{x}" for x in rng.integers(0, 300, n)) for n in (0, 1, 50, 700)]
    return [*texts, None, "a" * 100 + "1" * 70 + "Zz " * 3, "\u00e9t\u00e9 x x x"]


def plain_contexts(texts, dim, window=2):
    """Index vectors of neighbours, summed word by word."""
    def index(word):
        rows, places, signs = quality.index_entries([word], dim)
        v = np.zeros(dim)
        for p, s in zip(places[0], signs[0], strict=True):
            v[p] += s
        return int(rows[0]), v

    table = np.zeros((quality.ROWS, dim))
    for text in texts:
        for own in (quality.words_of(text), [quality.shape(w) for w in quality.words_of(text)]):
            for i, word in enumerate(own):
                for j in range(max(0, i - window), min(len(own), i + window + 1)):
                    if j != i:
                        table[index(word)[0]] += index(own[j])[1]
    return table, index


def test_word_vectors_and_network_by_hand(spark):
    texts, dim = texts_of_words(), 16
    table, index = plain_contexts(texts, dim)
    small = quality.Contexts(dim, limit=10)
    for t in texts:
        small.add([t])
    whole = quality.Contexts(dim)
    whole.add(texts)
    assert np.array_equal(whole.counts(), table) and np.array_equal(small.counts(), table)
    docs_ = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    unit = quality.corpus_contexts(docs_.repartition(3), dim)
    assert np.array_equal(unit, quality.unit_rows(table))
    pooled = quality.Pooler(unit, dim).vectors(texts)
    for text, got in zip(texts, pooled, strict=True):
        own = quality.words_of(text)
        want = np.zeros(2 * dim + 4)
        for kind, at in ((own, 0), ([quality.shape(w) for w in own], dim)):
            for word in kind:
                row, v = index(word)
                want[at : at + dim] += (unit[row] + v) / len(own)
        if own:
            want[-4:] = math.log(1 + len(own)) / 10, sum(a == b for a, b in zip(own, own[1:])) / len(own), len(set(own)) / len(own), 1
        assert np.allclose(got, want, atol=1e-5)
    rng = np.random.default_rng(1)
    net = quality.Network(*(rng.normal(size=x) for x in (36, 36, (36, 5), 5, 5)), 0.3, 1.7)
    for x, p in zip(pooled, net.score(pooled), strict=True):
        hidden = [math.tanh(sum((x[i] - net.mean[i]) / net.scale[i] * net.w1[i, j] for i in range(36)) + net.b1[j]) for j in range(5)]
        assert p == pytest.approx(1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + 0.3) / 1.7)))


def test_a_shape_is_of_the_whole_word():
    assert quality.shape(b"a" * 100 + b"1") == b"\x00a0" and quality.shape(b"a1" * 40) == b"\x00" + b"a0" * 40


def test_pieces_and_vocabulary_resets_change_nothing():
    texts = texts_of_words()
    table = quality.unit_rows(plain_contexts(texts, 16)[0])
    whole, cut = quality.Pooler(table, 16).vectors(texts), quality.Pooler(table, 16, piece=37).vectors(texts)
    assert np.allclose(whole, cut, atol=1e-5) and not whole[0].any()


def vectors(spark, n=700, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.2, 3, (n, 1))
    x[100:160] = x[100] * 1.5 + rng.normal(size=(60, dim)) * 0.05
    x[200:230] = x[200]
    x[300:304] *= 1e-30
    rows = [(i, [float(np.float32(v)) for v in x[i]], 0) for i in range(n)]
    bad = [(900, None, 0), (901, [0.0] * dim, 0), (902, [None] + [1.0] * (dim - 1), 0), (903, [float("nan")] * dim, 0), (904, [float("inf")] + [1.0] * (dim - 1), 0), (905, [], 0), (906, [1.0, 2.0], 0), (920, [2.0, 1.0], 0), (None, rows[3][1], 0)]
    return spark.createDataFrame([*rows, *bad, rows[7], rows[7]], "vec_id long, embedding array<float>, label int").withColumns({"score": F.lit(1), "rank": F.lit("x"), "dim": F.lit(2), "id": F.lit(3)})


def test_vector_join_is_exact(spark):
    df = vectors(spark)
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    good = [i for i, (_, e) in enumerate(rows) if e and all(v is not None and math.isfinite(v) for v in e) and any(e)]
    units = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in good}
    units = {i: u / np.linalg.norm(u) for i, u in units.items()}
    links = [(a, b) for a in good for b in good if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9]
    degree, roots = Counter(x for e in links for x in e), union_find(range(len(rows)), links)
    least = {}
    for i, root in roots.items():
        if rows[i][0] is not None:
            least[root] = min(least.get(root, 10**9), rows[i][0])
    want = Counter((rows[i][0], degree[i], least.get(roots[i])) for i in range(len(rows)))
    got = metric_join.near_vectors(df, pivots=6, block=64).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert metric_join.near_vectors(df.limit(0)).count() == 0
    assert [(r.n_links, r.component_id, r.kept) for r in metric_join.near_vectors(df.where("vec_id = 901")).collect()] == [(0, 901, True)]


def test_vector_join_in_double_precision(spark):
    """Pairs a billionth to either side of the threshold, huge components, and dense groups."""
    def pair(cosine, at, dim=6):
        a, b = np.zeros(dim), np.zeros(dim)
        a[at], b[at], b[at + 1] = 1.0, cosine, math.sqrt(1 - cosine * cosine)
        return a, b

    above, below = pair(0.9 + 1e-9, 0), pair(0.9 - 1e-9, 2)
    big = np.array([0, 0, 0, 0, 1e200, 1e200])
    x = [*above, *below, big, big * [1, 1, 1, 1, 1, 0.99], big * 1e-300]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_vectors(df).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3), 4: (2, 4), 5: (2, 4), 6: (2, 4)}
    rng = np.random.default_rng(3)
    near = rng.normal(size=(1, 24)) + rng.normal(size=(1500, 24)) * 0.02
    far = rng.normal(size=(500, 24))
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(np.concatenate([near, far]))], "vec_id long, embedding array<double>")
    got = metric_join.near_vectors(df, block=400).collect()
    assert Counter((r.n_links, r.component_id) for r in got if r.vec_id < 1500) == {(1499, 0): 1500}
    assert all((r.n_links, r.component_id) == (0, r.vec_id) for r in got if r.vec_id >= 1500)


def test_search_recall_and_scores(spark):
    df = vectors(spark, 880)
    rows = {r.vec_id: r.embedding for r in df.select("vec_id", "embedding").collect() if r.vec_id is not None}
    good = {i: np.array(e, float) for i, e in rows.items() if e and all(v is not None and math.isfinite(v) for v in e) and any(e)}
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=10, shard_rows=400, wave_rows=30).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {i for i in good if i % 20 == 0}
    hits = total = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        scores = sorted(((-float(good[q] @ e), i) for i, e in good.items() if i != q and len(e) == len(good[q])))[:10]
        assert [r["rank"] for r in found] == list(range(1, len(scores) + 1))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(r.score == pytest.approx(float(good[q] @ good[r.vec_id]), rel=1e-12) and r.vec_id != q for r in found)
        hits += len({i for _, i in scores} & {r.vec_id for r in found})
        total += len(scores)
    assert hits / total >= 0.9
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall_of_the_registered_query(spark):
    """Unclustered vectors of 64 dimensions, the query's own settings, against all products."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in registry.op2_ann(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.flatnonzero(ids % 20 == 0)
    products = x[asked] @ x.T
    products[np.arange(len(asked)), asked] = -np.inf
    best = ids[np.argsort(-products, 1)[:, :20]]
    assert np.mean([len(got[ids[a]] & set(b.tolist())) / 20 for a, b in zip(asked, best, strict=True)]) >= 0.95


def test_insertion_holds_little_where_hubs_are():
    """One node chosen by a whole batch does not widen the rows of all others that are full."""
    rng = np.random.default_rng(6)
    n, degree = 4096, 20
    x = ann.lift(rng.normal(size=(n, 64)), 20.0)
    x[: n - 512] = x[: n - 512] * np.float32(0.5)
    x[0] = x[n - 512 :].mean(0) * 20  # nearest to every new node
    links = np.full((n, 2 * degree), -1, np.int32)
    links[: n - 512] = rng.integers(0, n - 512, (n - 512, 2 * degree))
    tracemalloc.start()
    ann.insert(x, links, n - 512, n, np.zeros(512, np.int64), degree, 40)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert (links[n - 512 :] == 0).any(1).sum() > 400
    assert most < 60


def test_graph_search_finds_neighbours():
    """Recall within one shard of several thousand nodes, built by insertion in many batches."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5000, 32))
    graph = ann.build_graph([np.array([i]) for i in range(5000)], x, np.linalg.norm(x, axis=1).max(), 20, 40)
    q = rng.normal(size=(100, 32))
    found = graph.ids[ann.search(graph, q, 160)][:, :20]
    best = np.argsort(-(q @ x.T), 1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), best.tolist(), strict=True)]) >= 0.95
    again = ann.Graph.from_bytes(graph.to_bytes())
    assert all(np.array_equal(a, b) for a, b in zip(graph.links, again.links, strict=True))


@pytest.mark.parametrize("shard_rows", [400, 8192])
def test_search_among_many_equal_vectors(spark, shard_rows):
    """A third of the rows are copies of one vector; small groups of copies are the nearest of others."""
    rng = np.random.default_rng(8)
    alone = rng.normal(size=(900, 8))
    alone /= np.linalg.norm(alone, axis=1, keepdims=True)
    hot = np.array([-0.0, 0.0, 3.0, 0, 0, 0, 0, 0])
    x = np.concatenate([np.repeat(hot[None], 900, 0), alone, np.repeat(alone[:30], 30, 0)])
    x[::2][x[::2] == 0] = 0.0
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), e.tolist()) for i, e in zip(ids, x, strict=True)] + [(7, hot.tolist()), (7, hot.tolist())], "vec_id long, embedding array<double>")
    vectors = [(int(i), e) for i, e in zip(ids, x, strict=True)] + [(7, hot)]
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 30 = 0"), shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked = {i: e for i, e in vectors if i % 30 == 0}
    assert set(got) == set(asked)
    hits = 0
    for q, e in asked.items():
        score = {}
        for i, other in vectors:
            if i != q:
                score[i] = max(score.get(i, -np.inf), round(float(e @ other), 9))
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        if np.array_equal(e, hot):
            assert [i for i, _ in got[q]] == want
        hits += len({i for i, _ in got[q]} & set(want))
        assert all(s == pytest.approx(score[i], abs=1e-8) for i, s in got[q])
    assert hits / (20 * len(asked)) >= 0.95


def test_keys_meet_within_the_radius():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**16, (300, 64), np.uint16)
    y = x.copy()
    for row in y:
        at = rng.choice(64, 22, replace=False)
        row[at] += 1
    shared = (minhash.chunk_keys(x, 12, 22)[:, :] == minhash.chunk_keys(y, 12, 22)).any(1)
    assert shared.all()
    assert [minhash.radius_for(85, 64), minhash.radius_for(80, 64)] == [23, 27]


@pytest.mark.parametrize("block", [8, 512])
def test_signatures_connect_as_all_pairs_do(spark, block):
    """Symbols from small alphabets, so that buckets are large and mostly of unlike members."""
    rng = np.random.default_rng(12)
    x = rng.integers(0, 3, (160, 12), np.uint16)
    x[100:140] = x[100]
    x[100:140, 3] = np.arange(40)
    rows = [(int(i) * 7, s.tobytes()) for i, s in enumerate(x)]
    classes = spark.createDataFrame(rows, "class long, signature binary")
    near = [(7 * a, 7 * b) for a in range(160) for b in range(a) if (x[a] != x[b]).sum() <= 3]
    want = union_find({n for e in near for n in e}, near)
    assert {r.node: r.root for r in minhash.similar_signatures(classes, 2, 3, block).collect()} == want


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_texts(spark):
    rng = np.random.default_rng(6)
    base = [f"v{x}" for x in rng.integers(0, 5000, 260)]
    rows, grown = [], list(base)
    for i in range(90):  # a lineage of edits: neighbours are near, ends are not
        grown = list(grown)
        grown[int(rng.integers(0, 260))] = f"n{i}"
        rows.append((i, " ".join(grown)))
    rows += [(100 + i, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 60))) for i in range(40)]
    rows += [(200 + i, "Exact COPY of one text here") for i in range(50)] + [(300, "exact copy of one text here"), (301, "few words"), (302, "FEW words"), (303, "few"), (304, None), (305, ""), (306, "  "), (None, "few words"), (301, "few words"), (100, "another text under the same id")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("node", "root", "class", "signature", "n", "group")})


@pytest.mark.parametrize(("percent", "block"), [(85, 16), (80, 400)])
def test_near_duplicates_are_exact(spark, percent, block):
    rows, df = near_texts(spark)
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    roots = union_find(range(len(rows)), links)
    least = {}
    for i, root in roots.items():
        if rows[i][0] is not None:
            least[root] = min(least.get(root, 10**9), rows[i][0])
    want = Counter((rows[i][0], len(sets[i]), least.get(roots[i])) for i in range(len(rows)))
    got = minhash.near_duplicates(df, percent=percent, signature_block=block, set_block=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    groups = {roots[i] for i in range(len(rows)) if sets[i]}
    for limit in (0, 10**6):
        left = minhash.one_of_each_group(df, percent=percent, signature_block=block, set_block=block, broadcast_rows=limit)
        assert left.columns == df.columns and left.count() == len(groups) + sum(not s for s in sets)


def test_near_duplicates_of_nothing(empty):  # noqa: F811
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.one_of_each_group(empty).count() == 0


def test_pipeline_stages(spark):
    root = SF
    docs_ = common.table(spark, root, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = common.written(stages[0](spark, docs_, root), "t")
    assert kept.columns == docs_.columns and 0 < kept.count() <= docs_.count()
    unique = common.written(stages[1](spark, kept, root), "t")
    assert unique.columns == docs_.columns
    sets = [shingle_set(r.text) for r in unique.collect()]
    assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a))
    mixed = common.written(stages[2](spark, unique, root), "t")
    assert mixed.columns == docs_.columns
    packed = stages[3](spark, mixed, root)
    assert packed.agg(F.sum("n_tokens")).first()[0] == sum(len(words(r.text)) for r in mixed.collect())
    assert corpus_pipeline.run(spark, root).count() == packed.count()


def test_pipeline_stages_on_awkward_rows(spark, docs, empty, tmp_path):  # noqa: F811
    spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(120)] + [(None, 1), (7, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs.withColumns({c: F.lit("x") for c in ("n", "x", "group", "node", "root", "copy", "taken", "place", "width", "batch", "before")})
    stages = [f for _, f in corpus_pipeline.STAGES]
    for stage in stages[:3]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns and 0 < out.count()
        nothing = stage(spark, rows.limit(0), str(tmp_path))
        assert nothing.columns == rows.columns and nothing.count() == 0
    assert stages[3](spark, rows, str(tmp_path)).select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
    assert stages[3](spark, rows.limit(0), str(tmp_path)).count() == 0
    kept = stages[1](spark, rows, str(tmp_path))
    assert kept.where("doc_id in (200, 201, 202)").count() == 3 and kept.where("text = 'same text here'").count() == 1
