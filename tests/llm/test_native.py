"""Sharding, mixing, packing, chat and archives against brute force, with awkward rows."""

import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import chat, mixing, packing, registry, sharding, warc
from tests.oracle import assert_equal, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, extra=""):
    """Nulls, empty and long texts, repeats, a hot source, and columns with clashing names."""
    rows = [(i, f"w{i} " * (1 + i * 7 % 50), "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(120)]
    rows += [(5, "same text here", "en", "hot", 0)] * 40 + [(None, "no id", "en", None, None), (200, None, None, "s1", None), (201, "", "en", None, 0), (202, " \n\t", "en", "s2", 0), (203, "long " * 30000, "en", "s3", 0)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("shard", "size", "slot", "batch", "width", "score", "bucket", "target", "rank", "block")})


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_shards_are_near_equal_and_slots_gapless(spark, docs):
    rows = sharding.shard_by_bytes(docs.where("coalesce(doc_id, 0) <> 203"), 5).collect()
    assert len(rows) == 164 and {"lang", "source", "batch"} <= set(rows[0].asDict())
    per, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 16 and r.law == "bytes"
        per[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(per.values()) - min(per.values()) <= 2 * max(r.size for r in rows)


def test_a_hot_row_is_divided(spark):
    rows = spark.createDataFrame([(1, "copy")] * 1000, "doc_id long, text string")
    per = Counter(r.shard for r in sharding.shard_by_bytes(rows, 4).collect())
    assert sum(per.values()) == 1000 and len(per) == 4 and min(per.values()) > 150


@pytest.mark.parametrize("limit", [0, 10**6])
def test_many_ranges_make_a_shard(spark, limit):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 5).alias("text"))
    got = sharding.shard_by_bytes(rows, 3, task_bytes=4096, broadcast_rows=limit).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == [0, 1, 2] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    ordered = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert ordered == [r.doc_id for r in rows.orderBy(F.xxhash64("text"), "doc_id").collect()]


def test_splitters_meet_their_targets(spark):
    rng = np.random.default_rng(0)
    h, d, size = rng.integers(-(2**63), 2**63, 3000), np.arange(3000), rng.integers(16, 400, 3000)
    keys = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(h, d, size)], "h long, d long, bytes long")
    cuts = sharding.find_splitters(keys, 8, 0.01, 15)
    place = cuts.place(h, d, np.zeros(3000))
    per = np.bincount(place, weights=size, minlength=8)
    assert len(per) == 8 and np.abs(per - size.sum() / 8).max() <= 2 * (0.01 * size.sum() / 8 + 400)


def targets(sizes, cap=3):
    """Targets by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, left, fixed = sum(sizes.values()), set(order), {}
    while True:
        open_total = total - sum(fixed.values())
        share = {s: open_total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > cap * sizes[s]}
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}
        left -= over


def test_mix_meets_its_targets(docs):
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = targets(dict(sizes))
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    total = sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= 20 + 0.001 * total for s in want)
    key = lambda rs: sorted((repr((r.doc_id, r.copy, r.source, r.taken)) for r in rs))
    assert key(rows) == key(mixing.taken_words(docs.repartition(7)).collect())
    assert key(rows) == key(mixing.taken_words(docs, broadcast_sources=0).collect())


@pytest.mark.parametrize("blocks", [50, 1000, 1 << 20])
@pytest.mark.parametrize("broadcast_sources", [0, 100_000])
def test_small_sources_meet_their_own_targets(spark, blocks, broadcast_sources):
    """However coarse the schedule: sources of 1 to 60 words beside one of 40,000."""
    rows = [(i, "word " * 100, "en", "big", 0) for i in range(400)]
    rows += [(1000 + i, "w " * (1 + i % 20), "en", f"s{i % 37:02}", 0) for i in range(111)] + [(2000, "", "en", "void", 0)]
    small = spark.createDataFrame(rows, DOCS)
    sizes, taken = Counter(), Counter()
    for r in mixing.taken_words(small, blocks=blocks, broadcast_sources=broadcast_sources).collect():
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = targets({s: n for s, n in sizes.items()})
    assert sum(n == 0 for n in sizes.values()) == 1
    assert {s: (taken[s], want[s]) for s in want if abs(taken[s] - want[s]) > 1} == {}
    slots = [r.slot for r in mixing.plan_mix(small, blocks=blocks).slots.collect()]
    assert sorted(slots) == list(range(len(slots)))


def test_schedule_is_even_in_every_prefix(docs):
    plan = mixing.plan_mix(docs, blocks=2000)
    share = {r.source_no: r.target / r.total for r in plan.sources.collect()}
    slots = [r.source_no for r in plan.slots.orderBy("slot").collect()]
    seen = Counter()
    for i, s in enumerate(slots, 1):
        seen[s] += 1
        if i % 50 == 0:
            assert all(abs(seen[k] - i * v) <= 6 for k, v in share.items())
    blocks = defaultdict(list)
    for r in plan.slots.collect():
        blocks[r.source_no].append(r.block)
    assert all(sorted(b) == list(range(len(b))) for b in blocks.values())


def test_mixed_documents_keep_columns(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    assert times[200] == times[201] == times[202] == 1 and max(times[i] for i in range(120) if i != 5) <= 3


def test_empty_tables(spark, empty):
    assert sharding.shard_by_bytes(empty).count() == 0
    assert mixing.taken_words(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    none = spark.createDataFrame([], "conv_id long, call_id string, turn long, name string, arguments string, after string, content string")
    assert chat.link_tool_calls(none, none, {}).count() == 0


@pytest.mark.parametrize("n_buckets", [1, 2, 3])
def test_widths_are_optimal(n_buckets):
    from itertools import combinations

    lengths, counts = np.array([1, 2, 5, 6, 9, 14]), np.array([7, 1, 4, 4, 2, 1])

    def waste(widths):
        return sum(c * (min(w for w in widths if w >= x) - x) for x, c in zip(lengths, counts))

    best = min(waste((*w, 14)) for w in combinations(lengths[:-1], n_buckets - 1))
    assert waste(packing.best_widths(lengths, counts, n_buckets)) == best


def test_batches_hold_all_words_within_budget(docs):
    rows = packing.pack(docs, max_len=64, n_buckets=4, token_budget=256, part_rows=50).collect()
    batches, pieces = defaultdict(list), Counter()
    for r in rows:
        assert r.padding == r.width - r.n_tokens >= 0
        batches[r.batch].append(r)
        pieces[r.doc_id] += r.n_tokens
    for b in batches.values():
        assert sorted(r.place for r in b) == list(range(len(b))) and len(b) * b[0].width <= 256
    full = defaultdict(list)
    for name, b in batches.items():
        full[b[0].width].append(len(b))
    assert all(sum(n < 256 // w for n in ns) <= 1 for w, ns in full.items())
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len((r.text or "").split())
    assert pieces == want


def test_rows_without_id_spread_over_parts(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    assert packing.segments(rows, 64).agg(F.count_distinct("__place")).first()[0] == 3000
    got = packing.pack(rows, token_budget=30, part_rows=100).collect()
    batches = defaultdict(list)
    for r in got:
        batches[r.batch].append(r.place)
    assert len(got) == 3000 and all(sorted(b) == list(range(10)) for b in batches.values())


def test_argument_rules(spark):
    """Integers by value, unknown arguments, allowed values, and the order of keys."""
    schema = {"f": {"n": ("integer", False), "x": ("number", False), "mode": ("string", False, ('"a"', '"b"')), "on": ("boolean", False)}}
    cases = {
        '{"n":1}': "", '{"n":1.0}': "", '{"n":1e3}': "", '{"n":1.5}': "type:n", '{"n":123456789012345678901234567890}': "", '{"n":"1"}': "type:n", '{"x":1}': "", '{"x":0.5}': "",
        '{"mode":"b"}': "", '{"mode":"c"}': "value:mode", '{"z":1,"n":1.5,"a":null}': "type:n;unexpected:a;unexpected:z", "{}": "", "null": "not_an_object",
    }
    calls = spark.createDataFrame([(1, str(i), i, "f", c, None) for i, c in enumerate(cases)], "conv_id long, call_id string, turn long, name string, arguments string, after string")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {int(r.call_id): r.problems for r in chat.link_tool_calls(calls, results, schema).collect()}
    assert got == dict(enumerate(cases.values()))
    texts = spark.createDataFrame([('{"\ufffd":1,"\U0001f600":2,"b":{"z":1.50,"a":[]},"B":0}',)], "t string")
    assert texts.select(chat.canonical(F.col("t"))).first()[0] == '{"B":0,"b":{"a":[],"z":1.5},"\U0001f600":2,"\ufffd":1}'


def test_long_texts_and_clashing_names_in_chat(spark):
    long = "é\"\\" * 400_000
    calls = spark.createDataFrame([(1, "a", 0, "ask", json.dumps({"text": long, "words": 1}), None)], "conv_id long, call_id string, turn long, name string, arguments string, after string")
    results = spark.createDataFrame([(1, "a", 1, long)], "conv_id long, call_id string, turn long, content string")
    for c in ("json", "level", "problems", "n_calls", "n_results", "status", "rc", "x"):
        calls, results = calls.withColumn(c, F.lit("clash")), results.withColumn(c, F.lit(7))
    row = chat.link_tool_calls(calls, results, registry.CHAT_SCHEMAS).first()
    assert json.loads(row.json)["arguments"]["text"] == long == json.loads(row.json)["result"]
    assert (row.status, row.n_calls, row.n_results) == ("linked", 1, 1)


def test_calls_meet_results(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "ask", '{"words": 2, "text": "x"}', None), (1, "b", 2, "ask", '{"text":"y","words":1}', "a"), (1, "c", 4, "ask", '{"text": 5, "words": 1}', "b"),
        (1, "d", 6, "ask", "not json", "missing"), (1, "e", 8, "other", "{}", None), (1, "x", 9, "ask", '{"words":1,"words":2}', "y"), (1, "y", 10, "ask", "[1]", "x"),
        (1, None, 11, "ask", None, None), (None, "a", 1, "ask", '{"text":"z","words":0,"language":null}', None), (1, "a", 0, "ask", '{"words": 2, "text": "x"}', None),
    ], "conv_id long, call_id string, turn long, name string, arguments string, after string")
    results = spark.createDataFrame([(1, "a", 1, "r1"), (1, "a", 3, "r2"), (1, "b", 1, 'say "hi"\n'), (1, "z", 5, "lost"), (None, "a", 2, "n")], "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id): r for r in chat.link_tool_calls(calls.withColumn("status", F.lit(1)), results, registry.CHAT_SCHEMAS).collect()}
    assert len(got) == 10
    a, b = got[1, "a"], got[1, "b"]
    assert (a.status, a.level, a.problems, a.n_calls, a.n_results) == ("linked", 0, "", 2, 2)
    assert a.json == '{"arguments":{"text":"x","words":2},"call_id":"a","conversation":1,"name":"ask","result":"r1","status":"linked"}'
    assert (b.status, b.level) == ("early", 1) and json.loads(b.json)["result"] == 'say "hi"\n'
    assert (got[1, "c"].level, got[1, "c"].problems) == (2, "type:text")
    assert (got[1, "d"].level, got[1, "d"].problems, json.loads(got[1, "d"].json)["arguments"]) == (0, "not_an_object", "not json")
    assert got[1, "e"].problems == "unknown_tool" and got[1, "x"].level is None and got[1, "y"].level is None
    assert got[1, "z"].status == "orphan" and got[1, "z"].problems is None
    assert got[1, None].status == "unanswered" and got[None, "a"].status == "linked"


def test_long_chains_take_few_rounds(spark):
    n = 500
    calls = spark.createDataFrame([(1, f"c{i}", f"c{i - 1}" if i else None) for i in range(n)], "conv_id long, call_id string, after string")
    assert {r.call_id: r.level for r in chat.levels(calls).collect()} == {f"c{i}": i for i in range(n)}


def test_magic_in_payload_is_rejected(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "u", fake), (2, "u\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", "<p>é</p>"), (5, "u", ""), (None, "u", "null id"), (7, "u", fake + "x"), (7, "u", "tie"), (7, "u", "tie"), (6, "u", "tie")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    rows = warc.round_trip(df, with_payload=True).collect()
    assert Counter(r.page_id for r in rows) == Counter(p[0] for p in pages)
    by = {(r.page_id, r.record_type): r for r in rows}
    assert bytes(by[1, "response"].payload).decode() == fake and by[2, "revisit"].refers_to == 4 and by[3, "revisit"].refers_to == 5
    assert by[2, "revisit"].payload_bytes == len("<p>é</p>".encode()) and by[6, "revisit"].refers_to == 7
    assert sum(r.record_type == "response" for r in rows if r.page_id == 7) == 3
    assert by[4, "response"].payload_digest == by[2, "revisit"].payload_digest == by[4, "response"].declared_digest


def test_archives_are_read_by_splits(spark, tmp_path):
    """Records across splits, payloads of several MB, magics and line ends at any place in them."""
    rng = np.random.default_rng(2)
    fake = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    parts = ["x" * 700, "\r\n", "\r\n\r\n", "\nWARC/1.", "WARC/1.0\r\n", fake, "é", "\n"]
    htmls = ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 12))) for _ in range(300)]
    htmls += ["WARC/1.1\r\nContent-Length: 1\r\n\r\n", "m" * 5_000_000 + fake, fake * 2000]
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").withColumn("url", F.lit("http://h/WARC/1.1"))
    for name, some, size in (("small", "page_id < 300", "3000b"), ("large", "page_id >= 300", "400000b"), ("all", "true", "128m")):
        path = f"file://{tmp_path}/{name}"
        own = df.where(some)
        warc.write_warc(own.coalesce(1), path, min_bytes=1 << 40)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = warc.read_warc(spark, path).select("record_id", "payload", "payload_digest", "declared_digest").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert Counter((r.record_id, bytes(r.payload).decode()) for r in got) == Counter((f"<urn:page:{r.page_id}>", r.html) for r in own.collect())
        assert all(r.payload_digest == r.declared_digest for r in got)


def test_broken_archives(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r%d>\r\nContent-Length: 3\r\n\r\na\xffc\r\n\r\n"
    files = {"whole": record % 1 + record % 2, "cut": record % 3 + (record % 4)[:-2], "late": b"junk" + record % 5, "none": b"", "gap": record % 6 + b"x\r\n" + record % 7, "text": b"plain text"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert {r.record_id for r in got} == {"<r1>", "<r2>", "<r3>"}
    assert {bytes(r.payload) for r in got} == {b"a\xffc"}


def test_pointer_jumping_follows_the_chain():
    rng = np.random.default_rng(1)
    starts = np.concatenate([[0], np.cumsum(rng.integers(10, 50, 300))])
    real = [(int(a), int(b)) for a, b in zip(starts, starts[1:])]
    false = [(int(a) + 3, int(b)) for a, b in real[::3]] + [(int(a) + 5, int(a) + 7) for a, _ in real[::4]]
    links = real + false
    rng.shuffle(links)
    kept = warc.reachable(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert sorted(x for x, k in zip(links, kept) if k) == real
    assert not warc.reachable(np.array([4]), np.array([9])).any() and len(warc.reachable(np.zeros(0, int), np.zeros(0, int))) == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    assert_equal(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name])
