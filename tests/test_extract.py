"""Literal cases of scores, verdicts, reasoning and retrieved documents."""

import time

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import extract, seeded, text

#: Own wordings for each way a reply can state its score, or fail to.
SCORES = [
    ('{"score": 0.35, "reasoning": "polite throughout"}', 0.35), ('Here you go\n```json\n{"score": 0.15}\n```\nbye', 0.15), ('{"score": "0.65"}', 0.65), ("Refund issued in time.\nScore: 0.8", 0.8),
    ("**Score**: **0.55**", 0.55), ("SCORE=0.25", 0.25), ("score:.5", 0.5), ("score : 0", 0.0), ("score: 1.0", 1.0), ("My score for empathy is 0.2, all told", 0.2),
    ("On this criterion the agent is 0.45 at best", 0.45), ("Two refunds, three emails, one call.", None), ("The score. It is 0.9", None),
    ('{"reasoning": "some would say score: 0.95", "score": 0.05}', 0.05), ("score: 0.9 at first sight, but score: 0.6 on the whole", 0.6), ("", None), (None, None), ("   ", None),
    ('{"score": 1.5}', None), ('{"score": -0.5}', None), ("score: 100", None), ("0.4", None), ('{"score": false}', 0.0), ("score: 3, then score: 0.35, then score: -2", 0.35), ("{ unclosed score: 0.75", 0.75), ("} score: 0.1 {", 0.1),
]
VERDICTS = [
    ('{"answer": "B", "reasoning": "shorter"}', "B"), ('{"reasoning": "first\nsecond",\n\n"answer": "A"}', "A"), ("I weighed both.\n\n**Answer**: **B**", "B"),
    ('So:\n```\n{"answer": "A"}\n```', "A"), ('{"answer', None), ('{"answer": " a "}', "A"), ("answer=A", "A"), ("B was kinder than A.", None),
    ("", None), (None, None), ("Answer: B seemed right. Answer: A", "A"), ('{"answer": "neither"}', None), ('{"answer": "AB"}', None), ("answer: Both", None), ('{"answer": true}', None),
]


def values(spark, cases, column):
    rows = [(i, raw) for i, (raw, *_) in enumerate(cases)]
    return [r.v for r in spark.createDataFrame(rows, "i int, raw string").select("i", column(F.col("raw")).alias("v")).orderBy("i").collect()]


def test_long_runs_take_linear_time(spark):
    """A million spaces, braces or stars in one reply: quadratic patterns would take hours."""
    n = 1_000_000
    texts = ["a" + " " * n + "b", "{" * n, "}" * n + "{" * n, "score" + " " * n + "x", "answer " + "*" * n, "score: " + " " * n + "?", "score" + " " * n + ": 0.5"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    began = time.perf_counter()
    got = rows.select("i", extract.extract_score(F.col("t")).alias("s"), extract.extract_verdict(F.col("t")).alias("v"), F.length(extract.stripped(F.col("t"))).alias("n"), text.word_count(F.col("t")).alias("w")).orderBy("i").collect()
    assert time.perf_counter() - began < 40
    assert [r.s for r in got] == [None] * 6 + [0.5] and [r.v for r in got] == [None] * 7 and got[0].n == n + 2


def test_strip_and_braces(spark):
    cases = [("\u3000\x85 a b\u2028\t", "a b"), ("", ""), (" \n ", ""), (None, None), ("x", "x"), ("\u200bx", "\u200bx")]
    assert values(spark, cases, extract.stripped) == [e for _, e in cases]
    cases = [("a{b}c}d", "{b}c}"), ("}{", None), ("{", None), ("é{ü}", "{ü}"), ("", None), (None, None), ("{}", "{}")]
    assert values(spark, cases, extract.outermost_braces) == [e for _, e in cases]


def test_scores(spark):
    assert values(spark, SCORES, extract.extract_score) == [e for _, e in SCORES]


def test_verdicts(spark):
    assert values(spark, VERDICTS, extract.extract_verdict) == [e for _, e in VERDICTS]


@pytest.mark.parametrize(("completion", "content", "reasoning", "expected"), [(82, 12, 247, 78), (281, 12, 928, 277), (50, 200, 0, 0), (100, 0, 9999, 100), (0, 0, 0, 0), (5, 1, 1, 2)])
def test_derived_reasoning(spark, completion, content, reasoning, expected):
    got = spark.range(1).select(extract.derived_reasoning_tokens(*(F.lit(x).cast("long") for x in (completion, content, reasoning)))).first()[0]
    assert got == expected


def test_reasoning_leaves_content(spark):
    got = values(spark, [("a<think>x\ny</think>b<think>z",)], lambda c: extract.split_reasoning(c, F.lit("s")))
    assert (got[0].content, got[0].reasoning) == ("ab", "sx\nyz")


def test_documents(spark):
    listing = "1. First\n   ID: d1\n   Score: 0.5\n   Content: body\n   more\n2. not a document\n3. Third\nID: d3\nScore: -\n"
    got = values(spark, [(listing,), ("none found",), ("x" * 300,), ("ID: broken",), (None,)], extract.retrieved_documents)
    assert [(d.rank, d.doc_id, d.title, d.score) for d in got[0].docs] == [(1, "d1", "First", 0.5), (3, "d3", "Third", None)]
    assert got[0].docs[0].content == "body\n   more"
    assert [(len(g.docs), g.failed) for g in got] == [(2, False), (0, False), (0, True), (0, True), (0, False)]


def test_coin_repeats_the_generator(spark):
    import random

    keys = [f"k{i}" for i in range(50)]
    blank = spark.createDataFrame([(None,)] * 40, "k string").repartition(4).select(seeded.coin("k").alias("c"), seeded.seeded_choice(["a", "b"])("k").alias("o")).distinct()
    assert blank.count() == 1
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", seeded.coin("k").alias("c"), seeded.seeded_choice(["b", "a", "c"])("k").alias("o")).collect()
    assert all(r.c == (random.Random(r.k).random() > 0.5) and r.o == random.Random(r.k).choice(["a", "b", "c"]) for r in got)


def test_text_forms(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(text.clip(F.lit("abcdef"), 4)) == "abcd\n[... truncated, 2 more characters]"
    assert one(text.one_line(F.lit("a  b\n c"), 10)) == "a b c"
    assert one(text.one_line(F.lit("phone number, address of it"), 16)) == "phone number ..."
    assert one(text.word_count(F.lit("a b  c"))) == 3
    assert one(text.sections(Task=F.lit("t"), Empty=F.lit(" "), Other_part=F.lit("o"))) == "## Task\nt\n\n## Other part\no"


def test_replies_are_parsed_once(spark):
    """The reply stands once in the plan: copies of it in nested steps were parsed some hundred times a row."""
    rows = spark.createDataFrame([('Sure:\n```json\n{"bad": " b ", "good": " "}\n```',), ('{"bad": "x", "good": "y"} bye',), ("[1]",), (None,)], "raw string")
    levels = extract.level_map(F.col("raw"), ("bad", "good"))
    told = rows.select(levels.alias("m"), extract.all_levels_filled(extract.level_map(F.col("raw"), ("bad", "good")), ("bad", "good")).alias("all"))
    assert [(r.m["bad"], r.m["good"], r["all"]) for r in told.collect()] == [("b", "", False), ("x", "y", True), ("", "", False), ("", "", False)]
    for column, most in ((extract.json_object, 1), (lambda x: extract.level_map(x, ("bad", "good")), 1), (extract.extract_verdict, 3), (extract.extract_score, 5)):
        plan = spark.range(1).select(F.col("id").cast("string").alias("raw")).repartition(2).select(column(F.col("raw")).alias("v"))._jdf.queryExecution().optimizedPlan()
        assert plan.expressions().apply(0).toString().count("raw#") <= most
