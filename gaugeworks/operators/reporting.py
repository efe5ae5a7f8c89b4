"""What reports and run records need around the metrics: lanes, rosters, run totals, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.planning import GAPS


def lane(model: Column, override: Column | None = None) -> Column:
    """The provider before the first slash, the whole name without one; a roster's lane wins."""
    own = F.substring_index(model, "/", 1)
    return own if override is None else F.coalesce(override, own)


def lane_caps(roster: DataFrame, caps: DataFrame, dedicated: int = 2) -> DataFrame:
    """Configured caps of the roster's lanes, and ``dedicated`` for each dep: lane."""
    lanes = roster.select("lane").distinct()
    own = lanes.where("lane like 'dep:%'").withColumn("cap", F.lit(dedicated))
    return caps.join(lanes, "lane", "left_semi").where("lane not like 'dep:%'").unionByName(own)


def lane_counts(roster: DataFrame) -> DataFrame:
    return roster.groupBy("lane").agg(F.count("*").alias("n"))


def unknown_fields(record: Column, modelled: tuple[str, ...]) -> Column:
    """Of a map of all fields, those that the model has no column for."""
    return F.map_filter(record, lambda k, _: ~k.isin(*modelled))


def overlapped(stages: DataFrame) -> DataFrame:
    """Stages that share a wall clock have none of their own."""
    return stages.withColumns({"wall_s": F.lit(None).cast("double"), "concurrency": F.lit(None).cast("double"), "out_tps": F.lit(None).cast("double"), "interval": F.lit("overlapped")})


def not_greedy(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("temperature", F.lit(0.0)) != 0)


def failed(cells: DataFrame, width: int = 60) -> DataFrame:
    return cells.where("state = 'failed'").select("key", F.substring("detail", 1, width).alias("detail"))


def with_unreachable(rows: DataFrame, cold: DataFrame) -> DataFrame:
    """Summary rows, and a row of label, kind and error for each evaluator that never answered."""
    return rows.unionByName(cold.select("label", "kind", "error"), allowMissingColumns=True)


def with_usage(results: DataFrame, usage: DataFrame) -> DataFrame:
    """Results with their usage, which may be absent."""
    return results.join(usage, "label", "left")


def of_roster(roster: DataFrame, results: DataFrame) -> DataFrame:
    """Results of the roster's labels in its order; others are ignored."""
    return F.broadcast(roster.select("label", "position")).join(results, "label").orderBy("position")


def cumulative(runs: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals over all invocations, and each datapoint as its last invocation left it.

    ``runs``: run_id, wall_s, n_calls, total_tokens; ``parts``: seq, key, and what is known of it.
    """
    totals = runs.agg(F.count("*").alias("n_invocations"), F.round(F.sum("wall_s"), 1).alias("session_wall_s"), F.sum("n_calls").alias("n_calls"), F.sum("total_tokens").alias("total_tokens"))
    rest = [c for c in parts.columns if c not in ("key", "seq")]
    last = parts.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("x")).select("key", "x.*")
    return totals, last


def merged_maps(old: Column, new: Column) -> Column:
    """Union of two maps by key, the new one's values winning."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def run_ratios(totals: DataFrame) -> DataFrame:
    """Simulations are two a task; pairs are what was kept or rejected."""
    pairs = F.col("kept") + F.col("rejected")
    return totals.withColumns({"n_sims": 2 * F.col("n_tasks"), "pairs": pairs, "sims_per_pair": F.try_divide(2 * F.col("n_tasks"), pairs)})


def file_counts(files: DataFrame) -> DataFrame:
    """Pair files, and cells: distinct first three dotted parts of their names."""
    cell = F.array_join(F.slice(F.split("file", "[.]"), 1, 3), ".")
    return files.agg(F.count("*").alias("n_pairs"), F.count_distinct(cell).alias("n_cells"))


def dataset_balance(pairs: DataFrame) -> DataFrame:
    """Pairs per domain and criterion: how many such cells, the least and the most."""
    per = pairs.groupBy("domain", "criterion").agg(F.count("*").alias("n"))
    return per.agg(F.count_distinct("domain").alias("domains"), F.count_distinct("criterion").alias("criteria"), F.count("*").alias("cells"), F.min("n").alias("least"), F.max("n").alias("most"))


def lost_pairs(failures: DataFrame) -> DataFrame:
    """Distinct (label, id) among calls that still fail."""
    return failures.agg(F.count_distinct("label", "id").alias("lost"))


def in_gap_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.array_position(F.array(*(F.lit(g) for g in GAPS)), F.col("gap")))


def first_rows(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first ``n`` rows of a stable order."""
    return rows.orderBy(*keys).limit(n)


def shuffled(rows: DataFrame, seed: str, key: str) -> DataFrame:
    """A seeded order that does not depend on how the rows are stored."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), key), 256))


def listed_problems(problems: DataFrame, n: int = 20) -> DataFrame:
    """The first problems, each with the count of all."""
    total = problems.agg(F.count("*").alias("n_problems"))
    return first_rows(problems, n, "key").crossJoin(F.broadcast(total))


def reduced_replies(attempts: DataFrame, parsed: Column) -> DataFrame:
    """Per pair and judge: the answer of the last attempt, the reasoning of the last that parsed."""
    at = F.when(parsed & (F.coalesce("reasoning", F.lit("")) != ""), F.col("attempt"))
    return attempts.groupBy("id", "judge").agg(
        F.max("attempt").alias("attempts"), F.max_by("answer", "attempt").alias("answer"),
        F.coalesce(F.max_by(F.when(at.isNotNull(), F.col("reasoning")), at), F.max_by("reasoning", "attempt")).alias("reasoning"))


def document_order(results: DataFrame) -> DataFrame:
    """Distinct document ids of a conversation in the order in which they first appear."""
    first = results.groupBy("conv", "doc_id").agg(F.min("index").alias("index"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("index", "doc_id"))
    return first.withColumn("place", place).select("conv", "doc_id", "place")


def baseline_instruction(criteria: DataFrame, level: str) -> DataFrame:
    """Each criterion's instruction for a level; one without is an error when read."""
    text = F.try_element_at("instructions", F.lit(level))
    return criteria.select("name", F.coalesce(text, F.raise_error(F.concat(F.lit(f"no {level} instruction for "), F.col("name")))).alias("instruction"))


def table_lines(rows: DataFrame, spec: list[tuple[str, int, int | None]], order: list[Column]) -> DataFrame:
    """``rows`` as lines of a text table, in order: place (0 is the head) and line.

    ``spec``: column, width, and digits after the point for numbers (None for text, which is aligned
    left); a missing value is a dash. Tables are reports of a roster, so they are ordered in one task.
    """
    def cell(name: str, width: int, digits: int | None) -> Column:
        shown = F.col(name).cast("string") if digits is None else F.format_string(f"%.{digits}f", F.col(name).cast("double"))
        shown = F.coalesce(F.when(F.col(name).isNotNull(), shown), F.lit("-"))
        return F.rpad(shown, width, " ") if digits is None else F.lpad(shown, width, " ")

    head = "  ".join(n.ljust(w)[:w] if d is None else n.rjust(w)[:w] for n, w, d in spec)
    body = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    body = body.select("place", F.rtrim(F.concat_ws("  ", *(cell(*x) for x in spec))).alias("line"))
    return rows.sparkSession.createDataFrame([(0, head.rstrip())], "place int, line string").unionByName(body)
