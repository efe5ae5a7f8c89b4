"""Planning of cells: the grid, balanced gaps, seeded agents, what a prior index decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gap names with their (worse, better) levels. Fixed values.
GAPS = {"narrow_low": ("bad", "ok"), "narrow_high": ("ok", "good"), "wide": ("bad", "good")}
#: Levels in ascending order. Fixed values.
LEVELS = ("bad", "ok", "good")


def cell_grid(domains: DataFrame, criteria: DataFrame) -> DataFrame:
    """One cell per domain, criterion and task index; ``domains``: domain, n_tasks. The criteria
    are a short configured list."""
    tasks = domains.withColumn("task_index", F.explode(F.sequence(F.lit(0), F.col("n_tasks") - 1)))
    cells = tasks.crossJoin(F.broadcast(criteria.select("criterion")))
    return cells.select("domain", "criterion", "task_index", cell_key().alias("key"))


def cell_key() -> Column:
    return F.concat_ws(".", F.col("domain"), F.col("criterion"), F.concat(F.lit("t"), F.col("task_index")))


def balanced_gaps(cells: DataFrame, seed: str) -> DataFrame:
    """Gaps dealt in turn over each criterion's cells in a seeded order: counts differ by one at
    most. The order within a criterion is numbered in two levels, so no task holds a criterion."""
    place = F.sha2(F.concat_ws(":", F.lit(seed), "criterion", "key"), 256)
    cells = cells.withColumn("place", place).withColumn("part", F.substring("place", 1, 2))
    inside = F.row_number().over(Window.partitionBy("criterion", "part").orderBy("place")) - 1
    sizes = cells.groupBy("criterion", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("criterion").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("criterion", "part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = cells.withColumn("inside", inside).join(sizes, ["criterion", "part"])
    names = F.array(*(F.lit(g) for g in GAPS))
    gap = F.element_at(names, ((F.col("before") + F.col("inside")) % len(GAPS) + 1).cast("int"))
    return numbered.withColumn("gap_name", gap).drop("place", "part", "inside", "before")


def gap_counts(cells: DataFrame) -> DataFrame:
    """All gap names with their number of cells, 0 included."""
    names = cells.sparkSession.createDataFrame([(g,) for g in GAPS], "gap_name string")
    return names.join(cells.groupBy("gap_name").agg(F.count("*").alias("n")), "gap_name", "left").select("gap_name", F.coalesce("n", F.lit(0)).alias("n"))


def with_prior(cells: DataFrame, index: DataFrame) -> DataFrame:
    """Gap and agent stored for a cell win over freshly planned ones."""
    stored = index.select("key", F.col("gap_name").alias("old_gap"), F.col("agent").alias("old_agent"))
    out = cells.join(stored, "key", "left")
    return out.withColumns({"gap_name": F.coalesce("old_gap", "gap_name"), "agent": F.coalesce("old_agent", "agent")}).drop("old_gap", "old_agent")


def gap_of_levels(a: Column, b: Column) -> Column:
    """wide if the two levels are more than one step apart, else adjacent."""
    order = F.array(*(F.lit(x) for x in LEVELS))
    apart = F.abs(F.array_position(order, a) - F.array_position(order, b))
    return F.when(apart > 1, "wide").otherwise("adjacent")


def gap_name(levels: Column) -> Column:
    """The gap of two levels in either order; '?' for any other pair."""
    wanted = F.array_join(F.array_sort(levels), "-")
    name = F.lit("?")
    for gap, pair in GAPS.items():
        name = F.when(wanted == "-".join(sorted(pair)), gap).otherwise(name)
    return F.coalesce(name, F.lit("?"))


def same_context(pair_key: Column, key_1: Column, key_2: Column) -> Column:
    """Whether a pair and both its trajectories carry one context key."""
    return (pair_key == key_1) & (key_1 == key_2)


def hashed_choice(key: Column, options: list[str]) -> Column:
    """A choice by md5 of the key, the same in any engine."""
    at = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % len(options)
    return F.element_at(F.array(*(F.lit(o) for o in options)), (at + 1).cast("int"))


def hashed_coin(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % 2 == 1


def assign_slots(pairs: DataFrame, coin: Column) -> DataFrame:
    """``pairs`` (better, worse, better_level, worse_level) in slots: the better one first where
    the coin says so; levels and the label follow."""
    pick = lambda a, b: F.when(coin, F.col(a)).otherwise(F.col(b))
    return pairs.withColumns({
        "response_1": pick("better", "worse"), "response_2": pick("worse", "better"),
        "levels": F.array(pick("better_level", "worse_level"), pick("worse_level", "better_level")),
        "correct_response": F.when(coin, 1).otherwise(2),
    })


def join_sides(trajectories: DataFrame) -> DataFrame:
    """The worse and the better trajectory of each cell, refused unless both exist and share their
    context: columns key, worse, better, problem."""
    side = lambda level, name: trajectories.where(F.col("level") == F.col(level)).select("key", F.col("trajectory_id").alias(name), F.col("context_key").alias(f"{name}_context"))
    keys = trajectories.select("key").distinct()
    both = keys.join(side("worse_level", "worse"), "key", "left").join(side("better_level", "better"), "key", "left")
    problem = F.when(F.col("worse").isNull() | F.col("better").isNull(), "incomplete").when(F.col("worse_context") != F.col("better_context"), "context differs")
    return both.select("key", "worse", "better", problem.alias("problem"))


def roster_resolution(roster: DataFrame, gateways: list[str], credentials: list[str]) -> DataFrame:
    """Where each evaluator of the roster is called: status run, rerouted or dropped, with a note.

    ``roster``: label, provider, via_gateway (whether a gateway offers it). A provider with a
    credential is called directly; else through a gateway; else the row is dropped with a reason.
    """
    direct = F.col("provider").isin(credentials) if credentials else F.lit(False)
    other = F.col("via_gateway") & F.lit(bool(gateways))
    status = F.when(direct, "run").when(other, "rerouted").otherwise("dropped")
    note = F.when(direct, "").when(other, F.concat(F.lit("via "), F.lit(gateways[0] if gateways else ""))).otherwise(F.concat(F.lit("no credential for "), F.col("provider")))
    return roster.withColumns({"status": status, "note": note})
