"""Scans of the model's files. All schemas are declared; file names carry keys where noted."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from typing import Any, Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks import schemas
from gaugeworks.operators.keyed import attach_answers, checked, guarded_lookup, latest

#: Endings of files that stand beside trajectories and are none. Fixed values.
BOOKKEEPING = (
    ".pairs.json", "judge_votes.json", "dataset.json", "summary.json", "rejects.json", "pair_index.json", "pipeline_run.json",
    "usage_checkpoints.json", "generated_instructions.json",
)


def json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Records of JSON files that hold one array (or one object) each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def answers_path(dataset: str) -> str:
    """eval_dataset.json has its answers in eval_answers.json, any other file in <stem>_answers."""
    head, slash, name = dataset.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    own = "eval_answers.json" if name == "eval_dataset.json" else f"{stem}_answers{dot}{suffix}" if dot else f"{suffix}_answers"
    return f"{head}{slash}{own}"


def keyed_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers by id; of repeated ids the last in file order wins."""
    rows = json_array(spark, path, schemas.ANSWERS).withColumn("__seq", F.monotonically_increasing_id())
    return latest(rows, ["id"], "__seq")


def labelled_pairs(spark: SparkSession, dataset: str, answers: str | None = None) -> DataFrame:
    """The dataset with its labels; a pair without a label is an error."""
    pairs = json_array(spark, dataset, schemas.PAIR)
    return attach_answers(pairs, keyed_answers(spark, answers or answers_path(dataset)))


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """The append-only log; blank and half-written lines are dropped. ``seq`` orders rows as they
    were appended: by append, then row; lines that no ``append_log`` wrote come first, by file."""
    rows = spark.read.schema(f"{schemas.LOGGED_CALL}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.withColumn("seq", log_order()).where("_bad is null and id is not null").drop("_bad", "append", "row")


def log_order(scanned: bool = True) -> Column:
    """struct(append, file, split, row): the place of a line in the log. A stream can't number rows
    (``scanned`` false): there, lines that no ``append_log`` wrote are ordered by file and split."""
    at = F.coalesce("row", F.monotonically_increasing_id() if scanned else F.lit(0).cast("long"))
    file = F.when(F.col("append").isNull(), F.col("_metadata.file_name")).otherwise("")
    split = F.when(F.col("append").isNull(), F.col("_metadata.file_block_start")).otherwise(0)
    return F.struct(F.coalesce("append", F.lit("")).alias("append"), file.alias("file"), split.alias("split"), at.alias("row"))


def log_progress(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the last score of each task, all usage records): a null score is usage but no progress."""
    done = latest(log.where("score is not null").select("label", "id", "key", "run", "score", "seq"), ["label", "id", "key", "run"], "seq")
    return done, log.where("usage is not null").select("usage.*")


def _name() -> Column:
    return F.col("_metadata.file_name")


def pair_files(spark: SparkSession, root: str, schema: str = schemas.PAIR) -> DataFrame:
    """Pairs of <root>/pairs and <root>, with the file's name and the position, which ascends within
    a file; of a name in both, pairs/ wins."""
    frames = [f for f in (_glob(spark, f"{root}/{d}*.pairs.json", schema, rank) for rank, d in enumerate(("pairs/", ""))) if f is not None]
    if not frames:
        return spark.createDataFrame([], f"{schema}, file string, position bigint")
    every = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    best = every.groupBy("file").agg(F.min("__rank").alias("__best"))
    return every.join(best, "file").where(F.col("__rank") == F.col("__best")).drop("__rank", "__best")


def _glob(spark: SparkSession, pattern: str, schema: str, rank: int) -> DataFrame | None:
    try:
        rows = json_array(spark, pattern, schema)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise
    return rows.select("*", _name().alias("file"), F.monotonically_increasing_id().alias("position"), F.lit(rank).alias("__rank"))


def draw_of_file(file: Column) -> tuple[Column, Column]:
    """(cell key, attempt) of a pair file's name <key>[.aN].pairs.json."""
    attempt = F.regexp_extract(file, r"\.a(\d+)\.pairs\.json$", 1)
    return F.regexp_replace(file, r"(\.a\d+)?\.pairs\.json$", ""), F.when(attempt == "", 1).otherwise(attempt.try_cast("int"))


def cell_of_file(file: Column) -> Column:
    """The first three dotted parts of a file's name."""
    return F.array_join(F.slice(F.split(file, "[.]"), 1, 3), ".")


def point_lookup(pairs: DataFrame, key: str, attempt: int) -> DataFrame:
    """One cell's draw: the first record of its file."""
    own_key, own_attempt = draw_of_file(F.col("file"))
    return pairs.where((own_key == key) & (own_attempt == attempt)).orderBy("position").limit(1).drop("position")


def trajectories(spark: SparkSession, root: str) -> DataFrame:
    """Trajectories of <root>/trajectories if it holds any, else of <root>; bookkeeping files are
    left out either way."""
    for at in (f"{root}/trajectories", root):
        found = _glob(spark, f"{at}/*.json", schemas.TRAJECTORY, 0)
        if found is not None:
            for ending in BOOKKEEPING:
                found = found.where(~F.col("file").endswith(ending))
            found = found.drop("__rank", "position")
            if at == root or not found.isEmpty():
                return found
    return spark.createDataFrame([], f"{schemas.TRAJECTORY}, file string")


def simulations(spark: SparkSession, path: str, schema: str, tasks: DataFrame) -> DataFrame:
    """Saved simulations with their task; one whose task_id is unknown is an error when read."""
    return guarded_lookup(json_array(spark, path, schema), tasks, "task_id")


def having_artifact(cells: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Cells for which an artifact of the same key exists."""
    return cells.join(found.select(*keys), keys, "left_semi")


def results(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all <label>.results.json, with the label."""
    label = F.regexp_extract(_name(), r"^(.*)\.results\.json$", 1)
    return json_array(spark, f"{root}/*.results.json", schemas.RESULT).withColumn("label", label)


def flat_runs(rows: DataFrame) -> DataFrame:
    return rows.select("label", "id", "criterion_name", "correct_response", F.explode("runs").alias("r")).select("label", "id", "criterion_name", "correct_response", "r.*")


def annotations(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all panel_*/annotator_*.json, with panel and annotator from the path."""
    path = F.col("_metadata.file_path")
    rows = json_array(spark, f"{root}/panel_*/annotator_*.json", schemas.ANNOTATION)
    return rows.select("*", F.regexp_extract(path, r"/(panel_[^/]*)/", 1).alias("panel"), F.regexp_extract(path, r"/(annotator_[^/]*)\.json$", 1).alias("annotator"))


def votes(spark: SparkSession, path: str) -> DataFrame:
    """The votes array inside an object."""
    fields = ", ".join(f"{n}:{t}" for n, t in (c.split(" ") for c in schemas.VOTE.split(", ")))
    return json_array(spark, path, f"votes array<struct<{fields}>>").select(F.explode("votes").alias("v")).select("v.*")


def or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file's records, or an empty relation of the same schema if it is missing or corrupt."""
    try:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return spark.createDataFrame([], schema)
        raise
    return rows


def criteria(spark: SparkSession, path: str) -> DataFrame:
    """Criteria; a missing name, an empty description or a repeated name is an error when read."""
    rows = json_array(spark, path, schemas.CRITERION)
    counted = rows.groupBy("name").agg(F.max("description").alias("description"), F.count("*").alias("n"))
    bad = F.col("name").isNull() | (F.trim(F.coalesce("description", F.lit(""))) == "") | (F.col("n") > 1)
    return checked(counted, ~bad, F.concat(F.lit("bad criterion "), F.coalesce("name", F.lit("?")))).select("name", "description")


def strict_config(given: dict[str, Any], defaults: dict[str, Any]) -> dict[str, Any]:
    """Defaults overridden by ``given``; unknown keys are errors, judges must be judge1 and judge2."""
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    merged = defaults | given
    judges = merged.get("judges")
    if judges is not None:
        if sorted(j["name"] for j in judges) != ["judge1", "judge2"]:
            raise ValueError("judges must be judge1 and judge2")
        merged["judges"] = sorted(judges, key=lambda j: j["name"])
    return merged


def yaml_config(spark: SparkSession, path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """A YAML file's settings over the defaults, as ``strict_config`` takes them; an empty file gives
    the defaults, anything but a mapping is an error."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    given = yaml.safe_load(text)
    if given is not None and not isinstance(given, dict):
        raise ValueError(f"{path} holds no settings")
    return strict_config(given or {}, defaults)


def credentials(wanted: dict[str, tuple[str, ...]], env: Mapping[str, str] | None = None) -> list[str]:
    """The providers all of whose variables are set and not blank; values are never read out."""
    env = os.environ if env is None else env
    return sorted(p for p, names in wanted.items() if all(env.get(n, "").strip() for n in names))


def call_settings(base: dict[str, Any], extra: dict[str, Any]) -> dict[str, Any]:
    """Settings of a call: extra ones win, None removes."""
    return {k: v for k, v in (base | extra).items() if v is not None}


class Scorer(Protocol):
    """What answers a scoring call: a client, a replayed log or a stub. None: no score."""

    def __call__(self, label: str, prompt: str, response: str) -> float | None: ...


def live_scores(tasks: DataFrame, make: Callable[[], Scorer]) -> DataFrame:
    """Scores of ``tasks`` (label, id, side, run, prompt, response) by an injected scorer, one per
    partition. An exception is a failed call: null score, its kind and message kept; ValueError
    (a reply without a score) is marked as not worth repeating."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for batch in batches:
            out = []
            for row in batch.itertuples():
                try:
                    out.append((row.label, row.id, row.side, row.run, scorer(row.label, row.prompt, row.response), None, False))
                except ValueError as e:
                    out.append((row.label, row.id, row.side, row.run, None, f"{type(e).__name__}: {str(e)[:200]}", False))
                except Exception as e:  # noqa: BLE001  any failure of the service is recorded
                    out.append((row.label, row.id, row.side, row.run, None, f"{type(e).__name__}: {str(e)[:200]}", True))
            yield pd.DataFrame(out, columns=["label", "id", "side", "run", "score", "error", "transient"])

    ids = dict(tasks.dtypes)["id"]
    return tasks.mapInPandas(run, f"label string, id {ids}, side int, run int, score double, error string, transient boolean")


def replayed(tasks: DataFrame, log: DataFrame) -> DataFrame:
    """``tasks`` with the last logged score of their (label, response), null where there is none: a
    join, so a log of any size is replayed without being shipped to every task."""
    last = log.groupBy("label", "response").agg(F.max_by("score", "seq").alias("score"))
    return tasks.join(last, ["label", "response"], "left").select("label", "id", "side", "run", "score")
