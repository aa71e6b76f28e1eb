"""Stored results: prediction table, run records, condition summaries, report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kappaloom.functions.ids import CONDITION, experiment_id, parse_experiment_ids
from kappaloom.operators.conditions import Grid
from kappaloom.operators.joins import lookup_join
from kappaloom.session import materialize, path_exists
from kappaloom.sources import manifest
from kappaloom.sources.manifest import has_manifest

PREDICTION_SCHEMA = (
    "dataset string, model string, shot_type string, length string, context_level string, "
    "run_idx int, run_id string, item_id long, gold string, raw string, attempts int, "
    "error string, pred string, stage string, seconds double"
)
PARTITION = [*CONDITION, "run_idx"]

RUN_RECORD_SCHEMA = (
    "run_id string, part int, item_ids array<long>, test_labels array<string>, "
    "raw_outputs array<string>, predictions array<string>, elapsed_seconds double"
)
RECORD_ITEMS = 10_000

SUMMARY_SCHEMA = (
    "exp_id string, best_run_idx int, "
    "best_metrics struct<accuracy: double, precision: double, recall: double, f1: double, "
    "kappa: double>, "
    "consistency struct<mean_kappa: double, std_kappa: double, icc: double, "
    "kappas_per_run: array<double>>, _corrupt_record string"
)
METRIC_FIELDS = {
    "best_metrics": ("kappa", "accuracy", "precision", "recall", "f1"),
    "consistency": ("mean_kappa", "std_kappa", "icc"),
}


def append_predictions(preds: DataFrame, path: str) -> None:
    """Append finished rows to the prediction table, one folder per condition and run.

    The rebalance hint groups rows by folder and splits or merges the groups to
    the advisory size, so neither many tiny files nor one huge one appear. The manifest
    makes the rows visible at once or not at all; ``compact_predictions`` merges many small appends. Rows without ``seconds`` have a null.
    """
    if "seconds" not in preds.columns:
        preds = preds.withColumn("seconds", F.lit(None).cast("double"))
    columns = [f.split()[0] for f in PREDICTION_SCHEMA.split(", ")]
    manifest.append(preds.select(*columns), path, PARTITION)


def compact_predictions(spark: SparkSession, path: str) -> int:
    """Merge the appends whose files are small; returns how many were merged."""
    return manifest.compact(spark, path, PREDICTION_SCHEMA, PARTITION)


def drop_predictions(spark: SparkSession, path: str, grid: Grid) -> None:
    """Remove the folders of all runs of the grid, whether or not new rows will come."""
    if not has_manifest(spark, path):
        return
    folders = []
    for _, *condition in grid.rows():
        folder = "/".join(f"{name}={value}" for name, value in zip(CONDITION, condition))
        folders += [f"{folder}/run_idx={run}" for run in range(grid.n_runs)]
    manifest.drop_partitions(spark, path, folders)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The prediction table; filters on condition columns skip whole folders."""
    if not has_manifest(spark, path):  # one plain write
        return spark.read.schema(PREDICTION_SCHEMA).parquet(path)
    return manifest.read(spark, path, PREDICTION_SCHEMA)


def saved_predictions(spark: SparkSession, path: str) -> DataFrame | None:
    """The prediction table, or None where nothing was saved yet."""
    return read_predictions(spark, path) if path_exists(spark, path) else None


def run_records(preds: DataFrame, record_items: int = RECORD_ITEMS) -> DataFrame:
    """Interchange form: parallel arrays per run and part, in item order within a part.

    A record is built inside one task, so every run comes in parts of about ``record_items``
    items, numbered from 0. The prediction table is the form for large results; this one is
    for exchange. ``elapsed_seconds`` is what the requests of the part took one after another; an
    answer that several items share counts for each of them, as in a run that asks them all.
    """
    if "seconds" not in preds.columns:
        preds = preds.withColumn("seconds", F.lit(None).cast("double"))
    sizes = materialize(preds.groupBy("run_id").agg(F.count("*").alias("_n")), "run_sizes")
    parts = F.ceil(F.col("_n") / F.lit(record_items))
    cell = F.struct("item_id", "gold", "raw", "pred")
    return (
        lookup_join(preds.select("run_id", "item_id", "gold", "raw", "pred", "seconds"), sizes, ["run_id"])
        .withColumn("part", F.pmod(F.xxhash64("item_id"), parts).cast("int"))
        .groupBy("run_id", "part")
        .agg(F.array_sort(F.collect_list(cell)).alias("c"), F.sum("seconds").alias("elapsed_seconds"))
        .select(
            "run_id", "part",
            F.col("c.item_id").alias("item_ids"), F.col("c.gold").alias("test_labels"),
            F.col("c.raw").alias("raw_outputs"), F.col("c.pred").alias("predictions"),
            "elapsed_seconds",
        )
    )


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines, a record each, with nulls kept inside arrays; replaces the folder."""
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_run_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per item of stored run records: run_id, part, pos, item_id, gold, raw, pred.

    ``multi_line`` reads files that hold one record each, laid out over several lines.
    """
    records = spark.read.schema(RUN_RECORD_SCHEMA).option("multiLine", multi_line).json(path)
    # Records without item ids, and arrays cut short, still line up by position.
    places = F.transform("test_labels", lambda _, i: i.cast("long"))
    cells = F.arrays_zip(
        F.coalesce("item_ids", places).alias("item_id"), F.col("test_labels").alias("gold"),
        F.coalesce("raw_outputs", F.array().cast("array<string>")).alias("raw"),
        F.coalesce("predictions", F.array().cast("array<string>")).alias("pred"),
    )
    return records.where(F.col("run_id").isNotNull()).select(
        "run_id", F.coalesce("part", F.lit(0)).alias("part"), F.posexplode(cells).alias("pos", "c"),
    ).select("run_id", "part", "pos", "c.item_id", "c.gold", "c.raw", "c.pred")


def run_seconds(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(run_id, elapsed_seconds) of stored run records, all parts of a run added up; null where none says."""
    records = spark.read.schema(RUN_RECORD_SCHEMA).option("multiLine", multi_line).json(path)
    return records.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(
        F.sum("elapsed_seconds").alias("elapsed_seconds"))


def write_summaries(summary: DataFrame, path: str) -> None:
    """Condition summaries as nested JSON, a line each; replaces the folder."""
    columns = ["best_run_idx", "best_metrics", "consistency"]
    if "exp_id" not in summary.columns:
        summary = summary.withColumn("exp_id", experiment_id())
    write_records(summary.select("exp_id", *columns), path)


def _summary_files(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    return (
        spark.read.schema(SUMMARY_SCHEMA).option("multiLine", multi_line)
        .option("pathGlobFilter", "*.json").json(path)
    )


def read_metrics(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The five condition columns and eight metrics of every readable summary.

    Unreadable records and malformed ids drop out, ``unreadable_summaries`` counts them; a
    missing id is the file name without its ending; missing or undefined metrics are null.
    ``multi_line`` reads files that hold one summary each, laid out over several lines.
    """
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    readable = _summary_files(spark, path, multi_line).where(F.col("_corrupt_record").isNull()).withColumn(
        "exp_id", F.coalesce("exp_id", stem)
    )
    metrics = [
        F.nullif(F.col(f"{group}.{m}"), F.lit(float("nan"))).alias(m)
        for group, names in METRIC_FIELDS.items() for m in names
    ]
    return parse_experiment_ids(readable).select(*CONDITION, *metrics)


def unreadable_summaries(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(file, records, named): what ``read_metrics`` had to leave out, and how much of it has an id."""
    files = _summary_files(spark, path, multi_line).withColumn("file", F.col("_metadata.file_name"))
    return files.where(F.col("_corrupt_record").isNotNull()).groupBy("file").agg(
        F.count("*").alias("records"), F.count("exp_id").alias("named"))


def write_report_csv(report: DataFrame, path: str) -> None:
    """One CSV file with header; a report has a handful of rows."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
