"""Audit rows of runs, and what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "run_id string, status string, stage string, sources array<string>, jobs_found int, error string, at timestamp"
MOST_ERROR_CHARS = 4000
# Stages in order with their labels; statuses that end a run, and those that end it well.
STAGES = (
    ("queued", "Queued"), ("loading_resume", "Loading resume"), ("building_queries", "Building search queries"), ("fetching", "Fetching jobs"),
    ("extracting_skills", "Extracting job requirements"), ("embedding", "Embedding job descriptions"), ("scoring", "Scoring matches"),
    ("writing_matches", "Saving matches"), ("explaining", "Writing explanations"), ("done", "Done"),
)
TERMINAL = ("success", "succeeded", "partial", "failed")
SUCCESS = ("success", "succeeded")


def record_run(spark: SparkSession, run_id: str, status: str, stage: str | None, sources: list[str], jobs_found: int = 0, errors: list[str] | None = None, at=None) -> DataFrame:
    """One event of a run, to append: errors are joined by ``; `` and cut."""
    error = "; ".join(errors)[:MOST_ERROR_CHARS] if errors else None
    row = spark.createDataFrame([(run_id, status, stage, sources, jobs_found, error, at)], RUN_SCHEMA)
    return row.withColumn("at", F.coalesce("at", F.current_timestamp()))


def run_state(events: DataFrame) -> DataFrame:
    """The latest event of each run, with when it began."""
    latest = F.max_by(F.struct("status", "stage", "sources", "jobs_found", "error"), F.struct("at", "status")).alias("s")
    return events.groupBy("run_id").agg(latest, F.min("at").alias("started_at"), F.max("at").alias("changed_at")).select("run_id", "s.*", "started_at", "changed_at")


def run_status_from_sources(results: DataFrame) -> DataFrame:
    """run_id, status, jobs_found, error from rows (run_id, source, n_rows, error)."""
    out = results.groupBy("run_id").agg(F.count_if(F.col("error").isNotNull()).alias("bad"), F.sum("n_rows").alias("jobs_found"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "source", "error")))).alias("e"))
    status = F.when((F.col("bad") > 0) & (F.col("jobs_found") == 0), "failed").when(F.col("bad") > 0, "partial").otherwise("success")
    return out.select("run_id", status.alias("status"), F.col("jobs_found").cast("long").alias("jobs_found"), F.nullif(F.substring(F.array_join("e", "; "), 1, MOST_ERROR_CHARS), F.lit("")).alias("error"))


def ingest_report(stored: DataFrame, by: str = "source") -> DataFrame:
    """New and duplicate rows of a run."""
    return stored.groupBy(by).agg(F.count_if("is_new").alias("n_new"), F.count_if(~F.col("is_new")).alias("n_duplicate"), F.count(F.lit(1)).alias("n_stored"))


def run_progress(runs: DataFrame) -> DataFrame:
    """runs with step, total, label, is_terminal, is_success; an unknown stage is step 0."""
    return runs.withColumns({"step": _step(F.col("stage")), "total": F.lit(len(STAGES)), "label": _label(F.col("stage")), "is_terminal": F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False)), "is_success": F.coalesce(F.col("status").isin(*SUCCESS), F.lit(False))})


def _step(stage: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*(F.lit(s) for s, _ in STAGES)), stage), F.lit(0)).cast("int")


def _label(stage: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in STAGES for x in pair)), stage)
