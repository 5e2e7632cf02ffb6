import dataclasses
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.operators import whole_run
from matchspark.operators.score import Config
from matchspark.plans.runs import LETTERS, letter_counts
from matchspark.schema import JOB_COLUMNS, RESUME
from matchspark.tables import FREES, freed

SETTINGS = whole_run.Settings(Config(cos_lo=0.0, cos_hi=1.0), letter_counts, len(LETTERS), most_explained=1)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def profiles(spark, *rows):
    schema = T.StructType([T.StructField("resume_id", T.LongType()), T.StructField("parsed", RESUME), T.StructField("name", T.StringType())])
    return spark.createDataFrame([(i, ("A", None, None, 3.0, skills, [], [], []), "clash") for i, skills in rows], schema)


def vocabulary(spark):
    return spark.createDataFrame([("1", "Kafka", ["kfk"], True), ("2", "Spark", [], True)], "skill_id string, name string, aliases array<string>, active boolean")


def postings(spark, source, *rows):
    """key, title, description."""
    given = spark.createDataFrame([(source, k, t, d) for k, t, d in rows], "source string, source_job_id string, title string, description string")
    rest = {c: F.lit(None).cast(kind) for c, kind in JOB_COLUMNS.items() if c not in given.columns}
    return given.withColumns(rest).withColumn("company", F.lit("Acme")).select(*JOB_COLUMNS)


def failing(queries):
    raise OSError("no route\nto host")


def found(out):
    jobs = out.jobs.select("job_id", "source", "source_job_id")
    return {(r["resume_id"], r["source"], r["source_job_id"]): r for r in out.matches.join(jobs, "job_id").collect()}


def run(spark, folder, sources, people=((1, ["Kafka", "Airflow"]),), **more):
    return whole_run.run(spark, folder, "r", profiles(spark, *people), sources, vocabulary(spark), settings=more.pop("settings", SETTINGS), **more)


def test_run_of_two_sources_one_failing(spark, folder):
    a = postings(spark, "a", ("1", "Engineer", "Kafka and Airflow"), ("2", "Clerk", None))
    b = postings(spark, "b", ("7", "engineer", "Spark"), ("8", "Analyst", "Spark"))
    out = run(spark, folder, {"b": lambda q: b, "a": lambda q: a, "c": failing}, ((1, ["Kafka", "Airflow"]), (2, [])))
    assert (out.status, out.error) == ("partial", "c: no route")
    rows = found(out)
    assert set(rows) == {(1, "a", "1"), (1, "a", "2"), (1, "b", "8")}  # b's 7 is the same posting as a's 1; profile 2 has no skill
    assert [r["reasons"] for r in out.rejected.collect()] == [["neither skills nor experience"]]
    assert rows[1, "a", "1"]["skill_recall"] == 1.0 and rows[1, "a", "1"]["parsed_count"] == 2  # the profile brought Airflow into the vocabulary
    assert rows[1, "a", "2"]["skills_unparsed"] and rows[1, "b", "8"]["skill_recall"] == 0.0
    assert [k for k, r in rows.items() if r["explanation"]] == [(1, "a", "1")]
    events = out.events.orderBy("at").collect()
    assert [e["stage"] for e in events] == ["loading_resume", "building_queries", "fetching", "extracting_skills", "embedding", "scoring", "writing_matches", "explaining", "done"]
    assert events[-1]["status"] == "partial" and events[-1]["jobs_found"] == 3 and events[-1]["error"] == "c: no route"


def test_run_is_taken_up_where_it_stopped(spark, folder):
    a = postings(spark, "a", ("1", "Engineer", "Kafka"))
    calls = []

    def fetch(queries):
        calls.append(1)
        return a

    def broken(texts):
        raise RuntimeError("model is gone")

    with pytest.raises(Exception, match="model is gone"):
        run(spark, folder, {"a": fetch}, settings=whole_run.Settings(SETTINGS.config, letter_counts, len(LETTERS), broken))
    last = spark.read.parquet(f"{folder}/events").orderBy(F.desc("at")).first()
    assert (last["stage"], last["status"]) == ("explaining", "failed") and "model is gone" in last["error"]
    out = run(spark, folder, {"a": fetch}, settings=whole_run.Settings(SETTINGS.config, letter_counts, len(LETTERS), lambda prompts: [f"{p.splitlines()[0]}." for p in prompts]))
    assert len(calls) == 1 and out.status == "success"
    assert found(out)[1, "a", "1"]["explanation"] == "Posting: Engineer."


def test_a_second_run_adds_to_the_first(spark, folder):
    a = postings(spark, "a", ("1", "Engineer", "Kafka"), ("2", "Clerk", "Spark"))
    first = run(spark, f"{folder}/1", {"a": lambda q: a})
    told = first.matches.withColumn("explanation", F.when(F.col("explanation").isNotNull(), "as told"))
    # posting 1 comes again with another text: it keeps skills and passages that it has, and its explanation
    again = postings(spark, "a", ("1", "Engineer", "Kafka, new"), ("3", "Lead", "Kafka"))
    stored = whole_run.Stored(first.jobs.drop("is_new"), first.job_skills, first.passages, told)
    out = run(spark, f"{folder}/2", {"a": lambda q: again}, stored=stored)
    rows = found(out)
    assert set(rows) == {(1, "a", k) for k in "123"}
    assert rows[1, "a", "1"]["explanation"] == "as told" and rows[1, "a", "2"]["explanation"] is None
    assert {(r["source_job_id"], r["is_new"]) for r in out.jobs.collect()} >= {("1", False), ("3", True)}
    assert out.job_skills.count() == 3 and out.passages.groupBy("job_id").count().where("count > 1").isEmpty()


def test_no_source_delivers_and_nothing_found(spark, folder):
    out = run(spark, f"{folder}/1", {"c": failing})
    assert (out.status, out.error, out.matches) == ("failed", "c: no route", None)
    empty = run(spark, f"{folder}/2", {"a": lambda q: postings(spark, "a", ("1", "x", "y")).limit(0)})
    assert empty.status == "success" and empty.matches.isEmpty() and empty.jobs.isEmpty()


def test_pairs_are_written_once_and_never_dealt(spark, folder):
    a = postings(spark, "a", ("1", "Engineer", "Kafka and Airflow"), ("2", "Clerk", None), ("3", "Analyst", "Spark"))
    settings = dataclasses.replace(SETTINGS, carried=("source", "source_job_id"))
    out = run(spark, folder, {"a": lambda q: a}, ((1, ["Kafka", "Airflow"]), (2, ["Spark"])), settings=settings)
    rows = {(r["resume_id"], r["source"], r["source_job_id"]): r for r in out.matches.collect()}
    assert set(rows) == {(i, "a", k) for i in (1, 2) for k in "123"}
    assert {k for k, r in rows.items() if r["explanation"]} == {(1, "a", "1"), (2, "a", "3")}
    sizes = {t: spark.read.parquet(f"{folder}/{t}").count() for t in os.listdir(folder) if {"resume_id", "job_id"} <= set(spark.read.parquet(f"{folder}/{t}").columns)}
    assert sizes == {"scored": 6, "best": 2, "explained": 2}
    assert "hashpartitioning" not in out.matches._jdf.queryExecution().executedPlan().toString()
    assert out.matches.select("created_at").distinct().collect() == out.matches.select("created_at").distinct().collect()


def test_carried_columns_of_stored_matches_stay(spark, folder):
    settings = dataclasses.replace(SETTINGS, carried=("source_job_id",), most_explained=2)
    first = run(spark, f"{folder}/1", {"a": lambda q: postings(spark, "a", ("1", "Engineer", "Kafka"), ("2", "Clerk", "Spark"))}, settings=settings)
    told = first.matches.withColumn("explanation", F.when(F.col("explanation").isNotNull(), "as told"))
    stored = whole_run.Stored(first.jobs.drop("is_new"), first.job_skills, first.passages, told)
    out = run(spark, f"{folder}/2", {"a": lambda q: postings(spark, "a", ("1", "Engineer", "Kafka, new"), ("3", "Lead", "Kafka"))}, stored=stored, settings=settings)
    said = {r["source_job_id"]: r["explanation"] for r in out.matches.collect()}
    assert (said["1"], said["2"]) == ("as told", "as told") and said["3"] not in (None, "as told")
    assert out.matches.columns == first.matches.columns and spark.read.parquet(f"{folder}/2/best").count() == 1


def test_many_explanations_are_joined_by_a_shuffle(spark, folder, monkeypatch):
    monkeypatch.setattr(whole_run, "MOST_SENT", 0)
    out = run(spark, folder, {"a": lambda q: postings(spark, "a", ("1", "Engineer", "Kafka"), ("2", "Clerk", "Spark"))})
    assert {k: r["explanation"] is not None for k, r in found(out).items()} == {(1, "a", "1"): True, (1, "a", "2"): False}
    assert os.path.isdir(f"{folder}/matches")


def test_freed_is_set_within_only(spark):
    before = spark.conf.get(FREES)
    with pytest.raises(KeyError), freed(spark):
        assert spark.conf.get(FREES) == "true"
        raise KeyError
    assert spark.conf.get(FREES) == before
