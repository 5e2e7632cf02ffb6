"""Queries over streams; each gives what the batch form gives."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.operators import chunk, extract
from matchspark.operators.dedupe import first_per_key
from matchspark.plans.mapping import table
from matchspark.sources import boards
from matchspark.streaming import ingest
from matchspark.tables import new_folder


def activity_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type, in batch."""
    return ingest.windowed_activity(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def _hours(rows: DataFrame) -> DataFrame:
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def streamed_activity(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream of the event files."""
    out = new_folder(spark, "stream")
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    ingest.activity_stream(stream.select("ts", "event_type", "value"), f"{out}/hours", f"{out}/state").awaitTermination()
    return _hours(ingest.latest(spark, f"{out}/hours"))


def _with_late_rows(spark: SparkSession, d: str) -> str:
    """Events in three deliveries: the early days, the later ones, and what was held back of both; the folder of the hours."""
    out = new_folder(spark, "stream")
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "event_type", "value")
    held = F.col("event_id") % 10 == 0
    early = F.dayofmonth("ts") <= 10
    for part in (~held & early, ~held & ~early, held):
        events.where(part).write.mode("append").parquet(f"{out}/landing")
        stream = spark.readStream.schema(events.schema).parquet(f"{out}/landing")
        ingest.activity_stream(stream, f"{out}/hours", f"{out}/state", timedelta(hours=6)).awaitTermination()
    return f"{out}/hours"


def activity_in_time(spark: SparkSession, d: str) -> DataFrame:
    """Ended hours of three deliveries, without the rows that came after their hour had ended."""
    return _hours(ingest.ended_windows(spark, _with_late_rows(spark, d), timedelta(hours=6)))


def late_activity(spark: SparkSession, d: str) -> DataFrame:
    """The rows that came too late."""
    return ingest.late_rows(spark, _with_late_rows(spark, d)).select("event_id", "event_type")


def _ingested(spark: SparkSession, d: str, then: dict | None = None) -> str:
    """Orders landed as board payloads in three deliveries, each read as a stream and upserted by key; the table's folder."""
    base = new_folder(spark, "stream")
    o = table(spark, d, "orders")
    posting = F.to_json(F.struct(F.array(F.struct(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("&lt;p&gt;"), F.col("o_orderstatus"), F.lit("&lt;/p&gt;")).alias("content"))).alias("jobs")))
    landed = o.select(F.lit("board").alias("source"), F.lit("acme").alias("company"), F.lit("us").alias("country"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"), F.col("o_orderkey").alias("seq"), posting.alias("payload"))

    def normalise(batch: DataFrame) -> DataFrame:
        # the newest payload of each posting within the batch, then its time beside the posting
        keyed = batch.withColumn("source_job_id", F.concat_ws(":", "company", F.get_json_object("payload", "$.jobs[0].id")))
        newest = first_per_key(keyed, ["source_job_id"], [F.desc("fetched_at"), F.desc("seq")])
        return boards.normalize_company_board(newest.select("company", "payload")).hint("merge").join(newest.select("source_job_id", "fetched_at", "seq"), "source_job_id")

    year = F.year("fetched_at")
    for part in (year <= 1994, (year > 1994) & (year <= 1996), year > 1996):
        landed.where(part).write.mode("append").json(f"{base}/landing")
        ingest.incremental_ingest(spark, f"{base}/landing", f"{base}/jobs", f"{base}/state", normalise, "30 days", then, buckets=8).awaitTermination()
    return f"{base}/jobs"


def streamed_ingest(spark: SparkSession, d: str) -> DataFrame:
    return ingest.latest(spark, _ingested(spark, d)).select("source_job_id", "title", "description")


def streamed_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages and skills of the postings that a stream wrote, made in its batches."""
    index = spark.createDataFrame([(x.lower(), x, x) for x in ("F", "O", "P")], "surface string, skill_id string, name string")
    found = lambda rows: extract.extract_skills(rows.select("job_id", F.col("description").alias("text")), index)
    jobs = _ingested(spark, d, {"passages": chunk.chunk_jobs, "skills": found})
    passages, skills = ingest.follow_up(spark, jobs, "passages"), ingest.follow_up(spark, jobs, "skills")
    both = passages.hint("merge").join(skills.select("job_id", F.col("name").alias("skill"), "requirement"), "job_id")
    ids = ingest.latest(spark, jobs).select("job_id", "source_job_id")
    return both.hint("merge").join(ids, "job_id").select(F.col("source_job_id").alias("job_id"), "chunk_index", "text", "skill", "requirement")


QUERIES = {f.__name__: f for f in (activity_by_hour, streamed_activity, activity_in_time, late_activity, streamed_ingest, streamed_passages)}
_BY_HOUR = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"
#: A row of any delivery is late if its hour had ended six hours before the newest row of the deliveries before it.
_LATE = """WITH e AS (SELECT *, date_trunc('hour', ts) AS start, CASE WHEN event_id % 10 = 0 THEN 3 WHEN day(ts) <= 10 THEN 1 ELSE 2 END AS delivery FROM events WHERE ts IS NOT NULL),
newest AS (SELECT delivery, max(ts) AS ts FROM e GROUP BY 1), marks AS (SELECT d.delivery, (SELECT max(ts) FROM newest n WHERE n.delivery < d.delivery) - INTERVAL 6 HOUR AS closed, (SELECT max(ts) FROM newest) - INTERVAL 6 HOUR AS ended FROM newest d),
marked AS (SELECT e.*, ended, coalesce(start + INTERVAL 1 HOUR <= closed, false) AS late FROM e JOIN marks USING (delivery)) """
ORACLE_SQL = {
    "activity_in_time": _LATE + "SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM marked WHERE NOT late AND start + INTERVAL 1 HOUR <= ended GROUP BY 1, 2",
    "late_activity": _LATE + "SELECT event_id, event_type FROM marked WHERE late",
    "activity_by_hour": _BY_HOUR,
    "streamed_activity": _BY_HOUR,
    "streamed_ingest": "SELECT 'acme:' || o_custkey AS source_job_id, o_orderpriority AS title, o_orderstatus AS description FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "streamed_passages": "SELECT 'acme:' || o_custkey AS job_id, 0 AS chunk_index, o_orderstatus AS text, o_orderstatus AS skill, 'required' AS requirement FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
}
