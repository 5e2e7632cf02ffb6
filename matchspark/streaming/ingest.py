"""Incremental ingestion: the batch operators over a stream of landed payloads, and activity with late rows set aside."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchspark.operators.dedupe import upsert_jobs
from matchspark.sources.boards import with_dedup_hash
from matchspark.streaming.store import Store, by_hash, merge, replace

LANDED = "source string, company string, country string, fetched_at timestamp, seq long, payload string"
KEY = ["source", "source_job_id"]
#: Buckets of a table; a batch rewrites those that its keys fall into.
BUCKETS = 64


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that a table holds."""
    return Store(spark, path).read()


def follow_up(spark: SparkSession, table: str, name: str) -> DataFrame | None:
    """What followed the upserts of a table under a name: of each job the rows of its last batch."""
    return Store(spark, f"{table}-{name}").read()


def upsert_batch(spark: SparkSession, table: str, incoming: DataFrame, number: int, then: dict[str, Callable[[DataFrame], DataFrame]] | None = None, buckets: int = BUCKETS) -> None:
    """Upsert postings into a bucketed table, then replace what follows them; only touched buckets are read and written.

    Follow-ups are written once the postings are and each carries the batch's
    number too, so that a batch which is tried again completes what it lacks.
    """
    store = Store(spark, table)

    def combine(current: DataFrame | None, new: DataFrame) -> DataFrame:
        current = new.limit(0).withColumn("job_id", F.lit("")).drop("seq") if current is None else current
        return upsert_jobs(current, new).drop("is_new")

    incoming = with_dedup_hash(incoming).persist()
    stored = merge(store, incoming, by_hash(KEY, buckets), combine, number)
    if then and stored is not None:
        written = stored.hint("merge").join(incoming.select(*KEY).distinct(), KEY, "left_semi").persist()
        for name, make in then.items():
            follower = Store(spark, f"{table}-{name}")
            if not follower.done(number):
                replace(follower, make(written), written.select("job_id"), "job_id", buckets, number)
            follower.vacuum()
        written.unpersist()
    incoming.unpersist()
    store.vacuum()


def incremental_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, normalise: Callable[[DataFrame], DataFrame], watermark: str = "7 days", then: dict[str, Callable[[DataFrame], DataFrame]] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Read what is new in ``landing`` (JSON of LANDED rows) and upsert it to ``table``.

    ``normalise`` turns landed rows to postings with source, source_job_id,
    fetched_at and seq. A record that is delivered twice is dropped; the state for
    that holds only keys within the watermark, and payloads fetched before it are
    too late. ``then`` names what follows an upsert (passages, skills, scores):
    each function takes the stored rows that the batch wrote, and its rows (with
    job_id) replace those that the same jobs had (``follow_up`` reads them).
    """
    rows = spark.readStream.schema(LANDED).json(landing)
    payload = F.xxhash64("payload").alias("payload_hash")
    fresh = rows.select("*", payload).withWatermark("fetched_at", watermark).dropDuplicatesWithinWatermark(["source", "fetched_at", "seq", "payload_hash"]).drop("payload_hash")

    def write(batch: DataFrame, number: int) -> None:
        upsert_batch(batch.sparkSession, table, normalise(batch), number, then, buckets)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(events: DataFrame, watermark: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by hour and type, late rows up to the watermark; the same columns in batch and stream."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def activity_stream(events: DataFrame, table: str, checkpoint: str, delay: timedelta = timedelta(minutes=10), length: timedelta = timedelta(hours=1)) -> StreamingQuery:
    """A stream of events (ts, event_type, value) into a table of counts and sums by window and type, and one of late rows.

    A batch's watermark is the newest event of the batches before it less the
    delay. A row is late if its window had ended by then: it goes to the side
    table (``late_rows``) with the batch's number, and to no window, so that
    windows that have ended never change. All others are added to their windows,
    which lie in buckets by day; a batch rewrites the days that it adds to, and
    nothing is held between batches but that table.
    """
    seconds, wait = int(length.total_seconds()), int(delay.total_seconds())

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, table)
        high = store.manifest()["meta"].get("high")
        if store.done(number):
            return
        batch = batch.where("ts is not null").withColumn("start", F.window("ts", f"{seconds} seconds")["start"]).persist()
        ended = F.lit(False) if high is None else F.unix_timestamp("start") + seconds <= F.lit(high - wait)
        batch.where(ended).drop("start").write.mode("overwrite").parquet(f"{table}-late/batch={number}")
        added = batch.where(~ended).groupBy("start", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

        def combine(current: DataFrame | None, new: DataFrame) -> DataFrame:
            both = new if current is None else current.unionByName(new)
            return both.groupBy("start", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

        # whole seconds, down: windows end on whole seconds, and one has not ended before its end
        newest = batch.agg(F.max(F.floor(F.col("ts").cast("double")))).first()[0]
        merge(store, added, F.floor(F.unix_timestamp("start") / 86400).cast("int"), combine, number, {"high": max(x for x in (high, newest) if x is not None)} if newest is not None else None)
        store.vacuum()
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ended_windows(spark: SparkSession, table: str, delay: timedelta = timedelta(minutes=10), length: timedelta = timedelta(hours=1)) -> DataFrame | None:
    """The windows that no later row can change."""
    store = Store(spark, table)
    rows, high = store.read(), store.manifest()["meta"].get("high")
    return None if rows is None else rows.where(F.unix_timestamp("start") + int(length.total_seconds()) <= high - int(delay.total_seconds()))


def late_rows(spark: SparkSession, table: str) -> DataFrame:
    """Rows that came after their window had ended, by batch."""
    return spark.read.parquet(f"{table}-late")
