import datetime
import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from matchspark.operators import chunk
from matchspark.streaming import ingest
from matchspark.streaming.store import Store, by_hash, merge, rebucket, replace

POSTING = "source string, source_job_id string, title string, company string, location string, description string, fetched_at timestamp, seq long"


def day(d):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)


def posting(i, title, d=1):
    return ("s", str(i), title, "acme", "Oslo", f"{title} text", day(d), 0)


def folders(table):
    return {os.path.relpath(d, table) for d, _, names in os.walk(f"{table}/data") if any(n.startswith("part-") for n in names)}


def test_a_batch_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    table = str(tmp_path / "jobs")
    ingest.upsert_batch(spark, table, spark.createDataFrame([posting(i, "a") for i in range(300)], POSTING), 0, buckets=16)
    before = folders(table)
    ingest.upsert_batch(spark, table, spark.createDataFrame([posting(7, "b", 2), posting(999, "c", 2)], POSTING), 1, buckets=16)
    new = folders(table) - before
    assert len(before) == 16 and 1 <= len(new) <= 2 and all(f.startswith("data/v=1/") for f in new)
    rows = {r.source_job_id: r for r in ingest.latest(spark, table).collect()}
    assert len(rows) == 301 and rows["7"].title == "b" and rows["999"].title == "c" and rows["8"].title == "a"
    assert len(Store(spark, table).manifest()["buckets"]) == 16


def test_a_batch_that_is_tried_again_changes_nothing(spark, tmp_path):
    table = str(tmp_path / "jobs")
    for number, title in ((0, "a"), (0, "lost"), (1, "b"), (0, "lost")):
        ingest.upsert_batch(spark, table, spark.createDataFrame([posting(1, title)], POSTING), number, {"passages": chunk.chunk_jobs}, buckets=4)
    assert [r.title for r in ingest.latest(spark, table).collect()] == ["b"]
    assert [r.text for r in ingest.follow_up(spark, table, "passages").collect()] == ["b text"]


def test_a_write_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "jobs")
    ingest.upsert_batch(spark, table, spark.createDataFrame([posting(1, "a")], POSTING), 0, buckets=4)
    store = Store(spark, table)
    monkeypatch.setattr("matchspark.streaming.store.json", SimpleNamespace(dumps=lambda *_: 1 / 0, loads=json.loads))
    with pytest.raises(ZeroDivisionError):
        merge(store, spark.createDataFrame([posting(1, "b")], POSTING), by_hash(ingest.KEY, 4), lambda old, new: new, 1)
    monkeypatch.undo()
    assert [r.title for r in store.read().collect()] == ["a"] and not store.done(1)
    ingest.upsert_batch(spark, table, spark.createDataFrame([posting(1, "c")], POSTING), 1, buckets=4)
    assert [r.title for r in store.read().collect()] == ["c"]


def test_old_versions_go_and_readers_of_the_last_stay(spark, tmp_path):
    table = str(tmp_path / "jobs")
    for n in range(5):
        ingest.upsert_batch(spark, table, spark.createDataFrame([posting(i, f"t{n}") for i in range(20)], POSTING), n, buckets=2)
    assert folders(table) == {f"data/v={v}/bucket={b}" for v in (3, 4) for b in (0, 1)}
    assert sorted(os.listdir(f"{table}/manifest")) == ["v=3", "v=4"]
    assert {r.title for r in ingest.latest(spark, table).collect()} == {"t4"}


def test_rebucketing_keeps_the_rows(spark, tmp_path):
    table = str(tmp_path / "jobs")
    ingest.upsert_batch(spark, table, spark.createDataFrame([posting(i, "a") for i in range(50)], POSTING), 0, buckets=2)
    store = Store(spark, table)
    rebucket(store, by_hash(ingest.KEY, 8))
    assert len(store.manifest()["buckets"]) == 8 and store.read().count() == 50 and store.done(0) and not store.done(1)
    ingest.upsert_batch(spark, table, spark.createDataFrame([posting(3, "b")], POSTING), 1, buckets=8)
    assert store.read().where("title = 'b'").count() == 1 and store.read().count() == 50


def test_keys_without_rows_lose_what_they_had(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame(list(x), "job_id string, n int")
    replace(store, rows(("a", 1), ("a", 2), ("b", 3)), rows(("a", 0), ("b", 0)), "job_id", 4, 0)
    replace(store, rows(("a", 5)), rows(("a", 0), ("b", 0), ("c", 0)), "job_id", 4, 1)
    assert [tuple(r) for r in store.read().collect()] == [("a", 5)]
    replace(store, rows().where("false"), rows(("a", 0)), "job_id", 4, 2)
    assert store.read() is None and Store(spark, str(tmp_path / "none")).read() is None


def test_stream_with_follow_ups_equals_batch(spark, tmp_path):
    landing, table, state = (str(tmp_path / x) for x in ("landing", "table", "state"))

    def normalise(batch):
        r = batch.select("source", F.from_json("payload", "id string, title string").alias("p"), "fetched_at", "seq", "company")
        return r.select("source", F.col("p.id").alias("source_job_id"), F.col("p.title").alias("title"), "company", F.lit("Oslo").alias("location"), F.col("p.title").alias("description"), "fetched_at", "seq")

    row = lambda i, title, d: ("s", "acme", "no", day(d), d, json.dumps({"id": i, "title": title}))
    everything = []
    for d in range(3):
        rows = [row(str(i), f"title {i} of {d}", d) for i in range(d, 12, d + 1)]
        everything += rows
        spark.createDataFrame(rows, ingest.LANDED).write.mode("append").json(landing)
        ingest.incremental_ingest(spark, landing, table, state, normalise, "7 days", {"passages": chunk.chunk_jobs}, buckets=4).awaitTermination()
    last = {}
    for r in everything:
        p = json.loads(r[5])
        last[p["id"]] = p["title"]
    jobs = ingest.latest(spark, table)
    assert {r.source_job_id: r.title for r in jobs.collect()} == last
    texts = ingest.follow_up(spark, table, "passages").join(jobs.select("job_id", "source_job_id"), "job_id")
    assert {r.source_job_id: r.text for r in texts.collect()} == last


def test_late_rows_are_set_aside(spark, tmp_path):
    landing, table, state = (str(tmp_path / x) for x in ("landing", "hours", "state"))
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    deliveries = [[(at(1), "a", 1.0), (at(2, 30), "a", 2.0)], [(at(2, 10), "a", 4.0), (at(1, 50), "a", 8.0), (at(5), "b", 1.0)], [(at(2, 59), "a", 16.0), (at(4, 30), "b", 32.0), (None, "b", 64.0)]]
    for rows in deliveries:
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(landing)
        ingest.activity_stream(stream, table, state, datetime.timedelta(minutes=20)).awaitTermination()
    # the second delivery finds a watermark of 2:10, the third one of 4:40
    assert sorted((r.start.hour, r.n, r.total) for r in ingest.latest(spark, table).collect()) == [(1, 1, 1.0), (2, 2, 6.0), (4, 1, 32.0), (5, 1, 1.0)]
    assert sorted(r.value for r in ingest.late_rows(spark, table).collect()) == [8.0, 16.0]
    assert sorted(r.start.hour for r in ingest.ended_windows(spark, table, datetime.timedelta(minutes=20)).collect()) == [1, 2]
