import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from matchspark.functions import normalize as N
from matchspark.functions import text as X
from matchspark.operators import dedupe, runs
from matchspark.sources import boards, files
from matchspark.streaming import ingest


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def test_normal_forms(spark):
    given = ["  Full-Stack  Dev/Ops_x!", None, "", "Café Über", "ﬁne Straße", "日本 語"]
    assert column(spark, given, N.normalize_text) == ["full stack dev ops x", "", "", "cafe uber", "fine strasse", "日本 語"]
    assert column(spark, ["Acme Pvt. Ltd.", "Inc", "Co Inc", "Data AG Labs"], N.normalize_company) == ["acme", "inc", "co", "data ag labs"]
    assert column(spark, [" Pune , India", None, "Oslo"], N.extract_city) == ["Pune", "", "Oslo"]


def test_the_same_posting_has_one_hash(spark):
    rows = spark.createDataFrame([("Acme Inc", "Data  Engineer", "Pune"), ("ACME", "data-engineer", "pune"), (None, None, None)], "c string, t string, l string")
    a, b, n = [r.h for r in rows.select(N.dedup_hash(F.col("c"), F.col("t"), F.col("l")).alias("h")).collect()]
    assert a == b != n and len(n) == 64


def test_markup(spark):
    assert column(spark, ["<b>a</b>&amp;lt;b", "  ", None, "<p></p>", "x &lt;i&gt; y"], X.strip_html_flat) == ["a &lt;b", None, None, None, "x <i> y"]
    raw = "&lt;p&gt;One&amp;nbsp;two&lt;/p&gt;&lt;ul&gt;&lt;li&gt;x&lt;/li&gt;&lt;/ul&gt;\n\n\n\nend<br/>z"
    assert column(spark, [raw, None], X.html_to_text) == ["One\xa0two\n\nx\n\nend\nz", ""]


@pytest.mark.parametrize("text,expected", [
    ("3-5 years of work", ("3-5 years", 3)), ("7+ years", ("7+ years", 7)), ("minimum of 4 years", ("minimum of 4 years", 4)), ("2.5 years of relevant experience", ("2.5 years of relevant experience", Decimal("2.5"))),
    ("20 years in business", None), ("0+ years, at least 2 years", ("at least 2 years", 2)), ("none", None), (None, None),
])
def test_experience_phrases(spark, text, expected):
    r = spark.createDataFrame([(text,)], "t string").select(X.min_experience(F.col("t")).alias("x")).first().x
    assert (r and (r.raw, r.years)) == expected


def test_remote_wording(spark):
    f = lambda v: X.is_remote(F.lit("Dev"), v, F.lit(None).cast("string"))
    assert column(spark, ["Remote", "no remote", "remote is not possible", "telecommuting", "Oslo", None], f) == [True, False, False, True, False, False]


def test_dates_keep_their_own_offset(spark):
    assert column(spark, ["2024-03-01T23:30:00-05:00", "2024-03-01T00:00:00Z", "bad", None], X.iso_date) == [datetime.date(2024, 3, 1)] * 2 + [None, None]
    assert column(spark, ["86399999", "86400000", "x"], X.epoch_date) == [datetime.date(1970, 1, 1), datetime.date(1970, 1, 2), None]


def test_salary_text(spark):
    rows = spark.createDataFrame([(1000.0, 2500.5, "GBP", False), (5.0, 5.0, None, True), (None, 70.0, "EUR", False), (None, None, "EUR", True)], "a double, b double, c string, p boolean")
    assert [r.x for r in rows.select(X.salary_text(F.col("a"), F.col("b"), F.col("c"), F.col("p")).alias("x")).collect()] == ["GBP1,000 - GBP2,500 per year", "5 per year (estimated)", "EUR70 per year", None]


def test_search_results(spark):
    good = {"id": 7, "title": "<b>Dev</b>", "company": None, "location": {"display_name": "Pune, IN"}, "description": "3-5 years. Remote.", "salary_min": 0, "salary_max": None, "created": "2024-01-02T03:04:05Z"}
    raw = spark.createDataFrame([(json.dumps(x),) for x in (good, {"id": 8}, {"title": "x"}, {"id": 9, "title": "y", "salary_min": "100", "salary_is_predicted": "1"})] + [("broken",), (None,)], "payload string")
    out = {r.source_job_id: r for r in boards.normalize_search_api(raw, "in").collect()}
    assert set(out) == {"7", "9"}
    assert out["7"].salary_currency is None and out["7"].is_remote and out["7"].experience_min_years == 3 and out["7"].posted_date == datetime.date(2024, 1, 2)
    assert out["9"].salary_raw == "INR100 per year (estimated)" and out["9"].salary_period == "year"


def test_company_boards(spark):
    payload = {"jobs": [{"id": 1, "title": " Dev ", "location": {"name": "Remote"}, "content": "&lt;p&gt;Hi&lt;/p&gt;", "updated_at": None, "first_published": "2024-01-02T00:00:00Z"}, {"id": 2, "title": ""}, {"id": None, "title": "x"}]}
    out = boards.normalize_company_board(spark.createDataFrame([("acme", json.dumps(payload)), ("none", "{}")], "company string, payload string")).collect()
    assert [(r.source_job_id, r.title, r.description, r.is_remote, str(r.posted_date)) for r in out] == [("acme:1", "Dev", "Hi", True, "2024-01-02")]


def test_sectioned_boards(spark):
    one = {"id": "a", "text": "Dev", "categories": {"location": "Oslo"}, "description": "<p>Open</p>", "lists": [{"text": "Requirements", "content": "<li>Go</li><li>C</li>"}, {"text": "", "content": "plain"}, {"text": "Empty", "content": ""}], "additional": "End", "createdAt": 86400000, "workplaceType": "Remote", "hostedUrl": None, "applyUrl": "u"}
    out = boards.normalize_sectioned_board(spark.createDataFrame([("acme", json.dumps([one, {"id": "b"}]))], "company string, payload string")).collect()
    assert len(out) == 1 and out[0].description == "Open\n\nRequirements:\nGo\n\nC\n\nplain\n\nEnd" and out[0].is_remote and out[0].apply_url == "u" and str(out[0].posted_date) == "1970-01-02"


def test_a_failing_source_does_not_lose_the_others(spark):
    good = spark.createDataFrame([("a", 1)], "source string, n int")
    rows, errors = boards.union_sources({"a": good, "b": ValueError("down"), "c": good.drop("n")})
    assert rows.count() == 2 and errors == {"b": "down"}
    ok, bad = boards.split_unusable(spark.createDataFrame([("1", "t"), (None, "t"), ("2", " ")], "source_job_id string, title string"))
    assert ok.count() == 1 and {r.reason for r in bad.collect()} == {"no id", "no title"}


def test_one_odd_posting_takes_nothing_from_its_board(spark):
    fine = {"id": 7, "title": " A ", "location": {"name": "Oslo"}, "content": "&lt;p&gt;x&lt;/p&gt;", "updated_at": "2024-01-02T00:00:00Z", "absolute_url": "u"}
    odd = ["oops", 5, None, [1], {}, {"id": 0, "title": "a"}, {"id": " ", "title": "a"}, {"id": 1}, {"id": 1, "title": "\n"}, {"id": 1, "title": 5}, {"id": {"a": 1}, "title": "a"}, {"id": 1, "title": "a", "location": "Oslo"}, {"id": 1, "title": "a", "content": [1]}, {"id": 1, "title": "a", "updated_at": 5}, {"id": 1, "title": "a", "first_published": 5}]
    bare = {"id": "8", "title": "b", "location": "", "content": False, "updated_at": 0, "first_published": "2024-01-03", "absolute_url": None}
    many = [fine, *odd, bare, fine]
    raw = [("c", json.dumps({"jobs": many, "meta": 1})), ("cut", json.dumps({"jobs": [fine]})[:-1]), ("none", "{}"), ("null", None), ("blank", " "), ("empty", '{"jobs":[]}'), ("list", "[]"), ("twice", '{"jobs":[{"id":1,"id":2,"title":"x"},{"id":3,"title":"y"}]}')]
    raw = spark.createDataFrame([(c, p, "r") for c, p in raw], "company string, payload string, r string")
    records = boards.company_board_records(raw).cache()
    good = sorted(tuple(r) for r in boards.company_postings(records).select("source_job_id", "title", "location", "description", "apply_url", F.col("posted_date").cast("string")).collect())
    assert good == [("c:7", "A", "Oslo", "x", "u", "2024-01-02")] * 2 + [("c:8", "b", None, None, None, "2024-01-03"), ("twice:3", "y", None, None, None, None)]
    aside = {(r.company, r.position): (r.reason, r.record) for r in boards.set_aside(records).collect()}
    reasons = ["unreadable", "not an object", "not an object", "not an object", "no id", "no id", "no id", "no title", "no title", "title of another kind", "id of another kind", "location of another kind", "content of another kind", "date or list of another kind", "date or list of another kind"]
    assert [aside.pop(("c", i + 1))[0] for i in range(len(odd))] == reasons
    assert {k: v[0] for k, v in aside.items()} == {("cut", None): "unreadable", ("none", None): "no list of postings", ("null", None): "empty", ("blank", None): "empty", ("list", None): "no list of postings", ("twice", 0): "unreadable"}
    assert aside[("cut", None)][1].startswith('{"jobs"') and aside[("twice", 0)][1] == '{"id":1,"id":2,"title":"x"}'
    assert boards.normalize_company_board(raw.limit(0)).count() == 0


def test_odd_sections(spark):
    fine = {"id": "a", "text": "T", "categories": {"location": "Rome"}, "lists": [{"text": "Needs", "content": "<li>x</li>"}, 5, "y"], "createdAt": 86400000, "hostedUrl": "", "applyUrl": "u"}
    odd = [{"id": "b", "text": "T", "lists": [{"text": 1}]}, {"id": "c", "text": "T", "categories": ["x"]}, {"id": "d", "text": "T", "lists": "x"}, {"id": "e", "text": "T", "workplaceType": 3}, {"text": "T"}, 1]
    raw = spark.createDataFrame([("s", json.dumps([odd[0], fine, *odd[1:], fine | {"id": "z", "lists": None, "createdAt": None}])), ("t", json.dumps({"ok": False}))], "company string, payload string")
    got = sorted(tuple(r) for r in boards.normalize_sectioned_board(raw).select("source_job_id", "location", "description", "apply_url", F.col("posted_date").cast("string")).collect())
    assert got == [("s:a", "Rome", "Needs:\nx", "u", "1970-01-02"), ("s:z", "Rome", None, "u", None)]
    aside = sorted((r.company, r.position, r.reason) for r in boards.set_aside(boards.sectioned_board_records(raw)).na.fill(-1).collect())
    assert aside == [("s", 0, "date or list of another kind"), ("s", 2, "categories of another kind"), ("s", 3, "lists of another kind"), ("s", 4, "workplaceType of another kind"), ("s", 5, "no id"), ("s", 6, "not an object"), ("t", -1, "no list of postings")]


def test_first_rows_and_caps(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 2), ("b", 2, 3), ("b", 3, 4)], "g string, p int, k int")
    assert sorted((r.g, r.p) for r in dedupe.first_per_key(rows, ["k"], ["g", "p"]).collect()) == [("a", 1), ("b", 1), ("b", 2), ("b", 3)]
    turns = dedupe.interleave_round_robin(rows, "g", "g", ["p"], 4).collect()
    assert [(r.g, r.p) for r in turns] == [("a", 1), ("b", 1), ("a", 2), ("b", 2)]
    assert dedupe.cap_results(rows, ["g"], ["p"], 1).count() == 2


def test_upsert_is_idempotent_and_keeps_ids(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    current = spark.createDataFrame([("s", "1", "old", t(1), "ID1")], "source string, source_job_id string, title string, fetched_at timestamp, job_id string")
    incoming = spark.createDataFrame([("s", "1", None, t(2), 1), ("s", "1", "x", t(2), 0), ("s", "2", "new", t(1), 0)], "source string, source_job_id string, title string, fetched_at timestamp, seq long")
    once = dedupe.upsert_jobs(current, incoming)
    out = {r.source_job_id: r for r in once.collect()}
    assert out["1"].title is None and out["1"].job_id == "ID1" and not out["1"].is_new and out["2"].is_new and len(out["2"].job_id) == 64
    again = {r.source_job_id: r for r in dedupe.upsert_jobs(once.drop("is_new"), incoming).collect()}
    assert not again["2"].is_new and again["2"].job_id == out["2"].job_id and len(again) == 2


def test_rescoring_keeps_explanations(spark):
    current = spark.createDataFrame([(1, 1, 0.5, "why"), (1, 2, 0.1, "old")], "resume_id long, job_id long, overall_score double, explanation string")
    scored = spark.createDataFrame([(1, 1, 0.7), (1, 3, 0.2)], "resume_id long, job_id long, overall_score double")
    assert sorted((r.job_id, r.overall_score, r.explanation) for r in dedupe.upsert_matches(current, scored).collect()) == [(1, 0.7, "why"), (2, 0.1, "old"), (3, 0.2, None)]
    assert dedupe.invalidate_matches(current, spark.createDataFrame([(1,)], "resume_id long")).count() == 0
    assert [r.job_id for r in dedupe.insert_if_absent(current, scored, ["resume_id", "job_id"]).collect()] == [3]


def test_runs(spark):
    rows = spark.createDataFrame([("a", "x", 1, None), ("a", "y", 0, "down"), ("b", "x", 0, "bad"), ("c", "x", 0, None)], "run_id string, source string, n_rows int, error string")
    assert {r.run_id: (r.status, r.error) for r in runs.run_status_from_sources(rows).collect()} == {"a": ("partial", "y: down"), "b": ("failed", "x: bad"), "c": ("success", None)}
    t = lambda d: datetime.datetime(2024, 1, d)
    events = runs.record_run(spark, "r", "queued", "queued", ["s"], at=t(1)).unionByName(runs.record_run(spark, "r", "failed", "odd", ["s"], 3, ["e" * 5000], t(2)))
    state = runs.run_progress(runs.run_state(events)).first()
    assert (state.status, state.step, state.total, state.is_terminal, state.is_success, len(state.error)) == ("failed", 0, 10, True, False, 4000)


def test_files(spark, tmp_path):
    (tmp_path / "b.csv").write_text("term,category,reason\n Sales ,x,\"a, b\"\n ,y,z\n")
    assert [tuple(r) for r in files.read_blocklist(spark, str(tmp_path / "b.csv")).collect()] == [("Sales", "x", "a, b")]
    (tmp_path / "v.csv").write_text("skill_id,name,aliases,active\n1, Go ,golang| ,\n2,,x,true\n")
    assert [tuple(r) for r in files.read_vocabulary(spark, str(tmp_path / "v.csv")).collect()] == [("1", "Go", ["golang"], True)]
    raw = spark.createDataFrame([("1", '{"name":"A","skills":["x"]}'), ("2", "{broken")], "resume_id string, payload string")
    out = {r.resume_id: r for r in files.read_resumes(raw).collect()}
    assert out["1"].parsed.skills == ["x"] and out["1"].corrupt is None and out["2"].parsed is None and out["2"].corrupt == "{broken"


def test_stream_equals_batch(spark, tmp_path):
    landing, table, state = (str(tmp_path / x) for x in ("landing", "table", "state"))

    def land(rows):
        spark.createDataFrame(rows, ingest.LANDED).coalesce(1).write.mode("append").json(landing)

    def normalise(batch):
        r = batch.select(F.col("source"), F.from_json("payload", "id string, title string").alias("p"), "fetched_at", "seq", "company")
        return r.select("source", F.col("p.id").alias("source_job_id"), F.col("p.title").alias("title"), "company", F.lit("Oslo").alias("location"), "fetched_at", "seq")

    t = lambda d: datetime.datetime(2024, 1, d)
    row = lambda i, title, d, seq=0: ("s", "acme", "no", t(d), seq, json.dumps({"id": i, "title": title}))
    land([row("1", "a", 1), row("1", "a", 1), row("2", "b", 1)])
    ingest.incremental_ingest(spark, landing, table, state, normalise, "3650 days").awaitTermination()
    land([row("1", "c", 2), row("3", "d", 2), row("2", "b", 1)])
    ingest.incremental_ingest(spark, landing, table, state, normalise, "3650 days").awaitTermination()
    assert sorted((r.source_job_id, r.title) for r in ingest.latest(spark, table).collect()) == [("1", "c"), ("2", "b"), ("3", "d")]
