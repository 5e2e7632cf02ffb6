"""Queries on landed postings: normal forms, duplicates, caps, keyed writes, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.functions import normalize as N
from matchspark.functions import text as X
from matchspark.operators import dedupe, runs
from matchspark.plans.mapping import table
from matchspark.sources import boards


def company_keys(spark: SparkSession, d: str) -> DataFrame:
    """dedup_hash of every customer: name, segment as title, nation as city."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", N.dedup_hash(F.col("c_name"), F.col("c_mktsegment"), N.extract_city(F.concat(F.col("n_name"), F.lit(", x")))).alias("dedup_hash"))


def normalized_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = F.concat(F.lit(" "), "p_name", F.lit("/"), "p_brand", F.lit("--"), "p_type", F.lit(" Ltd. Co"))
    return p.select("p_partkey", N.normalize_text(name).alias("text"), N.normalize_company(name).alias("company"))


def page_text_flat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(X.strip_html_flat(F.col("html")), 256).alias("text_sha256"))


def page_text_lines(spark: SparkSession, d: str) -> DataFrame:
    text = X.html_to_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", text.alias("t")).select("page_id", F.length("t").alias("chars"), F.size(F.split("t", "\n")).alias("lines"), F.sha2("t", 256).alias("text_sha256"))


def search_api_postings(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as search-service payloads and read back through the source."""
    o = table(spark, d, "orders")
    years = F.col("o_orderkey") % 20
    payload = F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("<b>"), "o_orderpriority", F.lit("</b> &amp; more")).alias("title"),
        F.struct(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("display_name")).alias("company"),
        F.concat(F.lit("At least "), years.cast("string"), F.lit(" years. "), F.when(F.col("o_orderstatus") == "F", "No remote work").otherwise("Remote ok")).alias("description"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice").cast("string")).alias("salary_min"), F.format_string("%sT00:00:00Z", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("created"),
    ))
    out = boards.normalize_search_api(o.select(payload.alias("payload")), "gb")
    return out.select("source_job_id", "title", "company", "is_remote", F.col("salary_min").cast("double").alias("salary_min"), "salary_currency", "experience_raw", F.col("experience_min_years").cast("double").alias("years"), F.col("posted_date").cast("string").alias("posted"))


def first_per_text(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each text across sources."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("dedup_hash"))
    return dedupe.dedup_within_run(docs, ("source", "doc_id"))


def first_per_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each order and part."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("source_job_id"), F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("position"), "l_quantity")
    return dedupe.dedup_within_fetch(rows)


def interleaved_sources(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred documents, source by source in turn: the limit is the feature."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return dedupe.interleave_round_robin(docs, "source", "source", ["doc_id"], 100)


def capped_lines(spark: SparkSession, d: str) -> DataFrame:
    """At most two lines of each order and supplier group: the cap is the feature."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return dedupe.cap_results(rows, ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], 2)


def query_budget(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per.select("o_custkey", dedupe.split_budget(F.lit(100), F.col("n")).alias("budget"))


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").cast("string").alias("source_job_id"), F.col("o_orderstatus").alias("title"), F.col("o_orderdate").alias("fetched_at"))
    current = o.withColumn("job_id", N.job_id(F.col("source"), F.col("source_job_id")))
    incoming = table(spark, d, "lineitem").select(F.lit("orders").alias("source"), (F.col("l_orderkey") + 7).cast("string").alias("source_job_id"), F.nullif("l_linestatus", F.lit("O")).alias("title"), F.col("l_shipdate").alias("fetched_at"), F.col("l_linenumber").alias("seq"))
    return dedupe.upsert_jobs(current, incoming)


def upserted_jobs(spark: SparkSession, d: str) -> DataFrame:
    return _upserted(spark, d).select("source_job_id", "job_id", "title", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched"), "is_new")


def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    return runs.ingest_report(_upserted(spark, d))


def upserted_matches(spark: SparkSession, d: str) -> DataFrame:
    """Scores of (part, supplier) pairs replaced by those of returned lines; explanations stay."""
    lines = table(spark, d, "lineitem")
    key = [F.col("l_partkey").alias("resume_id"), F.col("l_suppkey").alias("job_id")]
    current = lines.groupBy(*key).agg(F.max("l_quantity").alias("overall_score")).withColumn("explanation", F.concat(F.lit("q"), F.col("overall_score").cast("int").cast("string")))
    scored = lines.where("l_returnflag = 'R'").groupBy(*key).agg(F.min("l_discount").alias("overall_score")).withColumn("explanation", F.lit("new"))
    return dedupe.upsert_matches(current, scored)


def new_links(spark: SparkSession, d: str) -> DataFrame:
    """Parts of returned lines that no other line of the same order priority has yet."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("resume_id"), F.col("l_partkey").alias("skill_id"), "l_returnflag")
    return dedupe.insert_if_absent(lines.where("l_returnflag <> 'R'"), lines.where("l_returnflag = 'R'"), ["resume_id", "skill_id"]).select("resume_id", "skill_id")


def kept_matches(spark: SparkSession, d: str) -> DataFrame:
    """Orders of customers without an urgent order."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("resume_id"), F.col("o_orderkey").alias("job_id"), "o_orderpriority")
    return dedupe.invalidate_matches(o, o.where("o_orderpriority = '1-URGENT'")).select("resume_id", "job_id")


def run_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a run: errors are failed sources."""
    e = table(spark, d, "events")
    error = F.col("event_type") == "error"
    rows = e.groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("source")).agg(F.count_if(~error & (F.col("value") > 20)).alias("n_rows"), F.max(F.when(error, F.lit("failed"))).alias("error"))
    return runs.run_status_from_sources(rows)


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user as the state of a run, with its progress."""
    stage = F.when(F.col("event_type") == "view", "scoring").when(F.col("event_type") == "error", "other").otherwise("done")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("succeeded")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), status.alias("status"), stage.alias("stage"), F.array(F.lit("x")).alias("sources"), F.col("event_id").cast("int").alias("jobs_found"), F.lit(None).cast("string").alias("error"), F.col("ts").alias("at"))
    return runs.run_progress(runs.run_state(e)).select("run_id", "status", "stage", "jobs_found", "step", "total", "label", "is_terminal", "is_success")


QUERIES = {
    f.__name__: f
    for f in (company_keys, normalized_names, page_text_flat, page_text_lines, search_api_postings, first_per_text, first_per_fetch, interleaved_sources, capped_lines, query_budget, upserted_jobs, ingest_report, upserted_matches, new_links, kept_matches, run_statuses, latest_runs)
}

_SUFFIX = "( (" + "|".join(N.COMPANY_SUFFIXES) + "))+$"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[-/_]+', ' ', 'g'), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def _decoded(x: str) -> str:
    """The references that the pages hold; as in HTML, these names need no semicolon."""
    for name, c in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("nbsp", "\u00a0"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{c}', 'g')"
    return x


_UPSERT = """WITH inc AS (SELECT CAST(l_orderkey + 7 AS VARCHAR) AS id, nullif(l_linestatus, 'O') AS title, l_shipdate AS seen, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, nullif(l_linestatus, 'O') NULLS FIRST) AS n FROM lineitem),
cur AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS title, o_orderdate AS seen FROM orders),
up AS (SELECT coalesce(c.id, i.id) AS source_job_id, CASE WHEN i.id IS NOT NULL THEN i.title ELSE c.title END AS title, CASE WHEN i.id IS NOT NULL THEN i.seen ELSE c.seen END AS seen, c.id IS NULL AS is_new FROM cur c FULL JOIN (SELECT * FROM inc WHERE n = 1) i ON c.id = i.id) """
ORACLE_SQL = {
    "company_keys": f"SELECT c_custkey, sha256({_norm('c_name')} || chr(0) || {_norm('c_mktsegment')} || chr(0) || {_norm('n_name')}) AS dedup_hash FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "normalized_names": f"SELECT p_partkey, t AS text, regexp_replace(t, '{_SUFFIX}', '') AS company FROM (SELECT p_partkey, {_norm(chr(39) + ' ' + chr(39) + ' || p_name || ' + chr(39) + '/' + chr(39) + ' || p_brand || ' + chr(39) + '--' + chr(39) + ' || p_type || ' + chr(39) + ' Ltd. Co' + chr(39))} AS t FROM part)",
    "page_text_flat": f"SELECT page_id, sha256(trim(regexp_replace({_decoded("regexp_replace(html, '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g'))) AS text_sha256 FROM pages",
    "page_text_lines": f"""SELECT page_id, CAST(length(t) AS INTEGER) AS chars, CAST(len(string_split(t, chr(10))) AS INTEGER) AS lines, sha256(t) AS text_sha256 FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_decoded("regexp_replace(regexp_replace(m, '(?i)</(p|div|li|ul|ol|h[1-6]|tr|table|section)>|<br[ ]*/?>|<li[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')")},
        '[ \\t\\r\\f\\v]+', ' ', 'g'), '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT page_id, CASE WHEN contains(u, '&lt;') OR contains(u, '&amp;') THEN {_decoded("u")} ELSE u END AS m FROM (SELECT page_id, {_decoded("html")} AS u FROM pages)))""",
    "search_api_postings": """SELECT CAST(o_orderkey AS VARCHAR) AS source_job_id, o_orderpriority || ' & more' AS title, 'C' || o_custkey AS company, o_orderstatus <> 'F' AS is_remote,
        CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice, 2) END AS salary_min, CASE WHEN o_orderkey % 4 <> 0 THEN 'GBP' END AS salary_currency,
        CASE WHEN o_orderkey % 20 BETWEEN 1 AND 15 THEN 'At least ' || (o_orderkey % 20) || ' years' END AS experience_raw, CASE WHEN o_orderkey % 20 BETWEEN 1 AND 15 THEN CAST(o_orderkey % 20 AS DOUBLE) END AS years,
        strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders""",
    "first_per_text": "SELECT doc_id, source, h AS dedup_hash FROM (SELECT doc_id, source, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1",
    "first_per_fetch": "SELECT source, source_job_id, page, position, l_quantity FROM (SELECT l_orderkey AS source, l_partkey AS source_job_id, l_linenumber AS page, l_suppkey AS position, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1",
    "interleaved_sources": "SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source, doc_id LIMIT 100",
    "capped_lines": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n <= 2",
    "query_budget": "SELECT o_custkey, CAST(greatest(1, 100 // count(*)) AS INTEGER) AS budget FROM orders GROUP BY 1",
    "upserted_jobs": _UPSERT + "SELECT source_job_id, sha256('orders' || chr(0) || source_job_id) AS job_id, title, strftime(seen, '%Y-%m-%d') AS fetched, is_new FROM up",
    "ingest_report": _UPSERT + "SELECT 'orders' AS source, count(*) FILTER (is_new) AS n_new, count(*) FILTER (NOT is_new) AS n_duplicate, count(*) AS n_stored FROM up",
    "upserted_matches": """SELECT c.resume_id, c.job_id, coalesce(s.x, c.x) AS overall_score, 'q' || CAST(c.x AS INTEGER) AS explanation FROM (SELECT l_partkey AS resume_id, l_suppkey AS job_id, max(l_quantity) AS x FROM lineitem GROUP BY 1, 2) c
        LEFT JOIN (SELECT l_partkey AS resume_id, l_suppkey AS job_id, min(l_discount) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) s USING (resume_id, job_id)""",
    "new_links": "SELECT DISTINCT l_suppkey AS resume_id, l_partkey AS skill_id FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_suppkey = a.l_suppkey AND b.l_partkey = a.l_partkey AND b.l_returnflag <> 'R')",
    "kept_matches": "SELECT o_custkey AS resume_id, o_orderkey AS job_id FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "run_statuses": """SELECT run_id, CASE WHEN bad > 0 AND n = 0 THEN 'failed' WHEN bad > 0 THEN 'partial' ELSE 'success' END AS status, n AS jobs_found, CASE WHEN bad > 0 THEN 'error: failed' END AS error
        FROM (SELECT user_id AS run_id, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type <> 'error' AND value > 20) AS n FROM events GROUP BY 1)""",
    "latest_runs": """SELECT CAST(user_id AS VARCHAR) AS run_id, status, CASE event_type WHEN 'view' THEN 'scoring' WHEN 'error' THEN 'other' ELSE 'done' END AS stage, CAST(event_id AS INTEGER) AS jobs_found,
        CASE event_type WHEN 'view' THEN 7 WHEN 'error' THEN 0 ELSE 10 END AS step, 10 AS total, CASE event_type WHEN 'view' THEN 'Scoring matches' WHEN 'error' THEN NULL ELSE 'Done' END AS label, status <> 'running' AS is_terminal, status = 'succeeded' AS is_success
        FROM (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'succeeded' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'succeeded' END DESC) AS n FROM events) WHERE n = 1""",
}
