"""Queries that calibrate and measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.operators import report, score
from matchspark.plans import mapping as m
from matchspark.plans.mapping import table


def _cosines(spark: SparkSession, d: str) -> DataFrame:
    """The cosine of every vector with the mean of its label."""
    mean = m.resume_vectors(spark, d).select(F.col("resume_id").alias("label"), F.col("vec").alias("mean"))
    e = table(spark, d, "embeddings").hint("merge").join(mean, "label")
    return e.select(F.col("vec_id").alias("key"), score.cosine_similarity(F.col("embedding"), F.col("mean")).alias("cos"))


def cosine_distribution(spark: SparkSession, d: str) -> DataFrame:
    out = report.cosine_distribution(_cosines(spark, d), "cos", "vector")
    return out.select("label", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


def suggested_band(spark: SparkSession, d: str) -> DataFrame:
    return report.suggest_band(report.cosine_distribution(_cosines(spark, d), "cos", "vector"))


def extreme_vectors(spark: SparkSession, d: str) -> DataFrame:
    out = report.extremes(_cosines(spark, d).withColumn("cos", F.round("cos", 9)), "key", "cos", 10)
    return out.select("key", "end")


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.chunk_counts(m.chunks(spark, d))


def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status as the corpus, the priority's text as description."""
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("source"), F.concat("o_orderpriority", F.repeat(F.lit("x"), (F.col("o_custkey") % 50).cast("int"))).alias("description"))
    asked = m.job_skills(spark, d).withColumn("requirement", score.requirement_level(F.col("requirement")))
    out = report.corpus_report(jobs, asked)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_skills", "share_none")})


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """A job and part for each line, as often as it stands there."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id"))


def skill_demand(spark: SparkSession, d: str) -> DataFrame:
    return report.skill_demand(_lines(spark, d))


def demand_change(spark: SparkSession, d: str) -> DataFrame:
    """Demand before and after inactive skills go."""
    return report.demand_without_inactive(_lines(spark, d), m.skills(spark, d))


def compared_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Part types of two suppliers' groups of lines (returned and not) by order priority."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kept = lambda cond: lines.where(cond).groupBy(F.col("l_suppkey").alias("id")).agg(F.array_sort(F.collect_set("p_brand")).alias("skills"))
    out = report.compare_extractions(kept("l_returnflag = 'R'"), kept("l_returnflag = 'A'"))
    return out.select("id", F.array_join("only_a", ",").alias("only_a"), F.array_join("only_b", ",").alias("only_b"))


def feed_shape(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("value") > 10, F.col("value")).alias("value"), F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))
    return report.feed_shape_report(e).select("field", F.round("rate", 6).alias("rate"))


def boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Documents of exactly the modal length that no label covers."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("description"))
    cap = docs.groupBy(F.length("description").alias("n")).agg(F.count(F.lit(1)).alias("k")).agg(F.max(F.struct("k", -F.col("n")))["col2"].alias("n"))
    at_cap = docs.crossJoin(F.broadcast(cap)).where(F.length("description") == -F.col("n"))  # one row
    return report.boilerplate_postings(at_cap, table(spark, d, "labels").select(F.col("doc_id").alias("job_id")), -F.col("n"), r"[a-z]").select("job_id")


QUERIES = {
    f"report_{f.__name__}": f
    for f in (cosine_distribution, suggested_band, extreme_vectors, chunk_counts, corpus_report, skill_demand, demand_change, compared_extractions, feed_shape, boilerplate)
}

_COS = f"WITH {m.SQL}, cv AS (SELECT vec_id AS key, list_cosine_similarity(CAST(embedding AS DOUBLE[]), vec) AS cos FROM embeddings JOIN resume_vectors ON label = resume_id)"
_Q = ", ".join(f"quantile_cont(cos, {p}) AS p{round(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))
ORACLE_SQL = {
    "report_cosine_distribution": _COS + f" SELECT label, n, round(min, 6) AS min, round(mean, 6) AS mean, round(max, 6) AS max, round(p05, 6) AS p05, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(p95, 6) AS p95 FROM (SELECT 'vector' AS label, count(*) AS n, min(cos) AS min, avg(cos) AS mean, max(cos) AS max, {_Q} FROM cv)",
    "report_suggested_band": _COS + f" SELECT label, CASE WHEN n >= 20 THEN round(p05, 2) END AS lo, CASE WHEN n >= 20 THEN round(p95, 2) END AS hi, CASE WHEN n < 20 THEN 'too few values' WHEN round(p95, 2) - round(p05, 2) < 0.05 THEN 'narrow spread' ELSE 'ok' END AS note FROM (SELECT 'vector' AS label, count(*) AS n, {_Q} FROM cv)",
    "report_extreme_vectors": _COS + " SELECT key, 'best' AS \"end\" FROM (SELECT key FROM cv ORDER BY round(cos, 9) DESC, key LIMIT 10) UNION ALL SELECT key, 'worst' FROM (SELECT key FROM cv ORDER BY round(cos, 9), key LIMIT 10)",
    "report_chunk_counts": "SELECT CAST(floor(vec_id / 4) AS BIGINT) AS job_id, count(*) AS n_chunks FROM embeddings GROUP BY 1",
    "report_corpus_report": f"""WITH {m.SQL}, s AS (SELECT job_id, count(*) AS n, count(*) FILTER (requirement IS DISTINCT FROM 'Nice-to-have ') AS req, count(*) FILTER (requirement = 'Nice-to-have ') AS pref FROM job_skills GROUP BY 1),
        j AS (SELECT o_orderstatus AS source, length(o_orderpriority) + o_custkey % 50 AS chars, coalesce(n, 0) AS n, coalesce(req, 0) AS req, coalesce(pref, 0) AS pref FROM orders LEFT JOIN s ON job_id = o_orderkey)
        SELECT source, count(*) AS n_jobs, CAST(min(chars) AS INTEGER) AS min_chars, median(chars) AS median_chars, CAST(max(chars) AS INTEGER) AS max_chars, CAST(sum(req) AS BIGINT) AS n_required, CAST(sum(pref) AS BIGINT) AS n_preferred, round(avg(n), 6) AS mean_skills, median(n) AS median_skills, round(avg(CASE WHEN n = 0 THEN 1 ELSE 0 END), 6) AS share_none FROM j GROUP BY ROLLUP (source)""",
    "report_skill_demand": "SELECT l_partkey AS skill_id, count(DISTINCT l_orderkey) AS n_jobs FROM lineitem GROUP BY 1",
    "report_demand_change": "SELECT l_partkey AS skill_id, count(DISTINCT l_orderkey) AS n_before, CASE WHEN any_value(p_size) > 5 THEN count(DISTINCT l_orderkey) ELSE 0 END AS n_after, CASE WHEN any_value(p_size) > 5 THEN 0 ELSE -count(DISTINCT l_orderkey) END AS change FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "report_compared_extractions": """WITH x AS (SELECT DISTINCT l_suppkey AS id, l_returnflag AS f, p_brand AS b FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('R', 'A')), g AS (SELECT id, b, bool_or(f = 'R') AS r, bool_or(f = 'A') AS a FROM x GROUP BY 1, 2)
        SELECT id, coalesce(string_agg(b, ',' ORDER BY b) FILTER (NOT a), '') AS only_a, coalesce(string_agg(b, ',' ORDER BY b) FILTER (NOT r), '') AS only_b FROM g GROUP BY 1""",
    "report_feed_shape": "SELECT 'event_id' AS field, 1.0::DOUBLE AS rate UNION ALL SELECT 'value', round(avg(CASE WHEN value > 10 THEN 1 ELSE 0 END), 6) FROM events UNION ALL SELECT 'k', round(avg(CASE WHEN json_extract(props, '$.k') IS NOT NULL THEN 1 ELSE 0 END), 6) FROM events UNION ALL SELECT 'absent', 0.0",
    "report_boilerplate": "WITH m AS (SELECT length(text) AS n FROM documents GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 1) SELECT doc_id AS job_id FROM documents, m WHERE length(text) = n AND regexp_matches(text, '[a-z]') AND doc_id NOT IN (SELECT doc_id FROM labels)",
}
