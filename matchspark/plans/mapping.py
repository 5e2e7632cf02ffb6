"""The matching tables built from the supplied star schema, in Spark and in SQL.

job: an order; skill: a part; a job asks for the parts of its lines, required,
preferred or unlabelled by return flag. Profile: a nation, which holds the parts
that its suppliers sell. Passages: the vectors, four to a job; a profile's
vector is the mean of the vectors of the label that is its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.operators.score import Config

CONFIG = Config(cos_lo=-0.1, cos_hi=0.9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("job_id"), F.col("o_orderpriority").alias("title"), F.when(key % 3 != 0, (key % 16).cast("double")).alias("required_years"))


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("skill_id"), F.format_string("%s %d", "p_name", "p_partkey").alias("name"), (F.col("p_size") > 5).alias("active"))


def job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a job and part: the strongest label wins."""
    rank = F.when(F.col("l_returnflag") == "A", 1).otherwise(0)
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id")).agg(F.min(rank).alias("r"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return best.select("job_id", "skill_id", F.when(F.col("r") == 1, "Nice-to-have ").when(F.col("k") > 0, "required").alias("requirement"))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("resume_id"), F.when(n % 5 != 0, (n % 12).cast("double")).alias("candidate_years"))


def resume_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    seller = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("resume_id"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("skill_id")).join(seller, "l_suppkey").select("resume_id", "skill_id").distinct()


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 4).alias("job_id"), (F.col("vec_id") % 4).cast("int").alias("chunk_index"), F.col("embedding").alias("vec"))


def resume_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = part.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return rows.select(F.col("label").alias("resume_id"), F.transform("v", lambda p: p["x"]).alias("vec")).hint("merge").join(resumes(spark, sf_dir).select("resume_id"), "resume_id", "left_semi")


#: The same tables as SQL, to stand before a query.
SQL = """
jobs AS (SELECT o_orderkey AS job_id, o_orderpriority AS title, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 16 AS DOUBLE) END AS required_years FROM orders),
skills AS (SELECT p_partkey AS skill_id, p_name || ' ' || p_partkey AS name, p_size > 5 AS active FROM part),
job_skills AS (SELECT l_orderkey AS job_id, l_partkey AS skill_id, CASE WHEN bool_and(l_returnflag = 'A') THEN 'Nice-to-have ' WHEN bool_or(l_returnflag = 'R') THEN 'required' END AS requirement FROM lineitem GROUP BY 1, 2),
resumes AS (SELECT n_nationkey AS resume_id, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey % 12 AS DOUBLE) END AS candidate_years FROM nation),
resume_skills AS (SELECT DISTINCT s_nationkey AS resume_id, l_partkey AS skill_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
chunks AS (SELECT CAST(floor(vec_id / 4) AS BIGINT) AS job_id, CAST(vec_id % 4 AS INTEGER) AS chunk_index, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
comp AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2),
resume_vectors AS (SELECT label AS resume_id, list(x ORDER BY i) AS vec FROM comp WHERE label IN (SELECT n_nationkey FROM nation) GROUP BY label),
asked AS (SELECT job_id, j.skill_id, name, requirement, CASE WHEN requirement = 'Nice-to-have ' THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS w FROM job_skills j JOIN skills s ON j.skill_id = s.skill_id WHERE active),
totals AS (SELECT job_id, sum(w) AS possible, count(*) AS parsed_count FROM asked GROUP BY 1),
earned AS (SELECT resume_id, job_id, sum(w) AS earned FROM asked JOIN resume_skills USING (skill_id) GROUP BY 1, 2),
cosines AS (SELECT resume_id, job_id, list_cosine_similarity(r.vec, c.vec) AS cos FROM chunks c, resume_vectors r),
best AS (SELECT resume_id, job_id, avg(cos) AS mean_cos FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, job_id ORDER BY cos DESC) AS k FROM cosines) WHERE k <= 3 GROUP BY 1, 2),
parts AS (
  SELECT r.resume_id, j.job_id, title, coalesce(earned, 0) / possible AS recall, sqrt(least(1.0, parsed_count / 6.0)) AS confidence, coalesce(parsed_count, 0) AS parsed_count,
         parsed_count IS NULL AS skills_unparsed, CASE WHEN mean_cos IS NULL THEN 0 ELSE greatest(0, least(1, mean_cos + 0.1::DOUBLE)) END AS semantic,
         CASE WHEN required_years - candidate_years IS NULL OR required_years - candidate_years <= 0 THEN 1.0 WHEN required_years - candidate_years <= 1 THEN 0.95 WHEN required_years - candidate_years <= 3 THEN 0.85 ELSE 0.7 END::DOUBLE AS mult
  FROM jobs j CROSS JOIN resumes r LEFT JOIN totals t ON t.job_id = j.job_id LEFT JOIN earned e ON e.job_id = j.job_id AND e.resume_id = r.resume_id LEFT JOIN best b ON b.job_id = j.job_id AND b.resume_id = r.resume_id),
scored AS (
  SELECT *, CASE WHEN o IS NULL THEN NULL WHEN skills_unparsed THEN NULL WHEN round(o, 9) >= 0.36::DOUBLE THEN 'strong' WHEN round(o, 9) >= 0.25::DOUBLE THEN 'moderate' ELSE 'weak' END AS tier, round(o, 4) AS overall_score
  FROM (SELECT *, CASE WHEN skills_unparsed THEN semantic * mult ELSE (0.6::DOUBLE * recall * confidence + 0.4::DOUBLE * semantic) * mult END AS o FROM parts))
"""
