"""A whole run over the supplied tables.

A skill is a name of parts, with the least number that bears it. A profile is a
nation, which holds some of them, and the last nation none, so that it is turned
down. A posting is an order that lists the names of its parts; two boards carry
some of them both, and a third source fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.operators import whole_run
from matchspark.operators.score import Config
from matchspark.plans.mapping import table
from matchspark.plans.records import EXPLANATION, PHRASE
from matchspark.sources import boards
from matchspark.tables import new_folder

LETTERS = "abcdefghilnoprstw"
CONFIG = Config(cos_lo=0.5, cos_hi=1.0)


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A caller's embedder that SQL can repeat."""
    return [[float(t.count(x)) for x in LETTERS] for t in texts]


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    held = table(spark, d, "nation").hint("shuffle_replicate_nl").join(_names(spark, d), ((F.col("id") + n) % 3 == 0) & (F.col("id") % 4 != 0) & (n != 24)).groupBy("n_nationkey").agg(F.array_sort(F.collect_list("p_name")).alias("s"))
    rows = table(spark, d, "nation").hint("merge").join(held, "n_nationkey", "left")
    parsed = F.struct(
        F.col("n_name").alias("name"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("phone"), (n % 12).cast("double").alias("total_experience_years"), F.coalesce("s", F.array().cast("array<string>")).alias("skills"),
        F.array().cast("array<struct<title:string,tech:array<string>>>").alias("projects"), F.array().cast("array<struct<company:string,role:string,duration:string>>").alias("experience"), F.array().cast("array<struct<institution:string,degree:string,year:string>>").alias("education"),
    )
    return rows.select(n.alias("resume_id"), parsed.alias("parsed"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey and the markup of each order's posting."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    asked = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    key = F.col("o_orderkey")
    body = F.concat(F.lit("<p>"), F.when(key % 3 != 0, F.concat((key % 9 + 1).cast("string"), F.lit("+ years of experience"))).otherwise("Apply"), F.lit("</p><ul>"), F.concat_ws("", F.transform("names", lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>")))), F.lit("</ul>"))
    return table(spark, d, "orders").select("o_orderkey").hint("merge").join(asked, "o_orderkey", "left").select("o_orderkey", F.concat(F.lit("Buyer "), key.cast("string")).alias("title"), body.alias("body"))


def _sources(spark: SparkSession, d: str) -> dict:
    o = _orders(spark, d)
    acme = F.lit("acme").alias("company")

    def company_board(queries: DataFrame) -> DataFrame:
        job = F.struct(F.col("o_orderkey").cast("string").alias("id"), "title", F.col("body").alias("content"))
        return boards.normalize_company_board(o.where("o_orderkey % 3 <> 1").select(acme, F.to_json(F.struct(F.array(job).alias("jobs"))).alias("payload")), parse_experience=True)

    def sectioned_board(queries: DataFrame) -> DataFrame:
        job = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("title").alias("text"), F.col("body").alias("description"))
        return boards.normalize_sectioned_board(o.where("o_orderkey % 2 = 1 or o_orderkey % 3 = 1").select(acme, F.to_json(F.array(job)).alias("payload")), parse_experience=True)

    def silent(queries: DataFrame) -> DataFrame:
        raise TimeoutError("no answer")

    return {"sectioned_board": sectioned_board, "company_board": company_board, "silent": silent}


def full_run(spark: SparkSession, d: str) -> DataFrame:
    """Every match of a run, the best 20 of each profile with their explanations."""
    skills = _names(spark, d).where("id % 6 <> 0").select(F.col("id").cast("string").alias("skill_id"), F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(True).alias("active"))
    settings = whole_run.Settings(CONFIG, letter_counts, len(LETTERS), carried=("source", "source_job_id"))
    out = whole_run.run(spark, new_folder(spark, "run"), "r", _parsed(spark, d), _sources(spark, d), skills, settings=settings)
    return out.matches.select(
        "resume_id", "source", "source_job_id", F.floor(F.col("overall_score") * 1000 + 1e-6).alias("thousandths"), "tier", "parsed_count", "explanation", F.lit(out.status).alias("run_status"), F.lit(out.error).alias("run_error"),
    )


QUERIES = {"full_run": full_run}
_COUNTS = lambda x: "[" + ", ".join(f"CAST(length({x}) - length(replace({x}, '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"
_LISTS = "list(name ORDER BY name) FILTER (held) AS have, list(name ORDER BY name) FILTER (NOT held) AS lack"
ORACLE_SQL = {
    "full_run": f"""WITH names AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1),
resume_skills AS (SELECT n_nationkey AS resume_id, name FROM nation, names WHERE (id + n_nationkey) % 3 = 0 AND id % 4 <> 0 AND n_nationkey <> 24),
known AS (SELECT name FROM names WHERE id % 6 <> 0 UNION SELECT name FROM resume_skills),
resumes AS (SELECT resume_id, CAST(resume_id % 12 AS DOUBLE) AS candidate_years, {_COUNTS("t")} AS vec FROM (SELECT resume_id, 'Skills: ' || string_agg(name, ', ' ORDER BY name) AS t FROM resume_skills GROUP BY 1)),
listed AS (SELECT DISTINCT l_orderkey AS k, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
texts AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 9 + 1) || '+ years of experience' ELSE 'Apply' END || coalesce((SELECT string_agg(name, ' ') FROM listed WHERE k = o_orderkey), '') AS t FROM orders),
jobs AS (SELECT k, CASE WHEN k % 3 <> 1 THEN 'company_board' ELSE 'sectioned_board' END AS source, sha256(CASE WHEN k % 3 <> 1 THEN 'company_board' ELSE 'sectioned_board' END || chr(0) || 'acme:' || k) AS job_id, CASE WHEN k % 3 <> 0 THEN CAST(k % 9 + 1 AS DOUBLE) END AS required_years, {_COUNTS("t")} AS vec FROM texts),
asked AS (SELECT k, name FROM listed SEMI JOIN known USING (name)),
totals AS (SELECT k, count(*) AS n FROM asked GROUP BY 1),
earned AS (SELECT resume_id, k, count(*) AS e FROM asked JOIN resume_skills USING (name) GROUP BY 1, 2),
parts AS (SELECT r.resume_id, j.k, source, job_id, coalesce(n, 0) AS n, n IS NULL AS skills_unparsed, coalesce(e, 0) / CAST(n AS DOUBLE) * sqrt(least(1.0::DOUBLE, n / 6.0::DOUBLE)) AS skill, greatest(0, least(1, (list_cosine_similarity(r.vec, j.vec) - 0.5::DOUBLE) / 0.5::DOUBLE)) AS semantic, required_years - candidate_years AS gap
  FROM jobs j CROSS JOIN resumes r LEFT JOIN totals USING (k) LEFT JOIN earned e ON e.k = j.k AND e.resume_id = r.resume_id),
o AS (SELECT *, (CASE WHEN skills_unparsed THEN semantic ELSE 0.6::DOUBLE * skill + 0.4::DOUBLE * semantic END) * CASE WHEN gap IS NULL OR gap <= 0 THEN 1.0 WHEN gap <= 1 THEN 0.95 WHEN gap <= 3 THEN 0.85 ELSE 0.7 END::DOUBLE AS o FROM parts),
scored AS (SELECT *, round(o, 4) AS overall_score, CASE WHEN skills_unparsed THEN NULL WHEN round(o, 9) >= 0.36::DOUBLE THEN 'strong' WHEN round(o, 9) >= 0.25::DOUBLE THEN 'moderate' ELSE 'weak' END AS tier FROM o),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY overall_score DESC, job_id) AS place FROM scored) WHERE place <= 20),
lists AS (SELECT t.resume_id, t.k, {_LISTS} FROM (SELECT t.resume_id, t.k, a.name, h.name IS NOT NULL AS held FROM top t JOIN asked a USING (k) LEFT JOIN resume_skills h ON h.resume_id = t.resume_id AND h.name = a.name) t GROUP BY 1, 2),
x AS (SELECT t.resume_id, t.k, tier, n, skills_unparsed, coalesce(have, CAST([] AS VARCHAR[])) AS have, coalesce(lack, CAST([] AS VARCHAR[])) AS lack FROM top t LEFT JOIN lists USING (resume_id, k)),
said AS (SELECT resume_id, k, {EXPLANATION} AS explanation FROM (SELECT *, {PHRASE("have", 5)} AS h, {PHRASE("lack", 5)} AS l FROM x))
SELECT resume_id, source, 'acme:' || k AS source_job_id, CAST(floor(overall_score * 1000 + 0.000001::DOUBLE) AS BIGINT) AS thousandths, tier, n AS parsed_count, explanation, 'partial' AS run_status, 'silent: no answer' AS run_error FROM scored LEFT JOIN said USING (resume_id, k)""",
}
