"""Queries on scores and ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.operators import explain, rank, report, rescore, score
from matchspark.plans import mapping as m
from matchspark.plans.records import EXPLANATION, PHRASE
from matchspark.tables import keep


def _scored(spark: SparkSession, d: str, names: bool = False) -> DataFrame:
    return score.score_all(m.resumes(spark, d), m.jobs(spark, d), m.job_skills(spark, d), m.skills(spark, d), m.resume_skills(spark, d), m.chunks(spark, d), m.resume_vectors(spark, d), m.CONFIG, names)


def _some(spark: SparkSession, d: str) -> DataFrame:
    """The same for one posting in rank.SOME."""
    few = rank.some_postings
    return score.score_all(m.resumes(spark, d), few(m.jobs(spark, d)), few(m.job_skills(spark, d)), m.skills(spark, d), m.resume_skills(spark, d), few(m.chunks(spark, d)), m.resume_vectors(spark, d), m.CONFIG, False)


def _best(spark: SparkSession, d: str, most: int = 20) -> DataFrame:
    return rank.top_ranked(_scored(spark, d), most, _some(spark, d))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return score.active_job_skills(m.job_skills(spark, d), m.skills(spark, d))


def _top(spark: SparkSession, d: str, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The best postings of every profile with names of skills, and (resume_id, name) of what profiles hold of what these ask for.

    The best are few, and written: every table is brought down to what concerns them before it is joined.
    """
    top = keep(_best(spark, d, most), "top")
    asked = keep(_asked(spark, d).join(F.broadcast(top.select("job_id").distinct()), "job_id", "left_semi"), "asked")
    skills = keep(asked.select("skill_id", "name").distinct(), "skills")
    held = keep(m.resume_skills(spark, d).join(F.broadcast(skills), "skill_id"), "held")
    return score.with_skill_names(top, asked, held), held.select("resume_id", "name")


def flagship_rank(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best postings of every profile in either bucket."""
    top = _best(spark, d)
    return top.select("resume_id", "job_id", "rank", "skills_unparsed", F.round("overall_score", 3).alias("overall_score"), "parsed_count", "tier")


def job_totals(spark: SparkSession, d: str) -> DataFrame:
    return score.job_totals(_asked(spark, d)).select("job_id", F.round("possible", 6).alias("possible"), "parsed_count", F.array_join("names", "; ").alias("names"))


def recall_by_profile(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.groupBy("resume_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("skills_unparsed").alias("n_unparsed"), F.round(F.avg("skill_recall"), 3).alias("mean_recall"), F.round(F.avg("skill_confidence"), 3).alias("mean_confidence"), F.max("parsed_count").alias("most_asked"))


def passage_similarity(spark: SparkSession, d: str) -> DataFrame:
    return score.passage_similarity(m.resume_vectors(spark, d), m.chunks(spark, d), m.CONFIG).select("resume_id", "job_id", F.round("mean_cos", 6).alias("mean_cos"))


def passage_products(spark: SparkSession, d: str) -> DataFrame:
    """The same by matrix products."""
    return score.passage_similarity_blocks(m.resume_vectors(spark, d), m.chunks(spark, d), m.CONFIG).select("resume_id", "job_id", F.round("mean_cos", 6).alias("mean_cos"))


def experience_mix(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("resume_id", "experience_multiplier").agg(F.count(F.lit(1)).alias("n"))


def tier_distribution(spark: SparkSession, d: str) -> DataFrame:
    return report.tier_distribution(_scored(spark, d)).select("tier", "n", F.round("share", 6).alias("share"))


def evidence_distribution(spark: SparkSession, d: str) -> DataFrame:
    return report.evidence_distribution(_scored(spark, d)).select("parsed_count", "n", F.round("cumulative_share", 6).alias("cumulative_share"))


def score_bands(spark: SparkSession, d: str) -> DataFrame:
    titled = _scored(spark, d).hint("merge").join(m.jobs(spark, d).select("job_id", "title"), "job_id")
    return report.score_bands(titled, F.col("title") == "1-URGENT").select("band", "n", F.round("share_of_class", 6).alias("share_of_class"))


def match_cards(spark: SparkSession, d: str) -> DataFrame:
    cards = rank.match_cards(_best(spark, d), m.jobs(spark, d), ("title",))
    return cards.select("resume_id", "job_id", "rank", "skills_unparsed", "title", rank.thin_evidence(F.col("parsed_count"), F.col("skills_unparsed")).alias("thin"))


def second_page(spark: SparkSession, d: str) -> DataFrame:
    return rank.page(rank.min_score(_scored(spark, d), 0.3), 10, 10, 5, 0, rank.min_score(_some(spark, d), 0.3)).select("resume_id", "job_id", "skills_unparsed", "rank", "total")


def requirements_split(spark: SparkSession, d: str) -> DataFrame:
    return rank.requirements_split(_asked(spark, d)).select("job_id", F.array_join("required", "; ").alias("required"), F.array_join("other", "; ").alias("other"))


def skill_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return rank.skill_suggestions(*_top(spark, d))


def all_skill_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Demand for what a profile lacks among all its ranked postings."""
    held = m.resume_skills(spark, d).join(m.skills(spark, d), "skill_id").select("resume_id", "name")
    return rank.suggestions_for_all(m.resumes(spark, d), _asked(spark, d), held)


def ranked_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every match with its rank and its bucket's total."""
    tied = _scored(spark, d).withColumn("overall_score", F.floor(F.col("overall_score") * 1000 + 1e-6))
    return rank.rank_matches(tied).select("resume_id", "job_id", "skills_unparsed", "rank", "total")


def explanations(spark: SparkSession, d: str) -> DataFrame:
    return explain.with_explanations(_top(spark, d)[0]).select("resume_id", "job_id", "explanation")


def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return explain.score_breakdown(_best(spark, d))


def job_detail(spark: SparkSession, d: str) -> DataFrame:
    texts = m.chunks(spark, d).withColumn("text", F.concat(F.lit("passage "), F.col("chunk_index").cast("string")))
    out = rank.job_detail(m.jobs(spark, d), _asked(spark, d), texts)
    return out.select("job_id", F.coalesce(F.size("skills"), F.lit(0)).alias("n_skills"), F.array_join(F.transform("skills", lambda s: s["name"]), "; ").alias("skills"), F.array_join(F.transform("chunks", lambda c: c["text"]), "; ").alias("chunks"))


def rescored_matches(spark: SparkSession, d: str) -> DataFrame:
    """The matches of an earlier state brought up to date: a tenth of the jobs is new, of others skills or passages were fewer, some profiles held nothing."""
    now = m.resumes(spark, d), m.jobs(spark, d), m.job_skills(spark, d), m.skills(spark, d), m.resume_skills(spark, d), m.chunks(spark, d), m.resume_vectors(spark, d)
    resumes, jobs, asked, skills, held, chunks, vectors = now
    jobs_then = jobs.where("job_id % 10 <> 0")
    asked_then = asked.where("job_id % 10 <> 0 and (job_id % 10 <> 1 or skill_id % 2 = 0)")
    chunks_then = chunks.where("job_id % 10 <> 2 or chunk_index < 2")
    held_then = held.where("resume_id % 7 <> 0")
    matches = score.score_all(resumes, jobs_then, asked_then, skills, held_then, chunks_then, vectors, m.CONFIG, names=False)
    job_changes = rescore.changes(rescore.job_digests(jobs_then, asked_then, skills, chunks_then, m.CONFIG), rescore.job_digests(jobs, asked, skills, chunks, m.CONFIG), "job_id")
    resume_changes = rescore.changes(rescore.resume_digests(resumes, held_then, vectors), rescore.resume_digests(resumes, held, vectors), "resume_id")
    out = rescore.rescore(matches, job_changes, resume_changes, *now, m.CONFIG)
    return out.select("resume_id", "job_id", F.floor(F.col("overall_score") * 1000 + 1e-6).alias("thousandths"), "tier", "parsed_count", "rescored")


QUERIES = {
    f.__name__: f
    for f in (flagship_rank, job_totals, recall_by_profile, passage_similarity, passage_products, experience_mix, tier_distribution, evidence_distribution, score_bands, match_cards, second_page, requirements_split, skill_suggestions, explanations, score_breakdown, job_detail, rescored_matches, all_skill_suggestions, ranked_matches)
}

_W = f"WITH {m.SQL}"
_RANKED = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY resume_id, skills_unparsed ORDER BY overall_score DESC, job_id) AS rank FROM scored)"
_NAMED = _RANKED + """, top AS (SELECT * FROM ranked WHERE rank <= 20),
named AS (SELECT t.resume_id, t.job_id, name, rs.skill_id IS NOT NULL AS held FROM top t JOIN asked a USING (job_id) LEFT JOIN resume_skills rs ON rs.resume_id = t.resume_id AND rs.skill_id = a.skill_id)"""
ORACLE_SQL = {
    "flagship_rank": _W + _RANKED + " SELECT resume_id, job_id, rank, skills_unparsed, round(overall_score, 3) AS overall_score, parsed_count, tier FROM ranked WHERE rank <= 20",
    "job_totals": _W + " SELECT job_id, round(sum(w), 6) AS possible, count(*) AS parsed_count, string_agg(name, '; ' ORDER BY name) AS names FROM asked GROUP BY 1",
    "recall_by_profile": _W + " SELECT resume_id, count(*) AS n, count(*) FILTER (skills_unparsed) AS n_unparsed, round(avg(round(recall, 4)), 3) AS mean_recall, round(avg(CASE WHEN NOT skills_unparsed THEN round(confidence, 4) END), 3) AS mean_confidence, max(parsed_count) AS most_asked FROM scored GROUP BY 1",
    "passage_similarity": _W + " SELECT resume_id, job_id, round(mean_cos, 6) AS mean_cos FROM best",
    "passage_products": _W + " SELECT resume_id, job_id, round(mean_cos, 6) AS mean_cos FROM best",
    "experience_mix": _W + " SELECT resume_id, mult AS experience_multiplier, count(*) AS n FROM scored GROUP BY 1, 2",
    "tier_distribution": _W + " SELECT tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM scored GROUP BY 1",
    "evidence_distribution": _W + " SELECT parsed_count, n, round(sum(n) OVER (ORDER BY parsed_count) / sum(n) OVER (), 6) AS cumulative_share FROM (SELECT parsed_count, count(*) AS n FROM scored WHERE NOT skills_unparsed GROUP BY 1)",
    "score_bands": _W + " SELECT CAST(floor(round(overall_score / 0.1::DOUBLE, 6)) AS INTEGER) AS band, count(*) AS n, round(avg(CASE WHEN title = '1-URGENT' THEN 1 ELSE 0 END), 6) AS share_of_class FROM scored WHERE NOT skills_unparsed GROUP BY 1",
    "match_cards": _W + _RANKED + " SELECT resume_id, job_id, rank, skills_unparsed, title, parsed_count BETWEEN 1 AND 2 AND NOT skills_unparsed AS thin FROM ranked WHERE rank <= 20",
    "second_page": _W + """, kept AS (SELECT * FROM scored WHERE skills_unparsed OR overall_score >= 0.3::DOUBLE),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY resume_id, skills_unparsed ORDER BY overall_score DESC, job_id) AS rank, count(*) OVER (PARTITION BY resume_id, skills_unparsed) AS total FROM kept)
        SELECT resume_id, job_id, skills_unparsed, rank, total FROM ranked WHERE CASE WHEN skills_unparsed THEN rank <= 5 ELSE rank > 10 AND rank <= 20 END""",
    "requirements_split": _W + " SELECT job_id, coalesce(string_agg(name, '; ' ORDER BY name) FILTER (requirement = 'required'), '') AS required, coalesce(string_agg(name, '; ' ORDER BY name) FILTER (requirement IS DISTINCT FROM 'required'), '') AS other FROM asked GROUP BY 1",
    "skill_suggestions": _W + _NAMED + " SELECT resume_id, name, count(*) AS demand FROM named WHERE NOT held GROUP BY 1, 2",
    "explanations": _W + _NAMED + f""", lists AS (SELECT resume_id, job_id, list(name ORDER BY name) FILTER (held) AS have, list(name ORDER BY name) FILTER (NOT held) AS lack FROM named GROUP BY 1, 2),
        x AS (SELECT t.resume_id, t.job_id, tier, parsed_count AS n, skills_unparsed, coalesce(have, CAST([] AS VARCHAR[])) AS have, coalesce(lack, CAST([] AS VARCHAR[])) AS lack FROM top t LEFT JOIN lists USING (resume_id, job_id)),
        p AS (SELECT *, {PHRASE('have', 5)} AS h, {PHRASE('lack', 5)} AS l FROM x) SELECT resume_id, job_id, {EXPLANATION} AS explanation FROM p""",
    "score_breakdown": _W + _RANKED + """ SELECT resume_id, job_id, CAST(round(overall_score * 100) AS INTEGER) AS overall_score_pct, CAST(round(round(recall * confidence, 4) * 100) AS INTEGER) AS skill_score_pct,
        CAST(round(round(semantic, 4) * 100) AS INTEGER) AS semantic_score_pct, CAST(round(round(recall, 4) * 100) AS INTEGER) AS skill_recall_pct, CASE WHEN NOT skills_unparsed THEN CAST(round(round(confidence, 4) * 100) AS INTEGER) END AS skill_confidence_pct FROM ranked WHERE rank <= 20""",
    "all_skill_suggestions": _W + " SELECT r.resume_id, d.name, d.demand FROM resumes r CROSS JOIN (SELECT name, count(DISTINCT job_id) AS demand FROM asked GROUP BY 1) d WHERE NOT EXISTS (SELECT 1 FROM resume_skills rs JOIN skills s USING (skill_id) WHERE rs.resume_id = r.resume_id AND s.name = d.name)",
    "ranked_matches": _W + """, t AS (SELECT *, floor(overall_score * 1000 + 0.000001::DOUBLE) AS s FROM scored)
        SELECT resume_id, job_id, skills_unparsed, row_number() OVER (PARTITION BY resume_id, skills_unparsed ORDER BY s DESC, job_id) AS rank, count(*) OVER (PARTITION BY resume_id, skills_unparsed) AS total FROM t""",
    "rescored_matches": _W + """, jc AS (SELECT job_id FROM jobs WHERE job_id % 10 = 0 UNION SELECT job_id FROM asked WHERE job_id % 10 = 1 AND skill_id % 2 = 1 UNION SELECT job_id FROM chunks WHERE job_id % 10 = 2 AND chunk_index >= 2), rc AS (SELECT resume_id FROM resume_skills WHERE resume_id % 7 = 0)
        SELECT resume_id, job_id, CAST(floor(overall_score * 1000 + 0.000001::DOUBLE) AS BIGINT) AS thousandths, tier, parsed_count, job_id IN (SELECT job_id FROM jc) OR resume_id IN (SELECT resume_id FROM rc) AS rescored FROM scored""",
    "job_detail": _W + """, s AS (SELECT job_id, count(*) AS n, string_agg(name, '; ' ORDER BY name) AS skills FROM asked GROUP BY 1), c AS (SELECT job_id, string_agg('passage ' || chunk_index, '; ' ORDER BY chunk_index) AS chunks FROM chunks GROUP BY 1)
        SELECT j.job_id, CAST(coalesce(n, 0) AS INTEGER) AS n_skills, skills, chunks FROM jobs j LEFT JOIN s USING (job_id) LEFT JOIN c USING (job_id)""",
}
