"""Scores brought up to date: only pairs whose posting or profile changed are scored again.

Whatever a pair's score depends on is summed up in a digest of its posting and
one of its profile. Digests of the last run against those of now tell what is
new, changed or gone; a changed posting meets all profiles, a changed profile all
other postings, and every other pair keeps its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.operators.dedupe import upsert_matches
from matchspark.operators.resumes import replace_resume_skills
from matchspark.operators.score import SCORER_VERSION, Config, active_job_skills, requirement_level, score_all
from matchspark.tables import keep


def _multiset(rows: DataFrame, key: str, *what: Column, name: str) -> DataFrame:
    """key and a digest of its rows whatever their order: their number and 128 bits of hashes."""
    both = [F.bit_xor(F.xxhash64(F.lit(seed), *what)).cast("string") for seed in (1, 2)]
    return rows.groupBy(key).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *both).alias(name))


def job_digests(jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, chunks: DataFrame, c: Config = Config()) -> DataFrame:
    """job_id, digest: years, active skills with their levels, passages, and how scores are made."""
    asked = _multiset(active_job_skills(job_skills, skills), "job_id", F.col("skill_id"), F.col("name"), requirement_level(F.col("requirement")), name="_asked")
    texts = _multiset(chunks, "job_id", F.transform("vec", lambda x: x.cast("double")), name="_texts")
    own = jobs.select("job_id", "required_years").hint("merge").join(asked, "job_id", "left").join(texts, "job_id", "left")
    return own.select("job_id", F.concat_ws("|", F.lit(SCORER_VERSION), F.lit(repr(c)), *(F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in ("required_years", "_asked", "_texts"))).alias("digest"))


def resume_digests(resumes: DataFrame, resume_skills: DataFrame, resume_vectors: DataFrame) -> DataFrame:
    """resume_id, digest: years, held skills, vectors."""
    held = _multiset(resume_skills.select("resume_id", "skill_id").distinct(), "resume_id", F.col("skill_id"), name="_held")
    vectors = _multiset(resume_vectors, "resume_id", F.transform("vec", lambda x: x.cast("double")), name="_vectors")
    own = resumes.select("resume_id", "candidate_years").hint("merge").join(held, "resume_id", "left").join(vectors, "resume_id", "left")
    return own.select("resume_id", F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in ("candidate_years", "_held", "_vectors"))).alias("digest"))


def changes(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """key, change (new, changed, gone) of keys whose digest differs."""
    both = before.withColumnRenamed("digest", "_old").hint("merge").join(now.withColumnRenamed("digest", "_new"), key, "full_outer")
    return both.where("not _old <=> _new").select(key, F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").otherwise("changed").alias("change"))


def _only(df: DataFrame, some: DataFrame, key: str) -> DataFrame:
    return df.hint("merge").join(some.select(key), key, "left_semi")


def _without(df: DataFrame, some: DataFrame, key: str) -> DataFrame:
    return df.hint("merge").join(some.select(key), key, "left_anti")


def rescore(
    matches: DataFrame, job_changes: DataFrame, resume_changes: DataFrame, resumes: DataFrame, jobs: DataFrame, job_skills: DataFrame, skills: DataFrame,
    resume_skills: DataFrame, chunks: DataFrame, resume_vectors: DataFrame, c: Config = Config(), names: bool = False,
) -> DataFrame:
    """The match table of now, with ``rescored``: whether a row was made anew.

    The same rows as score_all gives on the tables of now. Rows of postings and
    profiles that are gone go. A pair scored again as its posting changed keeps
    its explanation and created_at, where matches has them; one whose profile
    changed starts without, as an edit invalidates what was said about it.
    """
    job_changes, resume_changes = keep(job_changes, "job-changes"), keep(resume_changes, "resume-changes")
    of_job = lambda df: _only(df, job_changes.where("change <> 'gone'"), "job_id")
    rest = lambda df: _without(df, job_changes, "job_id")
    of_resume = lambda df: _only(df, resume_changes.where("change <> 'gone'"), "resume_id")
    by_job = score_all(resumes, of_job(jobs), of_job(job_skills), skills, resume_skills, of_job(chunks), resume_vectors, c, names)
    by_resume = score_all(of_resume(resumes), rest(jobs), rest(job_skills), skills, of_resume(resume_skills), rest(chunks), of_resume(resume_vectors), c, names)
    valid = _without(matches, resume_changes, "resume_id")
    again = upsert_matches(of_job(valid), by_job)
    fresh = by_resume.select(*(F.col(x) if x in by_resume.columns else F.lit(None).cast(matches.schema[x].dataType).alias(x) for x in matches.columns))
    made = again.select(*matches.columns).unionByName(fresh)
    return rest(valid).withColumn("rescored", F.lit(False)).unionByName(made.withColumn("rescored", F.lit(True)))


def edit_resumes(edits: DataFrame, resume_skills: DataFrame, skills: DataFrame, matches: DataFrame, source: str = "edited", blocklist: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What an edit of skill lists (resume_id, skills) leads to: resume_skills, vocabulary rows to add, matches that stay valid, and résumés to embed and score again.

    A résumé whose list names the skills that it held before stays as it is.
    """
    links, added = replace_resume_skills(resume_skills, edits, skills, source, blocklist)
    own = lambda df: _multiset(_only(df.select("resume_id", "skill_id").distinct(), edits, "resume_id"), "resume_id", F.col("skill_id"), name="digest")
    edited = keep(changes(own(resume_skills), own(links), "resume_id").select("resume_id"), "edited")
    return links, added, _without(matches, edited, "resume_id"), edited
