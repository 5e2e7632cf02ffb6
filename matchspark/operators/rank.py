"""Ranked lists, pages and the tables that a reader sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.tables import keep

#: What stands in one ranked list; one posting in how many tells how far down such a list its first rows reach.
BUCKET, SOME = ("resume_id", "skills_unparsed"), 64


def rank_matches(matches: DataFrame) -> DataFrame:
    """matches with rank and total within (résumé, ranked or unparsed): the two are never mixed. Ties go to the smaller job.

    Rows are dealt by range of (bucket, score, job); a range's rows are numbered
    by themselves and begin where the ranges of the bucket before it end, so that
    a bucket of any size is ranked by as many tasks as it has ranges.
    """
    order = [F.desc("overall_score"), F.asc("job_id")]
    ranged = keep(matches.repartitionByRange("resume_id", "skills_unparsed", *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("resume_id", "skills_unparsed", "_part").agg(F.count(F.lit(1)).alias("_here"))  # a row a bucket and range
    bucket = Window.partitionBy("resume_id", "skills_unparsed")
    before = F.coalesce(F.sum("_here").over(bucket.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("resume_id", "skills_unparsed", "_part", before.alias("_before"), F.sum("_here").over(bucket).alias("total"))
    own = F.row_number().over(Window.partitionBy("resume_id", "skills_unparsed", "_part").orderBy(*order))
    placed = ranged.withColumn("_own", own).join(sizes.hint("merge"), ["resume_id", "skills_unparsed", "_part"])
    return placed.select(*matches.columns, (F.col("_before") + F.col("_own")).alias("rank"), "total")


def some_postings(df: DataFrame) -> DataFrame:
    """Rows of one posting in SOME, by a hash."""
    return df.where(F.pmod(F.xxhash64("job_id"), F.lit(SOME)) == 0)


def reachable(matches: DataFrame, some: DataFrame, most: int, bucket: tuple = BUCKET) -> DataFrame:
    """matches without rows that cannot be among the first ``most`` of their bucket.

    The ``most``-th of a part of the matches stands no earlier than that of all:
    what comes after it in order is left out before anything is sorted. A bucket
    with fewer rows in the part loses none.
    """
    order = Window.partitionBy(*bucket).orderBy(F.desc("overall_score"), "job_id")
    last = some.select(*bucket, F.col("overall_score").alias("_score"), F.col("job_id").alias("_job"), F.row_number().over(order).alias("_n")).where(F.col("_n") == most)
    near = F.col("_score").isNull() | (F.col("overall_score") > F.col("_score")) | ((F.col("overall_score") == F.col("_score")) & (F.col("job_id") <= F.col("_job")))
    return matches.join(F.broadcast(last), list(bucket), "left").where(near).select(*matches.columns)  # a row a bucket


def top_ranked(matches: DataFrame, most: int, some: DataFrame | None = None) -> DataFrame:
    """The first ``most`` of each bucket, without totals. ``some``: matches of some of the postings, which tell what need not be sorted."""
    bucket = Window.partitionBy(*BUCKET).orderBy(F.desc("overall_score"), "job_id")
    rows = matches if some is None else reachable(matches, some, most)
    return rows.withColumn("rank", F.row_number().over(bucket)).where(F.col("rank") <= most)


def page(matches: DataFrame, limit: int, offset: int = 0, unparsed_limit: int | None = None, unparsed_offset: int = 0, some: DataFrame | None = None) -> DataFrame:
    """One page of either bucket, each with its own limit and offset, with rank and the bucket's total.

    Only the first rows of a bucket are ranked, and totals are counted apart, so no bucket is gathered. ``some`` as in top_ranked.
    """
    rest = unparsed_limit if unparsed_limit is not None else limit
    own = (F.col("rank") > offset) & (F.col("rank") <= offset + limit)
    other = (F.col("rank") > unparsed_offset) & (F.col("rank") <= unparsed_offset + rest)
    shown = top_ranked(matches, max(offset + limit, unparsed_offset + rest), some).where(F.when(F.col("skills_unparsed"), other).otherwise(own))
    totals = matches.groupBy("resume_id", "skills_unparsed").agg(F.count(F.lit(1)).alias("total"))
    return shown.join(totals.hint("shuffle_hash"), ["resume_id", "skills_unparsed"])


def min_score(matches: DataFrame, least: float) -> DataFrame:
    """Ranked matches of at least this score; unparsed ones stay."""
    return matches.where(F.col("skills_unparsed") | (F.col("overall_score") >= least))


def match_cards(matches: DataFrame, jobs: DataFrame, columns: tuple = ("title", "company", "location", "is_remote", "apply_url", "posted_date")) -> DataFrame:
    return matches.hint("merge").join(jobs.select("job_id", *(c for c in columns if c in jobs.columns)), "job_id")


def job_detail(jobs: DataFrame, asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Jobs with active skills by name and passages by index, vectors left out."""
    skills = asked.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("name", "requirement"))).alias("skills"))
    texts = chunks.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("chunks"))
    return jobs.join(skills, "job_id", "left").join(texts, "job_id", "left")


def absolute_rank(page_rows: DataFrame, offset: int) -> DataFrame:
    """Place among all ranked matches of rows of one page (position from 0)."""
    return page_rows.withColumn("place", F.when(~F.col("skills_unparsed"), F.lit(offset) + F.col("position") + 1))


def thin_evidence(parsed_count: Column, unparsed: Column) -> Column:
    return (parsed_count >= 1) & (parsed_count <= 2) & ~unparsed


def skill_suggestions(matches: DataFrame, held: DataFrame) -> DataFrame:
    """resume_id, name, demand: skills that a résumé's ranked matches ask for and it does not hold (held: resume_id, name)."""
    asked = matches.where("not skills_unparsed").select("resume_id", F.explode(F.array_distinct(F.concat("matching_skills", "missing_skills"))).alias("name"))
    wanted = asked.groupBy("resume_id", "name").agg(F.count(F.lit(1)).alias("demand"))
    return wanted.hint("merge").join(held.select("resume_id", "name").distinct(), ["resume_id", "name"], "left_anti")


def suggestions_for_all(resumes: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """skill_suggestions where every pair is scored, without the pairs.

    Every posting with skills is then among a résumé's ranked matches, so a
    skill's demand is the number of postings that ask for it, the same for all;
    what a résumé holds (resume_id, name) goes. The result is a row a résumé and
    skill by definition.
    """
    demand = keep(asked.groupBy("name").agg(F.count_distinct("job_id").alias("demand")), "demand")
    wanted = resumes.select("resume_id").distinct().hint("shuffle_replicate_nl").crossJoin(demand)
    return wanted.hint("merge").join(held.select("resume_id", "name").distinct(), ["resume_id", "name"], "left_anti")


def requirements_split(asked: DataFrame) -> DataFrame:
    """job_id with the names it requires and all others."""
    must = F.coalesce(F.col("requirement") == "required", F.lit(False))
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("name"))))
    return asked.groupBy("job_id").agg(names(must).alias("required"), names(~must).alias("other"))


def refused_searches(requests: DataFrame, resumes: DataFrame, known_sources: list[str]) -> DataFrame:
    """Requests (request_id, resume_id, sources) that cannot run, with the first reason."""
    state = resumes.select("resume_id", F.lit(True).alias("known"), F.col("parsed").isNotNull().alias("has_parse"))
    odd = F.filter("sources", lambda s: ~s.isin(*known_sources))
    reason = F.when(F.col("known").isNull(), "unknown resume").when(~F.col("has_parse"), "resume not parsed").when(F.size(odd) > 0, F.concat(F.lit("unknown source: "), F.array_join(odd, ", ")))
    return requests.join(state, "resume_id", "left").select("request_id", "resume_id", reason.alias("reason")).where("reason is not null")
