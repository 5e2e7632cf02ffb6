"""Distributions and quality reports that calibrate the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.tables import keep

POINTS = (0.05, 0.25, 0.5, 0.75, 0.95)


def exact_percentiles(values: DataFrame, col: str, points: tuple = POINTS) -> DataFrame:
    """n and p, the array of interpolated percentiles, of the values that are not null; exact whatever their number.

    Equal values are counted first, so that a frequent one is a row. Distinct
    values are dealt by range; the places before a range come from the sums of
    the ranges, those within it from a window of its own, and only the values at
    the wanted places go on.
    """
    counted = values.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    ranged = keep(counted.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("part").agg(F.sum("k").alias("here"))  # a row a partition
    before = F.coalesce(F.sum("here").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("part", before.alias("before"), F.sum("here").over(Window.partitionBy(F.lit(0))).alias("n"))
    own = F.sum("k").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("own", own).join(F.broadcast(sums), "part").select("x", "n", (F.col("before") + F.col("own") - F.col("k")).alias("low"), (F.col("before") + F.col("own")).alias("high"))
    places = F.array(*(F.lit(float(p)) for p in points))
    at = F.transform(places, lambda p: p * (F.col("n") - 1))
    held = placed.withColumn("at", at).where(F.exists("at", lambda a: (F.col("low") <= F.ceil(a)) & (F.floor(a) < F.col("high"))))

    def value(i: int) -> Column:
        a = F.get("at", F.lit(i))
        holds = lambda place: F.max(F.when((F.col("low") <= place) & (place < F.col("high")), F.col("x")))
        low, high, share = holds(F.floor(a)), holds(F.ceil(a)), F.max(a - F.floor(a))
        return low + (high - low) * share

    return held.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.array(*(value(i) for i in range(len(points)))).alias("p"))


def cosine_distribution(values: DataFrame, col: str, label: str) -> DataFrame:
    """One row: label, n, min, mean, max and five exact, interpolated percentiles."""
    values = keep(values.select(col), "values")
    agg = values.agg(F.min(col).alias("min"), F.avg(col).alias("mean"), F.max(col).alias("max"))
    both = exact_percentiles(values, col).crossJoin(F.broadcast(agg))  # one row each
    return both.select(F.lit(label).alias("label"), "n", "min", "mean", "max", *(F.get("p", F.lit(i)).alias(f"p{round(100 * p):02d}") for i, p in enumerate(POINTS)))


def suggest_band(distribution: DataFrame) -> DataFrame:
    """label, lo, hi, note from cosine_distribution: refused under 20 values, warned about a narrow spread."""
    lo, hi = F.round("p05", 2), F.round("p95", 2)
    note = F.when(F.col("n") < 20, "too few values").when(hi - lo < 0.05, "narrow spread").otherwise("ok")
    enough = F.col("n") >= 20
    return distribution.select("label", F.when(enough, lo).alias("lo"), F.when(enough, hi).alias("hi"), note.alias("note"))


def extremes(values: DataFrame, key: str, col: str, most: int) -> DataFrame:
    """The best and the worst rows, each found by top-k."""
    best = values.orderBy(F.desc(col), key).limit(most).select(key, col, F.lit("best").alias("end"))
    return best.unionByName(values.orderBy(F.asc(col), key).limit(most).select(key, col, F.lit("worst").alias("end")))


def chunk_counts(chunks: DataFrame, most: int | None = None) -> DataFrame:
    out = chunks.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_chunks")).orderBy(F.desc("n_chunks"), "job_id")
    return out.limit(most) if most else out


def corpus_report(jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    """By source and (null source) in all: posting lengths, required and preferred rows, skills a job and the share of jobs with none.

    Medians hold the distinct lengths and counts of a source, which are few.
    """
    per_job = job_skills.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_skills"), F.count_if(F.col("requirement") == "required").alias("req"), F.count_if(F.col("requirement") == "preferred").alias("pref"))
    rows = jobs.select("job_id", "source", F.length("description").alias("chars")).join(per_job, "job_id", "left").fillna(0, ["n_skills", "req", "pref"])
    return rows.rollup("source").agg(
        F.count(F.lit(1)).alias("n_jobs"), F.min("chars").alias("min_chars"), F.median("chars").alias("median_chars"), F.max("chars").alias("max_chars"),
        F.sum("req").alias("n_required"), F.sum("pref").alias("n_preferred"), F.avg("n_skills").alias("mean_skills"), F.median("n_skills").alias("median_skills"), F.avg((F.col("n_skills") == 0).cast("int")).alias("share_none"),
    )


def skill_demand(job_skills: DataFrame) -> DataFrame:
    """skill_id, n_jobs: how many distinct postings ask for each skill.

    Pairs are dealt by both keys to all shuffle partitions, unmerged, before any
    is held: neither a frequent skill nor a large table fills one task.
    """
    parts = int(job_skills.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = job_skills.select("skill_id", "job_id").repartition(parts, "skill_id", "job_id").distinct()
    return pairs.groupBy("skill_id").agg(F.count("job_id").alias("n_jobs"))


def demand_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """skill_id, n_before, n_after, change between two vocabularies."""
    both = skill_demand(before).withColumnRenamed("n_jobs", "b").join(skill_demand(after).withColumnRenamed("n_jobs", "a"), "skill_id", "full_outer").fillna(0, ["a", "b"])
    return both.select("skill_id", F.col("b").alias("n_before"), F.col("a").alias("n_after"), (F.col("a") - F.col("b")).alias("change"))


def demand_without_inactive(job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """demand_change to the vocabulary without its inactive skills: pairs are counted once, and only counts meet the vocabulary."""
    stays = skills.where("active").select("skill_id").distinct().withColumn("stays", F.lit(True))
    both = skill_demand(job_skills).hint("merge").join(stays.hint("merge"), "skill_id", "left")
    n_after = F.when(F.col("stays"), F.col("n_jobs")).otherwise(F.lit(0).cast("long"))
    return both.select("skill_id", F.col("n_jobs").alias("n_before"), n_after.alias("n_after"), (n_after - F.col("n_jobs")).alias("change"))


def score_bands(matches: DataFrame, title_class: Column, width: float = 0.1) -> DataFrame:
    """Ranked matches by score band, with the share whose title is of the class."""
    band = F.floor(F.round(F.col("overall_score") / width, 6)).cast("int")
    return matches.where("not skills_unparsed").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(title_class.cast("int")).alias("share_of_class"))


def tier_distribution(matches: DataFrame) -> DataFrame:
    """Count and share of each tier (null: unparsed)."""
    counts = matches.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))  # a handful of rows, so one window over all is small
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def evidence_distribution(matches: DataFrame) -> DataFrame:
    """How many ranked matches rest on how many requirements, with the cumulative share."""
    counts = matches.where("not skills_unparsed").groupBy("parsed_count").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy().orderBy("parsed_count").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cumulative_share", F.sum("n").over(up_to) / F.sum("n").over(Window.partitionBy()))


def compare_extractions(a: DataFrame, b: DataFrame, expected: DataFrame | None = None, removed: tuple[str, ...] = ()) -> DataFrame:
    """id, only_a, only_b (sorted) of two tables (id, skills), missing, what is expected and in neither, and removed_fields, columns of b that should be gone but hold something."""
    none = F.array().cast("array<string>")
    given = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in removed if c in b.columns))).cast("array<string>")
    both = a.select("id", F.col("skills").alias("sa")).join(b.select("id", F.col("skills").alias("sb"), given.alias("rf")), "id", "full_outer")
    both = both.select("id", F.coalesce("sa", none).alias("sa"), F.coalesce("sb", none).alias("sb"), F.coalesce("rf", none).alias("removed_fields"))
    if expected is not None:
        both = both.join(expected.select("id", F.col("skills").alias("se")), "id", "left")
    else:
        both = both.withColumn("se", none)
    return both.select("id", F.array_sort(F.array_except("sa", "sb")).alias("only_a"), F.array_sort(F.array_except("sb", "sa")).alias("only_b"), F.array_sort(F.array_except(F.coalesce("se", none), F.array_union("sa", "sb"))).alias("missing"), "removed_fields")


def suspicious_years(resumes: DataFrame, low: float = 3, high: float = 12) -> DataFrame:
    return resumes.where(F.col("total_experience_years").isNull() | (F.col("total_experience_years") < low) | (F.col("total_experience_years") > high))


def feed_shape_report(jobs: DataFrame, expected_currency: Column | None = None) -> DataFrame:
    """field, rate: the share of rows in which each field is given; currency_agrees where a currency is expected."""
    rates = [F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in jobs.columns]
    if expected_currency is not None:
        rates.append(F.avg(F.when(F.col("salary_currency").isNotNull(), (F.col("salary_currency") == expected_currency).cast("int"))).alias("currency_agrees"))
    one = jobs.agg(*rates)
    return one.unpivot([], one.columns, "field", "rate")


def boilerplate_postings(jobs: DataFrame, job_skills: DataFrame, cap: int | Column, phrase: str = r"(?i)equal[ -]opportunit") -> DataFrame:
    """Postings cut exactly at the cap, with an equal-opportunity phrase and without any skill."""
    return jobs.where((F.length("description") == cap) & F.col("description").rlike(phrase)).join(job_skills.select("job_id"), "job_id", "left_anti")
