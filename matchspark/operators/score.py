"""Scores of profile × posting pairs: weighted skill recall, passage similarity, experience.

Recall is computed by joins on the skill, not per pair: what a posting asks for
is summed once, what a profile holds of it comes from one equi-join, and both
meet in the pair table. Cosines need every pair of a profile vector and a
passage; a posting's passages stand in one row, profiles are broadcast after a
count, and only the mean of each pair's best goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from matchspark.tables import keep

SCORER_VERSION = "matchspark-1"
# Requirement labels folded to two levels.
REQUIREMENT_LEVELS = {
    "required": "required", "require": "required", "must": "required", "must_have": "required", "essential": "required", "mandatory": "required",
    "preferred": "preferred", "prefer": "preferred", "nice_to_have": "preferred", "nice": "preferred", "optional": "preferred",
    "desired": "preferred", "desirable": "preferred", "bonus": "preferred", "plus": "preferred",
}
#: Most profile vectors that are sent to every task at once (768 floats each: 60 MB).
MOST_BROADCAST = 20_000
#: Most profiles whose recall is read within a posting's row; more are joined on the skill.
MOST_IN_ROW = 500
#: Profiles whose sums stand in one row; their holders are bits of a long.
IN_SUMS = 64
#: Skills that some profile holds up to which the holders are sent to every task; more are joined by a shuffle.
MOST_HELD = 100_000
#: Cosines that one matrix product makes at most.
BLOCK_CELLS = 1 << 21


@dataclass(frozen=True)
class Config:
    required: float = 1.0
    preferred: float = 0.4
    full_evidence: int = 6
    cos_lo: float = 0.53
    cos_hi: float = 0.69
    top_k: int = 3
    skill_share: float = 0.6
    strong: float = 0.36
    moderate: float = 0.25


def requirement_level(label: Column) -> Column:
    """required or preferred; null is required, an unknown label preferred."""
    key = F.regexp_replace(F.lower(F.trim(label)), "[- ]", "_")
    levels = F.create_map(*(F.lit(x) for pair in REQUIREMENT_LEVELS.items() for x in pair))
    return F.when(label.isNull(), "required").otherwise(F.coalesce(F.try_element_at(levels, key), F.lit("preferred")))


def requirement_weight(label: Column, c: Config = Config()) -> Column:
    return F.when(requirement_level(label) == "required", c.required).otherwise(c.preferred)


def skill_confidence(n: Column, c: Config = Config()) -> Column:
    return F.sqrt(F.least(F.lit(1.0), n / F.lit(float(c.full_evidence))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column, strict: bool = True) -> Column:
    """0 for a null, empty or zero vector; vectors of unequal width are an error, or null where not strict."""
    n = norm(a) * norm(b)
    empty = F.coalesce(F.size(a) < 1, F.lit(True)) | F.coalesce(F.size(b) < 1, F.lit(True))
    wrong = F.raise_error(F.lit("vectors of unequal width")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(empty, 0.0).when(F.size(a) != F.size(b), wrong).when(n == 0, 0.0).otherwise(dot(a, b) / n)


def rescale_clamp(mean: Column, lo: float, hi: float) -> Column:
    if hi <= lo:
        return F.when(mean.isNull(), 0.0).when(mean >= hi, 1.0).otherwise(0.0)
    return F.when(mean.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean - F.lit(lo)) / F.lit(hi - lo))))


def experience_multiplier(required: Column, candidate: Column) -> Column:
    gap = required.cast("double") - candidate.cast("double")
    return F.when(gap.isNull() | (gap <= 0), 1.0).when(gap <= 1, 0.95).when(gap <= 3, 0.85).otherwise(0.7)


def overall_score(recall: Column, confidence: Column, semantic: Column, multiplier: Column, c: Config = Config()) -> Column:
    """A null recall marks a posting whose skills are unknown: similarity alone counts."""
    return F.when(recall.isNull(), semantic * multiplier).otherwise((c.skill_share * recall * confidence + (1 - c.skill_share) * semantic) * multiplier)


def tier(overall: Column, unparsed: Column, c: Config = Config()) -> Column:
    """By the score before its rounding to four places; nine places settle scores that stand exactly at a bound: what rounds to it is at least half a unit below it."""
    bound = lambda x: F.lit(float(Decimal(repr(round(x, 9))) - Decimal("5e-10")))
    return F.when(unparsed, None).when(overall >= bound(c.strong), "strong").when(overall >= bound(c.moderate), "moderate").otherwise("weak")


def round4(x: Column) -> Column:
    """F.round(x, 4), which goes through decimals, for the few numbers that stand near a tie or are none; others by arithmetic."""
    y = x * 10000.0
    return F.when(F.abs(y - F.rint(y)) > 0.4999, F.round(x, 4)).otherwise(F.rint(y) / 10000.0 + 0.0)


def active_job_skills(job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """job_id, skill_id, name, requirement of active skills."""
    return job_skills.join(skills.where("active").select("skill_id", "name"), "skill_id").select("job_id", "skill_id", "name", "requirement")


def job_totals(asked: DataFrame, c: Config = Config()) -> DataFrame:
    """job_id, possible (sum of weights), parsed_count, names (sorted)."""
    return asked.groupBy("job_id").agg(F.sum(requirement_weight(F.col("requirement"), c)).alias("possible"), F.count(F.lit(1)).alias("parsed_count"), F.array_sort(F.collect_list("name")).alias("names"))


def skill_recall(asked: DataFrame, resume_skills: DataFrame, pairs: DataFrame, c: Config = Config()) -> DataFrame:
    """pairs (resume_id, job_id) with recall, confidence, parsed_count, skills_unparsed."""
    held = resume_skills.select("resume_id", "skill_id").distinct()
    weighed = asked.select("job_id", "skill_id", requirement_weight(F.col("requirement"), c).alias("w"))
    earned = weighed.join(held, "skill_id").groupBy("resume_id", "job_id").agg(F.sum("w").alias("earned"))
    totals = weighed.groupBy("job_id").agg(F.sum("w").alias("possible"), F.count(F.lit(1)).alias("parsed_count"))
    out = pairs.join(totals, "job_id", "left").join(earned, ["resume_id", "job_id"], "left")
    return out.select(
        *pairs.columns,
        F.when(F.col("possible").isNotNull(), F.least(F.lit(1.0), F.coalesce("earned", F.lit(0.0)) / F.col("possible"))).alias("skill_recall"),  # sums may differ in the last bit
        F.when(F.col("parsed_count").isNotNull(), skill_confidence(F.col("parsed_count"), c)).alias("skill_confidence"),
        F.coalesce("parsed_count", F.lit(0)).cast("long").alias("parsed_count"),
        F.col("parsed_count").isNull().alias("skills_unparsed"),
    )


def _pairs_in_rows(resumes: DataFrame, own: DataFrame, asked: DataFrame, resume_skills: DataFrame, cosines: DataFrame, c: Config) -> DataFrame:
    """The pairs of few profiles as skill_recall gives them, with candidate_years and mean_cos.

    Profiles are numbered, and a skill's holders are the bits of a number. What a
    posting asks for is summed once, for each of up to IN_SUMS profiles in a
    column of its own; its pairs are made from that row, so none is shuffled,
    sorted or held and no function is called for a pair and skill. More profiles
    go in further passes. Other columns of ``own`` stay with its pairs.
    """
    carried = [x for x in own.columns if x not in ("job_id", "required_years")]
    profiles = resumes.select("resume_id", "candidate_years").collect()  # at most MOST_IN_ROW
    place = {x: i for i, x in enumerate(dict.fromkeys(r["resume_id"] for r in profiles if r["resume_id"] is not None))}
    kind = {f.name: f.dataType.simpleString() for f in resumes.select("resume_id", "candidate_years").schema}
    passes = [[r for r in profiles if place.get(r["resume_id"], 0) // IN_SUMS == k] for k in range(max(1, -(-len(place) // IN_SUMS)))]
    near = cosines.where("resume_id is not null").groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("resume_id", "mean_cos"))).alias("near"))
    weighed = asked.select("job_id", "skill_id", requirement_weight(F.col("requirement"), c).alias("w"))
    weighed, near = (weighed, near) if len(passes) == 1 else (keep(weighed, "weighed"), keep(near, "near"))
    out = None
    for some in passes:
        rows = [(r["resume_id"], r["candidate_years"], None if r["resume_id"] is None else place[r["resume_id"]] % IN_SUMS) for r in some]
        given = own.sparkSession.createDataFrame(rows, f"resume_id {kind['resume_id']}, candidate_years {kind['candidate_years']}, slot int")
        bits = F.broadcast(given.where("slot is not null").select("resume_id", F.expr("shiftleft(1L, slot)").alias("bit")).distinct())
        holders = keep(resume_skills.join(bits, "resume_id").groupBy("skill_id").agg(F.bit_or("bit").alias("bits")), "holders")
        holders = F.broadcast(holders) if holders.count() <= MOST_HELD else holders.hint("merge")
        earned = [F.sum(F.when(F.col("bits").bitwiseAND(F.lit(int(np.uint64(1 << i).view(np.int64)))) != 0, F.col("w")).otherwise(0.0)) for i in range(min(IN_SUMS, max(1, len(place))))]
        # dealt while rows are short: sums go nowhere any more
        dealt = weighed.join(holders, "skill_id", "left").select("job_id", "w", F.coalesce("bits", F.lit(0)).alias("bits")).repartition("job_id")
        totals = dealt.groupBy("job_id").agg(F.sum("w").alias("possible"), F.count(F.lit(1)).alias("parsed_count"), F.array(*earned).alias("earned"))
        every = given.agg(F.collect_list(F.struct("resume_id", "candidate_years", "slot")).alias("every"))
        both = own.hint("merge").join(totals, "job_id", "left").hint("merge").join(near, "job_id", "left").crossJoin(F.broadcast(every))
        pairs = both.select("job_id", "required_years", *carried, "possible", "parsed_count", "earned", "near", F.inline("every"))
        made = pairs.select(
            "resume_id", "job_id", "required_years", *carried, "candidate_years", F.when(F.col("near").isNotNull(), F.try_element_at("near", "resume_id")).alias("mean_cos"),
            F.when(F.col("possible").isNotNull(), F.least(F.lit(1.0), F.coalesce(F.get("earned", "slot"), F.lit(0.0)) / F.col("possible"))).alias("skill_recall"),  # sums may differ in the last bit
            F.when(F.col("parsed_count").isNotNull(), skill_confidence(F.col("parsed_count"), c)).alias("skill_confidence"),
            F.coalesce("parsed_count", F.lit(0)).cast("long").alias("parsed_count"), F.col("parsed_count").isNull().alias("skills_unparsed"),
        )
        out = made if out is None else out.unionByName(made)
    return out


def with_skill_names(matches: DataFrame, asked: DataFrame, resume_skills: DataFrame) -> DataFrame:
    """matches with matching_skills and missing_skills, by name. For all pairs this collects what every job asks for once a profile."""
    held = resume_skills.select("resume_id", "skill_id", F.lit(True).alias("held")).distinct()
    rows = matches.select("resume_id", "job_id").join(asked.select("job_id", "skill_id", "name"), "job_id").join(held, ["resume_id", "skill_id"], "left")
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("name"))))
    lists = rows.groupBy("resume_id", "job_id").agg(names(F.col("held").isNotNull()).alias("matching_skills"), names(F.col("held").isNull()).alias("missing_skills"))
    none = F.array().cast("array<string>")
    return matches.join(lists, ["resume_id", "job_id"], "left").withColumns({c: F.coalesce(c, none) for c in ("matching_skills", "missing_skills")})


def _passes(df: DataFrame, key: str) -> list[DataFrame]:
    """df in broadcasts of about MOST_BROADCAST rows by a hash of the key, after a count."""
    parts = max(1, -(-df.count() // MOST_BROADCAST))
    return [F.broadcast(df if parts == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)) for k in range(parts)]


def passage_similarity(resume_vectors: DataFrame, chunks: DataFrame, c: Config = Config()) -> DataFrame:
    """resume_id, job_id, mean of the top_k cosines of a posting's passages.

    Norms are computed once a row. A posting's passages stand in one row, so that
    a pair's cosines are made, sorted and averaged within it and none is
    shuffled. Profile vectors are counted: up to MOST_BROADCAST go to every task,
    more in as many passes over the postings.
    """
    given = lambda df, key, name: df.select(key, F.struct(F.col("vec").alias("v"), norm(F.col("vec")).alias("n")).alias("x")).where("x.n > 0").groupBy(key).agg(F.collect_list("x").alias(name))
    j = given(chunks, "job_id", "passages")
    out = None
    for part in _passes(resume_vectors.select("resume_id", "vec"), "resume_id"):
        both = j.crossJoin(F.broadcast(given(part, "resume_id", "own")))
        cosines = F.flatten(F.transform("passages", lambda p: F.transform("own", lambda r: dot(r["v"], p["v"]) / (r["n"] * p["n"]))))
        best = both.select("resume_id", "job_id", F.slice(F.sort_array(cosines, asc=False), 1, c.top_k).alias("best"))
        mean = best.select("resume_id", "job_id", (F.aggregate("best", F.lit(0.0), lambda acc, x: acc + x) / F.size("best")).alias("mean_cos"))
        out = mean if out is None else out.unionByName(mean)
    return out


def passage_similarity_blocks(resume_vectors: DataFrame, chunks: DataFrame, c: Config = Config()) -> DataFrame:
    """passage_similarity by matrix products over Arrow blocks: worth its crossing to Python where profiles are many.

    A pass sends at most MOST_BROADCAST profile vectors, of unit length, to every
    task as one matrix. A task takes postings as they come, multiplies slices of
    their passages by it, of which a slice's product holds BLOCK_CELLS numbers,
    and keeps each posting's best ``top_k`` cosines so far for every vector.
    Vectors of another width than the first profile's are an error.
    """
    given = lambda df, key: df.select(key, F.transform("vec", lambda x: x.cast("double")).alias("vec")).where("exists(vec, x -> x <> 0) and forall(vec, x -> x is not null)")
    passages = given(chunks, "job_id").groupBy("job_id").agg(F.collect_list("vec").alias("p"))
    own = keep(given(resume_vectors, "resume_id"), "profiles")
    kinds = {"job_id": chunks.schema["job_id"].dataType.simpleString(), "resume_id": resume_vectors.schema["resume_id"].dataType.simpleString()}
    parts = max(1, -(-own.count() // MOST_BROADCAST))
    out = None
    for k in range(parts):
        held = own.where(F.pmod(F.xxhash64("resume_id"), F.lit(parts)) == k).orderBy("resume_id").collect()  # at most about MOST_BROADCAST rows
        if not held and k:
            continue
        made = passages.mapInArrow(_products(own.sparkSession, held, to_arrow_type(own.schema["resume_id"].dataType), c.top_k), f"resume_id {kinds['resume_id']}, job_id {kinds['job_id']}, mean_cos double")
        out = made if out is None else out.unionByName(made)
    return out


def _products(spark: SparkSession, held: list, kind: pa.DataType, top: int):
    """The function of a task of passage_similarity_blocks, for some profile vectors in order of their profile."""
    matrix = np.array([r["vec"] for r in held], np.float64)
    ids = list(dict.fromkeys(r["resume_id"] for r in held))
    first = np.flatnonzero([i == 0 or held[i]["resume_id"] != held[i - 1]["resume_id"] for i in range(len(held))])
    sent = spark.sparkContext.broadcast((matrix.T / np.linalg.norm(matrix, axis=1) if held else matrix, ids, first))

    def best_of(own: np.ndarray) -> np.ndarray:
        return own if len(own) <= top else np.partition(own, len(own) - top, axis=0)[len(own) - top :]

    def means(best: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mean of the best of each profile's columns."""
        if len(first) == best.shape[1]:
            return best.mean(axis=0)
        return np.array([best_of(part.reshape(-1, 1)).mean() for part in np.split(best, first[1:], axis=1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across, ids, first = sent.value
        for batch in batches if ids else ():
            lists = batch.column(1)
            for row in range(batch.num_rows):
                vectors = lists[row].values
                x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
                if x.shape[1] != across.shape[0]:
                    raise ValueError("vectors of unequal width")
                step, best = max(1, BLOCK_CELLS // across.shape[1]), None
                for at in range(0, len(x), step):
                    part = x[at : at + step]
                    cosines = (part / np.linalg.norm(part, axis=1, keepdims=True)) @ across
                    best = best_of(cosines if best is None else np.concatenate([best, cosines]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([batch.column(0)[row].as_py()] * len(ids), batch.column(0).type), pa.array(means(best, first))], ["resume_id", "job_id", "mean_cos"])

    return run


def score_all(resumes: DataFrame, jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, resume_skills: DataFrame, chunks: DataFrame, resume_vectors: DataFrame, c: Config = Config(), names: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of resumes (resume_id, candidate_years) and jobs (job_id, required_years), scored.

    The pair table is the result's size by definition; profiles are counted. Up
    to MOST_IN_ROW are paired within each posting's row; more are broadcast, in
    several passes over the jobs where they are very many, and meet what they
    earn and their cosines by joins. ``carried`` names columns of jobs that stay
    with every pair, so that no one has to join them to all pairs.
    """
    own = jobs.select("job_id", "required_years", *carried)
    asked, cosines = active_job_skills(job_skills, skills), passage_similarity(resume_vectors, chunks, c)
    if resumes.count() <= MOST_IN_ROW:
        scored = _pairs_in_rows(resumes, own, asked, resume_skills, cosines, c)
    else:
        pairs = None
        for part in _passes(resumes.select("resume_id", "candidate_years"), "resume_id"):
            both = own.crossJoin(part)
            pairs = both if pairs is None else pairs.unionByName(both)
        scored = skill_recall(asked, resume_skills, pairs, c).join(cosines.hint("merge"), ["resume_id", "job_id"], "left")
    scored = scored.withColumn("semantic_score", rescale_clamp(F.col("mean_cos"), c.cos_lo, c.cos_hi)).withColumn("multiplier", experience_multiplier(F.col("required_years"), F.col("candidate_years")))
    scored = scored.withColumn("overall", overall_score(F.col("skill_recall"), F.col("skill_confidence"), F.col("semantic_score"), F.col("multiplier"), c))
    # by way of a generator, so that a filter on the score does not take all that it is made of in once more for each time it is named
    made = ["overall", "semantic_score", "multiplier"]
    scored = scored.select(*(x for x in scored.columns if x not in made), F.inline(F.array(F.struct(*made))))
    r4 = lambda x: round4(F.col(x) if isinstance(x, str) else x)
    scored = scored.select(
        "resume_id", "job_id", r4("overall").alias("overall_score"), r4("semantic_score").alias("semantic_score"),
        r4(F.col("skill_recall") * F.col("skill_confidence")).alias("skill_score"), r4("skill_recall").alias("skill_recall"), r4("skill_confidence").alias("skill_confidence"),
        "parsed_count", "skills_unparsed", F.col("multiplier").alias("experience_multiplier"), tier(F.col("overall"), F.col("skills_unparsed"), c).alias("tier"),
        F.lit(SCORER_VERSION).alias("model_version"), *carried,
    )
    return with_skill_names(scored, asked, resume_skills) if names else scored


def load_postings(jobs: DataFrame, job_skills: DataFrame, skills: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a job with its active skills and its passages in order; jobs without either stay."""
    asked = active_job_skills(job_skills, skills).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("name", "skill_id", "requirement"))).alias("skills"))
    parts = chunks.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "vec"))).alias("passages"))
    return jobs.join(asked, "job_id", "left").join(parts, "job_id", "left")
