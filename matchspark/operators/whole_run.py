"""A whole run: from parsed profiles and what sources deliver to scored, stored and explained matches.

The stages follow each other as tables in the run's folder. A stage's table is
written once and read by those after it, so that nothing is computed twice and
every join knows its sizes. A run that is started again under its folder takes
the tables that are complete as they are and goes on with the first that is not.

The pairs are by far the largest table and are written once: where no earlier
matches are stored, the matches are the scored pairs, to which the few
explanations are sent as they are read. Shuffle files go with each stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.operators import chunk, dedupe, embed, explain, extract, resumes, runs, score, vocabulary
from matchspark.sources.boards import with_dedup_hash
from matchspark.tables import freed, is_complete

LINKS = "resume_id string, skill_id string, source string"
#: Rows of a written table up to which a join sends them to every task.
MOST_SENT = 20_000


@dataclass(frozen=True)
class Stored:
    """What earlier runs left behind; None where there is nothing yet."""

    jobs: DataFrame | None = None
    job_skills: DataFrame | None = None
    passages: DataFrame | None = None
    matches: DataFrame | None = None


@dataclass(frozen=True)
class Settings:
    config: score.Config = field(default_factory=score.Config)
    embedder: Callable | None = None
    width: int = embed.WIDTH
    #: Replies of a model to prompts; a template explains where there is none or it says nothing.
    model: Callable[[list[str]], list[str]] | None = None
    most_explained: int = explain.MOST_EXPLAINED
    max_results: int = 100
    #: Columns of postings that matches keep; stored matches have them too.
    carried: tuple[str, ...] = ()


@dataclass(frozen=True)
class Outcome:
    """The tables of a run; all but events, rejected and queries are None where no source delivered."""

    status: str
    error: str | None
    events: DataFrame
    rejected: DataFrame
    queries: DataFrame
    skills: DataFrame
    jobs: DataFrame | None = None
    job_skills: DataFrame | None = None
    passages: DataFrame | None = None
    matches: DataFrame | None = None


class _Folder:
    """The tables and the events of a run."""

    def __init__(self, spark: SparkSession, path: str, run_id: str, sources: list[str]):
        self.spark, self.path, self.run_id, self.sources, self.stage = spark, path, run_id, sources, None

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.path}/{name}"
        if not is_complete(self.spark, path):
            with freed(self.spark):
                make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def enter(self, stage: str, status: str = "running", jobs_found: int = 0, errors: list[str] | None = None) -> None:
        self.stage = stage
        runs.record_run(self.spark, self.run_id, status, stage, self.sources, jobs_found, errors).write.mode("append").parquet(f"{self.path}/events")

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/events")


def _sent(df: DataFrame) -> DataFrame:
    """A written table to join with: sent to every task where it has few rows, which its footers tell, else dealt by key."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df.hint("merge")


def _profiles(at: _Folder, parsed: DataFrame, skills: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Accepted profiles with their vectors, rejected ones, links to skills, and the vocabulary with what profiles add."""
    checked = at.table("checked", lambda: parsed.select("resume_id", "parsed"))
    good, bad = resumes.validate_resumes(checked)
    text = good.withColumn("text", embed.resume_embedding_text(F.col("parsed")))
    own = at.table("profiles", lambda: embed.embed_table(text.select("resume_id", "parsed", F.col("parsed.total_experience_years").alias("candidate_years"), "text"), "text", s.embedder, s.width))
    edits = own.select("resume_id", F.col("parsed.skills").alias("skills"))
    none = at.spark.createDataFrame([], LINKS).withColumn("resume_id", F.col("resume_id").cast(own.schema["resume_id"].dataType))
    links, added = resumes.replace_resume_skills(none, edits, skills, "parsed")
    known = at.table("vocabulary", lambda: skills.select("skill_id", "name", "aliases", "active").unionByName(added.select("skill_id", "name", "aliases", "active")))
    return own, at.table("rejected", lambda: bad.select("resume_id", "reasons")), at.table("resume_skills", lambda: links), known


def _fetched(at: _Folder, sources: dict[str, Callable[[DataFrame], DataFrame]], queries: DataFrame) -> tuple[DataFrame | None, dict[str, str]]:
    """The postings of all sources that deliver, first of each text, and the errors of the others."""
    found, errors = [], {}
    for name, fetch in sources.items():
        try:
            found.append(at.table(f"fetched-{name}", lambda f=fetch: f(queries)))
        except Exception as problem:  # whatever one source does, the others are read
            errors[name] = str(problem).splitlines()[0] if str(problem) else type(problem).__name__
    if not found:
        return None, errors
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    hashed = with_dedup_hash(every).withColumns({c: F.lit(None).cast(kind) for c, kind in (("fetched_at", "timestamp"), ("seq", "long")) if c not in every.columns})
    return at.table("found", lambda: dedupe.dedup_within_run(hashed, ("source", "source_job_id", F.desc("fetched_at"), F.desc("seq")))), errors


def _explained(top: DataFrame, jobs: DataFrame, profiles: DataFrame, model: Callable | None) -> DataFrame:
    """resume_id, job_id, explanation of the best matches."""
    told = explain.with_explanations(top)
    if model is None:
        return told.select("resume_id", "job_id", "explanation")
    both = told.withColumnRenamed("explanation", "_template").hint("merge").join(jobs.select("job_id", "title", "company", F.col("experience_min_years").alias("required_years")), "job_id").hint("merge").join(profiles.select("resume_id", "candidate_years"), "resume_id")
    said = explain.explain_with(explain.explanation_prompts(both), model)
    return said.select("resume_id", "job_id", F.coalesce("explanation", "_template").alias("explanation"))


def run(spark: SparkSession, folder: str, run_id: str, parsed: DataFrame, sources: dict[str, Callable[[DataFrame], DataFrame]], skills: DataFrame, stored: Stored = Stored(), settings: Settings = Settings()) -> Outcome:
    """Take profiles (resume_id, parsed) through a run in ``folder``, which executors share.

    ``sources`` gives for each name a function from search queries (resume_id, n,
    keywords, max_results) to normalised postings, unique by key. One that fails
    is noted in the events and leaves the run ``partial``; if none delivers the
    run is ``failed``. A posting that several deliver is kept of the first by
    name. Skills that profiles name and the vocabulary lacks are added to it.
    Postings found now are extracted and cut where they have no skills or passages
    yet, scored against every profile, and merged into the stored matches, whose
    explanations stay; the best of each profile without one are explained. Any
    other error is noted with its stage, marks the run failed and is raised.

    Blank postings have no passage and no skill and are scored as such; profiles
    that are rejected have no match; empty tables go through every stage.
    """
    at = _Folder(spark, folder, run_id, list(sources))
    try:
        return _run(at, parsed, sources, skills, stored, settings)
    except Exception as problem:
        at.enter(at.stage, "failed", errors=[str(problem) or type(problem).__name__])
        raise


def _run(at: _Folder, parsed: DataFrame, sources: dict, skills: DataFrame, stored: Stored, s: Settings) -> Outcome:
    only = lambda df, old, some: df if old is None else df.hint("merge").join(some.select("job_id"), "job_id", "left_semi")
    plus = lambda old, new: new if old is None else old.select(*new.columns).unionByName(new)

    at.enter("loading_resume")
    profiles, rejected, links, known = _profiles(at, parsed, skills, s)
    at.enter("building_queries")
    queries = at.table("queries", lambda: resumes.build_search_queries(profiles, s.max_results)[0])
    at.enter("fetching")
    found, errors = _fetched(at, sources, queries)
    told = [f"{name}: {error}" for name, error in sorted(errors.items())]
    first = {"rejected": rejected, "queries": queries, "skills": known}
    if found is None:
        at.enter("done", "failed", errors=told)
        return Outcome("failed", "; ".join(told) or None, at.events(), **first)
    n = found.count()  # of a written table: read from its footers
    current = found.limit(0).withColumn("job_id", F.lit("")).drop("seq") if stored.jobs is None else stored.jobs
    jobs = at.table("jobs", lambda: dedupe.upsert_jobs(current, found))
    key = ["source", "source_job_id"]
    # without stored postings all are found now
    mine = jobs.dropna(subset=key) if stored.jobs is None else at.table("found-jobs", lambda: jobs.hint("merge").join(found.select(*key), key, "left_semi"))
    mine = mine.withColumn("required_years", F.col("experience_min_years").cast("double"))

    at.enter("extracting_skills", jobs_found=n)
    todo = mine if stored.job_skills is None else extract.pending_jobs(mine, stored.job_skills)
    text = todo.select("job_id", extract.extraction_text(F.col("title"), F.col("description")).alias("text"))
    read = at.table("extracted", lambda: extract.extract_skills(text, vocabulary.build_vocab_index(known)).drop("name"))
    job_skills = plus(stored.job_skills, read)

    at.enter("embedding", jobs_found=n)
    made = at.table("embedded", lambda: embed.embed_table(chunk.chunk_jobs(mine, stored.passages), "text", s.embedder, s.width))
    passages = plus(stored.passages, made)

    at.enter("scoring", jobs_found=n)
    asked, vectors = only(job_skills, stored.job_skills, mine), profiles.where("vec is not null").select("resume_id", "vec")
    pairs = lambda: score.score_all(profiles, mine, asked, _sent(known), links, only(passages, stored.passages, mine), vectors, s.config, names=False, carried=s.carried)
    scored = at.table("scored", lambda: pairs().withColumns({"explanation": F.lit(None).cast("string"), "created_at": F.current_timestamp()}))

    at.enter("writing_matches", jobs_found=n)
    written = scored if stored.matches is None else at.table("written", lambda: dedupe.upsert_matches(stored.matches, scored))

    at.enter("explaining", jobs_found=n)
    pair = ["resume_id", "job_id"]
    first_of = lambda: explain.top_n_for_explanation(scored.drop("explanation", "created_at", *s.carried), s.most_explained).dropna(subset=pair)
    best = at.table("best", lambda: first_of() if stored.matches is None else first_of().hint("merge").join(stored.matches.where("explanation is not null").select(*pair), pair, "left_anti"))
    wanted = asked.join(_sent(best.select("job_id")), "job_id", "left_semi")
    top = score.with_skill_names(best, score.active_job_skills(wanted, known), links)
    new = at.table("explained", lambda: _explained(top, mine, profiles, s.model).withColumnRenamed("explanation", "_new"))
    told_of = lambda: written.join(_sent(new), pair, "left").withColumn("explanation", F.coalesce("explanation", "_new")).drop("_new")
    matches = told_of() if new.count() <= MOST_SENT else at.table("matches", told_of)

    status = "failed" if errors and not n else "partial" if errors else "success"
    at.enter("done", status, n, told or None)
    return Outcome(status, "; ".join(told)[: runs.MOST_ERROR_CHARS] or None, at.events(), jobs=jobs, job_skills=job_skills, passages=passages, matches=matches, **first)
