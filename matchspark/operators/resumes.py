"""Work on the résumé table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.arrays import let
from matchspark.functions.normalize import _squeezed
from matchspark.operators.dedupe import split_budget
from matchspark.operators.vocabulary import canonicalize_all

LEAST_CHARS, MOST_CHARS, MOST_LABEL, MOST_QUERIES, SKILLS_PER_QUERY = 120, 24_000, 60, 3, 4
# What parsers say for nothing; domains of made-up addresses.
PLACEHOLDERS = (
    "string", "str", "n/a", "na", "none", "null", "unknown", "not specified", "not provided", "not mentioned", "example", "john doe",
    "jane doe", "your name", "-", "",
)
FAKE_DOMAINS = ("@example.com", "@email.com", "@domain.com")
# Seniority and filler words of titles; skills too common to search by.
SENIORITY = r"(?i)\b(senior|sr|junior|jr|lead|principal|staff|chief|head|associate|entry.level|mid.level|intern|trainee|i{1,3}|iv|v|\d)\b"
TITLE_FILLER = r"(?i)\b(at|for|of|the|and|with|in|to)\b"
GENERIC_SKILLS = (
    "communication", "teamwork", "leadership", "problem solving", "problem-solving", "time management", "agile", "scrum", "git", "english",
    "microsoft office", "excel", "ms office", "documentation", "collaboration", "analytical skills", "teamplayer", "team player",
)


def is_placeholder(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin(*PLACEHOLDERS), F.lit(True))


def clean_optional(x: Column) -> Column:
    return F.when(~is_placeholder(x), F.trim(x))


def clean_required(x: Column) -> Column:
    return F.coalesce(clean_optional(x), F.lit(""))


def clean_email(x: Column) -> Column:
    """Lower case; null unless there is an @ and a dot after the last one, or for a made-up domain."""
    e = F.lower(clean_optional(x))
    fake = F.lit(False)
    for domain in FAKE_DOMAINS:
        fake = fake | e.endswith(domain)
    return F.when(F.contains(e, F.lit("@")) & F.contains(F.substring_index(e, "@", -1), F.lit(".")) & ~fake, e)


def dedupe_labels(labels: Column) -> Column:
    """Labels without placeholders, overlong ones and repeats in any case; order kept."""
    good = F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: ~is_placeholder(x) & (F.length(x) <= MOST_LABEL))
    folded = lambda a: F.transform(a, lambda x: F.lower(x))
    return F.filter(good, lambda x, i: F.array_position(folded(good), F.lower(x)) == i + 1)


def intake_gate(raw: DataFrame, text: str = "text") -> DataFrame:
    """Texts long enough for a résumé, cut for the parser."""
    return raw.where(F.length(F.trim(text)) >= LEAST_CHARS).withColumn(text, F.substring(text, 1, MOST_CHARS))


def validate_resumes(df: DataFrame, col: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """Accepted rows with a cleaned parse, and rejected rows with their reasons."""
    p = F.col(col)
    years = p["total_experience_years"]
    clean = F.struct(
        clean_optional(p["name"]).alias("name"), clean_email(p["email"]).alias("email"), clean_optional(p["phone"]).alias("phone"), years.alias("total_experience_years"),
        dedupe_labels(p["skills"]).alias("skills"),
        F.filter(F.transform(p["projects"], lambda x: F.struct(clean_required(x["title"]).alias("title"), dedupe_labels(x["tech"]).alias("tech"))), lambda x: x["title"] != "").alias("projects"),
        F.filter(F.transform(p["experience"], lambda x: F.struct(clean_required(x["company"]).alias("company"), clean_required(x["role"]).alias("role"), clean_required(x["duration"]).alias("duration"))), lambda x: (x["company"] != "") | (x["role"] != "")).alias("experience"),
        F.filter(F.transform(p["education"], lambda x: F.struct(clean_required(x["institution"]).alias("institution"), clean_required(x["degree"]).alias("degree"), clean_optional(x["year"]).alias("year"))), lambda x: (x["institution"] != "") | (x["degree"] != "")).alias("education"),
    )
    cleaned = df.withColumn("_clean", F.when(p.isNotNull(), clean))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    reasons = F.array_compact(F.array(
        F.when(p.isNull(), "no parse"), F.when((years < 0) | (years > 60), "years out of range"),
        F.when(p.isNotNull() & none(F.col("_clean.skills")) & none(F.col("_clean.experience")), "neither skills nor experience"),
    ))
    tagged = cleaned.withColumn("reasons", reasons)
    return tagged.where("size(reasons) = 0").withColumn(col, F.col("_clean")).drop("_clean", "reasons"), tagged.where("size(reasons) > 0").drop("_clean")


def replace_resume_skills(current: DataFrame, edits: DataFrame, skills: DataFrame, source: str, blocklist: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """resume_skills after the lists of edited résumés (resume_id, skills array) are replaced, and vocabulary rows to add."""
    phrases = edits.select("resume_id", F.posexplode("skills").alias("pos", "raw"))
    links, added = canonicalize_all(phrases, skills, "resume_id", blocklist)
    kept = current.join(edits.select("resume_id").distinct(), "resume_id", "left_anti")
    return kept.select("resume_id", "skill_id", "source").unionByName(links.select("resume_id", "skill_id", F.lit(source).alias("source"))), added


def upsert_users(current: DataFrame, emails: DataFrame) -> DataFrame:
    """users (user_id, email) with a row for every new address, trimmed and folded."""
    folded = emails.select(F.lower(F.trim("email")).alias("email")).where("email <> ''").distinct()
    return current.select("user_id", "email").unionByName(folded.join(current, "email", "left_anti").select(F.sha2("email", 256).alias("user_id"), "email"))


def clean_title(title: Column) -> Column:
    role = F.regexp_replace(F.regexp_replace(title, SENIORITY, " "), TITLE_FILLER, " ")
    return F.trim(F.regexp_replace(F.get(F.split(role, r"[-–—|(/,]", 2), F.lit(0)), r"\s+", " "))


def build_search_queries(resumes: DataFrame, max_results: int = 100, max_queries: int = MOST_QUERIES) -> tuple[DataFrame, DataFrame]:
    """resume_id, n, keywords, max_results of the searches of each résumé (resume_id, parsed), and résumés with none.

    First the latest title, then the leading skills, then the title before.
    """
    p = F.col("parsed")
    titles = F.filter(F.transform(F.coalesce(p["experience"]["role"], F.array().cast("array<string>")), lambda t: clean_title(F.coalesce(t, F.lit("")))), lambda t: F.size(F.split(t, " ")) >= 2)
    keyed = lambda a: F.transform(a, lambda x: _squeezed(F.lower(x)))
    # each is keyed once, not once for every other
    once = lambda a: let(keyed(a), lambda k: F.filter(a, lambda x, i: (F.array_position(k, F.get(k, i)) == i + 1) & (F.get(k, i) != "")))
    skills = F.filter(F.transform(F.coalesce(p["skills"], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: ~_squeezed(F.lower(x)).isin(*GENERIC_SKILLS))
    rows = resumes.select("resume_id", titles.alias("t"), skills.alias("s")).select("resume_id", once(F.col("t")).alias("t"), once(F.col("s")).alias("s"))
    bag = F.when(F.size("s") > 0, F.array_join(F.slice("s", 1, SKILLS_PER_QUERY), " "))
    sets = F.slice(F.array_compact(F.array(F.get("t", F.lit(0)), bag, F.get("t", F.lit(1)))), 1, max_queries)
    rows = rows.select("resume_id", sets.alias("k"))
    queries = rows.where("size(k) > 0").select("resume_id", F.posexplode("k").alias("n", "keywords"), split_budget(F.lit(max_results), F.size("k")).alias("max_results"))
    return queries, rows.where("size(k) = 0").select("resume_id", F.lit("no usable titles or skills").alias("reason"))


def resume_profile(resumes: DataFrame, resume_skills: DataFrame, skills: DataFrame) -> DataFrame:
    """resume_id, skill_ids (active, sorted), candidate_years (null unless a number), embedding."""
    held = resume_skills.join(skills.where("active").select("skill_id"), "skill_id").groupBy("resume_id").agg(F.array_sort(F.collect_set("skill_id")).alias("skill_ids"))
    own = resumes.select("resume_id", F.col("years").cast("string").try_cast("double").alias("candidate_years"), *(["embedding"] if "embedding" in resumes.columns else []))
    return own.join(held, "resume_id", "left").withColumn("skill_ids", F.coalesce("skill_ids", F.array().cast("array<string>")))


