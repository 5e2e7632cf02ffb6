"""Explanations of matches from their stored columns; no model is called here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators import rank

MOST_LISTED, MOST_IN_PROMPT, MOST_EXPLAINED, THIN = 5, 6, 20, 2
# Display names of tiers, and the four rewritten openings.
TIER_LABELS = {"strong": "Strong match", "moderate": "Decent match", "weak": "Weak fit"}
# Fixed value: openings of a model's reply that say nothing.
PREAMBLE = r"(?i)^\s*(sure[,!.]?|certainly[,!.]?|of course[,!.]?|here(?:'s| is)[^.:]*[.:]|explanation[.:]|based on the (?:above|provided)[^,]*,)\s*"


def list_phrase(names: Column, most: int = MOST_LISTED) -> Column:
    """``a, b and c``, or the first ``most`` and how many more."""
    full = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    n = F.size(full)
    ends = F.concat_ws(" and ", F.array_join(F.slice(full, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.element_at(full, -1))
    return F.when(n == 0, "").when(n > most, F.concat(F.array_join(F.slice(full, 1, most), ", "), F.lit(" and "), (n - most).cast("string"), F.lit(" more"))).when(n == 1, F.get(full, F.lit(0))).otherwise(ends)


def evidence_clause(parsed_count: Column) -> Column:
    n = F.coalesce(parsed_count, F.lit(0))
    noun = F.when(n == 1, "requirement").otherwise("requirements")
    return F.when((n >= 1) & (n <= THIN), F.concat(F.lit(" This rests on only "), n.cast("string"), F.lit(" stated "), noun, F.lit("."))).otherwise("")


def explain_template(tier: Column, matching: Column, missing: Column, parsed_count: Column, unparsed: Column) -> Column:
    """A sentence or two by tier and by what is held and missing."""
    have, lack = list_phrase(matching), list_phrase(missing)
    some, gaps = have != "", lack != ""
    one = F.size(F.filter(missing, lambda x: x.isNotNull() & (x != ""))) == 1
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    strong = F.when(gaps, say("A strong match: you bring ", have, ". Also asked for: ", lack, ".")).otherwise(say("A strong match: you bring ", have, ", all that it asks for."))
    moderate = (
        F.when(some & gaps, say("A fair match: you bring ", have, "; ", lack, " would make it stronger."))
        .when(some, say("A fair match: you bring ", have, "."))
        .otherwise(say("A fair match in outline, though nothing it names (", lack, ") is on your résumé."))
    )
    weak = (
        F.when(some & gaps, say("A weak match: you bring ", have, ", but it needs ", lack, " too."))
        .when(gaps, say("A weak match: it needs ", lack, F.when(one, ", which is not on your résumé.").otherwise(", which are not on your résumé.")))
        .otherwise("A weak match: it shares little with your résumé.")
    )
    text = F.concat(F.when(tier == "strong", strong).when(tier == "moderate", moderate).otherwise(weak), evidence_clause(parsed_count))
    return F.when(unparsed, "The requirements of this posting could not be read, so no skills were compared; the score tells overall similarity only.").otherwise(text)


def with_explanations(matches: DataFrame) -> DataFrame:
    return matches.withColumn("explanation", explain_template(F.col("tier"), F.col("matching_skills"), F.col("missing_skills"), F.col("parsed_count"), F.col("skills_unparsed")))


def top_n_for_explanation(matches: DataFrame, most: int = MOST_EXPLAINED) -> DataFrame:
    """The best of each résumé, both buckets together; matches are a table, of which some postings tell what need not be sorted."""
    order = Window.partitionBy("resume_id").orderBy(F.desc("overall_score"), "job_id")
    return rank.reachable(matches, rank.some_postings(matches), most, ("resume_id",)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def explanation_prompts(matches: DataFrame) -> DataFrame:
    """matches (with title, company, candidate_years, required_years) and a prompt for a model of the caller's choice."""
    names = lambda c: F.coalesce(F.nullif(F.array_join(F.slice(c, 1, MOST_IN_PROMPT), ", "), F.lit("")), F.lit("none"))
    skills = F.when(F.col("skills_unparsed"), F.lit("The posting's requirements are unknown: say so, and name none.")).otherwise(F.concat(F.lit("Asked for and held: "), names("matching_skills"), F.lit("\nAsked for and not held: "), names("missing_skills")))
    years = F.when(F.col("required_years").isNotNull() & F.col("candidate_years").isNotNull(), F.concat(F.lit("Years asked for: "), F.col("required_years").cast("string"), F.lit("; years held: "), F.col("candidate_years").cast("string")))
    head = F.concat(F.lit("Posting: "), F.coalesce("title", F.lit("")), F.lit("\nCompany: "), F.coalesce(F.nullif("company", F.lit("")), F.lit("not stated")), F.lit("\nScore: "), F.round(F.col("overall_score") * 100).cast("int").cast("string"), F.lit("%"))
    return matches.withColumn("prompt", F.concat_ws("\n", head, skills, years, F.lit("Explain the match to the candidate in two or three plain sentences.")))


def tidy_replies(reply: Column) -> Column:
    """A model's reply without fence, preamble, quotes around it and spare white space; nothing left: null."""
    text = F.trim(F.regexp_replace(F.trim(reply), r"^```[a-z]*\n?|```$", ""))
    text = F.trim(F.regexp_replace(text, PREAMBLE, ""))
    text = F.regexp_replace(text, r"(?s)^([\"'])(.+)\1$", "$2")
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def explain_with(matches: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Replies of the caller's model to the prompts, in Arrow batches."""
    def run(batches):
        for pdf in batches:
            pdf["explanation"] = model(pdf["prompt"].tolist())
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matches.schema if f.name != "explanation")
    return matches.drop("explanation").mapInPandas(run, f"{schema}, explanation string").withColumn("explanation", tidy_replies(F.col("explanation")))


def relabel(text: Column) -> Column:
    """Openings of stored explanations in today's wording."""
    for old, new in (("Strong match\\.", "A strong match:"), ("Decent match\\.", "A fair match:"), ("Moderate match\\.", "A fair match:"), ("Weak fit\\.", "A weak match:")):
        text = F.regexp_replace(text, f"^{old}", new)
    return text


def tier_label(tier: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in TIER_LABELS.items() for x in pair)), tier)


def score_breakdown(matches: DataFrame) -> DataFrame:
    """The components as percentages."""
    return matches.select("resume_id", "job_id", *(F.round(F.col(c) * 100, 0).cast("int").alias(f"{c}_pct") for c in ("overall_score", "skill_score", "semantic_score", "skill_recall", "skill_confidence")))


