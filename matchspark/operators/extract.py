"""Skills found in posting texts against the vocabulary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.functions.arrays import let
from matchspark.tables import keep

# Openings of preferred and of required sections.
PREFERRED_MARKERS = (
    "preferred qualifications", "desired qualifications", "nice to have", "nice-to-have", "good to have", "would be a plus", "is a plus",
    "bonus points", "bonus skills", "desirable", "advantageous", "preferred skills", "preferred", "bonus", "optional",
)
REQUIRED_MARKERS = (
    "minimum qualifications", "basic qualifications", "required qualifications", "what you'll need", "what you will need",
    "what we're looking for", "what we are looking for", "skills and experience", "technical skills", "key skills", "requirements",
    "requirement", "qualifications", "must have", "must-have", "must haves", "essential", "responsibilities", "you will", "you have",
    "the role", "about the role", "skills",
)
# Surfaces that are ordinary words too, and words that tell a technology beside them.
SHORT = ("r", "go", "c", "c#", "c++", "d", "js")
AMBIGUOUS = (
    "spark", "vault", "envoy", "playwright", "jest", "express", "rails", "oracle", "pandas", "cypress", "selenium", "swift", "dart", "helm",
    "snowflake", "keras", "groovy", "perl", "ruby",
)
QUALIFIERS = (
    "programming", "program", "language", "languages", "lang", "developer", "developers", "dev", "engineer", "engineers", "golang", "coding",
    "scripting", "sharp", "dotnet", "stack",
)
#: Marks of section starts and of guarded names; removed from the input first.
S1, S2, H1, H2 = "\u0001", "\u0002", "\u0003", "\u0004"
#: Surface forms up to which their tables are broadcast; beyond, joins shuffle.
MOST_BROADCAST = 500_000
#: First pieces of forms up to which a task tests a place by a set of them before it makes a row of it.
MOST_IN_SET = 4000
#: A piece of a text: a run of what names are made of, or any other character.
PIECE = r"(?s)\x03?[A-Za-z0-9+#]+|[^\x03]"
_NAMING = r"[A-Za-z0-9+#]"


def pending_jobs(jobs: DataFrame, job_skills: DataFrame) -> DataFrame:
    """Jobs without any job_skills row yet."""
    return jobs.join(job_skills.select("job_id").hint("merge"), "job_id", "left_anti")


def extraction_text(title: Column, description: Column) -> Column:
    return F.concat_ws("\n\n", title, F.coalesce(description, F.lit("")))


def split_sections(text: Column) -> Column:
    """Array of (level, span): spans between section openings at line starts; before the first: required."""
    names = sorted(PREFERRED_MARKERS + REQUIRED_MARKERS, key=len, reverse=True)
    # Fixed value: how a section opens.
    opening = r"(?i)(?:^|\n)[ \t]*(?:[-*•\d.)\s]{0,4})?(" + "|".join(re.escape(m).replace("\\ ", " ") for m in names) + r")(?![\p{L}\p{N}_])[ \t]*:?"
    given = F.coalesce(text, F.lit(""))
    # a mark in the input is rare, and looking for it cheaper than taking it out
    clean = F.when(given.rlike(f"[{S1}{S2}{H1}{H2}]"), F.translate(given, S1 + S2 + H1 + H2, "")).otherwise(given)
    pieces = F.split(F.regexp_replace(clean, opening, f"{S1}$1{S2}"), S1)

    def span(piece: Column, i: Column) -> Column:
        level = F.when((i > 0) & F.lower(F.substring_index(piece, S2, 1)).isin(*PREFERRED_MARKERS), "preferred").otherwise("required")
        body = F.when(i == 0, piece).otherwise(F.substr(piece, F.locate(S2, piece) + 1))
        return F.struct(level.alias("level"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("span"))

    spans = F.transform(pieces, span)
    whole = F.array(F.struct(F.lit("required").alias("level"), clean.alias("span")))
    return F.filter(F.when(F.size(pieces) == 1, whole).otherwise(spans), lambda s: s["span"] != "")


def guard_marks(span: Column) -> Column:
    """The span with a mark before each guarded name that has no evidence beside it.

    The text is cut at guarded names; a name sees what stands back to the one
    before it and on to the end of the part after it. Evidence never lies
    further, however long those parts are, and all of them together are as long
    as the text.
    """
    names = "|".join(re.escape(x) for x in sorted(SHORT + AMBIGUOUS, key=len, reverse=True))
    firsts = "".join(sorted({x[0] for x in SHORT + AMBIGUOUS} | {x[0].upper() for x in SHORT + AMBIGUOUS}))
    parts = F.split(F.regexp_replace(span, rf"(?=[{firsts}])(?<![A-Za-z0-9+#.])((?i:{names}))(?![A-Za-z0-9+#])", f"{H1}$1{H2}"), H1)

    def marked(p: Column) -> Column:
        plain = lambda i: F.translate(F.coalesce(F.get(p, i), F.lit("")), H2, "")

        def one(part: Column, i: Column) -> Column:
            name, rest = F.substring_index(part, H2, 1), F.substring_index(part, H2, -1)
            counts = evidence_guard(name, plain(i - 1), F.concat(rest, plain(i + 1)))
            return F.when(i == 0, part).otherwise(F.concat(F.when(counts, "").otherwise(H1), F.translate(part, H2, "")))

        return F.when(F.size(p) == 1, span).otherwise(F.array_join(F.transform(p, one), ""))

    return let(parts, marked)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _unmarked(piece: Column) -> Column:
    return F.when(piece.startswith(H1), F.translate(piece, H1, "")).otherwise(piece)


def _first_key(p: Column, x: Column, i: Column) -> Column:
    """What a form that begins with piece x, the i-th, is looked up by: the piece, and the run after it if it is none itself."""
    after = F.get(p, i + 1)
    return F.when(x.rlike(_NAMING), _unmarked(x)).when(F.coalesce(after.rlike(_NAMING), F.lit(False)), F.concat(x, _unmarked(after))).otherwise(x)


def match_surfaces(spans: DataFrame, index: DataFrame) -> DataFrame:
    """spans (job_id, section, level, span) with one row a hit: pos, surface, skill_id, name.

    Surfaces of the index (surface, skill_id, name; folded, without blanks at
    either end) are found whatever their case between borders. Hits do not
    overlap: leftmost first, then longest. Guarded surfaces without evidence are
    no hits. A vocabulary of any size is joined: texts and forms fall into the
    same pieces (runs of naming characters, single others), so that a place is
    looked up by its first piece, which gives the numbers of pieces of the forms
    that begin so, and then by the joined pieces of each such number. Only places
    whose first piece some form begins with leave their text.
    """
    known = keep(index.select(F.lower("surface").alias("surface"), "skill_id", "name").withColumn("_p", _pieces(F.col("surface"))).withColumn("k", F.size("_p")), "forms")
    facts = known.agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("most")).first()
    most = facts["most"] or 1
    sent = (lambda df: F.broadcast(df)) if facts["n"] <= MOST_BROADCAST else (lambda df: df.hint("merge"))
    first = known.select(_first_key(F.col("_p"), F.get("_p", F.lit(0)), F.lit(0)).alias("key"), "k").groupBy("key").agg(F.sort_array(F.collect_set("k")).alias("ks"))

    some = [r["key"] for r in first.select("key").limit(MOST_IN_SET + 1).collect()]
    wanted = (lambda key: key.isin(some)) if len(some) <= MOST_IN_SET else (lambda key: F.lit(True))

    def starts(p: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(p, i - 1), F.lit(" "))
            # blanks are most of the other pieces; a run is never next to a run
            begins = (x != " ") & wanted(_first_key(p, x, i)) & (before != ".") & (x.rlike(_NAMING) | (~before.rlike(_NAMING) & ~x.rlike(r"^\s$")))
            return F.when(begins, F.struct(i.alias("pos"), _first_key(p, x, i).alias("key"), F.slice(p, i + 1, F.lit(most + 1)).alias("here")))

        places = F.transform(p, place)
        return F.filter(places, lambda x: x.isNotNull())

    pieces = _pieces(F.lower(guard_marks(F.col("span"))))
    places = spans.select("job_id", "section", "level", F.explode(let(pieces, starts)).alias("s")).select("job_id", "section", "level", "s.*")
    met = places.join(sent(first), "key")
    joined = lambda k: F.array_join(F.slice("here", F.lit(1), k), "")
    here = lambda k: let(joined(k), lambda x: F.when(x.contains(H1), F.translate(x, H1, "")).otherwise(x))
    # a form that ends in another character than those of names ends before such a one
    ends = lambda k: (F.size("here") >= k) & (F.get("here", k - 1).rlike(_NAMING) | ~F.coalesce(F.get("here", k), F.lit(" ")).rlike(_NAMING))
    tried = F.transform(F.filter("ks", ends), lambda k: F.struct(k.alias("k"), here(k).alias("surface")))
    tried = met.select("job_id", "section", "level", "pos", F.get("here", F.lit(0)).startswith(H1).alias("unproven"), F.explode(tried).alias("t")).select("job_id", "section", "level", "pos", "unproven", "t.*")
    hits = tried.join(sent(known.select("surface", "skill_id", "name")), "surface")
    # dealt once by posting: the windows and sums that follow are all within one, and find their rows where they are
    hits = _without_overlaps(hits.repartition("job_id"))
    return hits.where(~((F.col("k") == 1) & F.col("unproven") & F.col("surface").isin(*SHORT, *AMBIGUOUS))).drop("k", "unproven")


def _without_overlaps(hits: DataFrame) -> DataFrame:
    """Of hits (pos, k) of a span those that a reader from left to right takes, the longest at each place.

    Hits that no earlier one reaches into begin an island; islands are settled one by one.
    """
    span = Window.partitionBy("job_id", "section")
    longest = hits.withColumn("_n", F.row_number().over(Window.partitionBy("job_id", "section", "pos").orderBy(F.desc("k")))).where("_n = 1").drop("_n")
    reach = F.max(F.col("pos") + F.col("k")).over(span.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("pos") < F.coalesce(reach, F.lit(0)), 0).otherwise(1)
    island = F.sum("_b").over(span.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rest = [c for c in longest.columns if c not in ("job_id", "section")]
    found = longest.withColumn("_b", begins).withColumn("_i", island).groupBy("job_id", "section", "_i").agg(F.array_sort(F.collect_list(F.struct("pos", *(c for c in rest if c != "pos")))).alias("h"))
    start = F.struct(F.lit(0).alias("end"), F.slice("h", 1, 0).alias("taken"))
    step = lambda a, x: F.when(x["pos"] < a["end"], a).otherwise(F.struct((x["pos"] + x["k"]).alias("end"), F.array_append(a["taken"], x).alias("taken")))
    taken = F.when(F.size("h") == 1, F.col("h")).otherwise(F.aggregate("h", start, step, lambda a: a["taken"]))
    return found.select("job_id", "section", F.explode(taken).alias("x")).select("job_id", "section", "x.*")


def evidence_guard(surface: Column, left: Column, right: Column) -> Column:
    """Whether a hit counts: guarded surfaces need list punctuation or a qualifier beside them, and no ``&`` or quote."""
    guarded = F.lower(surface).isin(*SHORT, *AMBIGUOUS)
    words, back = "|".join(QUALIFIERS), "|".join(x[::-1] for x in QUALIFIERS)
    end = r"^(?:\n\r|[\n\r\x85\u2028\u2029])?"  # the left side is read from its end, which a line's end may follow

    def told(both: Column) -> Column:
        left, right = both["left"], both["right"]
        bound = F.coalesce(left.rlike(end + r"[&'’]"), F.lit(False)) | right.rlike(r"^[&'’]")
        listed = left.rlike(end + r"[ \t]*[,;/|(\[{•\-–—\n\t]") | right.rlike(r"^[ \t]*[,;/|)\]}•\n\t]")
        named = right.rlike(rf"(?i)^[ \t]*(?:{words})(?![A-Za-z0-9.+#_-])") | left.rlike(rf"(?i)^[^A-Za-z0-9.+#_-]*(?:{back})(?:[^A-Za-z0-9.+#_-]|\z)")
        return ~bound & (listed | named)

    return ~guarded | let(F.struct(F.reverse(left).alias("left"), right.alias("right")), told)


def extract_skills(jobs: DataFrame, index: DataFrame, text: str = "text") -> DataFrame:
    """job_id, skill_id, name, requirement, pos from jobs (job_id, text) and a vocabulary index (surface, skill_id, name) of any size."""
    spans = jobs.select("job_id", F.posexplode(split_sections(F.col(text))).alias("section", "s")).select("job_id", "section", "s.level", "s.span")
    return job_skill_rows(match_surfaces(spans, index))


def job_skill_rows(found: DataFrame) -> DataFrame:
    """One row a job and skill: required beats preferred; pos is the place in document order."""
    best = found.groupBy("job_id", "skill_id", "name").agg(F.min(F.when(F.col("level") == "required", 0).otherwise(1)).alias("l"), F.min(F.struct("section", "pos")).alias("at"))
    return best.select("job_id", "skill_id", "name", F.when(F.col("l") == 0, "required").otherwise("preferred").alias("requirement"), (F.shiftleft(F.col("at.section").cast("long"), 32) + F.col("at.pos")).alias("pos"))


def unmatched_jobs(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """Jobs in which no skill was found."""
    return jobs.hint("merge").join(found.select("job_id"), "job_id", "left_anti")
