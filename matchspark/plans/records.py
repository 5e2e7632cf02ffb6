"""Queries on files, boards, guarded extraction, résumé records, stored matches and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.functions import text as X
from matchspark.operators import embed, explain, extract, rank, report, resumes, score, vocabulary
from matchspark.plans import mapping as m
from matchspark.plans.mapping import table
from matchspark.sources import boards, files
from matchspark.tables import keep, new_folder


def sectioned_postings(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as payloads of a sectioned board and read back."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    one = F.struct(
        key.cast("string").alias("id"), F.concat(F.lit(" "), "o_orderpriority").alias("text"),
        F.struct(F.when(key % 5 == 0, "Remote, EU").otherwise("Bonn").alias("location")).alias("categories"),
        F.concat(F.lit("<p>Order &amp; more</p>"), status).alias("description"),
        F.array(F.struct(F.lit("Needs").alias("text"), F.concat(F.lit("<ul><li>a"), key.cast("string"), F.lit("</li><li>b</li></ul>")).alias("content")), F.struct(F.lit("").alias("text"), F.lit("<br/>").alias("content"))).alias("lists"),
        F.when(key % 2 == 0, "<div>End</div>").alias("additional"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000).cast("string").alias("createdAt"),
        F.when(key % 7 == 0, "Remote").otherwise("onsite").alias("workplaceType"), F.when(key % 3 == 0, "").otherwise("h").alias("hostedUrl"), F.lit("a").alias("applyUrl"),
    )
    raw = table(spark, d, "orders").select(F.lit("acme").alias("company"), F.to_json(F.array(one)).alias("payload"))
    out = boards.normalize_sectioned_board(raw)
    return out.select("source_job_id", "title", "location", "is_remote", "description", "apply_url", F.col("posted_date").cast("string").alias("posted"))


def _board(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    job = F.struct(
        key.cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.struct(F.when(key % 5 == 0, "REMOTE").otherwise("Bonn").alias("name")).alias("location"),
        F.concat(F.lit("&lt;p&gt;At least "), (key % 20).cast("string"), F.lit(" years&lt;/p&gt;&lt;li&gt;"), F.when(key % 7 == 0, "remote &amp;amp; free").otherwise("desk"), F.lit("&lt;/li&gt;")).alias("content"),
        F.when(key % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00-05:00"))).alias("updated_at"), F.lit("2020-02-03T00:00:00Z").alias("first_published"), F.lit("u").alias("absolute_url"),
    )
    raw = table(spark, d, "orders").select(F.lit("acme").alias("company"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("payload"))
    return boards.normalize_company_board(raw, parse_experience=True)


def company_postings(spark: SparkSession, d: str) -> DataFrame:
    return _board(spark, d).select("source_job_id", "is_remote", "description", F.col("experience_min_years").cast("double").alias("years"), F.col("posted_date").cast("string").alias("posted"))


def remote_postings(spark: SparkSession, d: str) -> DataFrame:
    return boards.remote_only(_board(spark, d), True).select("source_job_id")


#: Elements of a board by the remainder of the order key: what makes each odd, and its JSON.
ODD = {3: ("unreadable", '"oops"'), 4: ("not an object", "null"), 5: ("no id", '{"title":"x"}'), 6: ("no title", '{"id":1,"title":" "}'), 7: ("location of another kind", '{"id":1,"title":"x","location":"Oslo"}'), 8: ("title of another kind", '{"id":1,"title":5}'), 9: ("unreadable", '{"id":1,"id":2,"title":"x"}')}


def _mixed_boards(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's orders as one board with odd elements among good ones; some boards are cut off as a whole."""
    key = F.col("o_orderkey")
    element = F.to_json(F.struct(key.cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.struct(F.lit("Bonn").alias("name")).alias("location"), F.concat(F.lit("&lt;p&gt;"), "o_orderstatus", F.lit("&lt;/p&gt;")).alias("content")))
    for k, (_, odd) in ODD.items():
        element = F.when(key % 20 == k, odd).otherwise(element)
    boards_ = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("company")).agg(F.array_sort(F.collect_list(F.struct(key, element.alias("e")))).alias("es"))
    listed = F.concat(F.lit('{"jobs":['), F.array_join(F.col("es.e"), ","), F.lit("]"))
    return boards_.select("company", F.when(F.col("company").cast("long") % 10 == 4, listed).otherwise(F.concat(listed, F.lit("}"))).alias("payload"))


def mixed_boards(spark: SparkSession, d: str) -> DataFrame:
    """The postings of boards that hold odd elements, and what was set aside."""
    records = keep(boards.company_board_records(_mixed_boards(spark, d)), "records")
    good = boards.company_postings(records).select("company", F.lit(None).cast("int").alias("position"), "source_job_id", "title", "description", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(boards.set_aside(records).select("company", "position", "reason"), allowMissingColumns=True)


def salary_texts(spark: SparkSession, d: str) -> DataFrame:
    key, low = F.col("o_orderkey"), F.floor("o_totalprice").cast("decimal(14,2)")
    high = F.when(key % 3 == 0, low).when(key % 3 == 1, low + 1000)
    return table(spark, d, "orders").select("o_orderkey", X.salary_text(F.when(key % 4 != 0, low), high, X.currency_of(F.when(key % 2 == 0, "gb").otherwise("zz")), key % 5 == 0).alias("salary"))


def usable_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers as postings, some without an id or a title."""
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").select(key, F.when(key % 7 != 0, key.cast("string")).alias("source_job_id"), F.when(key % 5 == 0, " ").otherwise(F.col("c_name")).alias("title"))
    good, bad = boards.split_unusable(rows)
    return good.select("c_custkey", F.lit("").alias("reason")).unionByName(bad.select("c_custkey", "reason"))


def landed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of which one has unreadable payloads, and a third that failed: postings by source, and what was set aside."""
    key = F.col("o_orderkey")
    good = F.to_json(F.struct(key.cast("string").alias("id"), F.col("o_orderpriority").alias("title")))
    raw = table(spark, d, "orders").select(F.when(key % 2 == 0, "one").otherwise("two").alias("source"), F.when(key % 11 == 1, "{oops").when(key % 13 == 1, " ").otherwise(good).alias("payload"))
    fine, aside = boards.quarantine(raw, boards.SEARCH_RECORD)
    batches = {name: boards.normalize_search_api(fine.where(F.col("source") == name), "gb", source=name) for name in ("one", "two")}
    every, _ = boards.union_sources(batches | {"three": RuntimeError("down")})
    counted = every.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("posting"))
    return counted.unionByName(aside.groupBy("source", F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def vocabulary_file(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as a vocabulary file and read back; blank names go."""
    p, out = table(spark, d, "part"), new_folder(spark, "files")
    key = F.col("p_partkey")
    p.select(key.cast("string").alias("skill_id"), F.when(key % 9 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name")).alias("name"), F.concat_ws("|", "p_brand", F.lit(" "), "p_type").alias("aliases"), F.when(key % 4 != 0, F.lit("false")).alias("active")).write.csv(out, header=True)
    return files.read_vocabulary(spark, out).select("skill_id", "name", F.array_join("aliases", ";").alias("aliases"), "active")


def blocklist_file(spark: SparkSession, d: str) -> DataFrame:
    p, out = table(spark, d, "part"), new_folder(spark, "files")
    key = F.col("p_partkey")
    p.select(F.when(key % 9 == 0, " ").otherwise(F.concat(F.lit('a "'), "p_name", F.lit('",\n'), key.cast("string"))).alias("term"), F.col("p_type").alias("category"), F.concat(F.lit(" why "), "p_brand").alias("reason")).write.csv(out, header=True, escape='"')
    return files.read_blocklist(spark, out)


def resume_files(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' résumés as JSON, some of them cut off."""
    key = F.col("s_suppkey")
    good = F.to_json(F.struct(F.col("s_name").alias("name"), (key % 30).alias("total_experience_years"), F.array(F.lit("a"), F.lit("b")).alias("skills")))
    raw = table(spark, d, "supplier").select(key.alias("resume_id"), F.when(key % 5 == 0, F.substring(good, 1, 20)).otherwise(good).alias("payload"))
    return files.read_resumes(raw).select("resume_id", F.col("parsed.name").alias("name"), F.col("parsed.total_experience_years").alias("years"), F.size("parsed.skills").alias("n_skills"), F.col("corrupt").isNotNull().alias("is_corrupt"))


def strongest_skills(spark: SparkSession, d: str) -> DataFrame:
    """Part names of each order's lines at their strongest level, at most three an order."""
    parts = table(spark, d, "part").select("p_partkey", vocabulary.cleaned_names(F.concat("p_name", F.lit(" skills"))).alias("names"))
    lines = table(spark, d, "lineitem").join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    entries = lines.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("pos"), "names", F.when(F.col("l_returnflag") == "A", "preferred").otherwise("required").alias("requirement"))
    return vocabulary.strongest_per_skill(entries, 3).select("job_id", "name", "requirement", "pos")


def audited_aliases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    skills = p.select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("name"), F.array("p_brand", F.lower("p_type")).alias("aliases"))
    return vocabulary.alias_audit(skills, p.where("p_size = 1").select(F.upper("p_brand").alias("alias")))


def pending_jobs(spark: SparkSession, d: str) -> DataFrame:
    return extract.pending_jobs(m.jobs(spark, d).select("job_id"), table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id")))


def extraction_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(extract.extraction_text(F.col("source"), F.when(F.col("doc_id") % 3 != 0, F.col("text"))), 256).alias("text_sha256"))


#: Posting texts by the remainder of the order key: sections, guarded names, neighbours that bind.
GUARDED = (
    "Requirements:\nGo, Python\nNice to have:\nKafka", "We go to work with Python", "Preferred:\n- Spark engineer", "spark joy", "Bonus points:\nKafka\nMust have:\nKafka", "R&D and Python",
    "Java; R; C++", "about Java.\nOptional:\nR language, js", "Golang developer: Go programming", "python's jest", "Essential: Rails | Kafka\nBonus:\nRails",
)
_FOUND = {
    0: (("Go", "required"), ("Python", "required"), ("Kafka", "preferred")), 1: (("Python", "required"),), 2: (("Spark", "preferred"),), 3: (), 4: (("Kafka", "required"),), 5: (("Python", "required"),),
    6: (("Java", "required"), ("R", "required"), ("C++", "required")), 7: (("Java", "required"), ("R", "preferred"), ("JS", "preferred")), 8: (("Go", "required"),), 9: (("Python", "required"),), 10: (("Rails", "required"), ("Kafka", "required")),
}
_NAMES = ("Go", "Python", "Kafka", "Spark", "R", "Java", "C++", "JS", "Jest", "Rails")


def guarded_skills(spark: SparkSession, d: str) -> DataFrame:
    """Skills of texts that orders take by their key: preferred sections, and names that need evidence beside them."""
    texts = F.array(*(F.lit(x) for x in GUARDED))
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.get(texts, (F.col("o_orderkey") % len(GUARDED)).cast("int")).alias("text"))
    index = spark.createDataFrame([(x.lower(), x, x) for x in _NAMES], "surface string, skill_id string, name string")
    return extract.extract_skills(jobs, index).select("job_id", "name", "requirement")


def faulty_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Problems of vectors of which every seventh is made wrong in one of four ways."""
    key, vec = F.col("vec_id") % 28, F.col("embedding")
    wrong = F.when(key == 0, None).when(key == 7, F.slice(vec, 1, 63)).when(key == 14, F.concat(F.slice(vec, 1, 63), F.array(F.lit(None).cast("float")))).when(key == 21, F.transform(vec, lambda x: F.lit(0).cast("float"))).otherwise(vec)
    return embed.check_vectors(table(spark, d, "embeddings").select("vec_id", wrong.alias("vec")), ["vec_id"], "vec", 64)


def replaced_skills(spark: SparkSession, d: str) -> DataFrame:
    """Profiles' skills by part name, where every third profile's list is edited to that of the next nation's small parts."""
    p = table(spark, d, "part")
    skills = p.groupBy("p_name").agg(F.min("p_partkey").cast("string").alias("skill_id")).select("skill_id", F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(True).alias("active"))
    current = m.resume_skills(spark, d).select("resume_id", F.col("skill_id").cast("string").alias("skill_id"), F.lit("parse").alias("source"))
    small = p.where("p_size < 5").agg(F.array_sort(F.collect_set("p_name")).alias("skills"))
    edits = m.resumes(spark, d).where("resume_id % 3 = 0").select("resume_id").crossJoin(F.broadcast(small))
    return resumes.replace_resume_skills(current, edits, skills, "edit")[0]


def stored_users(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    current = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("user_id"), F.concat(F.lower("c_name"), F.lit("@x.org")).alias("email"))
    return resumes.upsert_users(current, c.select(F.concat(F.lit(" "), "c_name", F.lit("@X.org ")).alias("email"))).select("user_id", "email")


def resume_profiles(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("resume_id")
    own = m.resumes(spark, d).select("resume_id", F.when(n % 4 == 0, "many").otherwise((n % 12).cast("string")).alias("years"))
    held = m.resume_skills(spark, d).select("resume_id", F.col("skill_id").cast("string").alias("skill_id"))
    skills = m.skills(spark, d).select(F.col("skill_id").cast("string").alias("skill_id"), "active")
    return resumes.resume_profile(own, held, skills).select("resume_id", "candidate_years", F.array_join("skill_ids", ",").alias("skill_ids"))


def loaded_postings(spark: SparkSession, d: str) -> DataFrame:
    out = score.load_postings(m.jobs(spark, d), m.job_skills(spark, d), m.skills(spark, d), m.chunks(spark, d))
    return out.select("job_id", "title", F.array_join(F.transform("skills", lambda s: s["name"]), ";").alias("names"), F.array_join(F.transform("passages", lambda p: p["chunk_index"].cast("string")), ",").alias("passages"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Stored matches made of orders: tier, names and counts by key."""
    key = F.col("o_orderkey")
    names = lambda n, x: F.transform(F.slice(F.sequence(F.lit(1), F.lit(9)), F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(x), i.cast("string")))
    tier = F.when(key % 3 == 0, "strong").when(key % 3 == 1, "moderate").otherwise("weak")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("resume_id"), key.alias("job_id"), tier.alias("tier"), names(key % 8, "have").alias("matching_skills"), names(key.cast("long") % 7, "lack").alias("missing_skills"),
        (key % 5).cast("long").alias("parsed_count"), (key % 10 == 9).alias("skills_unparsed"), F.round(F.col("o_totalprice") / 600_000, 4).alias("overall_score"), F.col("o_orderpriority").alias("title"),
        F.when(key % 2 == 0, "Acme").alias("company"), F.when(key % 3 != 0, (key % 9).cast("double")).alias("candidate_years"), F.when(key % 4 != 0, F.lit(3.0)).alias("required_years"),
    )


def listed_names(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("job_id", explain.list_phrase(F.col("matching_skills")).alias("have"), explain.list_phrase(F.col("missing_skills"), 3).alias("lack"))


def explained_matches(spark: SparkSession, d: str) -> DataFrame:
    return explain.with_explanations(_matches(spark, d)).select("job_id", "explanation")


def top_for_explanation(spark: SparkSession, d: str) -> DataFrame:
    """The three best matches of each customer: the number is the feature."""
    return explain.top_n_for_explanation(_matches(spark, d), 3).select("resume_id", "job_id")


def match_prompts(spark: SparkSession, d: str) -> DataFrame:
    return explain.explanation_prompts(_matches(spark, d)).select("job_id", "prompt")


def _echo(prompts: list[str]) -> list[str]:
    """Stands for a model: says the prompt's first line and its number of lines, in a fence."""
    return [f"```text\nSure! {p.splitlines()[0]}: {len(p.splitlines())} lines.\n```" for p in prompts]


def model_replies(spark: SparkSession, d: str) -> DataFrame:
    """What a model makes of the prompts of all matches."""
    return explain.explain_with(explain.explanation_prompts(_matches(spark, d)), _echo).select("job_id", "explanation")


def tidied_replies(spark: SparkSession, d: str) -> DataFrame:
    key, said = F.col("o_orderkey") % 5, F.concat(F.lit("You  fit\n"), "o_orderpriority")
    reply = F.when(key == 0, F.concat(F.lit("```text\n"), said, F.lit("\n```"))).when(key == 1, F.concat(F.lit('"'), said, F.lit('"'))).when(key == 2, F.concat(F.lit("Sure! "), said)).when(key == 3, "  ").otherwise(said)
    return table(spark, d, "orders").select("o_orderkey", explain.tidy_replies(reply).alias("reply"))


def relabelled(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey") % 5
    old = F.when(key == 0, "Strong match.").when(key == 1, "Decent match.").when(key == 2, "Moderate match.").when(key == 3, "Weak fit.").otherwise("So: Weak fit.")
    return table(spark, d, "orders").select("o_orderkey", explain.relabel(F.concat(old, F.lit(" "), "o_orderpriority")).alias("text"), explain.tier_label(F.when(key == 0, "strong").when(key == 1, "moderate").when(key == 2, "weak")).alias("label"))


def placed_page(spark: SparkSession, d: str) -> DataFrame:
    """Second pages of five, with places among all ranked matches."""
    shown = rank.page(_matches(spark, d), 5, 5, 2, 0)
    rows = shown.withColumn("position", F.col("rank") - 6)
    return rank.absolute_rank(rows, 5).select("resume_id", "job_id", "skills_unparsed", "total", F.col("place").cast("long").alias("place"))


def refused(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    requests = table(spark, d, "orders").select(key.alias("request_id"), F.col("o_custkey").alias("resume_id"), F.when(key % 4 == 0, F.array(F.lit("a"), F.lit("x"))).otherwise(F.array(F.lit("a"))).alias("sources"))
    known = table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("resume_id"), F.when(F.col("c_custkey") % 3 != 0, "p").alias("parsed"))
    return rank.refused_searches(requests, known, ["a", "b"])


def checked_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Two extractions of each supplier with what was expected, a removed field, and years out of range."""
    key = F.col("s_suppkey")
    s = table(spark, d, "supplier").withColumn("id", key)
    a = s.select("id", F.array(F.lit("sql"), F.concat(F.lit("k"), (key % 3).cast("string"))).alias("skills"))
    b = s.select("id", F.array(F.lit("sql"), F.concat(F.lit("k"), (key % 2).cast("string"))).alias("skills"), F.when(key % 4 == 0, "old").alias("summary"))
    expected = s.select("id", F.array(F.lit("k0"), F.lit("k1")).alias("skills"))
    both = report.compare_extractions(a, b, expected, ("summary",))
    odd = report.suspicious_years(s.select("id", F.when(key % 6 != 0, (key % 20).cast("double")).alias("total_experience_years"))).select(F.col("id").alias("_id"), F.lit(True).alias("odd"))
    joined = both.join(odd.hint("merge"), F.col("id") == F.col("_id"), "left")
    return joined.select("id", *(F.array_join(c, ",").alias(c) for c in ("only_a", "only_b", "missing", "removed_fields")), F.coalesce("odd", F.lit(False)).alias("odd_years"))


QUERIES = {
    f.__name__: f
    for f in (
        sectioned_postings, company_postings, remote_postings, mixed_boards, salary_texts, usable_rows, landed_sources, vocabulary_file, blocklist_file, resume_files, strongest_skills, audited_aliases, pending_jobs, extraction_texts,
        guarded_skills, faulty_vectors, replaced_skills, stored_users, resume_profiles, loaded_postings, listed_names, explained_matches, top_for_explanation, match_prompts, model_replies, tidied_replies, relabelled, placed_page, refused, checked_extractions,
    )
}

_NL = "chr(10)"
_LIST = lambda n, x: f"CASE WHEN {n} = 0 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, CAST({n} + 1 AS BIGINT)), lambda i: '{x}' || i) END"
PHRASE = lambda a, most: f"CASE WHEN len({a}) = 0 THEN '' WHEN len({a}) > {most} THEN array_to_string({a}[1:{most}], ', ') || ' and ' || (len({a}) - {most}) || ' more' WHEN len({a}) = 1 THEN {a}[1] ELSE array_to_string({a}[1:len({a}) - 1], ', ') || ' and ' || {a}[len({a})] END"
#: Rounded by the number's decimal digits, as Spark does; a product with 10,000 may fall on either side of a half.
_ROUND4 = lambda x: f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE)"
_MATCHES = f"""m AS (SELECT o_custkey AS resume_id, o_orderkey AS job_id, CASE o_orderkey % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'weak' END AS tier, {_LIST('(o_orderkey % 8)', 'have')} AS have, {_LIST('(o_orderkey % 7)', 'lack')} AS lack,
  o_orderkey % 5 AS n, o_orderkey % 10 = 9 AS skills_unparsed, {_ROUND4('o_totalprice / 600000')} AS overall_score, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'Acme' END AS company, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 9 AS DOUBLE) END AS cy, CASE WHEN o_orderkey % 4 <> 0 THEN 3.0::DOUBLE END AS ry FROM orders)"""
#: An explanation from tier, have, lack, their phrases h and l, n and skills_unparsed.
EXPLANATION = """CASE WHEN skills_unparsed THEN 'The requirements of this posting could not be read, so no skills were compared; the score tells overall similarity only.' ELSE
        CASE WHEN tier = 'strong' AND l <> '' THEN 'A strong match: you bring ' || h || '. Also asked for: ' || l || '.' WHEN tier = 'strong' THEN 'A strong match: you bring ' || h || ', all that it asks for.'
             WHEN tier = 'moderate' AND h <> '' AND l <> '' THEN 'A fair match: you bring ' || h || '; ' || l || ' would make it stronger.' WHEN tier = 'moderate' AND h <> '' THEN 'A fair match: you bring ' || h || '.' WHEN tier = 'moderate' THEN 'A fair match in outline, though nothing it names (' || l || ') is on your résumé.'
             WHEN h <> '' AND l <> '' THEN 'A weak match: you bring ' || h || ', but it needs ' || l || ' too.' WHEN l <> '' THEN 'A weak match: it needs ' || l || CASE WHEN len(lack) = 1 THEN ', which is not on your résumé.' ELSE ', which are not on your résumé.' END ELSE 'A weak match: it shares little with your résumé.' END
        || CASE WHEN n = 1 THEN ' This rests on only 1 stated requirement.' WHEN n = 2 THEN ' This rests on only 2 stated requirements.' ELSE '' END END"""
_ODD = ", ".join(f"({k}, '{reason}')" for k, (reason, _) in ODD.items())
_GUARDED = ", ".join(f"({k}, '{name}', '{level}')" for k, found in _FOUND.items() for name, level in found)
ORACLE_SQL = {
    "sectioned_postings": f"""SELECT 'acme:' || o_orderkey AS source_job_id, o_orderpriority AS title, CASE WHEN o_orderkey % 5 = 0 THEN 'Remote, EU' ELSE 'Bonn' END AS location, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS is_remote,
        'Order & more' || {_NL} || o_orderstatus || {_NL} || {_NL} || 'Needs:' || {_NL} || 'a' || o_orderkey || {_NL} || {_NL} || 'b' || CASE WHEN o_orderkey % 2 = 0 THEN {_NL} || {_NL} || 'End' ELSE '' END AS description,
        CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'h' END AS apply_url, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders""",
    "company_postings": f"""SELECT 'acme:' || o_orderkey AS source_job_id, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS is_remote, 'At least ' || (o_orderkey % 20) || ' years' || {_NL} || {_NL} || CASE WHEN o_orderkey % 7 = 0 THEN 'remote & free' ELSE 'desk' END AS description,
        CASE WHEN o_orderkey % 20 BETWEEN 1 AND 15 THEN CAST(o_orderkey % 20 AS DOUBLE) END AS years, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2020-02-03' END AS posted FROM orders""",
    "remote_postings": "SELECT 'acme:' || o_orderkey AS source_job_id FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0",
    "mixed_boards": f"""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS company, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS position, o_orderkey, o_orderpriority, o_orderstatus, k.reason, o_custkey % 10 = 4 AS lost FROM orders LEFT JOIN (VALUES {_ODD}) k(k, reason) ON o_orderkey % 20 = k.k)
        SELECT company, CASE WHEN reason IS NOT NULL THEN position END AS position, CASE WHEN reason IS NULL THEN company || ':' || o_orderkey END AS source_job_id, CASE WHEN reason IS NULL THEN o_orderpriority END AS title, CASE WHEN reason IS NULL THEN o_orderstatus END AS description, reason FROM o WHERE NOT lost
        UNION ALL SELECT DISTINCT company, NULL, NULL, NULL, NULL, 'unreadable' FROM o WHERE lost""",
    "salary_texts": """SELECT o_orderkey, CASE WHEN lo IS NULL AND hi IS NULL THEN NULL ELSE CASE WHEN lo IS NOT NULL AND hi IS NOT NULL AND lo <> hi THEN cur || format('{:,}', lo) || ' - ' || cur || format('{:,}', hi) ELSE cur || format('{:,}', coalesce(lo, hi)) END || ' per year' || CASE WHEN o_orderkey % 5 = 0 THEN ' (estimated)' ELSE '' END END AS salary
        FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS lo, CASE o_orderkey % 3 WHEN 0 THEN CAST(floor(o_totalprice) AS BIGINT) WHEN 1 THEN CAST(floor(o_totalprice) AS BIGINT) + 1000 END AS hi, CASE WHEN o_orderkey % 2 = 0 THEN 'GBP' ELSE '' END AS cur FROM orders)""",
    "usable_rows": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'no id' WHEN c_custkey % 5 = 0 THEN 'no title' ELSE '' END AS reason FROM customer",
    "landed_sources": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'one' ELSE 'two' END AS source, count(*) AS n, CASE WHEN o_orderkey % 11 = 1 THEN 'unreadable' WHEN o_orderkey % 13 = 1 THEN 'empty' ELSE 'posting' END AS kind FROM orders GROUP BY ALL",
    "vocabulary_file": "SELECT CAST(p_partkey AS VARCHAR) AS skill_id, p_name AS name, p_brand || ';' || p_type AS aliases, p_partkey % 4 = 0 AS active FROM part WHERE p_partkey % 9 <> 0",
    "blocklist_file": f"""SELECT 'a "' || p_name || '",' || {_NL} || p_partkey AS term, p_type AS category, 'why ' || p_brand AS reason FROM part WHERE p_partkey % 9 <> 0""",
    "resume_files": "SELECT s_suppkey AS resume_id, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 30 AS DOUBLE) END AS years, CASE WHEN s_suppkey % 5 <> 0 THEN 2 END AS n_skills, s_suppkey % 5 = 0 AS is_corrupt FROM supplier",
    "strongest_skills": """SELECT job_id, name, requirement, pos FROM (SELECT job_id, name, requirement, row_number() OVER (PARTITION BY job_id ORDER BY seen, name) AS pos FROM (SELECT l_orderkey AS job_id, p_name AS name, CASE WHEN bool_and(l_returnflag = 'A') THEN 'preferred' ELSE 'required' END AS requirement, min(l_linenumber) AS seen FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)) WHERE pos <= 3""",
    "audited_aliases": "SELECT p_partkey AS skill_id, p_name AS name, p_brand AS alias FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 1)",
    "pending_jobs": "SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "extraction_texts": f"SELECT doc_id, sha256(source || {_NL} || {_NL} || CASE WHEN doc_id % 3 <> 0 THEN text ELSE '' END) AS text_sha256 FROM documents",
    "guarded_skills": f"SELECT o_orderkey AS job_id, name, requirement FROM orders JOIN (VALUES {_GUARDED}) v(k, name, requirement) ON o_orderkey % {len(GUARDED)} = k",
    "faulty_vectors": "SELECT vec_id, CASE vec_id % 28 WHEN 0 THEN 'null' WHEN 7 THEN 'width' WHEN 14 THEN 'null component' ELSE 'zero' END AS problem FROM embeddings WHERE vec_id % 7 = 0",
    "replaced_skills": f"""WITH {m.SQL}, ids AS (SELECT p_name, CAST(min(p_partkey) AS VARCHAR) AS skill_id FROM part GROUP BY 1) SELECT resume_id, CAST(skill_id AS VARCHAR) AS skill_id, 'parse' AS source FROM resume_skills WHERE resume_id % 3 <> 0
        UNION ALL SELECT resume_id, skill_id, 'edit' FROM resumes, ids WHERE resume_id % 3 = 0 AND p_name IN (SELECT p_name FROM part WHERE p_size < 5)""",
    "stored_users": "SELECT CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE sha256(lower(c_name) || '@x.org') END AS user_id, lower(c_name) || '@x.org' AS email FROM customer",
    "resume_profiles": f"""WITH {m.SQL} SELECT r.resume_id, CASE WHEN r.resume_id % 4 <> 0 THEN CAST(r.resume_id % 12 AS DOUBLE) END AS candidate_years, coalesce((SELECT string_agg(CAST(rs.skill_id AS VARCHAR), ',' ORDER BY CAST(rs.skill_id AS VARCHAR)) FROM resume_skills rs JOIN skills s ON s.skill_id = rs.skill_id WHERE s.active AND rs.resume_id = r.resume_id), '') AS skill_ids FROM resumes r""",
    "loaded_postings": f"""WITH {m.SQL}, s AS (SELECT job_id, string_agg(name, ';' ORDER BY name) AS names FROM asked GROUP BY 1), c AS (SELECT job_id, string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY chunk_index) AS passages FROM chunks GROUP BY 1)
        SELECT j.job_id, title, names, passages FROM jobs j LEFT JOIN s USING (job_id) LEFT JOIN c USING (job_id)""",
    "listed_names": f"WITH {_MATCHES} SELECT job_id, {PHRASE('have', 5)} AS have, {PHRASE('lack', 3)} AS lack FROM m",
    "explained_matches": f"WITH {_MATCHES}, p AS (SELECT *, {PHRASE('have', 5)} AS h, {PHRASE('lack', 5)} AS l FROM m) SELECT job_id, {EXPLANATION} AS explanation FROM p",
    "top_for_explanation": f"WITH {_MATCHES} SELECT resume_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY overall_score DESC, job_id) AS k FROM m) WHERE k <= 3",
    "match_prompts": f"""WITH {_MATCHES} SELECT job_id, 'Posting: ' || title || {_NL} || 'Company: ' || coalesce(company, 'not stated') || {_NL} || 'Score: ' || CAST(round(overall_score * 100) AS INTEGER) || '%' || {_NL} ||
        CASE WHEN skills_unparsed THEN 'The posting''s requirements are unknown: say so, and name none.' ELSE 'Asked for and held: ' || CASE WHEN len(have) = 0 THEN 'none' ELSE array_to_string(have[1:6], ', ') END || {_NL} || 'Asked for and not held: ' || CASE WHEN len(lack) = 0 THEN 'none' ELSE array_to_string(lack[1:6], ', ') END END || {_NL} ||
        CASE WHEN cy IS NOT NULL AND ry IS NOT NULL THEN 'Years asked for: ' || ry || '; years held: ' || cy || {_NL} ELSE '' END || 'Explain the match to the candidate in two or three plain sentences.' AS prompt FROM m""",
    "model_replies": f"WITH {_MATCHES} SELECT job_id, 'Posting: ' || title || ': ' || CASE WHEN skills_unparsed THEN 5 ELSE 6 END + CASE WHEN cy IS NOT NULL AND ry IS NOT NULL THEN 1 ELSE 0 END || ' lines.' AS explanation FROM m",
    "tidied_replies": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 3 THEN 'You fit ' || o_orderpriority END AS reply FROM orders",
    "relabelled": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'A strong match:' WHEN 1 THEN 'A fair match:' WHEN 2 THEN 'A fair match:' WHEN 3 THEN 'A weak match:' ELSE 'So: Weak fit.' END || ' ' || o_orderpriority AS text, CASE o_orderkey % 5 WHEN 0 THEN 'Strong match' WHEN 1 THEN 'Decent match' WHEN 2 THEN 'Weak fit' END AS label FROM orders",
    "placed_page": f"""WITH {_MATCHES}, r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY resume_id, skills_unparsed) AS total FROM m WINDOW w AS (PARTITION BY resume_id, skills_unparsed ORDER BY overall_score DESC, job_id))
        SELECT resume_id, job_id, skills_unparsed, total, CASE WHEN NOT skills_unparsed THEN k END AS place FROM r WHERE CASE WHEN skills_unparsed THEN k <= 2 ELSE k > 5 AND k <= 10 END""",
    "refused": "SELECT o_orderkey AS request_id, o_custkey AS resume_id, CASE WHEN c_custkey IS NULL THEN 'unknown resume' WHEN c_custkey % 3 = 0 THEN 'resume not parsed' ELSE 'unknown source: x' END AS reason FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey WHERE c_custkey IS NULL OR c_custkey % 3 = 0 OR o_orderkey % 4 = 0",
    "checked_extractions": """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> s_suppkey % 2 THEN 'k' || (s_suppkey % 3) ELSE '' END AS only_a, CASE WHEN s_suppkey % 3 <> s_suppkey % 2 THEN 'k' || (s_suppkey % 2) ELSE '' END AS only_b,
        concat_ws(',', CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 2 <> 0 THEN 'k0' END, CASE WHEN s_suppkey % 3 <> 1 AND s_suppkey % 2 <> 1 THEN 'k1' END) AS missing, CASE WHEN s_suppkey % 4 = 0 THEN 'summary' ELSE '' END AS removed_fields,
        s_suppkey % 6 = 0 OR s_suppkey % 20 < 3 OR s_suppkey % 20 > 12 AS odd_years FROM supplier""",
}
