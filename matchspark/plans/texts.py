"""Queries on texts: vocabulary, extraction, passages, vectors, résumés."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.operators import chunk, embed, extract, resumes, vocabulary
from matchspark.plans.mapping import table

#: Names of the vocabulary that is drawn from the documents.
VOCABULARY = 3000


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent pairs of words of at least five letters a-z, one blank between, as active skills with the first word as alias: a top-k report over all texts."""
    pairs = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(?:^|(?<=\\s))(?=([a-z]{5,} [a-z]{5,})(?:\\s|$))"), F.lit(1))).alias("w"))
    top = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(VOCABULARY)
    return top.select(F.col("w").alias("skill_id"), F.col("w").alias("name"), F.array(F.substring_index("w", " ", 1)).alias("aliases"), F.lit(True).alias("active"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), "source", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    text = _jobs(spark, d).select("job_id", F.col("description").alias("text"))
    return extract.extract_skills(text, vocabulary.build_vocab_index(_vocabulary(spark, d)))


def extracted_skills(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("job_id", "name", "requirement")


def unmatched_jobs(spark: SparkSession, d: str) -> DataFrame:
    return extract.unmatched_jobs(_jobs(spark, d).select("job_id"), _found(spark, d))


def vocabulary_index(spark: SparkSession, d: str) -> DataFrame:
    """Index of parts as skills: names of two words, the brand as alias."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), (F.col("p_size") > 5).alias("active"))
    return vocabulary.build_vocab_index(p)


def canonical_skills(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of order priorities and part types brought to skill ids of the part vocabulary."""
    p = table(spark, d, "part")
    skills = p.groupBy("p_name").agg(F.min("p_partkey").cast("string").alias("skill_id")).select("skill_id", F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(True).alias("active"))
    phrases = p.select("p_partkey", F.lit(0).alias("pos"), F.concat(F.lit("Strong "), "p_name", F.lit(" and 3+ years "), F.lower("p_type")).alias("raw"))
    split = phrases.select("p_partkey", "pos", F.concat(F.lit("Strong "), F.substring_index(F.substring_index("raw", " and 3+", 1), "Strong ", -1), F.lit(" experience")).alias("raw"))
    return vocabulary.canonicalize_all(split, skills, "p_partkey")[0]


def seeded_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Part names seeded with brands as aliases into a vocabulary of small parts."""
    p = table(spark, d, "part")
    per = p.groupBy("p_name").agg(F.array_sort(F.collect_set(F.lower("p_brand"))).alias("brands"), F.min("p_partkey").cast("string").alias("id"), F.min("p_size").alias("size"), F.min(F.lower("p_brand")).alias("one"))
    skills = per.where("size <= 2").select(F.col("id").alias("skill_id"), F.col("p_name").alias("name"), F.array("one").alias("aliases"), F.lit(True).alias("active"))
    out = vocabulary.seed_vocabulary(skills, per.select(F.col("p_name").alias("name"), F.col("brands").alias("aliases")))
    return out.select("name", F.size("aliases").alias("n_aliases"), "change")


def blocked_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Part names against a block list of the names of large parts."""
    p = table(spark, d, "part")
    skills = p.select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("name"), F.lit(True).alias("active"))
    listed = p.where("p_size > 48").select(F.initcap("p_name").alias("term")).distinct()
    return vocabulary.apply_blocklist(skills, listed)[0].select("skill_id", "name", "active")


def disallowed_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    names = p.select("p_partkey", F.when(F.col("p_size") > 40, F.concat("p_name", F.lit(" Engineer"))).when(F.col("p_size") > 35, " ").when(F.col("p_size") > 30, "Time-Management").when(F.col("p_size") > 25, "!!").otherwise(F.col("p_name")).alias("name"))
    return vocabulary.disallowed_reason(names, p.where("p_size = 1").select(F.col("p_name").alias("term")).distinct()).select("p_partkey", "reason")


def passages(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunk_jobs(_jobs(spark, d)).select("job_id", "chunk_index", chunk.estimate_tokens(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("text_sha256"))


def passage_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of each document that its passages hold: none is lost."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return chunk.chunk_jobs(_jobs(spark, d)).select("job_id", n.alias("n")).groupBy("job_id").agg(F.sum("n").alias("n_words"))


def estimated_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _jobs(spark, d).select("job_id", chunk.estimate_tokens(F.col("description")).alias("tokens"))


def passage_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Passages of every document through the default embedder, and their squared lengths."""
    made = embed.embed_table(chunk.chunk_jobs(_jobs(spark, d)), "text")
    length = F.aggregate(F.array_remove("vec", 0.0), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return made.select("job_id", "chunk_index", F.size("vec").alias("width"), F.round(length, 3).alias("squared"))


def vector_problems(spark: SparkSession, d: str) -> DataFrame:
    return embed.check_vectors(table(spark, d, "embeddings"), ["vec_id"], "embedding", 64)


def résumé_intake(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role = 'user'")
    return resumes.intake_gate(turns).select("conv_id", "turn", F.length("text").alias("chars"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """A parsed résumé of each supplier: the names of its parts as skills, their types as roles."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    per = lines.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("p_name")).alias("skills"), F.array_sort(F.collect_set(F.concat(F.lit("Senior "), F.lower("p_type"), F.lit(" buyer - x")))).alias("roles"))
    s = table(spark, d, "supplier").join(per, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    none = F.array().cast("array<string>")
    parsed = F.struct(
        F.col("s_name").alias("name"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.when(F.col("s_nationkey") < 5, "@example.com").when(F.col("s_nationkey") < 8, "").otherwise("@Mail.org")).alias("email"), F.lit("n/a").alias("phone"),
        (F.col("s_acctbal") / 100).alias("total_experience_years"), F.coalesce("skills", none).alias("skills"), F.array().cast("array<struct<title:string,tech:array<string>>>").alias("projects"),
        F.transform(F.coalesce("roles", none), lambda r: F.struct(F.lit("").alias("company"), r.alias("role"), F.lit("").alias("duration"))).alias("experience"), F.array().cast("array<struct<institution:string,degree:string,year:string>>").alias("education"),
    )
    return s.select(F.col("s_suppkey").alias("resume_id"), parsed.alias("parsed"))


def validated_resumes(spark: SparkSession, d: str) -> DataFrame:
    good, bad = resumes.validate_resumes(_profiles(spark, d))
    kept = good.select("resume_id", F.lit("").alias("reasons"), F.col("parsed.email").alias("email"), F.col("parsed.phone").alias("phone"), F.size("parsed.skills").alias("n_skills"))
    gone = bad.select("resume_id", F.array_join("reasons", "; ").alias("reasons"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("int").alias("n_skills"))
    return kept.unionByName(gone)


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    return resumes.build_search_queries(_profiles(spark, d))[0]


def résumé_text(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("resume_id", F.sha2(embed.resume_embedding_text(F.col("parsed")), 256).alias("text_sha256"))


QUERIES = {
    f.__name__.replace("é", "e"): f
    for f in (extracted_skills, unmatched_jobs, vocabulary_index, canonical_skills, seeded_vocabulary, blocked_vocabulary, disallowed_names, passages, passage_words, estimated_tokens, passage_vectors, vector_problems, résumé_intake, validated_resumes, search_queries, résumé_text)
}

_WORDS = "SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents"
#: Pairs by frequency; names that cleaning leaves alone; then, piece by piece, pairs from left to right (of pairs that overlap in a row every other one) and single words outside them.
_HITS = f"""WITH spaced AS (SELECT doc_id, regexp_split_to_array(text, '\\s') AS w FROM documents),
seen AS (SELECT w[i] || ' ' || w[i + 1] AS w FROM (SELECT w, unnest(range(1, len(w))) AS i FROM spaced) WHERE regexp_matches(w[i], '^[a-z]{{5,}}$') AND regexp_matches(w[i + 1], '^[a-z]{{5,}}$')),
vocab AS (SELECT w FROM (SELECT w, count(*) AS n FROM seen s GROUP BY 1 ORDER BY n DESC, w LIMIT {VOCABULARY})),
kept AS (SELECT w FROM vocab WHERE NOT regexp_matches(w, '\\b(strong|solid|basic|knowledge|skills?|expertise|experience|your|which|including|should|preferably|ideally|especially|particularly|demonstrated|proven|significant|substantial|excellent|great|advanced|profound|experienced|familiar|comfortable|proficient|expert|understanding|background|exposure|required|preferred|production|proficiency|fundamentals)\\b') AND NOT regexp_matches(w, '^[a-z]+ing ') AND length(w) <= 32),
alias AS (SELECT split_part(w, ' ', 1) AS a, min(w) AS w FROM kept GROUP BY 1),
pieces AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9+#]+|[^a-z0-9+#]', 0, 's') AS p FROM documents)),
near AS (SELECT *, lag(p) OVER d AS before, lead(p) OVER d AS blank, lead(p, 2) OVER d AS after FROM pieces WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
found AS (SELECT n.*, k.w IS NOT NULL AS pair FROM near n LEFT JOIN kept k ON n.blank = ' ' AND k.w = n.p || ' ' || n.after WHERE coalesce(before, ' ') <> '.'),
chains AS (SELECT *, i - 2 * row_number() OVER (PARTITION BY doc_id, i % 2 ORDER BY i) AS chain FROM found WHERE pair),
taken AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i % 2, chain ORDER BY i) % 2 = 1 AS own FROM chains),
hits AS (SELECT doc_id, p || ' ' || after AS name FROM taken WHERE own UNION SELECT f.doc_id, a.w FROM found f JOIN alias a ON a.a = f.p LEFT JOIN taken t ON t.doc_id = f.doc_id AND t.i = f.i - 2 WHERE NOT f.pair AND NOT coalesce(t.own, false)) """
_PROFILE = "prof AS (SELECT s_suppkey, s_nationkey, s_acctbal, (SELECT list(DISTINCT p_name ORDER BY p_name) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey) AS skills, (SELECT list(DISTINCT lower(p_type) ORDER BY lower(p_type)) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey) AS types FROM supplier)"
#: The rules of passages over ordered rows: lines to blocks, blocks to parts by sentences, parts to passages, short passages to their neighbours.
_TOKENS = lambda x: f"CAST(floor(len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')) * 1.35::DOUBLE) AS INTEGER)"
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_PASSAGES = f"""WITH RECURSIVE clean AS (SELECT doc_id, {_STRIP("regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM documents),
paras AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS pi FROM (SELECT doc_id, regexp_split_to_array(t, '\\n\\s*\\n') AS p FROM clean)),
lines AS (SELECT doc_id, pi, unnest(l) AS line, generate_subscripts(l, 1) AS li FROM (SELECT doc_id, pi, string_split(p, chr(10)) AS l FROM paras WHERE {_STRIP("p")} <> '')),
heads AS (SELECT *, s <> '' AND len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) <= 8 AND NOT regexp_matches(s, '{chunk.BULLET}') AND (ends_with(s, ':') OR (s = upper(s) AND s <> lower(s) AND length(s) > 2) OR regexp_matches(s, '{chunk.SECTION}')) AS head FROM (SELECT *, {_STRIP("line")} AS s FROM lines)),
numbered AS (SELECT *, sum(CASE WHEN li = 1 OR head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pi, li) AS b FROM heads),
blocks AS (SELECT doc_id, b, {_STRIP("string_agg(line, chr(10) ORDER BY pi, li)")} AS body, first(head ORDER BY pi, li) AS opens FROM numbered GROUP BY 1, 2),
sized AS (SELECT *, {_TOKENS("body")} AS n FROM blocks WHERE body <> ''),
sentences AS (SELECT doc_id, b, opens, x, i, {_TOKENS("x")} AS n FROM (SELECT doc_id, b, opens, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT *, string_split(regexp_replace(body, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM sized WHERE n > {chunk.HIGH}))),
cuts AS (SELECT doc_id, b, i, n AS total, 1 AS part FROM sentences WHERE i = 1 UNION ALL SELECT s.doc_id, s.b, s.i, CASE WHEN c.total + s.n > {chunk.HIGH} THEN s.n ELSE c.total + s.n END, c.part + CASE WHEN c.total + s.n > {chunk.HIGH} THEN 1 ELSE 0 END FROM cuts c JOIN sentences s ON s.doc_id = c.doc_id AND s.b = c.b AND s.i = c.i + 1),
parts AS (SELECT doc_id, b, 1 AS part, body, opens FROM sized WHERE n <= {chunk.HIGH} UNION ALL SELECT doc_id, b, part, string_agg(x, ' ' ORDER BY i), any_value(opens) AND part = 1 FROM sentences JOIN cuts USING (doc_id, b, i) GROUP BY doc_id, b, part),
ordered AS (SELECT *, {_TOKENS("body")} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY b, part) AS i FROM parts),
packs AS (SELECT doc_id, i, n AS total, 1 AS k FROM ordered WHERE i = 1 UNION ALL SELECT o.doc_id, o.i, CASE WHEN p.total >= {chunk.LOW} AND (o.opens OR p.total + o.n > {chunk.HIGH}) THEN o.n ELSE p.total + o.n END, p.k + CASE WHEN p.total >= {chunk.LOW} AND (o.opens OR p.total + o.n > {chunk.HIGH}) THEN 1 ELSE 0 END FROM packs p JOIN ordered o ON o.doc_id = p.doc_id AND o.i = p.i + 1),
packed AS (SELECT doc_id, k, string_agg(body, chr(10) || chr(10) ORDER BY i) AS x FROM packs JOIN ordered USING (doc_id, i) GROUP BY 1, 2),
grouped AS (SELECT *, sum(CASE WHEN k = 1 OR {_TOKENS("x")} >= {chunk.LEAST} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM packed),
merged AS (SELECT doc_id, g, string_agg(x, chr(10) || chr(10) ORDER BY k) AS x FROM grouped GROUP BY 1, 2),
joined AS (SELECT *, CASE WHEN g = 1 AND max(g) OVER (PARTITION BY doc_id) > 1 AND {_TOKENS("x")} < {chunk.LEAST} THEN 2 ELSE g END AS j FROM merged),
done AS (SELECT doc_id, j, string_agg(x, chr(10) || chr(10) ORDER BY g) AS x FROM joined GROUP BY 1, 2)
SELECT doc_id AS job_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS INTEGER) AS chunk_index, {_TOKENS("x")} AS tokens, sha256(x) AS text_sha256 FROM done"""
ORACLE_SQL = {
    "passages": _PASSAGES,
    "extracted_skills": _HITS + "SELECT doc_id AS job_id, name, 'required' AS requirement FROM hits",
    "unmatched_jobs": _HITS + "SELECT doc_id AS job_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)",
    "vocabulary_index": "SELECT surface, skill_id, name FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY alias, skill_id) AS n FROM (SELECT lower(p_name) AS surface, p_partkey AS skill_id, p_name AS name, false AS alias FROM part WHERE p_size > 5 UNION ALL SELECT lower(p_brand), p_partkey, p_name, true FROM part WHERE p_size > 5)) WHERE n = 1",
    "canonical_skills": "SELECT p_partkey, CAST(id AS VARCHAR) AS skill_id, 0 AS pos FROM part JOIN (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1) USING (p_name)",
    "seeded_vocabulary": "SELECT p_name AS name, CAST(count(DISTINCT p_brand) AS INTEGER) AS n_aliases, CASE WHEN min(p_size) > 2 THEN 'added' WHEN count(DISTINCT p_brand) > 1 THEN 'updated' ELSE 'kept' END AS change FROM part GROUP BY 1",
    "blocked_vocabulary": "SELECT p_partkey AS skill_id, p_name AS name, p_name NOT IN (SELECT p_name FROM part WHERE p_size > 48) AS active FROM part",
    "disallowed_names": """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'job title' WHEN p_size > 35 THEN 'empty' WHEN p_size > 30 THEN 'abstract' WHEN p_size > 25 THEN 'normalises to nothing' WHEN p_name IN (SELECT p_name FROM part WHERE p_size = 1) THEN 'blocklisted' END AS reason FROM part""",
    "passage_words": f"SELECT doc_id AS job_id, count(*) AS n_words FROM ({_WORDS}) WHERE w <> '' GROUP BY 1",
    "estimated_tokens": f"SELECT doc_id AS job_id, CAST(floor(count(*) FILTER (w <> '') * 1.35::DOUBLE) AS INTEGER) AS tokens FROM ({_WORDS}) GROUP BY 1",
    "vector_problems": "SELECT vec_id, CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) <> 64 THEN 'width' ELSE 'zero' END AS problem FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64 OR list_sum(list_transform(embedding, lambda x: abs(x))) = 0",
    "resume_intake": "SELECT conv_id, turn, CAST(least(length(text), 24000) AS INTEGER) AS chars FROM conversations WHERE role = 'user' AND length(trim(text)) >= 120",
    "validated_resumes": f"""WITH {_PROFILE}, r AS (SELECT *, concat_ws('; ', CASE WHEN s_acctbal / 100 < 0 OR s_acctbal / 100 > 60 THEN 'years out of range' END, CASE WHEN coalesce(len(skills), 0) = 0 THEN 'neither skills nor experience' END) AS reasons FROM prof)
        SELECT s_suppkey AS resume_id, reasons, CASE WHEN reasons = '' AND s_nationkey >= 8 THEN 's' || s_suppkey || '@mail.org' END AS email, CAST(NULL AS VARCHAR) AS phone, CASE WHEN reasons = '' THEN CAST(len(skills) AS INTEGER) END AS n_skills FROM r""",
    "search_queries": f"""WITH {_PROFILE}, q AS (SELECT s_suppkey, list_filter([types[1] || ' buyer', array_to_string(skills[1:4], ' '), types[2] || ' buyer'], lambda x: x IS NOT NULL) AS k FROM prof WHERE len(skills) > 0)
        SELECT s_suppkey AS resume_id, CAST(i - 1 AS INTEGER) AS n, k[i] AS keywords, CAST(100 // len(k) AS INTEGER) AS max_results FROM q, range(1, 4) t(i) WHERE i <= len(k)""",
    "resume_text": f"""WITH {_PROFILE} SELECT s_suppkey AS resume_id, sha256(CASE WHEN len(skills) > 0 THEN 'Skills: ' || array_to_string(skills, ', ') || chr(10) || chr(10) || 'Roles: ' || array_to_string(list_transform(types, lambda t: 'Senior ' || t || ' buyer - x'), '; ') ELSE '' END) AS text_sha256 FROM prof""",
}
