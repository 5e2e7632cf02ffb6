import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchspark.operators import chunk, embed, explain, extract, report, resumes, vocabulary


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


PHRASES = {
    "Strong hands-on Python": ["Python"], "Comfortable with Docker.": ["Docker"], "PostgreSQL knowledge at scale": ["PostgreSQL"], "Kafka or Redis, Celery": ["Kafka", "Redis", "Celery"],
    "Go/Rust": ["Go", "Rust"], "CI/CD and UI/UX work": ["CI/CD", "UI/UX work"], "3+ years Python": ["Python"], "6 years of professional backend work today": [], "3+ years in data engineering": [],
    "Deep SQL: windows, tuning": ["SQL"], "Monitoring with Prometheus": ["Prometheus"], "running big services": [], "what you will be doing here": [], "n/a": [], "": [],
    "an extremely long name of a skill that nobody has": [], "communication": [], None: [],
}


def test_names_from_phrases(spark):
    assert column(spark, list(PHRASES), vocabulary.clean_skill_names) == list(PHRASES.values())


def skills(spark, rows):
    return spark.createDataFrame(rows, "skill_id string, name string, aliases array<string>, active boolean")


def test_index_prefers_names_and_skips_what_is_not_canonical(spark):
    rows = [("2", "Go", ["golang"], True), ("1", "Golang", None, True), ("3", "Strong Python", None, True), ("4", "Old", None, False), ("5", "C++", ["cpp", " "], True)]
    assert {r.surface: r.skill_id for r in vocabulary.build_vocab_index(skills(spark, rows)).collect()} == {"go": "2", "golang": "1", "c++": "5", "cpp": "5"}


def test_canonical_ids_and_new_names(spark):
    known = skills(spark, [("1", "Python", ["py"], True), ("2", "C++", [], True), ("3", "C", [], True)])
    names = spark.createDataFrame([("PY",), ("c++",), ("C",), ("Rust",), ("Scrum",), ("Data Engineer",), ("!!",)], "name string")
    found, added = vocabulary.canonicalize(names, known)
    ids = {r.name: r.skill_id for r in found.collect()}
    assert (ids["PY"], ids["c++"], ids["C"]) == ("1", "2", "3") and ids["Scrum"] is None and ids["Data Engineer"] is None and ids["!!"] is None
    assert [r.name for r in added.collect()] == ["Rust"] and ids["Rust"] == added.first().skill_id


def test_seed_block_and_audit(spark):
    known = skills(spark, [("1", "Python", ["py"], True), ("2", "Sales", [], True)])
    seeded = {r.name: r for r in vocabulary.seed_vocabulary(known, spark.createDataFrame([("python", ["PY", "python3"]), ("Go", None)], "name string, aliases array<string>")).collect()}
    assert seeded["Python"].aliases == ["py", "python3"] and seeded["Python"].change == "updated" and seeded["Go"].change == "added" and seeded["Sales"].change == "kept"
    out, missing = vocabulary.apply_blocklist(known, spark.createDataFrame([("SALES",), ("Zebra",), ("Apple",)], "term string"))
    assert {r.name: r.active for r in out.collect()} == {"Python": True, "Sales": False} and [r.term for r in missing.collect()] == ["Apple", "Zebra"]
    assert [r.alias for r in vocabulary.alias_audit(known, spark.createDataFrame([("Py",)], "alias string")).collect()] == ["py"]


def test_strongest_entry_wins(spark):
    entries = spark.createDataFrame([(1, 0, "React a plus", "preferred"), (1, 1, "React", "required"), (1, 2, "Go/Rust", "preferred")], "job_id long, pos int, name string, requirement string")
    assert [(r.name, r.requirement) for r in vocabulary.strongest_per_skill(entries).orderBy("pos").collect()] == [("React", "required"), ("Go", "preferred"), ("Rust", "preferred")]


def test_sections(spark):
    text = "Intro line\nRequirements: Go\n- Nice to have: Rust\nWe have requirements inside prose"
    assert [(s.level, s.span) for s in column(spark, [text], extract.split_sections)[0]] == [("required", "Intro line"), ("required", "Go"), ("preferred", "Rust\nWe have requirements inside prose")]
    assert column(spark, ["just text", None, ""], extract.split_sections)[1:] == [[], []]


VOCAB = ["Python", "Machine Learning", "Learning", "C", "C++", "C#", ".NET", "R", "Go", "Spark", "Node.js", "SQL"]


@pytest.mark.parametrize("text,expected", [
    ("machine learning and learning", ["Learning", "Machine Learning"]), ("C++, C# and .NET", ["C#", "C++"]), ("R&D engineer", []), ("Go to our site", []), ("languages: Go, R", ["Go", "R"]),
    ("Python and go programming", ["Go", "Python"]), ("a spark of joy", []), ("Kafka, Spark", ["Spark"]), ("Pythonic PySpark", []), ("Node.js/SQL", ["Node.js", "SQL"]), ("use mysql", []),
])
def test_hits(spark, text, expected):
    index = vocabulary.build_vocab_index(skills(spark, [(str(i), n, [], True) for i, n in enumerate(VOCAB)]))
    found = extract.extract_skills(spark.createDataFrame([(1, text)], "job_id long, text string"), index)
    assert sorted(r.name for r in found.collect()) == sorted(expected)


def test_required_beats_preferred(spark):
    index = vocabulary.build_vocab_index(skills(spark, [("1", "Python", [], True), ("2", "Kafka", [], True)]))
    jobs = spark.createDataFrame([(1, "Nice to have:\nPython, Kafka\nRequirements:\nPython"), (2, "nothing"), (3, None)], "job_id long, text string")
    found = extract.extract_skills(jobs, index)
    assert {(r.job_id, r.name): r.requirement for r in found.collect()} == {(1, "Python"): "required", (1, "Kafka"): "preferred"}
    assert sorted(r.job_id for r in extract.unmatched_jobs(jobs, found).collect()) == [2, 3]
    assert extract.extract_skills(jobs, index.limit(0)).count() == 0


def python_chunks(text):
    """The chunking rules once more, line by line."""
    tokens = lambda t: int(len(t.split()) * 1.35)
    text = re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", re.sub("\r\n?", "\n", text))).strip()
    head = lambda s: bool(s) and len(s.split()) <= 8 and not re.match(chunk.BULLET, s) and (s.endswith(":") or (s == s.upper() != s.lower() and len(s) > 2) or bool(re.match(chunk.SECTION, s)))
    blocks = []
    for paragraph in re.split(r"\n\s*\n", text):
        fresh = True
        for line in paragraph.split("\n"):
            if fresh or head(line.strip()):
                blocks.append([[], head(line.strip())])
            blocks[-1][0].append(line)
            fresh = False
    packed, cur, n = [], [], 0
    for lines, opens in blocks:
        body = "\n".join(lines).strip()
        parts = [body]
        if tokens(body) > 400:
            parts, own, k = [], [], 0
            for s in re.split(chunk.SENTENCE, body):
                if own and k + tokens(s) > 400:
                    parts.append(" ".join(own))
                    own, k = [], 0
                own.append(s)
                k += tokens(s)
            parts.append(" ".join(own))
        for p in filter(None, parts):
            if cur and n >= 200 and (opens or n + tokens(p) > 400):
                packed.append("\n\n".join(cur))
                cur, n = [], 0
            cur.append(p)
            n += tokens(p)
            opens = False
    packed += ["\n\n".join(cur)] if cur else []
    out = []
    for c in packed:
        if out and tokens(c) < 50:
            out[-1] += "\n\n" + c
        else:
            out.append(c)
    if len(out) > 1 and tokens(out[0]) < 50:
        out[:2] = [out[0] + "\n\n" + out[1]]
    return out


SENTENCE = st.builds(lambda n, c: "Word " + "word " * n + "end" + c, st.integers(0, 60), st.sampled_from([".", "", "!"]))
LINE = st.one_of(SENTENCE, st.sampled_from(["REQUIREMENTS", "Skills:", "- item one", "* bullet", "", "  ", "Perks and more", "short"]))
TEXT = st.lists(LINE, max_size=25).map("\n".join)


def test_chunks_follow_the_rules(spark):
    texts = []

    @settings(max_examples=60, deadline=None, database=None)
    @given(TEXT, st.integers(0, 3))
    def gather(text, k):
        texts.append((text + "\r\n\n\n" + "Long sentence here. " * 150 * (k == 3)))

    gather()
    jobs = spark.createDataFrame(list(enumerate([*texts, None, "  ", "one"])), "job_id long, description string")
    found: dict = {}
    for r in chunk.chunk_jobs(jobs).orderBy("job_id", "chunk_index").collect():
        found.setdefault(r.job_id, []).append((r.chunk_index, r.text))
    for i, text in enumerate(texts):
        want = python_chunks(text) if text.strip() else []
        got = found.get(i, [])
        assert [k for k, _ in got] == list(range(len(got)))
        assert [" ".join(t.split()) for _, t in got] == [" ".join(t.split()) for t in want]
        assert " ".join(t for _, t in got).split() == text.split()
    n = len(texts)
    assert n not in found and n + 1 not in found and found[n + 2] == [(0, "one")]
    assert chunk.chunk_jobs(jobs, spark.createDataFrame([(n + 2,)], "job_id long")).where(F.col("job_id") == n + 2).count() == 0


def test_embedding_calls(spark):
    sizes = []
    df = spark.createDataFrame([(i, "text" if i % 2 else " ") for i in range(10)], "i int, t string").coalesce(1)
    out = embed.embed_table(df, "t", lambda texts: [[float(len(texts)), 0.0]] * len(texts), 2, 3).orderBy("i").collect()
    assert [r.vec and r.vec[0] for r in out] == [None, 3.0, None, 3.0, None, 3.0, None, 2.0, None, 2.0] and not sizes
    with pytest.raises(Exception, match="width"):
        embed.embed_table(df, "t", lambda texts: [[1.0]] * len(texts), 2).collect()
    bad = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [None, 1.0])], "k int, vec array<float>")
    assert {r.k: r.problem for r in embed.check_vectors(bad, ["k"], width=2).collect()} == {2: "null", 3: "zero", 4: "width", 5: "null component"}


def parse(spark, rows):
    return spark.createDataFrame(rows, "resume_id int, parsed struct<name:string,email:string,phone:string,total_experience_years:double,skills:array<string>,projects:array<struct<title:string,tech:array<string>>>,experience:array<struct<company:string,role:string,duration:string>>,education:array<struct<institution:string,degree:string,year:string>>>")


def test_resumes(spark):
    df = parse(spark, [
        (1, ("John Doe", "A@Mail.org ", "n/a", 3.0, ["Go", "go", "string", "x" * 61, "Git", "SQL"], [("", ["a"]), ("P", ["k", "K"])], [("", "", "x"), ("Acme", "Senior Backend Engineer - Remote", ""), ("", "Engineer", ""), ("B", "Data Analyst", "")], [("", "", "1")])),
        (2, (None, "x@example.com", None, 99.0, [], [], [], [])), (3, None),
    ])
    good, bad = resumes.validate_resumes(df)
    p = good.first().parsed
    assert (p.name, p.email, p.phone, p.skills) == (None, "a@mail.org", None, ["Go", "Git", "SQL"]) and [x.title for x in p.projects] == ["P"] and p.projects[0].tech == ["k"] and len(p.experience) == 3 and p.education == []
    assert {r.resume_id: r.reasons for r in bad.collect()} == {2: ["years out of range", "neither skills nor experience"], 3: ["no parse"]}
    queries, rejected = resumes.build_search_queries(df)
    assert [(r.resume_id, r.n, r.keywords, r.max_results) for r in queries.orderBy("resume_id", "n").collect()] == [(1, 0, "Backend Engineer", 33), (1, 1, "Go string " + "x" * 61 + " SQL", 33), (1, 2, "Data Analyst", 33)]
    assert {r.resume_id for r in rejected.collect()} == {2, 3}
    text = good.select(embed.resume_embedding_text(F.col("parsed")).alias("t")).first().t
    assert text == "Skills: Go, Git, SQL\n\nRoles: Senior Backend Engineer - Remote at Acme; Engineer; Data Analyst at B\n\nProjects: P (k)"


def test_explanations(spark):
    rows = [("strong", ["a", "b"], [], 6, False), ("strong", ["a"], ["b"], 2, False), ("moderate", [], ["a", "b", "c"], 3, False), ("weak", [], ["a"], 1, False), ("weak", [], [], 3, False), (None, [], [], 0, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, tier string, matching_skills array<string>, missing_skills array<string>, parsed_count int, skills_unparsed boolean")
    out = [r.explanation for r in explain.with_explanations(df).orderBy("i").collect()]
    assert "a and b" in out[0] and "rests on" not in out[0] and "only 2 stated requirements." in out[1] and "a, b and c" in out[2] and "which is not" in out[3] and "only 1 stated requirement." in out[3] and "little" in out[4] and "could not be read" in out[5]
    assert column(spark, [list("abcdefg"), list("abcde"), [None, "", "z"], None], explain.list_phrase, "array<string>") == ["a, b, c, d, e and 2 more", "a, b, c, d and e", "z", ""]
    assert column(spark, ['```\nSure, "you fit"\n```', '"quoted  text"', "  ", None], explain.tidy_replies) == ['"you fit"'.strip('"'), "quoted text", None, None]


def test_reports(spark):
    values = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "k int, cos double")
    d = report.cosine_distribution(values, "cos", "x").first()
    assert (d.n, d.min, d.max, d.p50, d.p05) == (100, 1.0, 100.0, 50.5, 5.95)
    assert report.suggest_band(report.cosine_distribution(values.limit(5), "cos", "x")).first().note == "too few values"
    a = spark.createDataFrame([(1, ["x", "y"])], "id int, skills array<string>")
    b = spark.createDataFrame([(1, ["y", "z"]), (2, ["q"])], "id int, skills array<string>")
    out = {r.id: (r.only_a, r.only_b, r.missing) for r in report.compare_extractions(a, b, spark.createDataFrame([(1, ["w", "x"])], "id int, skills array<string>")).collect()}
    assert out == {1: (["x"], ["z"], ["w"]), 2: ([], ["q"], [])}


def test_chunking_follows_the_length_of_a_block(spark):
    """Sixteen times the sentences of one block cost far less than the square of it."""
    sentence = "This is a sentence of about fourteen words that stands in a long block alone."

    def seconds(n):
        df = spark.createDataFrame([(1, " ".join([sentence] * n))], "job_id int, description string")
        took = []
        for _ in range(2):
            began = time.perf_counter()
            assert len(chunk.chunk_jobs(df).collect()) == n // 20
            took.append(time.perf_counter() - began)
        return min(took)

    seconds(100)
    assert seconds(6400) < 8 * seconds(400)


def test_passages_are_made_once(spark):
    """A filter on the size of the passages would make them twice."""
    jobs = spark.createDataFrame([("a", "Intro\n\nSkills:\nspark\n"), ("b", "\x01x\x02 y\t z  w ")], "job_id string, description string")
    out = chunk.chunk_jobs(jobs)
    assert not re.search(r"Filter .*\bsize\(", out._jdf.queryExecution().optimizedPlan().toString())
    assert [(r.job_id, r.text) for r in out.orderBy("job_id").collect()] == [("a", "Intro\n\nSkills:\nspark"), ("b", "x y z w")]


def test_vectors_of_a_batch(spark):
    """Whole numbers of tokens, blank rows null, and what a caller's embedder gives as lists."""
    rows = [(i, None if i % 7 == 0 else " " if i % 5 == 0 else f"word{i % 3} Word{i % 3} other") for i in range(3000)]
    out = embed.embed_table(spark.createDataFrame(rows, "i int, t string").coalesce(1), "t", width=16).orderBy("i").collect()
    for r in out:
        if r.t is None or not r.t.strip():
            assert r.vec is None
        else:
            assert abs(sum(x * x for x in r.vec) - 1) < 1e-5 and len(r.vec) == 16


def test_names_cleaned_beforehand(spark):
    entries = spark.createDataFrame([(1, 1, "Python and SQL", "preferred"), (1, 2, "python", "required"), (1, 3, "...", "required"), (2, 1, "C++/Java", "required"), (2, 2, None, "required")], "job_id int, pos int, name string, requirement string")
    own = vocabulary.strongest_per_skill(entries)
    made = entries.select("job_id", "pos", "requirement", vocabulary.cleaned_names(F.col("name")).alias("names"))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, vocabulary.strongest_per_skill(made).collect()))
