import random
import re

import pytest
from pyspark.sql import functions as F

from matchspark.operators import extract

SCHEMA = "surface string, skill_id string, name string"


def some_form(rnd):
    word = lambda: "".join(rnd.choice("abcde+#1") for _ in range(rnd.randint(1, 3)))
    form = word()
    for _ in range(rnd.randint(0, 3)):
        form += rnd.choice((" ", " ", "-", ".", "/", " & ")) + word()
    return rnd.choice(("", "", "", ".")) + form + rnd.choice(("", "", "", "", ".", "%"))


def some_text(rnd, forms, n):
    out = ""
    for _ in range(n):
        out += rnd.choice((" ", " ", "\n", ", ", ".", "/", "")) + (rnd.choice(forms) if rnd.random() < 0.6 else some_form(rnd))
    return out.upper() if rnd.random() < 0.2 else out


def by_pattern(forms, text):
    """Hits of one alternation of all forms, longest first."""
    pattern = re.compile(r"(?<![A-Za-z0-9+#.])(?:" + "|".join(re.escape(f) for f in sorted(forms, key=len, reverse=True)) + r")(?![A-Za-z0-9+#])")
    return [m.group() for m in pattern.finditer(text.lower())]


def found(spark, forms, texts):
    index = spark.createDataFrame([(f, f, f) for f in forms], SCHEMA)
    spans = spark.createDataFrame([(i, 0, "required", t) for i, t in enumerate(texts)], "job_id int, section int, level string, span string")
    out = {}
    for r in extract.match_surfaces(spans, index).orderBy("job_id", "pos").collect():
        out.setdefault(r.job_id, []).append(r.surface)
    return [out.get(i, []) for i in range(len(texts))]


@pytest.mark.parametrize("n,shuffled", [(30, False), (20_000, False), (20_000, True)])
def test_hits_are_those_of_one_pattern(spark, monkeypatch, n, shuffled):
    rnd = random.Random(n)
    forms = sorted({some_form(rnd) for _ in range(n)} - set(extract.SHORT))
    texts = [some_text(rnd, forms, rnd.randint(0, 60)) for _ in range(60)]
    if shuffled:
        monkeypatch.setattr(extract, "MOST_BROADCAST", 0)
    assert found(spark, forms, texts) == [by_pattern(forms, t) for t in texts]


def test_two_hundred_thousand_forms(spark):
    forms = [f"name{i} of {i % 97}" for i in range(150_000)] + [f"one{i}" for i in range(50_000)]
    texts = ["Name5 of 5, one77 and one99999; name149999 of 37", "name7 of 8 one49999."]
    assert found(spark, forms, texts) == [["name5 of 5", "one77", "name149999 of 37"], ["one49999"]]


def test_overlaps_in_a_row(spark):
    forms = ["a b", "b c", "c d", "a", "c", "d e f", "e f"]
    assert found(spark, [*forms, "b"], ["a b c d e f", "b b c a", "c d e f"]) == [["a b", "c d", "e f"], ["b", "b c", "a"], ["c d", "e f"]]


def test_evidence_lies_behind_any_filler(spark):
    stars, blanks = "*" * 300, " " * 300
    texts = [f"developer {stars} go", f"developers{'x' * 80} {stars} go", f"go{blanks}programming", f"xdeveloper {stars} go", f"go {stars} programming", f"a,{blanks}go", "developer go go", f"my-developer {stars} go"]
    assert found(spark, ["go"], texts) == [["go"], [], ["go"], [], [], ["go"], ["go"], []]


def test_a_guarded_name_inside_a_longer_one_needs_no_evidence(spark):
    assert found(spark, ["spark", "apache spark", "c"], ["we run apache spark daily", "a spark of c"]) == [["apache spark"], []]


def test_odd_spans(spark):
    index = spark.createDataFrame([("sql", "1", "SQL")], SCHEMA)
    jobs = spark.createDataFrame([(1, None), (2, ""), (3, "\u0003SQL\u0004"), (4, "sql " * 3000)], "job_id int, text string")
    out = extract.extract_skills(jobs, index).collect()
    assert sorted((r.job_id, r.name) for r in out) == [(3, "SQL"), (4, "SQL")]
    assert extract.extract_skills(jobs.where(F.lit(False)), index).count() == 0


def test_evidence_before_a_line_end(spark):
    """The left side is read from its end, past a line's end there, as far as it goes."""
    rows = [("Go", "&\n", "", False), ("go", "R&D, ", "", True), ("R", "programming" + " " * 300, "", True), ("r", "xprogramming ", "", False), ("r", "programming\r\n", "", True), ("java", "", "", True), ("go", "", " lang", True), ("go", "x", "' lang", False)]
    got = spark.createDataFrame(rows, "s string, l string, r string, want boolean").select(extract.evidence_guard(F.col("s"), F.col("l"), F.col("r")).alias("x"), "want").collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_hits_are_dealt_once(spark):
    """Windows over a place, a section and a posting, and the sums after them, share one exchange."""
    index = spark.createDataFrame([("kafka", "1", "Kafka"), ("spark sql", "2", "Spark SQL"), ("sql", "3", "SQL")], SCHEMA)
    jobs = spark.createDataFrame([(1, "Kafka, Spark SQL\nPreferred: sql"), (2, "kafka kafka"), (3, None)], "job_id int, text string")
    got = extract.extract_skills(jobs, index)
    assert sorted((r.job_id, r.skill_id, r.requirement) for r in got.collect()) == [(1, "1", "required"), (1, "2", "required"), (1, "3", "preferred"), (2, "1", "required")]
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("hashpartitioning(job_id") == 1
