import pytest
from pyspark.sql import functions as F

from matchspark.operators import rescore, score
from tests.test_score import tables

CONFIG = score.Config(cos_lo=0.0, cos_hi=1.0)


def scored(given):
    return score.score_all(*given, CONFIG, names=False)


def run(matches, before, now):
    resumes, jobs, asked, skills, held, chunks, vectors = before
    jc = rescore.changes(rescore.job_digests(jobs, asked, skills, chunks, CONFIG), rescore.job_digests(now[1], now[2], now[3], now[5], CONFIG), "job_id")
    rc = rescore.changes(rescore.resume_digests(resumes, held, vectors), rescore.resume_digests(now[0], now[4], now[6]), "resume_id")
    return jc, rc, rescore.rescore(matches, jc, rc, *now, CONFIG)


def same(out, now):
    columns = scored(now).columns
    assert sorted(map(tuple, out.select(*columns).collect()), key=repr) == sorted(map(tuple, scored(now).collect()), key=repr)


def with_rows(df, *rows):
    return df.unionByName(df.sparkSession.createDataFrame(list(rows), df.schema))


CASES = {
    "nothing": (lambda t: t, set()),
    "asked": (lambda t: t._replace_at(2, with_rows(t[2], (11, 2, "required"))), {(1, 11), (2, 11)}),
    "passage": (lambda t: t._replace_at(5, with_rows(t[5], (12, 0, [1.0, 1.0]))), {(1, 12), (2, 12)}),
    "skill becomes active": (lambda t: t._replace_at(3, t[3].withColumn("active", F.lit(True))), {(r, j) for r in (1, 2) for j in (10, 12)}),
    "vector": (lambda t: t._replace_at(6, t[6].withColumn("vec", F.when(F.col("resume_id") == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.col("vec")))), {(1, j) for j in (10, 11, 12)}),
    "profile gone": (lambda t: t._replace_at(0, t[0].where("resume_id <> 1")), set()),
    "both": (lambda t: t._replace_at(1, with_rows(t[1], (13, 2.0)))._replace_at(4, with_rows(t[4], (2, 1))), {(1, 13), *((2, j) for j in (10, 11, 12, 13))}),
}


class Tables(tuple):
    def _replace_at(self, i, df):
        return Tables((*self[:i], df, *self[i + 1 :]))


@pytest.mark.parametrize("name", CASES)
def test_only_what_changed_is_scored_again(spark, name):
    change, expected = CASES[name]
    before = Tables(tables(spark))
    now = change(before)
    _, _, out = run(scored(before), before, now)
    rows = out.collect()
    same(out, now)
    assert {(r.resume_id, r.job_id) for r in rows if r.rescored} == expected


def test_explanations_stay_unless_the_profile_changed(spark):
    before = Tables(tables(spark))
    matches = scored(before).withColumn("explanation", F.concat(F.lit("why "), F.col("job_id").cast("string"))).withColumn("created_at", F.lit(1))
    now = before._replace_at(2, with_rows(before[2], (11, 2, "required")))._replace_at(4, with_rows(before[4], (2, 1)))
    _, _, out = run(matches, before, now)
    same(out, now)
    assert {(r.resume_id, r.job_id): r.explanation for r in out.collect()} == {(1, j): f"why {j}" for j in (10, 11, 12)} | {(2, j): None for j in (10, 11, 12)}


def test_an_edit_invalidates_the_matches_of_its_profile(spark):
    skills = spark.createDataFrame([("1", "Python", [], True), ("2", "Kafka", [], True)], "skill_id string, name string, aliases array<string>, active boolean")
    held = spark.createDataFrame([("r1", "1", "cv"), ("r2", "2", "cv"), ("r3", "1", "cv")], "resume_id string, skill_id string, source string")
    matches = spark.createDataFrame([(r, j) for r in ("r1", "r2", "r3") for j in (1, 2)], "resume_id string, job_id int")
    edits = spark.createDataFrame([("r1", ["Python", "Rust"]), ("r2", ["kafka"])], "resume_id string, skills array<string>")
    links, added, valid, edited = rescore.edit_resumes(edits, held, skills, matches)
    assert [r.name for r in added.collect()] == ["Rust"]
    assert [r.resume_id for r in edited.collect()] == ["r1"]
    assert sorted({r.resume_id for r in valid.collect()}) == ["r2", "r3"]
    assert sorted((r.resume_id, r.source) for r in links.collect()) == [("r1", "edited"), ("r1", "edited"), ("r2", "edited"), ("r3", "cv")]
