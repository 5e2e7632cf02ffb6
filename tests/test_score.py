import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchspark.operators import rank, report, score


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("label,weight", [(None, 1.0), ("Required", 1.0), ("must-have", 1.0), (" Nice to have ", 0.4), ("nonsense", 0.4), ("", 0.4)])
def test_requirement_weight(spark, label, weight):
    assert one(spark, score.requirement_weight(F.lit(label).cast("string"))) == weight


@pytest.mark.parametrize("n,expected", [(1, math.sqrt(1 / 6)), (6, 1.0), (9, 1.0)])
def test_confidence(spark, n, expected):
    assert one(spark, score.skill_confidence(F.lit(n))) == pytest.approx(expected)


@pytest.mark.parametrize("a,b,expected", [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 1.0], [-2.0, -2.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([], [1.0], 0.0)])
def test_cosine(spark, a, b, expected):
    v = lambda x: F.array(*map(F.lit, x)).cast("array<double>")
    assert one(spark, score.cosine_similarity(v(a), v(b))) == pytest.approx(expected)


def test_cosine_of_unequal_width(spark):
    a, b = F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, score.cosine_similarity(a, b, strict=False)) is None
    with pytest.raises(Exception, match="unequal width"):
        one(spark, score.cosine_similarity(a, b))


@pytest.mark.parametrize("mean,expected", [(0.53, 0.0), (0.61, 0.5), (0.69, 1.0), (0.2, 0.0), (0.9, 1.0), (None, 0.0)])
def test_rescale(spark, mean, expected):
    assert one(spark, score.rescale_clamp(F.lit(mean).cast("double"), 0.53, 0.69)) == pytest.approx(expected)


def test_rescale_of_a_band_without_width(spark):
    assert one(spark, score.rescale_clamp(F.lit(0.5), 0.5, 0.5)) == 1.0 and one(spark, score.rescale_clamp(F.lit(0.4), 0.5, 0.5)) == 0.0


@pytest.mark.parametrize("need,have,expected", [(None, 1, 1.0), (3, None, 1.0), (3, 3, 1.0), (3, 2.5, 0.95), (3, 2, 0.95), (4, 2.9, 0.85), (5, 2, 0.85), (5, 1.9, 0.7), (12, 2, 0.7)])
def test_experience(spark, need, have, expected):
    assert one(spark, score.experience_multiplier(F.lit(need).cast("decimal(4,1)"), F.lit(have).cast("double"))) == expected


def tables(spark):
    resumes = spark.createDataFrame([(1, 3.0), (2, None)], "resume_id long, candidate_years double")
    jobs = spark.createDataFrame([(10, 5.0), (11, None), (12, None)], "job_id long, required_years double")
    skills = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", False)], "skill_id long, name string, active boolean")
    asked = spark.createDataFrame([(10, 1, None), (10, 2, "plus"), (10, 3, None), (12, 3, None)], "job_id long, skill_id long, requirement string")
    held = spark.createDataFrame([(1, 1), (1, 3), (2, 9)], "resume_id long, skill_id long")
    chunks = spark.createDataFrame([(11, 0, [1.0, 0.0]), (11, 1, [0.0, 1.0]), (11, 2, [1.0, 1.0]), (11, 3, [0.0, -1.0])], "job_id long, chunk_index int, vec array<double>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "resume_id long, vec array<double>")
    return resumes, jobs, asked, skills, held, chunks, vectors


def test_score_all(spark):
    out = {(r.resume_id, r.job_id): r for r in score.score_all(*tables(spark), score.Config(cos_lo=0.0, cos_hi=1.0)).collect()}
    assert len(out) == 6
    r = out[1, 10]
    assert r.skill_recall == round(1 / 1.4, 4) and r.parsed_count == 2 and r.matching_skills == ["a"] and r.missing_skills == ["b"] and r.experience_multiplier == 0.85
    assert out[2, 10].skill_recall == 0.0 and out[2, 10].tier == "weak"
    assert out[1, 12].skills_unparsed and out[1, 12].tier is None  # its only skill is inactive
    assert out[1, 11].semantic_score == pytest.approx(round((1 + math.sqrt(0.5) + 0) / 3, 4)) and out[1, 11].overall_score == out[1, 11].semantic_score
    assert out[2, 11].semantic_score == 0.0


def test_many_profiles_are_dealt_in_parts(spark, monkeypatch):
    _, _, _, _, _, chunks, _ = tables(spark)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "resume_id long, vec array<double>")
    whole = sorted(score.passage_similarity(vectors, chunks).collect())
    monkeypatch.setattr(score, "MOST_BROADCAST", 2)
    assert sorted(score.passage_similarity(vectors, chunks).collect()) == whole


@pytest.mark.parametrize("most,cells", [(20_000, 1 << 21), (3, 1 << 21), (3, 7)])
def test_products_are_the_same(spark, monkeypatch, most, cells):
    rnd = random.Random(5)
    vec = lambda: [rnd.uniform(-1, 1) for _ in range(6)]
    rows = [(i % 11, k, vec()) for k in range(9) for i in range(11) if rnd.random() < 0.7] + [(3, 20, [0.0] * 6), (4, 21, None)]
    chunks = spark.createDataFrame(rows, "job_id long, chunk_index int, vec array<double>")
    vectors = spark.createDataFrame([(str(i % 5), vec()) for i in range(8)] + [("z", [0.0] * 6)], "resume_id string, vec array<double>")
    want = {(r.resume_id, r.job_id): r.mean_cos for r in score.passage_similarity(vectors, chunks).collect()}
    monkeypatch.setattr(score, "MOST_BROADCAST", most)
    monkeypatch.setattr(score, "BLOCK_CELLS", cells)
    got = {(r.resume_id, r.job_id): r.mean_cos for r in score.passage_similarity_blocks(vectors, chunks).collect()}
    assert got == pytest.approx(want) and len(got) == 55
    assert score.passage_similarity_blocks(vectors.where("false"), chunks).count() == 0


def test_ranks_by_ranges_and_exact_percentiles(spark):
    rows = [(1, j, float(j % 7), j % 3 == 0) for j in range(500)] + [(2, 1, 0.5, False)]
    ranked = rank.rank_matches(spark.createDataFrame(rows, "resume_id long, job_id long, overall_score double, skills_unparsed boolean").repartition(7))
    for unparsed in (True, False):
        own = sorted((x for x in rows if x[0] == 1 and x[3] == unparsed), key=lambda x: (-x[2], x[1]))
        found = sorted((r.rank, r.job_id, r.total) for r in ranked.where(f"resume_id = 1 and skills_unparsed = {unparsed}").collect())
        assert found == [(i + 1, x[1], len(own)) for i, x in enumerate(own)]
    for values in ([3.0], [1.0, 2.0], [5.0] * 400 + [1.0, 9.0], [float(i * i % 101) for i in range(333)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5)
        r = report.exact_percentiles(df, "v", (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)).first()
        assert r.n == len(values) and r.p == pytest.approx(list(np.quantile(values, [0.0, 0.05, 0.25, 0.5, 0.95, 1.0])))
    none = report.exact_percentiles(spark.createDataFrame([], "v double"), "v").first()
    assert none.n == 0 and set(none.p) == {None}


def test_scores_need_no_python(spark):
    plan = score.score_all(*tables(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Broadcast" in plan


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([None, "required", "plus"]), min_size=1, max_size=8), st.sets(st.integers(0, 7)), st.sets(st.integers(0, 7)))
def test_recall_grows_with_held_skills(spark, labels, some, more):
    asked = spark.createDataFrame([(1, i, str(i), r) for i, r in enumerate(labels)], "job_id long, skill_id long, name string, requirement string")
    pairs = spark.createDataFrame([(1, 1), (2, 1)], "resume_id long, job_id long")
    held = spark.createDataFrame([(1, i) for i in some] + [(2, i) for i in some | more], "resume_id long, skill_id long")
    r = {x.resume_id: x.skill_recall for x in score.skill_recall(asked, held, pairs).collect()}
    assert 0 <= r[1] <= r[2] <= 1


def test_ranks_do_not_mix_and_page_apart(spark):
    rows = [(1, j, s, u) for j, s, u in [(1, 0.5, False), (2, 0.9, True), (3, 0.7, False), (4, 0.7, False)]]
    ranked = rank.rank_matches(spark.createDataFrame(rows, "resume_id long, job_id long, overall_score double, skills_unparsed boolean"))
    assert {r.job_id: (r.rank, r.total) for r in ranked.collect()} == {3: (1, 3), 4: (2, 3), 1: (3, 3), 2: (1, 1)}
    assert {r.job_id for r in rank.page(ranked, 1, 1, 1).collect()} == {4, 2}
    assert {r.job_id for r in rank.min_score(ranked, 0.7).collect()} == {2, 3, 4}


def test_pairs_of_few_profiles_are_made_in_rows(spark, monkeypatch):
    def rows():
        df = score.score_all(*tables(spark), score.Config(cos_lo=0.0, cos_hi=1.0), names=False)
        return sorted(map(str, df.collect())), df._jdf.queryExecution().executedPlan().toString()

    some, plan = rows()
    assert "[resume_id" not in "".join(x for x in plan.splitlines() if "SortMergeJoin" in x or "hashpartitioning" in x)
    monkeypatch.setattr(score, "MOST_IN_ROW", 0)
    assert some == rows()[0]


def test_tied_and_plain_numbers_round_to_four_places(spark):
    x = [0.00005, 0.12345, 0.12355, 0.29995, 1.0, 0.0, 0.36, 0.3599999995, 0.35999999949, float("nan"), None] + [random.Random(3).random() for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select(score.round4(F.col("x")).alias("a"), F.round("x", 4).alias("b"), score.tier(F.col("x"), F.lit(False)).alias("t"), (F.round("x", 9) >= 0.36).alias("s")).collect()
    assert all(repr(r.a) == repr(r.b) for r in rows)
    assert all((r.t == "strong") == bool(r.s) for r in rows)


def test_pairs_of_many_bits_and_odd_ids(spark):
    """holders as bits, several passes, profiles twice or without an id."""
    resumes = spark.createDataFrame([(i, float(i % 5)) for i in range(130)] + [(7, 1.0), (None, 2.0)], "resume_id long, candidate_years double")
    own = spark.createDataFrame([("a", 3.0), ("b", None), ("c", 1.0), (None, 1.0), (None, 2.0)], "job_id string, required_years double")
    asked = spark.createDataFrame([(j, s, f"s{s}", "required" if s % 3 else "bonus") for j, n in (("a", 40), ("b", 3)) for s in range(n)], "job_id string, skill_id long, name string, requirement string")
    held = {(i, s) for i in range(130) for s in range(40) if (i * s) % 7 == 3}
    resume_skills = spark.createDataFrame(sorted(held), "resume_id long, skill_id long")
    cosines = spark.createDataFrame([(i, "a", i / 1000) for i in range(0, 130, 3)] + [(None, "a", 0.5), (1, "x", 0.5)], "resume_id long, job_id string, mean_cos double")
    made = score._pairs_in_rows(resumes, own, asked, resume_skills, cosines, score.Config())
    got = made.collect()
    assert len(got) == 132 * 5
    weight = lambda s: 1.0 if s % 3 else 0.4
    for r in got:
        n = {"a": 40, "b": 3}.get(r.job_id, 0)
        assert r.parsed_count == n and r.skills_unparsed == (n == 0)
        want = sum(weight(s) for s in range(n) if (r.resume_id, s) in held) / sum(weight(s) for s in range(n)) if n else None
        assert r.skill_recall == pytest.approx(want)
        assert r.mean_cos == (r.resume_id / 1000 if r.job_id == "a" and r.resume_id is not None and r.resume_id % 3 == 0 else None)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan  # no lambda over what is asked for, once for each pair


def test_first_rows_are_found_without_sorting_all(spark):
    matches = spark.createDataFrame([(r, j, (j * 7919 % 97) / 97, j % 11 == 0) for r in range(3) for j in range(3000)] + [(9, 5, 0.5, False)], "resume_id int, job_id int, overall_score double, skills_unparsed boolean")
    key = lambda df: sorted((x.resume_id, x.job_id, x.rank) for x in df.collect())
    few = rank.some_postings(matches)
    assert key(rank.top_ranked(matches, 3, few)) == key(rank.top_ranked(matches, 3))
    assert rank.reachable(matches, few, 3).count() < matches.count() / 4
    shown = lambda df: sorted(map(tuple, df.select("resume_id", "job_id", "rank", "total").collect()))
    assert shown(rank.page(matches, 2, 1, some=few)) == shown(rank.page(matches, 2, 1))


def test_demand_is_counted_once_and_dealt_out(spark, sf_dir):
    """Odd pairs and a vocabulary with repeats give what two counts give; the query reads the lines once, and deals a frequent skill to all partitions."""
    from matchspark import catalog

    pairs = [(j, 1) for j in range(400)] * 2 + [(1, 2), (None, 2), (None, 3), (1, None), (2, None), (3, 4), (3, 4), (5, 6)]
    lines = spark.createDataFrame(pairs, "job_id long, skill_id long")
    skills = spark.createDataFrame([(1, True), (1, True), (2, True), (3, False), (4, False), (4, None), (6, None), (9, True), (None, True)], "skill_id long, active boolean")
    shown = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = shown(report.demand_without_inactive(lines, skills))
    assert got == sorted([(1, 400, 400, 0), (2, 1, 1, 0), (3, 0, 0, 0), (None, 2, 0, -2), (4, 1, 0, -1), (6, 1, 0, -1)], key=repr)
    assert got == shown(report.demand_change(lines, lines.join(skills.where("active"), "skill_id").select("job_id", "skill_id")))
    plan = catalog.QUERIES["report_demand_change"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("lineitem.parquet") == 1 and "REPARTITION_BY_NUM" in plan
