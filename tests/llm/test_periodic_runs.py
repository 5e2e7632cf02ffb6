import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from matchspark.llm import periodic_runs
from tests.llm.common import empty_docs, odd_docs


def brute_runs(w, least=6, times=4):
    """All runs (start, length, period) by the definition, lag by lag."""
    n, out = len(w), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            smallest = lambda s: not any(all(a == b for a, b in zip(s, s[d:])) for d in range(1, q))
            if length >= max(least, times * q) and smallest(w[i : i + length]):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def brute_planted(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def brute_kept(w, runs):
    return b" ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + length for s, length, q in runs))


def periodic_text(rnd):
    w = []
    for _ in range(rnd.randint(0, 4)):
        base = [f"w{rnd.randint(0, rnd.choice([1, 2, 5]))}" for _ in range(rnd.randint(1, 14))]
        w += (base * 90)[: rnd.randint(0, 90)] + [f"w{rnd.randint(0, 2)}" for _ in range(rnd.randint(0, 5))]
    return rnd.choice([" ", "\n", " \t"]).join(w)


@pytest.mark.parametrize("least,times", [(6, 4), (9, 4), (2, 5), (30, 6)])
def test_runs_against_the_definition(spark, least, times):
    rnd = random.Random(least)
    rows = [(i, periodic_text(rnd)) for i in range(150)] + [(200, "a b " * 400 + "a b c " * 300), (201, "Ωmega é " * 12)]
    out = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least, times).collect()
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        w = texts[r.doc_id].encode().split()
        found = [(x.start, x.length, x.period) for x in r.runs]
        assert found == brute_runs(w, least, times)
        assert r.n_words == len(w) and r.collapsed.encode() == brute_kept(w, found)


def test_seeds_serve_every_lag_once():
    for least, times in ((6, 4), (2, 4), (40, 4), (6, 9)):
        at = 1
        for k, low, high in periodic_runs.lag_classes(5000, least, times):
            assert low == at and all(2 * q - 1 <= k <= max(least, times * q) - q for q in range(low, high + 1))
            at = high + 1
        assert max(least, times * at) > 5000


def test_one_word_a_million_times(spark):
    rows = [(1, "x " * 1_000_000), (2, " ".join(f"y{i % 1000}" for i in range(300_000)))]
    out = {r.doc_id: r for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in out[1].runs] == [(0, 1_000_000, 1)] and out[1].collapsed == "x"
    assert [tuple(x) for x in out[2].runs] == [(0, 300_000, 1000)] and len(out[2].collapsed.split()) == 1000


def test_nested_and_overlapping_runs():
    text = ("a a a a a a b " * 5 + "c").split()
    assert [x for x in brute_runs(text) if x[2] == 7] == [(0, 35, 7)]


def test_digests_against_the_definition(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = periodic_runs.op11_periodic_runs(spark, sf_dir).collect()
    assert len(out) == len(rows) and sum(r.n_runs > 0 for r in out) > 5
    for r in out:
        w = brute_planted(r.doc_id, rows[r.doc_id])
        ids = {x: i for i, x in enumerate(dict.fromkeys(w))}
        if len(w) > 1200:
            continue
        runs = brute_runs([ids[x] for x in w])
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *((best[0], best[1], best[2]) if best else (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_kept(w, runs)).hexdigest()


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).select("doc_id", "text").collect()]
    out = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(odd_docs(spark)))).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)
    empty = [r for r in out if r.doc_id in (2, 3, 4)]
    assert all((r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (0, None, None, None, None) and r.collapsed_sha256 == hashlib.sha256(b"").hexdigest() for r in empty)
    seven = brute_planted(7, "same words " * 40)
    assert [(r.n_runs, r.length, r.period) for r in out if r.doc_id == 7] == [(1, max(x[1] for x in brute_runs(seven)), brute_runs(seven)[0][2])] * 2
    none = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(empty_docs(spark))))
    assert none.count() == 0 and dict(none.dtypes)["n_runs"] == "bigint"
    ids = odd_docs(spark).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert periodic_runs.periodic_runs(ids).count() == len(rows)
