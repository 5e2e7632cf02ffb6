import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchspark.llm import _components, ann, near_dedup, substring_dedup
from tests.llm.common import empty_docs, odd_docs

K = 20


def brute_kept(rows):
    """doc_id -> n_words, n_removed, kept words, by the definition; rows sorted by doc_id."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - K + 1):
            window = tuple(w[a : a + K])
            if seen.setdefault(window, (i, a)) != (i, a):
                gone[a : a + K] = [True] * K
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def kept_of(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in df.collect()}


def passages_corpus(seed, n=120):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    some = [[rnd.choice(vocab) for _ in range(rnd.randint(15, 70))] for _ in range(12)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rnd.randint(0, 6)):
            kind = rnd.random()
            if kind < 0.4:
                text += [rnd.choice(vocab) for _ in range(rnd.randint(1, 60))]
            elif kind < 0.8:
                p = list(rnd.choice(some))
                if rnd.random() < 0.3 and p:
                    p[rnd.randrange(len(p))] = "edit"
                text += p
            elif kind < 0.9:
                text += ["x"] * rnd.randint(1, 60)
            else:
                text += ["p", "q", "r"] * rnd.randint(1, 30)
        rows.append((i * 7 % n, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 3), (3, 7)])
def test_substrings_against_the_definition(spark, seed, partitions):
    rows = passages_corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    assert kept_of(substring_dedup.remove_repeats(docs)) == brute_kept(rows)


def test_crowded_minimisers_change_nothing(spark, monkeypatch):
    rows = passages_corpus(4) + [(1000 + i, "a common line that stands before many texts here " + f"tail{i} " * 25) for i in range(40)]
    monkeypatch.setattr(substring_dedup, "LEAST", 3)
    monkeypatch.setattr(substring_dedup, "SEEN", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(substring_dedup.crowded_minimisers(docs)) > 0
    assert kept_of(substring_dedup.remove_repeats(docs)) == brute_kept(rows)


def test_substrings_of_odd_rows(spark):
    out = substring_dedup.remove_repeats(odd_docs(spark))
    rows = defaultdict(list)
    for r in out.collect():
        rows[r.doc_id].append(r)
    assert sum(map(len, rows.values())) == 11
    assert rows[5][0].n_removed == 0 and rows[6][0].n_removed == rows[6][0].n_words == 30_000
    assert [r.n_removed for r in rows[7]] == [brute_kept([(7, "same words " * 40)])[7][1]] * 2
    assert rows[2][0].n_words == 0 and rows[2][0].kept == "" and rows[None][0].n_removed == 0
    assert substring_dedup.remove_repeats(empty_docs(spark)).count() == 0


def test_substring_query(spark, sf_dir):
    want = brute_kept([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op5_substring_dedup(spark, sf_dir).collect()}
    assert got == {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in want.items()}


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, k):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def copies_corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(500)]
    rows = []
    for base in range(25):
        text = [rnd.choice(vocab) for _ in range(rnd.choice([3, 12, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 5, 30])):
            if rnd.random() < 0.7:  # chains of edits: neighbours are near, ends may be far
                text = list(text)
                for _ in range(max(1, len(text) // 40)):
                    text[rnd.randrange(len(text))] = rnd.choice(vocab)
            rows.append(" ".join(text))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def found_components(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed,k", [(1, 2), (2, 5)])
def test_near_duplicates_against_all_pairs(spark, seed, k):
    rows = copies_corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = near_dedup.near_duplicates(docs, k)
    assert found_components(out) == brute_components(rows, k)
    assert out.where("kept <> (doc_id = component_id)").count() == 0


def test_small_nodes_and_blocks_change_nothing(spark, monkeypatch):
    rows = copies_corpus(3)
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_WEIGHT", 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert found_components(near_dedup.near_duplicates(docs, 2)) == brute_components(rows, 2)


def test_chance_that_all_trees_lose_a_link():
    lost = [near_dedup.chance_lost(levels) for levels in range(1, near_dedup.DEPTH + 1)]
    assert lost == sorted(lost) and lost[-1] + 3e-5 < 1e-4


def test_links_just_above_the_threshold_in_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    rnd = random.Random(6)
    body = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):  # every pair of these shares about 0.81 of its shingles
        text = list(body)
        for at in rnd.sample(range(400), 21):
            text[at] = f"e{i}x{at}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert found_components(near_dedup.near_duplicates(docs, 1)) == brute_components(rows, 1)


def test_cross_links_join_what_all_pairs_join():
    rnd = np.random.default_rng(8)
    for _ in range(40):
        base = rnd.integers(0, 1000, 30)
        sets = []
        for _ in range(int(rnd.integers(2, 14))):
            own = base.copy()
            own[rnd.integers(0, 30, int(rnd.integers(0, 9)))] = rnd.integers(1000, 9000)
            sets.append(np.unique(own).astype(np.uint64))
        label = rnd.integers(0, 4, len(sets))
        visitors = int(rnd.integers(0, len(sets) + 1))
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        near = lambda i, j: 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - both)
        got = near_dedup.cross_links(np.concatenate(sets), bounds, label, visitors, 80)
        assert all(i < visitors <= j and near(i, j) for i, j in got)

        def joined(edges):
            root = {x: x for x in range(4)}
            for i, j in edges:
                a, b = root[label[i]], root[label[j]]
                root = {x: a if r == b else r for x, r in root.items()}
            return [root[a] == root[b] for a in range(4) for b in range(4)]

        assert joined(got) == joined((i, j) for i in range(visitors) for j in range(visitors, len(sets)) if near(i, j))


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_texts_that_modular_hashes_confuse(spark):
    """Thue and Morse's strings, as single words and as words: power-of-two rolling hashes of both are equal."""
    a, b = thue_morse(2048)
    rows = list(enumerate([a, b, " ".join(a), " ".join(b), " ".join(f"{a}{i} {a}" for i in range(12)), " ".join(f"{a}{i} {b}" for i in range(12))]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_components(near_dedup.near_duplicates(docs, 2)) == brute_components(rows, 2)
    assert kept_of(substring_dedup.remove_repeats(docs)) == brute_kept(rows)


def test_near_copies_beside_a_null_id(spark):
    text = [f"w{i}" for i in range(60)]
    near = " ".join(text[:-1] + ["other"])
    docs = spark.createDataFrame([(None, " ".join(text)), (5, near), (3, " ".join(text)), (None, near)], "doc_id long, text string")
    out = near_dedup.near_duplicates(docs, 2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out if r.doc_id is not None) == [(3, 3, True), (5, 3, False)]
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)] * 2


def test_only_high_thresholds(spark):
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(empty_docs(spark), threshold=0.7)


def test_near_duplicates_of_odd_rows(spark):
    rows = defaultdict(list)
    for r in near_dedup.near_duplicates(odd_docs(spark), 2).collect():
        rows[r.doc_id].append(r)
    assert sum(map(len, rows.values())) == 11
    assert rows[9][0].component_id == 1 and not rows[9][0].kept and rows[6][0].component_id == 5
    assert all(r.kept and r.n_shingles == 0 for i in (2, 3, 4) for r in rows[i])
    assert [r.component_id for r in rows[7]] == [7, 7] and rows[8][0].n_shingles == 1 and rows[None][0].kept
    assert near_dedup.near_duplicates(empty_docs(spark)).count() == 0


def test_near_duplicate_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found_components(near_dedup.op7_near_dedup(spark, sf_dir)) == brute_components(rows, 2)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 40)] + [(50, 51), (51, 52), (52, 50), (60, 60)]
    out = defaultdict(set)
    for r in _components.components(spark.createDataFrame(edges, "a long, b long")).collect():
        out[r.root].add(r.id)
    assert sorted(map(sorted, out.values())) == [list(range(1, 40)), [50, 51, 52], list(range(100, 141))]


def test_ann_recall(spark, sf_dir):
    out = ann.op9_ann(spark, sf_dir).toPandas()
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = t.vec_id.to_numpy(), np.array(t.embedding.tolist(), np.float64)
    hits = 0
    queries = np.flatnonzero(ids % 20 == 0)
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]])
        own = out[out.query_id == ids[q]].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and np.allclose(own.score, s[np.searchsorted(ids, own.vec_id)], atol=1e-12)
        assert list(zip(-own.score, own.vec_id)) == sorted(zip(-own.score, own.vec_id))
        hits += len(best & set(own.vec_id))
    assert hits >= 0.9 * 20 * len(queries)


def test_ann_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [2.0, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "vec", "u", "v", "s", "q")})
    use = ann.usable(df, "vec_id", "embedding")
    assert {r.id for r in use.collect()} == {0, 1, 8, 20}
    out = ann.search(use, ann.build(use), F.col("id") % 20 == 0, 2).collect()
    assert sorted((r.q, r.id, r.s) for r in out) == [(0, 1, 0.5), (0, 20, 2.0), (20, 0, 2.0), (20, 1, 1.5)]
    none = ann.usable(df.limit(0), "vec_id", "embedding")
    assert ann.search(none, ann.build(none), F.col("id") % 20 == 0, 2).count() == 0


def ann_recall(x, ids, found, n):
    """Share of the n nearest by score, then id, that was found."""
    hits = total = 0
    for q, own in found.items():
        s = x.astype(np.float64) @ x[list(ids).index(q)].astype(np.float64)
        s[list(ids).index(q)] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:n]].tolist())
        hits, total = hits + len(best & own), total + n
    return hits / total


def ann_found(spark, x, ids, n):
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "id long, vec array<float>").repartition(3)
    found = defaultdict(set)
    for r in ann.search(df, ann.build(df), F.col("id") % 20 == 0, n).collect():
        found[r.q].add(r.id)
    return found


def test_ann_descends_from_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 32)
    monkeypatch.setattr(ann, "ROUNDS", 2)
    monkeypatch.setattr(ann, "LIST", 150)
    x = np.random.default_rng(3).normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(3000)
    found = ann_found(spark, x, ids, 20)
    assert len(found) == 150 and ann_recall(x, ids, found, 20) >= 0.9


def test_ann_of_equal_vectors_takes_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 32)
    x = np.random.default_rng(4).normal(size=(600, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[200:400] = x[200]
    ids = np.random.default_rng(5).permutation(600)
    assert ann_recall(x, ids, ann_found(spark, x, ids, 20), 20) >= 0.99
