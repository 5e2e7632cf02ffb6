import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from matchspark.llm import simhash
from tests.llm.common import empty_docs, odd_docs


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius=3):
    """value -> smallest value of its component, over all pairs."""
    left, out = set(values), {}
    while left:
        seed = left.pop()
        group, queue = {seed}, [seed]
        while queue:
            x = queue.pop()
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            group |= near
            queue += near
        out |= {v: min(group) for v in group}
    return out


def family(rnd, n, flips):
    """Fingerprints that go away from one another by a few bits."""
    out = [rnd.getrandbits(64)]
    for _ in range(n - 1):
        x = rnd.choice(out)
        for b in rnd.sample(range(64), rnd.randint(1, flips)):
            x ^= 1 << b
        out.append(x)
    return out


def grouped(edges, values):
    root = {v: v for v in values}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in edges:
        a, b = top(x), top(y)
        root[max(a, b)] = min(a, b)
    return {v: top(v) for v in values}


@pytest.mark.parametrize("seed", range(6))
def test_tiles_against_all_pairs(seed):
    rnd = random.Random(seed)
    values = list({v for _ in range(12) for v in family(rnd, rnd.randint(1, 40), 6)} | {rnd.getrandbits(64) for _ in range(100)})
    rnd.shuffle(values)
    own = simhash.own_links(np.array(values, np.uint64), 3)
    assert grouped(own, values) == brute_components(values) and len(own) < len(values)
    a, b = values[: len(values) // 3], values[len(values) // 3 :]
    across = simhash.tile_links(np.array(a, np.uint64), np.array(b, np.uint64), 3)
    assert grouped(across, values) == grouped([(x, y) for x in a for y in b if (x ^ y).bit_count() <= 3], values)
    assert all((x ^ y).bit_count() <= 3 for x, y in own + across)


@pytest.mark.parametrize("parts,tile", [(1, 50), (2, 8192), (4, 8192), (4, 7), (8, 3)])
def test_skipped_tiles_lose_no_link(spark, parts, tile):
    rnd = random.Random(parts)
    values = list({v for _ in range(20) for v in family(rnd, 20, 5)} | {0, 1, (1 << 64) - 1, 7, 15})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, parts, tile).collect()
    assert grouped([(r.a % (1 << 64), r.b % (1 << 64)) for r in edges], values) == brute_components(values)


def test_steps_are_half_of_the_neighbours():
    for parts, n in ((1, 7), (2, 25), (4, 129), (8, 833)):
        steps = simhash.neighbour_steps(parts, 3)
        assert len(steps) == (n + 1) // 2 and len({*map(tuple, steps)} | {tuple(-d for d in s) for s in steps}) == n


def held(rows, out):
    """Every row's fingerprint and component by brute force."""
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    root = brute_components([f for _, f in prints])
    least = defaultdict(list)
    for i, f in prints:
        least[root[f]] += [] if i is None else [i]
    expected = sorted((str(i), f"{f:016x}", min(least[root[f]], default=None)) for i, f in prints)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in out) == expected


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = simhash.op12_simhash(spark, sf_dir).collect()
    held(rows, out)
    assert any(r.component_id != r.doc_id for r in out)


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).select("doc_id", "text").collect()]
    held(rows, simhash.near_duplicates(odd_docs(spark)).collect())
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    alone = odd_docs(spark).where("doc_id is null")
    assert simhash.near_duplicates(alone).collect()[0].component_id is None
    crowd = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("one text that all of them share but for a word "), F.repeat(F.lit("and more words that stay "), 40), F.col("id") % 30).alias("text"))
    held([(r.doc_id, r.text) for r in crowd.collect()], simhash.near_duplicates(crowd.repartition(5)).collect())


def test_long_text_is_counted_in_slices(monkeypatch):
    text = " ".join(f"Word{i % 977}" for i in range(5000))
    monkeypatch.setattr(simhash, "COUNTED", 700)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
