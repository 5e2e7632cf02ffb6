"""Near-duplicate documents by chosen-path set similarity join.

1. Each text becomes its set of word shingles; equal sets are one class, stood
   for by its smallest doc_id. A class carries ``FUNCTIONS`` min-wise values.
2. ``TREES`` independent trees branch the classes: at a node, each min-wise
   function is chosen with a chance that makes ``BRANCHES`` choices on average,
   and a class goes to the child (function, value). Nodes of one class end,
   nodes of up to ``SMALL`` classes are compared exhaustively on two-bit
   sketches, larger ones branch again; what is still large at ``DEPTH`` shares
   so many min-wise values that its classes are taken for similar as they are.
   A pair of similarity 0.8 is lost by all trees with a chance below 1e-13 where
   roots suffice, and of about 1e-8, 2e-6, 3.4e-5 where 2, 3, 4 levels are needed
   (``chance_lost``: averaged over how many min-wise values agree, as all trees
   draw on the same ones). The sketches lose 3e-5 more of small nodes' pairs.
3. Candidate components are verified on full sets. The members' texts come
   together once, in blocks of bounded weight, and a search from text to text
   finds groups joined by links of Jaccard similarity at least ``threshold``. Of
   a component beyond one block, one text stands for each group; those are
   searched in the same way until a component's fit one block or no longer
   shrink. Only texts outside the largest group found then visit all blocks.
4. Components over the confirmed links give each document's component_id.

Defined results. Null text or no words: an empty set, linked with nothing.
Fewer words than a shingle: the whole sequence is one shingle. Ties in the
smallest doc_id cannot occur; repeated rows are equal sets and fall together.
A null doc_id cannot stand for a class: such rows form no links and stay.
Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm._components import components
from matchspark.llm._tables import drop_kept, keep, table
from matchspark.llm._text import blocks, mix, sequence_hashes, trimmed, words

SHINGLE, THRESHOLD = 5, 0.8
FUNCTIONS, CHOOSE_FROM = 64, 64
#: A root chooses 2 functions on average, any other node 1 / THRESHOLD: a pair at the threshold then lives on in one child on average.
TREES, BRANCHES, SMALL, DEPTH = 20, (2.0, 1.25), 64, 4
#: Equal two-bit values of 64 below which a pair of similarity 0.8 falls with a chance of about 1e-5.
LEAST_EQUAL = 42
#: Shingles (and ROW_WEIGHT, what a row takes beside them, for each text) that a block of the verification holds, on average.
BLOCK_WEIGHT, ROW_WEIGHT = 2_000_000, 50

_RNG = np.random.default_rng(11)
_XOR = _RNG.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32)
_MULTIPLY = _RNG.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32) | np.uint32(1)


def chance_lost(levels: int, similarity: float = THRESHOLD) -> float:
    """The chance that all trees lose a pair of this similarity which needs so many levels."""
    total = 0.0
    for m in range(CHOOSE_FROM + 1):
        lost = 0.0
        for level in range(levels, 0, -1):
            lost = (1 - BRANCHES[level > 1] / CHOOSE_FROM * (1 - lost)) ** m
        total += comb(CHOOSE_FROM, m) * similarity**m * (1 - similarity) ** (CHOOSE_FROM - m) * lost**TREES
    return total


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of each row (with repeats), and the bounds of the rows in them."""
    _, _, h, first = words(buf, offsets, lower=True)
    n = np.diff(first)
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    start = first[row] + np.arange(int(bounds[-1])) - bounds[row]
    return sequence_hashes(h, start, start + np.minimum(n, shingle)[row]), bounds


def minwise(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, FUNCTIONS) min-wise values; rows must not be empty."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, FUNCTIONS), np.uint32)
    for k in range(FUNCTIONS):
        y = (x ^ _XOR[k]) * _MULTIPLY[k]
        out[:, k] = np.minimum.reduceat(y ^ (y >> np.uint32(15)), bounds[:-1])
    return out


def _bits(values: np.ndarray) -> np.ndarray:
    """64 zero-one columns as one 64-bit number a row."""
    return np.packbits(values.astype(np.uint8), axis=1).view(np.uint64).ravel()


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (hash of the set), a and b (sketch), values (the min-wise values to choose from)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_shingles", "s1", "s2", "a", "b", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, buf, offsets in blocks(batch.column(1)):
                h, bounds = shingle_hashes(buf, offsets, shingle)
                rows = len(offsets) - 1
                size, s1, s2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                b = bounds.tolist()
                for i in range(rows):
                    own = np.unique(h[b[i] : b[i + 1]])
                    size[i] = len(own)
                    s1[i], s2[i] = own.sum(dtype=np.uint64), mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                full = np.flatnonzero(size)
                low = np.zeros((rows, FUNCTIONS), np.uint32)
                if len(full):
                    low[full] = minwise(h, bounds[np.append(full, rows)])
                chosen = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * CHOOSE_FROM), pa.array(low[:, :CHOOSE_FROM].astype(np.int32, copy=True).ravel()))
                longs = [pa.array(x.view(np.int64)) for x in (s1, s2, _bits(low & np.uint32(1)), _bits((low >> np.uint32(1)) & np.uint32(1)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(size), *longs, chosen], names)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, n_shingles long, s1 long, s2 long, a long, b long, values array<int>")


def _children(node: Column, values: Column, branches: float) -> Column:
    """The children of a node that a class with these values goes to."""
    chance = int((1 << 32) * branches / CHOOSE_FROM)
    goes = lambda i: F.pmod(F.xxhash64(node, i), F.lit(1 << 32)) < F.lit(chance)
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(CHOOSE_FROM - 1)), goes), lambda i: F.xxhash64(node, i, F.get(values, i)))


def candidates(classes: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """Edges (a, b) of classes (doc_id, a, b, values) that may be similar: their components hold every similar pair.

    Tables that the edges are made of join ``spent``, to be dropped when the edges are written.
    """
    roots = F.array(*(F.lit(t).cast("long") for t in range(TREES)))
    own = classes.select(F.col("doc_id").alias("_doc"), "a", "b", "values")
    at = found = None
    for depth in range(1, DEPTH + 1):
        if at is None:
            stepped = classes.select("doc_id", "a", "b", "values", roots.alias("nodes"))
        else:  # one row a class with its nodes, of which trees and branches bound the number
            held = at.groupBy("doc_id").agg(F.collect_list("node").alias("nodes"))
            stepped = held.hint("merge").join(own, F.col("doc_id") == F.col("_doc"))
        children = F.flatten(F.transform("nodes", lambda node: _children(node, F.col("values"), BRANCHES[depth > 1])))
        stepped = stepped.select("doc_id", "a", "b", F.explode(children).alias("node"))
        stepped = keep(stepped, "nodes")
        sizes = keep(stepped.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        sized = keep(stepped.hint("merge").join(sizes, "node"), "sized")
        drop_kept(stepped)
        spent += [sizes, sized]
        small = sized.where(F.col("n") <= SMALL)
        edges = small.select("node", "doc_id", "a", "b").repartition("node").sortWithinPartitions("node").mapInArrow(trimmed(_compare), "a long, b long")
        at = sized.where(F.col("n") > SMALL).select("doc_id", "node")
        if depth == DEPTH:
            least = keep(at.groupBy("node").agg(F.min("doc_id").alias("b")), "heads")
            spent.append(least)
            edges = edges.unionByName(at.hint("merge").join(least, "node").select(F.col("doc_id").alias("a"), "b"))
        found = edges if found is None else found.unionByName(edges)
        if at.isEmpty():
            break
    return found.where("a <> b").distinct()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join the classes of each (small) node whose sketches agree; rows come sorted by node."""
    rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
    for batch in chain(batches, [None]):
        more = [c.to_numpy() for c in batch.columns] if batch is not None else [np.zeros(0, np.int64)] * 4
        node, doc, a, b = (np.concatenate(x) for x in zip(rest, more))
        if not len(node):
            continue
        begin = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        last = begin[-1] if batch is not None else len(node)  # the last node may go on in the next batch
        rest = [x[last:] for x in (node, doc, a, b)]
        ends = np.append(begin[1:], len(node))
        left, right = [], []
        two = begin[(ends - begin == 2) & (ends <= last)]
        near = _equal(a[two], b[two], a[two + 1], b[two + 1]) >= LEAST_EQUAL
        left.append(doc[two[near]])
        right.append(doc[two[near] + 1])
        for s, e in zip(begin.tolist(), ends.tolist()):
            if e - s > 2 and e <= last:
                i, j = np.nonzero(np.triu(_equal(a[s:e, None], b[s:e, None], a[None, s:e], b[None, s:e]) >= LEAST_EQUAL, 1))
                left.append(doc[s + i])
                right.append(doc[s + j])
                if len(i) > e - s:
                    left[-1], right[-1] = _forest(left[-1], right[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def _equal(a1: np.ndarray, b1: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """How many of the 64 two-bit values agree."""
    return FUNCTIONS - np.bitwise_count(((a1 ^ a2) | (b1 ^ b2)).view(np.uint64)).astype(np.int64)


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the edges as join the same vertices."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(left.tolist(), right.tolist())):
        x, y = top(x), top(y)
        if x != y:
            root[y] = x
            kept.append(k)
    return left[kept], right[kept]


def linked_groups(h: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """Group (its first row) of each of the non-empty sets h[bounds[i]:bounds[i+1]]; sets are linked where 100 * intersection >= percent * union.

    A search from set to set compares each with those not yet reached only.
    """
    n = len(bounds) - 1
    keys, flat = np.unique(h, return_inverse=True)
    size = np.diff(bounds)
    group = np.full(n, -1)
    live, live_flat, live_start = np.arange(n), flat, bounds[:-1]
    flags = np.zeros(len(keys), bool)
    for seed in range(n):
        if group[seed] >= 0:
            continue
        group[seed] = seed
        queue = [seed]
        while queue:
            i = queue.pop()
            waiting = group[live] < 0
            left = int(waiting.sum())
            if not left:
                break
            if 2 * left <= len(live):
                live_flat = live_flat[np.repeat(waiting, size[live])]
                live = live[waiting]
                live_start = np.cumsum(size[live]) - size[live]
                waiting = np.ones(left, bool)
            own = flat[bounds[i] : bounds[i + 1]]
            flags[own] = True
            shared = np.add.reduceat(flags[live_flat].view(np.int8), live_start, dtype=np.int64)
            flags[own] = False
            hit = live[waiting & (100 * shared >= percent * (size[i] + size[live] - shared))]
            group[hit] = seed
            queue += hit.tolist()
    return group


def cross_links(h: np.ndarray, bounds: np.ndarray, label: np.ndarray, visitors: int, percent: int) -> list[tuple[int, int]]:
    """Links of the first ``visitors`` sets to later ones of another label; labels that a link joins count as one from then on."""
    label = label.copy()
    keys, flat = np.unique(h, return_inverse=True)
    size = np.diff(bounds)
    flags = np.zeros(len(keys), bool)
    here = np.arange(visitors, len(size))
    start = bounds[:-1][visitors:] - bounds[visitors]
    flat_here = flat[bounds[visitors] :]
    found = []
    for i in range(visitors if len(here) else 0):
        own = flat[bounds[i] : bounds[i + 1]]
        flags[own] = True
        shared = np.add.reduceat(flags[flat_here].view(np.int8), start, dtype=np.int64)
        flags[own] = False
        hit = here[(label[here] != label[i]) & (100 * shared >= percent * (size[i] + size[here] - shared))]
        for other in hit.tolist():
            if label[other] != label[i]:
                found.append((i, other))
                label[label == label[other]] = label[i]
    return found


def _in_blocks(rows: DataFrame, keys: list[str], shingle: int, links) -> DataFrame:
    """Edges (a, b) that ``links(h, bounds, label, visits)`` finds in each block of rows (keys, visits, label, doc_id, text), visitors first."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                ids, sets, label, visits = zip(*held)
                bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, sets), np.int64, len(sets)))])
                found.extend((ids[i], ids[j]) for i, j in links(np.concatenate(sets), bounds, np.array(label), sum(visits)))

        for batch in batches:
            block = list(zip(*(batch.column(c).to_pylist() for c in range(len(keys)))))
            visits, label, who = (batch.column(len(keys) + c).to_pylist() for c in range(3))
            for at, buf, offsets in blocks(batch.column(len(keys) + 3)):
                h, bounds = shingle_hashes(buf, offsets, shingle)
                b = bounds.tolist()
                for r in range(len(offsets) - 1):
                    if block[at + r] != now:
                        close()
                        now, held = block[at + r], []
                    held.append((who[at + r], np.unique(h[b[r] : b[r + 1]]), label[at + r], visits[at + r]))
            yield _edges(found)
            found.clear()
        close()
        yield _edges(found)

    def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("visits"))
    return dealt.select(*keys, "visits", "label", "doc_id", "text").mapInArrow(trimmed(search), "a long, b long")


def _block_of(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("k")).cast("int")


def confirmed(docs: DataFrame, members: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Edges (a, b) whose components are those of all links within each candidate component.

    members: doc_id, root, n_shingles of the classes of candidate components.
    """
    percent = round(100 * threshold)

    def stars(h: np.ndarray, bounds: np.ndarray, label: np.ndarray, visits: int) -> list[tuple[int, int]]:
        return [(g, k) for k, g in enumerate(linked_groups(h, bounds, percent).tolist()) if g != k]

    weigh = lambda df: df.groupBy("root").agg(F.sum(F.col("n_shingles") + ROW_WEIGHT).alias("w"), F.count(F.lit(1)).alias("n"))
    blocks_ = F.ceil(F.col("w") / BLOCK_WEIGHT).cast("int")
    weight = keep(weigh(members), "weights")
    spread = members.hint("merge").join(weight.select("root", blocks_.alias("k"), "n"), "root").select(F.col("doc_id").alias("_doc"), "root", "k", "n", "n_shingles")
    texts = spread.hint("merge").join(docs.select("doc_id", "text"), F.col("_doc") == F.col("doc_id")).drop("_doc")
    texts = texts.withColumns({"label": F.col("doc_id"), "visits": F.lit(False)})
    links = keep(_in_blocks(texts.withColumn("own", _block_of(0)), ["root", "own"], shingle, stars), "links")
    if weight.where(blocks_ > 1).isEmpty():
        return links

    crowd = live = keep(texts.where("k > 1"), "crowd")
    found, seed = links, 0
    while True:  # one text of each group of a block; each doc_id is the b of one star at most
        standing = keep(live.hint("merge").join(links.select(F.col("b").alias("doc_id")), "doc_id", "left_anti"), "standing")
        sizes = weigh(standing).select("root", blocks_.alias("_k"), F.col("n").alias("_n"))
        again = standing.hint("merge").join(sizes, "root").where("k > 1 and 2 * _n <= n")
        live = keep(again.withColumns({"k": F.col("_k"), "n": F.col("_n")}).drop("_k", "_n"), "standing")
        if live.isEmpty():
            break
        seed += 1
        links = keep(_in_blocks(live.withColumn("own", _block_of(seed)), ["root", "own"], shingle, stars), "links")
        found = found.unionByName(links)

    named = components(found.hint("merge").join(crowd.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b"))
    labelled = crowd.drop("label").hint("merge").join(named.select(F.col("id").alias("_id"), F.col("root").alias("_group")), F.col("doc_id") == F.col("_id"), "left")
    labelled = keep(labelled.withColumn("label", F.coalesce("_group", "doc_id")).drop("_id", "_group"), "labelled")
    groups = labelled.groupBy("root", "label").agg(F.sum(F.col("n_shingles") + ROW_WEIGHT).alias("w"))
    largest = groups.groupBy("root").agg(F.max(F.struct("w", "label"))["label"].alias("_main"), F.sum("w").alias("_all"), F.max("w").alias("_most"))
    largest = largest.where("_all > _most").select("root", "_main", F.ceil((F.col("_all") - F.col("_most")) / BLOCK_WEIGHT).cast("int").alias("turns"))
    split = keep(labelled.hint("merge").join(largest, "root"), "split")
    turn = F.explode(F.sequence(F.lit(0), F.col("turns") - 1))
    residents = split.withColumns({"own": _block_of(0), "turn": turn})
    visitors = split.where("label <> _main").withColumns({"turn": F.pmod(F.xxhash64("doc_id", F.lit(-1)), F.col("turns")).cast("int"), "own": F.explode(F.sequence(F.lit(0), F.col("k") - 1)), "visits": F.lit(True)})
    columns = ["root", "own", "turn", "visits", "label", "doc_id", "text"]
    across = lambda h, bounds, label, visits: cross_links(h, bounds, label, visits, percent)
    met = _in_blocks(residents.select(*columns).unionByName(visitors.select(*columns)), ["root", "own", "turn"], shingle, across)
    return found.unionByName(met)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id is the smallest of its component)."""
    if threshold < THRESHOLD:
        raise ValueError(f"branches and sketches are made for similarities of {THRESHOLD} or more")
    signed = keep(signatures(docs, shingle), "signatures")
    same = ["s1", "s2", "n_shingles"]
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = keep(usable.groupBy(*same).agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("a", "b", "values"))), "classes")
    spent: list[DataFrame] = []
    hopeful = components(candidates(classes, spent))
    drop_kept(*spent)
    members = classes.select("doc_id", "n_shingles").hint("merge").join(hopeful.withColumnRenamed("id", "doc_id"), "doc_id")
    linked = components(confirmed(docs.where("doc_id is not null"), keep(members, "members"), shingle, threshold))
    least = keep(linked.groupBy("root").agg(F.min("id").alias("component")), "least")
    found = keep(linked.hint("merge").join(least, "root").select(F.col("id").alias("doc"), "component"), "found")
    named = classes.select(*same, F.col("doc_id").alias("rep")).hint("merge").join(found, F.col("rep") == F.col("doc"), "left")
    named = keep(named.select(*(F.col(c).alias(f"_{c}") for c in same), F.coalesce("component", "rep").alias("component")), "named")
    out = signed.select("doc_id", *same).hint("merge").join(named, F.expr(" and ".join(f"{c} = _{c}" for c in same) + " and doc_id is not null"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLE_SQL: dict[str, str] = {}
