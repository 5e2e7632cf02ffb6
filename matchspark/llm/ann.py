"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Equal vectors are one class, stood for by its smallest id; graph and search are
over classes, and found classes are opened into their smallest ids at the end.

Build. Each round of the start sorts all classes by their nearest pivots (a
bounded sample of vectors, other ones each round) and cuts the order into small
blocks of ``BLOCK`` rows; rows of a block are compared with each other. Then
NN-descent: every class introduces its new neighbours to its new and old ones,
both ways, through joins on the class they share; pairs better than what either
side holds enter its list as new, until few do. Every class is in the index.

Search. A class with queries starts from its own list, walks to the neighbours
(both ways) of its best candidates not yet visited, and goes on until its list
of ``LIST`` stands still. A class's neighbourhood passes once a step, in front of
the queries that visit it. Both work on vectors rounded to a byte a component;
the best of a list are scored again in double precision on the original ones.

Nearness is the larger inner product; ties go to the smaller id. Reverse
neighbours taken for a round are bounded by ``DEGREE``, chosen by hash, as in
the published method; recall is measured against brute force in the tests.

Defined results. Vectors that are null, zero, or hold null or non-finite
components take no part, nor do vectors of another width than the most frequent
(of equals the larger). Repeated ids: one row, the first by its components, is
taken. A null id takes no part. Fewer candidates than asked for: all of them.
Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchspark.llm._tables import drop_kept, keep, table

#: Pivots of the first and of the second order; rows that one product takes; blocks of a partition.
DEGREE, BLOCK, ROUNDS, PIVOTS, SLICE, DEALT = 20, 256, 2, (8, 32), 512, 16
#: NN-descent ends when a round changes less than this share of the graph.
LEAST_CHANGE = 0.08
#: Length of a query's list, how many of its entries are opened in a step, and how many times those asked for are scored again.
LIST, OPENED, AGAIN = 500, 80, 5


def matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    """A column of lists of one width."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1) if n else np.zeros((0, 1), dtype)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    width = rows.groupBy(F.size("vec").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    rows = rows.where(F.size("vec") == (width[0]["w"] if width else 0))
    return keep(rows.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")


def classed(rows: DataFrame) -> DataFrame:
    """id, vec, cls: the smallest id of an equal vector."""
    classes = rows.groupBy("vec").agg(F.min("id").alias("cls"))
    return keep(rows.hint("merge").join(classes, "vec").select("id", "vec", "cls"), "classed")


def _classes(rows: DataFrame) -> DataFrame:
    """One row (id, vec) a class."""
    return keep((rows if "cls" in rows.columns else classed(rows)).where("id = cls").select("id", "vec"), "classes")


def _best(edges: DataFrame, most: int, key: str = "u", other: str = "v") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("s"), other)
    return edges.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def _blocks_of_round(rows: DataFrame, k: int) -> DataFrame:
    """Edges u, v, s within blocks of the order of one round."""
    picked = [np.array(r["vec"], np.float32) for r in rows.orderBy(F.xxhash64("id", F.lit(k)), "id").limit(sum(PIVOTS)).select("vec").collect()]
    pivots = np.array(picked)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = matrix(batch.column(1)) @ pivots.T
            first, second = near[:, : PIVOTS[0]].argmax(axis=1), near[:, PIVOTS[0] :].argmax(axis=1) if near.shape[1] > PIVOTS[0] else np.zeros(len(near), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first * PIVOTS[1] + second), pa.array(near[:, 0].astype(np.float64))], ["id", "vec", "cell", "along"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs = np.zeros(0, np.int64), None
        for batch in chain(batches, [None]):
            if batch is not None:
                ids = np.concatenate([ids, batch.column(0).to_numpy()])
                vecs = matrix(batch.column(1)) if vecs is None or not len(vecs) else np.concatenate([vecs, matrix(batch.column(1))])
            while len(ids) >= 2 * BLOCK or (batch is None and len(ids)):
                size = BLOCK if len(ids) >= 2 * BLOCK else len(ids)
                own, x = ids[:size], vecs[:size]
                ids, vecs = ids[size:], vecs[size:]
                if size < 2:
                    continue
                most = min(DEGREE, size - 1)
                for at in range(0, size, SLICE):
                    part = own[at : at + SLICE]
                    s = x[at : at + SLICE] @ x.T
                    s[np.arange(len(part)), np.arange(at, at + len(part))] = -np.inf
                    top = np.argpartition(s, size - most, axis=1)[:, size - most :]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, most)), pa.array(own[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel().astype(np.float64))], ["u", "v", "s"])

    kind = rows.schema["vec"].dataType.simpleString()
    placed = keep(rows.select("id", "vec").mapInArrow(place, f"id long, vec {kind}, cell long, along double"), "placed")
    parts = max(1, placed.count() // (DEALT * BLOCK))  # so that partitions hold whole blocks
    dealt = placed.repartitionByRange(parts, "cell", "along", "id").sortWithinPartitions("cell", "along", "id").select("id", "vec")
    return dealt.mapInArrow(compare, "u long, v long, s double")


def coded(rows: DataFrame) -> DataFrame:
    """id, code (a byte a component) and scale of rows (id, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            scale = np.abs(x).max(axis=1) / 127 if len(x) else np.zeros(0, np.float32)
            code = np.round(x / np.where(scale == 0, 1, scale)[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale, pa.float32())], ["id", "code", "scale"])

    return rows.select("id", "vec").mapInArrow(run, "id long, code binary, scale float")


def _decoded(code: pa.Array, scale: np.ndarray) -> np.ndarray:
    """Vectors of a column of codes, one after another, with the scale of each."""
    ends = np.frombuffer(code.buffers()[1], np.int32)[code.offset : code.offset + len(code) + 1]
    flat = np.frombuffer(code.buffers()[2], np.int8)[ends[0] : ends[-1]] if len(code) else np.zeros(0, np.int8)
    return flat.reshape(len(scale), -1).astype(np.float32) * scale[:, None].astype(np.float32) if len(scale) else np.zeros((0, 1), np.float32)


def _best_of(u: np.ndarray, v: np.ndarray, s: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Places of the ``most`` best of each u, best first; of equal (u, v) one, a known one before a fresh one."""
    order = np.lexsort((fresh, v, u))
    one = np.append(True, (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])) if len(u) else np.zeros(0, bool)
    order = order[one]
    order = order[np.lexsort((v[order], -s[order], u[order]))]
    first = np.flatnonzero(np.append(True, u[order][1:] != u[order][:-1])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < most]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups of the first column of sorted batches, with where each group begins and ends."""
    rest = None
    for batch in chain(batches, [None]):
        if batch is not None:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if rest is None or not len(rest):
            continue
        key = rest.column(0).to_numpy()
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = int(begin[-1]) if batch is not None else len(key)  # the last group may go on in the next batch
        begin = begin[begin < last]
        if len(begin):
            yield rest.slice(0, last).combine_chunks(), begin, np.append(begin[1:], last)
        rest = rest.slice(last)


def _lists(edges: DataFrame) -> DataFrame:
    """u with its best DEGREE of edges (u, v, s, fresh): ids, s, and new where an edge is fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in _groups(batches):
            u, v, s, fresh = (rows.column(k).to_numpy() for k in range(4))
            best = _best_of(u, v, s, fresh, DEGREE)
            whose, begin = np.unique(u[best], return_index=True)
            bounds = pa.array(np.append(begin, len(best)), pa.int32())
            listed = [pa.ListArray.from_arrays(bounds, pa.array(x[best])) for x in (v, s, fresh)]
            yield pa.RecordBatch.from_arrays([pa.array(whose), *listed], ["u", "ids", "s", "new"])

    # hubs come with few edges each from many batches, DEGREE of each at most
    return edges.repartition("u").sortWithinPartitions("u").mapInArrow(run, "u long, ids array<long>, s array<double>, new array<boolean>")


def _descend(graph: DataFrame, codes: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """New edges (u, v, s) between vectors that share a neighbour, one of them new, better than the worst that either side holds."""
    edges = graph.select("u", F.explode(F.arrays_zip("ids", "new")).alias("e")).select("u", F.col("e.ids").alias("v"), F.col("e.new").alias("new"))
    some = Window.partitionBy("v", "new").orderBy(F.xxhash64("u", "v"), "u")
    reverse = edges.withColumn("_rank", F.row_number().over(some)).where(F.col("_rank") <= DEGREE)
    lists = edges.select(F.col("u").alias("at"), F.col("v").alias("x"), "new").unionByName(reverse.select(F.col("v").alias("at"), F.col("u").alias("x"), "new"))
    worst = F.when(F.size("s") >= DEGREE, F.element_at("s", -1)).otherwise(F.lit(float("-inf")))
    known = keep(graph.select("u", worst.alias("worst")).hint("merge").join(codes, F.col("u") == F.col("id")).select("id", "code", "scale", "worst"), "known")
    spent.append(known)
    met = lists.hint("merge").join(known, F.col("x") == F.col("id")).select("at", "x", "new", "code", "scale", "worst")

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin, ends in _groups(batches):
            x, new, worst = (rows.column(k).to_numpy() for k in (1, 2, 5))
            vec = _decoded(rows.column(3).chunk(0), rows.column(4).to_numpy())
            us, vs, ss = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
            for b, e in zip(begin.tolist(), ends.tolist()):
                fresh = np.flatnonzero(new[b:e])
                if not len(fresh):
                    continue
                own = x[b:e]
                s = vec[b:e][fresh] @ vec[b:e].T
                s[own[fresh][:, None] == own[None, :]] = -np.inf
                i, j = np.nonzero(s > worst[b:e][fresh][:, None])
                us.append(own[fresh[i]])
                vs.append(own[j])
                ss.append(s[i, j])
                i, j = np.nonzero((s > worst[b:e][None, :]) & ~new[b:e][None, :])
                us.append(own[j])
                vs.append(own[fresh[i]])
                ss.append(s[i, j])
            u, v, s = np.concatenate(us), np.concatenate(vs), np.concatenate(ss).astype(np.float64)
            best = _best_of(u, v, s, np.ones(len(u), bool), DEGREE)  # beyond these of a batch none can enter
            yield pa.RecordBatch.from_arrays([pa.array(u[best]), pa.array(v[best]), pa.array(s[best])], ["u", "v", "s"])

    return met.repartition("at").sortWithinPartitions("at").mapInArrow(introduce, "u long, v long, s double")


def build(rows: DataFrame) -> DataFrame:
    """The neighbour graph of the classes of usable vectors (id, vec): u, ids, s, new."""
    rows = _classes(rows)
    codes = keep(coded(rows), "codes")
    start = None
    for k in range(ROUNDS):
        found = _blocks_of_round(rows, k)
        start = found if start is None else start.unionByName(found)
    graph = keep(_lists(start.withColumn("fresh", F.lit(True))), "graph")
    while True:
        spent = [graph]
        held = graph.select("u", F.explode(F.arrays_zip("ids", "s")).alias("e")).select("u", F.col("e.ids").alias("v"), F.col("e.s").alias("s"), F.lit(False).alias("fresh"))
        next_ = keep(_lists(held.unionByName(_descend(graph, codes, spent).withColumn("fresh", F.lit(True)))), "graph")
        counts = next_.agg(F.sum(F.size(F.filter("new", lambda x: x))).alias("new"), F.sum(F.size("ids")).alias("all")).first()
        drop_kept(*spent)
        graph = next_
        if (counts["new"] or 0) <= LEAST_CHANGE * (counts["all"] or 0):
            return graph


def _neighbourhoods(graph: DataFrame, codes: DataFrame) -> DataFrame:
    """at with the ids, codes and scales of its neighbours, both ways (2 * DEGREE at most)."""
    edges = graph.select("u", F.explode(F.arrays_zip("ids", "s")).alias("e")).select("u", F.col("e.ids").alias("v"), F.col("e.s").alias("s"))
    back = Window.partitionBy("v").orderBy(F.desc("s"), "u")
    reverse = edges.withColumn("_rank", F.row_number().over(back)).where(F.col("_rank") <= DEGREE).select(F.col("v").alias("at"), F.col("u").alias("to"))
    ways = edges.select(F.col("u").alias("at"), F.col("v").alias("to")).unionByName(reverse).distinct()
    near = ways.hint("merge").join(codes, F.col("to") == F.col("id")).groupBy("at").agg(F.collect_list(F.struct("to", "code", "scale")).alias("n"))
    return near.select("at", F.col("n.to").alias("tos"), F.col("n.code").alias("codes"), F.col("n.scale").alias("scales"))


def _visit(nodes: DataFrame, front: DataFrame) -> DataFrame:
    """q, id, s of the neighbours of each visited node (q, qvec, worst, at) that are no worse than the worst of the list of q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tos, vec = None, None, None
        for batch in batches:
            at, node = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | node[1:] | node[:-1])) if len(at) else []
            for b, e in zip(begin, [*begin[1:], len(at)]):
                if node[b]:  # a node stands before its visitors
                    now, tos = at[b], batch.column(4)[b].values.to_numpy()
                    vec = _decoded(batch.column(5)[b].values, batch.column(6)[b].values.to_numpy())
                    continue
                if at[b] != now:
                    continue
                part = batch.slice(b, e - b)
                q, worst = part.column(1).to_numpy(), part.column(3).to_numpy()
                s = matrix(part.column(2)) @ vec.T
                i, j = np.nonzero((s >= worst[:, None]) & (tos[None, :] != q[:, None]))
                out.append((q[i], tos[j], s[i, j].astype(np.float64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["q", "id", "s"])

    # lists are empty, not null: Spark goes through the null ones of a batch again for each row that it adds
    none = lambda t: (F.array() if t.startswith("array") else F.lit(None)).cast(t)
    kinds = {"tos": "array<long>", "codes": "array<binary>", "scales": "array<float>"}
    visits = front.select("at", "q", F.col("qvec").cast("array<float>").alias("qvec"), "worst", *(none(t).alias(c) for c, t in kinds.items()))
    both = nodes.select("at", none("long").alias("q"), none("array<float>").alias("qvec"), none("double").alias("worst"), *kinds).unionByName(visits)
    return both.repartition("at").sortWithinPartitions("at", F.col("q").asc_nulls_first()).mapInArrow(run, "q long, id long, s double")


def _listed(entries: DataFrame, length: int) -> DataFrame:
    """q with its best ``length`` of entries (q, id, s, opened): ids, s, opened, and next, those to open now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in _groups(batches):
            q, v, s, opened = (rows.column(k).to_numpy() for k in range(4))
            best = _best_of(q, v, s, ~opened, length)
            whose, begin = np.unique(q[best], return_index=True)
            bounds = np.append(begin, len(best))
            left = ~opened[best]
            turn = np.cumsum(left) - np.repeat((np.cumsum(left) - left)[begin], np.diff(bounds))
            now = left & (turn <= OPENED)
            next_ = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.add.reduceat(now.astype(np.int64), begin))), pa.int32()), pa.array(v[best][now]))
            ends = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(whose), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (v[best], s[best], opened[best] | now)), next_], ["q", "ids", "s", "opened", "next"])

    return entries.repartition("q").sortWithinPartitions("q").mapInArrow(run, "q long, ids array<long>, s array<double>, opened array<boolean>, next array<long>")


def walk(rows: DataFrame, graph: DataFrame, queries: DataFrame, length: int) -> DataFrame:
    """q, id, s: the list of every query class (q, qvec) when it stands still, with scores of rounded vectors; rows are classes."""
    nodes = keep(_neighbourhoods(graph, coded(rows)), "nodes")
    lists = keep(_listed(queries.select("q", F.col("q").alias("id"), F.lit(float("inf")).alias("s"), F.lit(False).alias("opened")), length), "list")  # each class is its own first entry
    while not lists.where("size(next) > 0").isEmpty():
        worst = F.when(F.size("ids") >= length, F.element_at("s", -1)).otherwise(F.lit(float("-inf")))
        front = lists.select("q", worst.alias("worst"), F.explode("next").alias("at")).hint("merge").join(queries, "q")
        held = lists.select("q", F.explode(F.arrays_zip("ids", "s", "opened")).alias("e")).select("q", F.col("e.ids").alias("id"), F.col("e.s").alias("s"), F.col("e.opened").alias("opened"))
        after = keep(_listed(held.unionByName(_visit(nodes, front).withColumn("opened", F.lit(False))), length), "list")
        drop_kept(lists)
        lists = after
    return lists.select("q", F.explode(F.arrays_zip("ids", "s")).alias("e")).select("q", F.col("e.ids").alias("id"), F.col("e.s").alias("s")).where("q <> id")


def search(rows: DataFrame, graph: DataFrame, is_query: Column, nearest: int) -> DataFrame:
    """q, id, s: the ``nearest`` best found for every row of which is_query holds, itself left out."""
    rows = rows if "cls" in rows.columns else classed(rows)
    asked = keep(rows.where(is_query).select(F.col("id").alias("query"), "cls"), "asked")
    classes = _classes(rows)
    queries = keep(asked.select(F.col("cls").alias("id")).distinct().hint("merge").join(classes, "id").select(F.col("id").alias("q"), F.col("vec").alias("qvec")), "queries")
    likely = keep(_best(walk(classes, graph, queries, max(LIST, AGAIN * nearest)), AGAIN * nearest, "q", "id").select("q", "id"), "likely").unionByName(queries.select("q", F.col("q").alias("id")))
    paired = likely.hint("merge").join(queries, "q").hint("merge").join(classes, "id")
    product = F.aggregate(F.zip_with("qvec", "vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, x: t + x)
    found = keep(paired.select("q", "id", product.alias("s")), "found")
    members = keep(_best(rows.select("cls", "id", F.lit(0).alias("s")), nearest + 1, "cls", "id").select("cls", F.col("id").alias("member")), "members")
    opened = found.hint("merge").join(members, F.col("id") == F.col("cls")).select("q", F.col("member").alias("id"), "s")
    opened = keep(_best(opened, nearest + 1, "q", "id"), "opened")
    dealt = asked.hint("merge").join(opened, F.col("cls") == F.col("q")).select(F.col("query").alias("q"), "id", "s").where("q <> id")
    return _best(dealt, nearest, "q", "id")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classed(usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    found = search(rows, build(rows), F.col("id") % 20 == 0, 20)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))
    return found.select(F.col("q").alias("query_id"), rank.alias("rank"), F.col("id").alias("vec_id"), F.col("s").alias("score"))


QUERIES = {"op9_ann": op9_ann}
ORACLE_SQL: dict[str, str] = {}
