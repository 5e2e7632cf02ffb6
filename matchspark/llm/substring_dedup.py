"""Removal of long repeated word sequences by De Bruijn compaction.

Every run of ``k`` words is an edge of the De Bruijn graph of words. Edges are
grouped to paths on the fly: consecutive edges of a text that share the place
of their smallest ``m``-word hash (the minimiser) form one path, so that no edge
stands twice in a path, and equal stretches of two texts fall into equal paths
except at their ends. A path is one row
``(h, c, doc_id, start, n)``: minimiser, hash of all its words, source
coordinates, number of edges. Paths are dealt by minimiser, so all occurrences
of an edge meet in one group:

* a group with one content is nonbranching: it stays compact, its first source
  coordinate (doc_id, start) keeps the words and every other occurrence, whole
  path by whole path, is a repeat;
* in a branching group equal contents are settled in the same way, and only the
  first occurrence of each content is opened into its edges, which are dealt by
  their own hash and settled edge by edge against the earliest coordinate.

Repeats whose source coordinates go on side by side in both documents join to
long spans, so that a repeated passage is one row. Then the source coordinates
verify it: the words at either end are read again, and only where their 128-bit
digests agree are the document's words removed. (An opened edge is settled by a
digest of its words from the start.) All decisions are about the input texts,
not about what is left.

Minimiser paths stand for a graph of single k-mers, which would take a shuffled
row a word; joins compact what lies side by side, and open what branches.

Skew. Copies meet first inside each Arrow batch, where all but the earliest
become spans at once, so a path comes to its group once a batch at most.
Minimisers that many different paths share do not act as keys: their edges are
dealt one by one. They are found by frequency sketches over whole partitions,
which miss none that holds ``SHARE`` of all paths and a fifth more.

Defined results. Null or empty text, or fewer than k words: nothing is removed.
Rows that share a doc_id count as one document given twice: they do not remove
each other's words. A null doc_id has no order: such rows keep all words and
remove none. Ties cannot occur beyond that. Further columns pass through
``remove_repeats`` unless they clash with its own new names. Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.llm._tables import drop_kept, keep, table
from matchspark.llm._text import blocks, sequence_hashes, trimmed, words

K, M = 20, 6
#: A minimiser's share of all paths from which it is crowded, and rows at least; rows of a partition from which it is reported; minimisers that a partition's sketch holds.
SHARE, LEAST, SEEN, HELD = 1 / 20_000, 2000, 2, 400_000
_NAMES = ["h", "c", "doc_id", "start", "n", "from_doc", "from_start", "digest"]
_SCHEMA = "h long, c long, doc_id long, start int, n int, from_doc long, from_start int, digest binary"
_SPAN = ["doc_id", "start", "n", "from_doc", "from_start"]


def _minima(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each ``width`` consecutive values and its place, the first of equals."""
    low, place = x, np.arange(len(x))

    def folded(by: int) -> tuple[np.ndarray, np.ndarray]:
        less = low[by:] < low[: len(low) - by]
        return np.where(less, low[by:], low[: len(low) - by]), np.where(less, place[by:], place[: len(low) - by])

    size = 1
    while size * 2 <= width:
        low, place = folded(size)
        size *= 2
    if width > size:
        low, place = folded(width - size)
    return low, place


def paths_of(buf: np.ndarray, offsets: np.ndarray, crowded: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, ...]:
    """h, c, row, start (word of the row), n of every path of a block of texts."""
    _, _, h, first = words(buf, offsets)
    if len(h) < k:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    at = np.arange(len(h) - k + 1)
    low, place = _minima(sequence_hashes(h, np.arange(len(h) - m + 1), np.arange(m, len(h) + 1)), k - m + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(at)]
    at = at[at + k <= first[1:][row]]
    low, row, place = low[at], row[at], place[at]
    if len(crowded):
        spot = np.searchsorted(crowded, low)
        spot[spot == len(crowded)] = 0
        own = np.flatnonzero(crowded[spot] == low)
        low[own], place[own] = sequence_hashes(h, at[own], at[own] + k), -at[own]
    if not len(at):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    start = at[begin]
    return low[begin], sequence_hashes(h, start, start + n + k - 1), row[begin], start - first[row[begin]], n


def _combined(h, c, doc, start, n) -> Iterator[pa.RecordBatch]:
    """The earliest occurrence of each (h, c) of a batch, and the others as spans with where they come from, neighbours joined."""
    order = np.lexsort((start, doc, c, h))
    h, c, doc, start, n = h[order], c[order], doc[order], start[order], n[order]
    if not len(h):
        return
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    later = same & ((doc != doc[lead]) | (start != start[lead]))  # the same place given twice stays unsettled
    open_ = ~same
    yield _batch(h[open_], c[open_], doc[open_], start[open_], n[open_])
    doc, start, n, from_doc, from_start = doc[later], start[later], n[later], doc[lead][later], start[lead][later]
    if len(doc):
        order = np.lexsort((start, from_start - start, from_doc, doc))
        doc, start, n, from_doc, from_start = doc[order], start[order], n[order], from_doc[order], from_start[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != (start + n)[:-1]) | (from_doc[1:] != from_doc[:-1]) | (from_start[1:] != (from_start + n)[:-1])
        begin = np.flatnonzero(new)
        total = np.add.reduceat(n, begin)
        doc, start, from_doc, from_start = doc[begin], start[begin], from_doc[begin], from_start[begin]
        spread = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (start.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        yield _batch(spread, spread, doc, start, total, from_doc, from_start)


def _batch(h, c, doc, start, n, from_doc=None, from_start=None, digest=None) -> pa.RecordBatch:
    """Rows of paths (from_doc null), settled spans, or passages with their digest."""
    whole = lambda x, t: pa.nulls(len(doc), t) if x is None else pa.array(x, t)
    keys = [whole(None if x is None else x.view(np.int64), pa.int64()) for x in (h, c)]
    return pa.RecordBatch.from_arrays([*keys, pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), whole(from_doc, pa.int64()), whole(None if from_start is None else from_start.astype(np.int32), pa.int32()), whole(digest, pa.binary())], _NAMES)


def digest_of(words_: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words_), digest_size=16).digest()


def _paths_of_batch(batch: pa.RecordBatch, crowded: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    ids = batch.column(0).to_numpy()
    parts = []
    for at, buf, offsets in blocks(batch.column(1)):
        h, c, row, start, n = paths_of(buf, offsets, crowded, k, m)
        parts.append((h, c, ids[at + row], start, n))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3


def crowded_minimisers(docs: DataFrame, k: int = K, m: int = M) -> np.ndarray:
    """Minimisers that hold more than SHARE of all paths (and LEAST of them) after the copies of each batch are joined: about 1 / SHARE at most.

    Each partition sums its counts; when more than HELD keys are held, all lose
    what the next one has (the counters of Misra and Gries, which may be added).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            h, c, *_ = _paths_of_batch(batch, np.zeros(0, np.uint64), k, m)
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            one = np.ones(len(h), bool)
            one[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            total += int(one.sum())
            more, times = np.unique(h[one], return_counts=True)
            both, where = np.unique(np.concatenate([key, more]), return_inverse=True)
            key, n = both, np.bincount(where, weights=np.concatenate([n, times]), minlength=len(both)).astype(np.int64)
            if len(key) > HELD:
                n -= np.partition(n, -HELD - 1)[-HELD - 1]
                key, n = key[n > 0], n[n > 0]
        many = n >= max(SEEN, total * SHARE / 10)
        yield pa.RecordBatch.from_arrays([pa.array([*key[many].view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(n[many], total))], ["h", "n"])

    # the sums stay in Spark; only minimisers beyond the limit, about 1 / SHARE at most, come to the driver
    counts = keep(docs.select("doc_id", "text").mapInArrow(trimmed(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "minimisers")
    total = counts.where("h is null").agg(F.sum("n").alias("n")).first()["n"] or 0
    found = counts.where(F.col("h").isNotNull() & (F.col("n") > max(LEAST, int(total * SHARE)))).select("h").collect()
    drop_kept(counts)
    return np.sort(np.array([r["h"] for r in found], np.int64).view(np.uint64))


def _long_spans(spans: DataFrame) -> DataFrame:
    """Spans that go on side by side, in their document and in the one they come from, as one."""
    along = Window.partitionBy("doc_id", "from_doc", F.col("start") - F.col("from_start")).orderBy("start")
    new = F.coalesce(F.lag(F.col("start") + F.col("n")).over(along) < F.col("start"), F.lit(True))
    numbered = spans.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("doc_id", "from_doc", (F.col("start") - F.col("from_start")).alias("_shift"), "_run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("_end"))
    return runs.select("doc_id", "start", (F.col("_end") - F.col("start")).alias("n"), "from_doc", (F.col("start") - F.col("_shift")).alias("from_start"))


def repeated_spans(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """doc_id, start, n, digest: every edge start … start + n - 1 of the document also starts earlier, if the words there have this digest (null: if)."""
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError("doc_id must be an integer: its order tells which occurrence is the first")
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = spark.sparkContext.broadcast(crowded_minimisers(rows, k, m))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _combined(*_paths_of_batch(batch, sent.value, k, m))

    by_minimiser = Window.partitionBy("h")
    dealt = _with_source(rows.mapInArrow(trimmed(paths), _SCHEMA).repartition("h"))
    found = keep(dealt.withColumn("branching", F.min("c").over(by_minimiser) != F.max("c").over(by_minimiser)).where("from_doc is not null or branching").select("h", *_SPAN), "paths")
    spans = keep(_long_spans(found.where("from_doc is not null").select(*_SPAN)), "spans")
    opened = keep(_opened(rows, found.where("from_doc is null"), spans, k), "opened")
    edges = _with_source(opened.where("digest is null").repartition("h")).where("from_doc is not null")
    passages = opened.where("digest is not null").select(F.col("doc_id").alias("from_doc"), F.col("start").alias("from_start"), "n", "digest")
    verified = spans.hint("merge").join(passages, ["from_doc", "from_start", "n"])
    return verified.select("doc_id", "start", "n", "digest").unionByName(edges.select("doc_id", "start", "n", F.lit(None).cast("binary").alias("digest")))


def _with_source(dealt: DataFrame) -> DataFrame:
    """Paths with where the first of equal content stands, if that is elsewhere; settled spans as they are."""
    lead = F.first(F.struct("doc_id", "start")).over(Window.partitionBy("h", "c").orderBy("doc_id", "start"))
    later = F.col("from_doc").isNull() & (F.struct("doc_id", "start") != F.col("_lead"))
    led = dealt.withColumn("_lead", lead).withColumn("_later", later)
    return led.withColumns({"from_doc": F.when(F.col("_later"), F.col("_lead.doc_id")).otherwise(F.col("from_doc")), "from_start": F.when(F.col("_later"), F.col("_lead.start")).otherwise(F.col("from_start"))}).drop("_lead", "_later")


def _opened(rows: DataFrame, branching: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """From one reading of the texts: the edges of branching paths, and the digests of the passages that spans come from."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, digests = [], []
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2)):
                raw = text.as_py().split()
                start, n, edge = (wanted.values.field(i).to_numpy(zero_copy_only=False).tolist() for i in range(3))
                for s, many, is_edge in zip(start, n, edge):
                    if s + many + k - 1 > len(raw):
                        continue  # rows that share a doc_id may be shorter
                    if is_edge:
                        edges += [(doc, at, digest_of(raw[at : at + k])) for at in range(s, s + many)]
                    else:
                        digests.append((doc, s, many, digest_of(raw[s : s + many + k - 1])))
            if edges:
                doc, start, digest = zip(*edges)
                both = np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 2)
                yield from _combined(both[:, 0].copy(), both[:, 1].copy(), np.array(doc), np.array(start), np.ones(len(doc), np.int64))
            if digests:
                doc, start, n, digest = zip(*digests)
                yield _batch(None, None, np.array(doc), np.array(start), np.array(n), digest=list(digest))

    wanted = branching.select("doc_id", "start", "n", F.lit(True).alias("edge")).unionByName(spans.select(F.col("from_doc").alias("doc_id"), F.col("from_start").alias("start"), "n", F.lit(False).alias("edge")).distinct())
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "edge")).alias("wanted"))
    return rows.hint("merge").join(lists, "doc_id").select("doc_id", "text", "wanted").mapInArrow(trimmed(read), _SCHEMA)


def remove_repeats(docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """docs with n_words, n_removed and kept (the words left, joined by one space)."""
    spans = repeated_spans(docs, k, m).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "digest")).alias("_spans")).withColumnRenamed("doc_id", "_doc")
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept", "_doc", "_spans")]
    joined = docs.select(*own).hint("merge").join(spans, F.col("doc_id").cast("long") == F.col("_doc"), "left")
    text_at = own.index("text")

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(text_at).cast(pa.binary())
            lists = batch.column(batch.num_columns - 1)
            total, gone, kept = [], [], []
            for text, spans in zip(raw, lists):
                own_words = (text.as_py() or b"").split()
                total.append(len(own_words))
                if spans.is_valid and own_words:
                    start, n = (spans.values.field(i).to_numpy() for i in (0, 1))
                    end = start + n + k - 1
                    right = [d is None or digest_of(own_words[a:b]) == d for a, b, d in zip(start.tolist(), end.tolist(), spans.values.field(2).to_pylist())]
                    cover = np.zeros(len(own_words) + 1, np.int64)
                    np.add.at(cover, np.minimum(start[right], len(own_words)), 1)
                    np.add.at(cover, np.minimum(end[right], len(own_words)), -1)
                    stay = np.cumsum(cover[:-1]) == 0
                    gone.append(int(len(stay) - stay.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], stay, [False]]).astype(np.int8)))
                    own_words = [w for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) for w in own_words[a:b]]
                else:
                    gone.append(0)
                kept.append(b" ".join(own_words).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*own, "n_words", "n_removed", "kept"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own) + ", n_words long, n_removed long, kept string"
    return joined.select(*own, "_spans").mapInArrow(trimmed(strike), schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
