"""Stretches of words that repeat with a short period, found along diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) of at least ``max(least_words, times * q)`` words that no
neighbouring word extends with that period. Words q apart agree on a diagonal
of a text against itself, so a run is a stretch of the diagonal with lag q, of
``times * q - q`` places or more.

Seeds. Lags fall into classes of which each has one seed length k: no longer
than the shortest stretch that a run with such a lag guarantees, and at least
``2q - 1`` for its largest lag. Then (Fine and Wilf) the k-gram at any place of
a run comes again first at exactly q words further, so that the pairs of
consecutive occurrences hold every run and number no more than the words: a
word said a million times does not give a million squared pairs. Pairs come
from one sort of the rolling hashes of a class's k-grams; only places whose
k-gram of the class before came again are hashed for the next one.

Extension. Seeds of a text are taken by lag and place. A table of the furthest
place covered on each lag suppresses those that an earlier extension of the lag
has passed; any other is compared word by word along its diagonal, both ways.

Each text is searched by itself in its Arrow batch, in memory linear in its
words; the corpus is not shuffled.

Defined results. A null text counts as empty: no words, no runs, nothing kept.
Texts of fewer words than ``least_words`` have no runs. ``doc_id`` may be null
or repeat; each row is searched by itself. Runs of different periods may overlap
and are all reported; nothing bounds the length of a text or the number of its
runs. Words are compared by 62-bit hashes. Further columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm._tables import table
from matchspark.llm._text import blocks, sequence_hashes, words

LEAST_WORDS, TIMES = 6, 4
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lag_classes(n: int, least_words: int = LEAST_WORDS, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """(k, low, high): seed length and the lags it serves, for texts of n words; each class reaches half as far again as the one before."""
    overlap = lambda q: max(least_words, times * q) - q
    turn = least_words // times  # up to this lag the number of words decides, beyond it the number of times
    low = 1
    while max(least_words, times * low) <= n:
        high = max(low, (overlap(low) + 1) // 2) if low > turn else low
        while low <= turn and 2 * (high + 1) - 1 <= min(map(overlap, range(low, high + 2))):
            high += 1
        yield min(map(overlap, {low, high, min(high, max(low, turn)), min(high, max(low, turn + 1))})), low, high
        low = high + 1


def _extend(ids: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The bounds of the stretch of the diagonal around place ``at`` where words a lag apart agree, within [low, high)."""
    left, right, step = at, at, 64
    while right < high - lag:
        to = min(high - lag, right + step)
        differ = ids[right:to] != ids[right + lag : to + lag]
        if differ.any():
            right += int(differ.argmax())
            break
        right, step = to, 2 * step
    step = 64
    while left > low:
        to = max(low, left - step)
        differ = (ids[to:left] != ids[to + lag : left + lag])[::-1]
        if differ.any():
            left -= int(differ.argmax())
            break
        left, step = to, 2 * step
    return left, right


def runs_of(ids: np.ndarray, bounds: np.ndarray, least_words: int = LEAST_WORDS, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs in rows ids[bounds[r]:bounds[r+1]], by row, start and period."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    end = bounds[row + 1]
    found: list[tuple[int, int, int, int]] = []
    alive = np.arange(len(ids))  # places whose seed of the last class came again, or was that of an earlier place
    for k, low, high in lag_classes(int(n.max(initial=0)), least_words, times):
        alive = alive[(alive + k <= end[alive]) & (n[row[alive]] >= max(least_words, times * low))]
        if not len(alive):
            break
        # sorts are stable: equal seeds of a row follow each other by place
        key = sequence_hashes(ids, alive, alive + k) + row[alive].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key, kind="stable")
        key, place = key[order], alive[order]
        again = key[1:] == key[:-1]
        lag = place[1:] - place[:-1]
        seed = np.flatnonzero(again & (lag >= low) & (lag <= high) & (row[place[1:]] == row[place[:-1]]))
        seeds = place[seed][np.lexsort((place[seed], lag[seed]))]
        lags = np.sort(lag[seed])
        # what the seed before it covers needs no look at the table
        head = np.ones(len(seeds), bool)
        head[1:] = (lags[1:] != lags[:-1]) | (seeds[1:] > seeds[:-1] + k)
        covered: dict[int, int] = {}
        for at, q in zip(seeds[head].tolist(), lags[head].tolist()):
            if at < covered.get(q, 0):
                continue
            r = int(row[at])
            left, right = _extend(ids, at, q, int(bounds[r]), int(bounds[r + 1]))
            covered[q] = right + 1
            if right - left + q >= max(least_words, times * q):
                found.append((r, left - int(bounds[r]), right - left + q, q))
        more = np.zeros(len(place), bool)
        more[1:] |= again
        more[:-1] |= again
        alive = np.sort(place[more])
    out = np.array(sorted(found, key=lambda x: (x[0], x[1], x[3])), np.int64).reshape(-1, 4)
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the words outside repeats, a space between)."""
    if times < 4 or least_words < 2:
        raise ValueError("seeds are made for runs of four periods or more, over two words at least")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, buf, offsets in blocks(batch.column(1)):
                _, _, ids, first = words(buf, offsets)
                row, start, length, period = runs_of(ids, first, least_words, times)
                by = np.searchsorted(row, np.arange(len(offsets)))
                collapsed = []
                for r in range(len(offsets) - 1):
                    own = buf[offsets[r] : offsets[r + 1]].tobytes().split()
                    s, e = by[r], by[r + 1]
                    collapsed.append(b" ".join(compress(own, kept_words(len(own), start[s:e], length[s:e], period[s:e]).tolist()) if s < e else own).decode())
                structs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(by, pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(offsets) - 1), pa.array(np.diff(first), pa.int64()), lists, pa.array(collapsed, pa.string())], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUN}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: of each tenth document (by crc32 of its id) the words from a place on repeat a stretch."""
    h = F.crc32(F.col("doc_id").cast("string"))
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, w).alias("w")).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    whole = lambda c: c.cast("int")
    stretch = F.slice("w", whole(F.col("a")) + 1, whole(F.least(F.col("p"), F.col("n") - F.col("a"))))
    tail = F.slice(F.flatten(F.array_repeat(stretch, whole(F.ceil((F.col("n") - F.col("a")) / F.col("p"))))), F.lit(1), whole(F.col("n") - F.col("a")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), whole(F.col("a"))), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest (ties: smallest start, then period), digests of all runs and of the words that stay."""
    r: Column = F.col("runs")
    best = F.array_max(F.transform(r, lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.array_join(F.transform(r, lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", F.size(r).cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("b.period")
    return out.select(
        "doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), period.alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
