"""Toxicity by maximum-scoring segment search.

1. Token log-odds between toxic and clean labelled texts, smoothed by an
   informative Dirichlet prior (the pooled token frequencies), are computed
   with DataFrame aggregations over a bounded sample of labelled rows (at most
   about ``per_class`` of either label, by a hash of the id; exact copies count
   once, and a token once a text). A token scores its log-odds, above or below
   zero, where they exceed ``Z`` standard deviations, else nothing; every token
   pays a drift beside, the least that makes random clean text sink.
2. A linear scan (all maximal scoring segments, Ruzzo and Tompa) finds every
   passage of a whole text. Runs of tokens without evidence fold into one
   negative step, so the scan touches evidence only.
3. A segment score S becomes ``lambda * S - ln(n)``, its surprise under the
   extreme-value law of a random text of n tokens (minus the logarithm of how
   many such segments chance would make); lambda solves
   sum(p * exp(lambda * s)) = 1 over clean tokens. Surprises of the significant
   segments (less than ``CHANCE`` expected) are added, and a logistic fit maps
   the sum to (0, 1). It is fitted on a fifth of the sample that the log-odds
   have not seen.

The sample is written once, so documents are read twice: to draw it and to score.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and ASCII punctuation at
both ends left out.

Defined results. Null or empty text: no segments, the score of no evidence.
Labels other than 0 and 1 or null are not learned; with repeated labels of an
id the larger counts. Nothing to learn: every score is 0. doc_id may be null or
repeat: each row is scored by itself. Further columns are not read. Empty
tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm._tables import keep as keep_table
from matchspark.llm._tables import table
from matchspark.llm._text import _LOWER, blocks, span_hashes, trimmed, words

PER_CLASS = 3000
#: Weight of the prior, as a multiple of the smaller class's tokens.
PRIOR = 1.0
Z = 3.0
#: What one random token adds on average in clean text, at most; the drift sees to it.
SINK = -0.05
#: Segments as high as a significant one that chance makes in a text.
CHANCE = 0.05
SIGNIFICANT = -math.log(CHANCE)
#: One part in so many of the sample is left for the fit.
HELD_BACK = 5
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes of the tokens with evidence
    scores: np.ndarray  # their log-odds less the drift
    drift: float  # cost of any token
    rate: float  # lambda
    slope: float = 0.0
    offset: float = 0.0


def token_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without punctuation at either end, and the bounds of each row in them."""
    starts, ends, _, first = words(buf, offsets, lower=True)
    starts, ends = starts.copy(), ends.copy()
    go = np.arange(len(starts))
    while len(go := go[(starts[go] < ends[go]) & _PUNCT[buf[np.minimum(starts[go], len(buf) - 1)]]]):
        starts[go] += 1
    go = np.arange(len(starts))
    while len(go := go[(starts[go] < ends[go]) & _PUNCT[buf[ends[go] - 1]]]):
        ends[go] -= 1
    return span_hashes(_LOWER[buf], starts, ends).view(np.int64), first


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum at its end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, end, left, right = i, i + 1, before, total
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= left:
                k -= 1
            if k < 0 or found[k][3] >= right:
                found.append((start, end, left, right))
                break
            start, left = found[k][0], found[k][2]
            del found[k:]
    return [(a, b, right - left) for a, b, left, right in found]


def passages(hashes: np.ndarray, model: Model) -> list[tuple[int, int, float]]:
    """Segments (first word, past last word, score) of one text's token hashes."""
    if not len(model.tokens) or not len(hashes):
        return []
    at = np.searchsorted(model.tokens, hashes)
    at[at == len(model.tokens)] = 0
    hits = np.flatnonzero(model.tokens[at] == hashes)
    if not len(hits):
        return []
    steps: list[float] = []
    where: list[int] = []
    last = hits[0] - 1
    for p, s in zip(hits.tolist(), model.scores[at[hits]].tolist()):
        if p > last + 1:
            steps.append(-model.drift * (p - last - 1))
            where.append(last + 1)
        steps.append(s)
        where.append(p)
        last = p
    where.append(last + 1)
    return [(where[a], where[b], s) for a, b, s in segments(steps)]


def evidence(hashes: np.ndarray, model: Model) -> tuple[float, int]:
    """log(1 + sum of the surprises of the significant segments), and their number."""
    most = [x for _, _, s in passages(hashes, model) if (x := model.rate * s - math.log(len(hashes))) > SIGNIFICANT]
    return math.log1p(sum(most)), len(most)


def _tokens(rows: DataFrame) -> DataFrame:
    """toxic, token, n (texts that hold the token) of rows (text, toxic), summed within batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            for at, buf, offsets in blocks(batch.column(0)):
                h, first = token_hashes(buf, offsets)
                once = [np.unique(h[s:e]) for s, e in zip(first.tolist(), first[1:].tolist())]
                for label in (0, 1):
                    own = [x for x, k in zip(once, toxic[at : at + len(once)]) if k == label]
                    token, n = np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), label, np.int32)), pa.array(token), pa.array(n)], ["toxic", "token", "n"])

    return rows.select("text", "toxic").mapInArrow(trimmed(run), "toxic int, token long, n long")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    own = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), 1.0, 1.0)
    if len(sizes) < 2:
        return nothing
    part = F.when(F.col("toxic") == 1, per_class * 1_000_000 // sizes[1] + 1).otherwise(per_class * 1_000_000 // sizes[0] + 1)
    chosen = own.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < part)
    # at most about 2 * per_class ids, so sending them to every task is bounded by that parameter
    # copies would count a token's chance company as often as they were copied
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").where("text is not null").dropDuplicates(["text", "toxic"])
    sample = keep_table(rows, "labelled")
    part = F.pmod(F.xxhash64("text"), F.lit(HELD_BACK))

    by = _tokens(sample.where(part > 0)).groupBy("token").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    by = keep_table(by, "tokens")
    totals = by.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    if not totals["t"] or not totals["c"]:
        return nothing
    nt, nc = float(totals["t"]), float(totals["c"])
    weight = PRIOR * min(nt, nc)
    prior = F.lit(weight / (nt + nc)) * (F.col("t") + F.col("c"))
    odds = F.log((F.col("t") + prior) / (nt + weight - F.col("t") - prior)) - F.log((F.col("c") + prior) / (nc + weight - F.col("c") - prior))
    spread = F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    # tokens of the bounded sample that hold enough evidence; a handful of texts each, so far fewer than its tokens
    strong = by.select("token", "c", odds.alias("s"), (odds / spread).alias("z")).where(F.abs("z") > Z).select("token", "s", "c").collect()
    if not any(r["s"] > 0 for r in strong):
        return nothing
    strong.sort(key=lambda r: r["token"])
    s = np.array([r["s"] for r in strong])
    p = np.array([r["c"] + 0.5 for r in strong]) / nc
    p *= min(1.0, 0.999 / float(p.sum()))
    drift = max(-SINK, float((s * p).sum()) - SINK)
    s, rest = s - drift, 1 - float(p.sum())
    low, high = 1e-6, 50.0
    for _ in range(80):  # the positive root of sum(p * exp(x * s)) = 1
        mid = (low + high) / 2
        total = float((p * np.exp(np.minimum(mid * s, 500))).sum()) + rest * math.exp(-mid * drift)
        low, high = (mid, high) if total < 1 else (low, mid)
    model = Model(np.array([r["token"] for r in strong], np.int64), s, drift, low)
    model.slope, model.offset = _calibrate(sample.where(part == 0), model)
    return model


def _calibrate(rows: DataFrame, model: Model) -> tuple[float, float]:
    """Logistic fit of the labels on the evidence of (bounded) labelled rows, both classes weighing alike."""
    found = _evidence(rows.select("toxic", "text"), model).select("toxic", "evidence").collect()
    x = np.array([r["evidence"] for r in found])
    y = np.array([float(r["toxic"]) for r in found])
    if not len(x) or y.min() == y.max():
        return 0.0, 0.0
    mean, spread = x.mean(), x.std() + 1e-9
    u = (x - mean) / spread
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    a = b = 0.0
    for _ in range(200):  # Newton steps with a little ridge
        q = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        g = np.array([(w * (q - y) * u).sum() + 1e-3 * a, (w * (q - y)).sum()])
        r = w * q * (1 - q)
        hess = np.array([[(r * u * u).sum() + 1e-3, (r * u).sum()], [(r * u).sum(), r.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a / spread), float(b - a * mean / spread)


def _evidence(rows: DataFrame, model: Model) -> DataFrame:
    """rows (the last column is the text) with evidence and n_passages."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = [*rows.columns, "evidence", "n_passages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, buf, offsets in blocks(batch.column(batch.num_columns - 1)):
                h, first = token_hashes(buf, offsets)
                b = first.tolist()
                found = [evidence(h[s:e], sent.value) for s, e in zip(b, b[1:])]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(found)).columns, pa.array([x for x, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int32())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(trimmed(run), f"{schema}, evidence double, n_passages int")


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with score and n_passages (significant passages)."""
    found = _evidence(docs.select(*(F.col(c).alias(f"_{c}") for c in keep if c != "text"), "text"), model)  # the text crosses once
    value = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("evidence") + F.lit(model.offset)))) if model.slope else F.lit(0.0)
    return found.select(*(F.col(c if c == "text" else f"_{c}").alias(c) for c in keep), value.alias("score"), "n_passages")


def find_passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first_word, end_word, segment_score, surprise of every significant passage."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, buf, offsets in blocks(batch.column(1)):
                h, first = token_hashes(buf, offsets)
                out = [(ids[at + i], a, b, s, x) for i in range(len(offsets) - 1) for a, b, s in passages(h[first[i] : first[i + 1]], sent.value) if (x := sent.value.rate * s - math.log(first[i + 1] - first[i])) > SIGNIFICANT]
                names = ["doc_id", "first_word", "end_word", "segment_score", "surprise"]
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, first_word long, end_word long, segment_score double, surprise double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_passages")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
