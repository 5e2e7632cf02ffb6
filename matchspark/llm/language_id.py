"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled rows (at most
``per_lang`` of each language, chosen by a hash of the id) inside Arrow batches
and sums them in Spark; the log-probability matrix (``buckets`` x languages) is
broadcast and whole texts are scored in numpy, by gathering the matrix rows of a
text's n-grams and summing them. Every language is learned: those beyond
``LANGS_A_PASS`` are counted and scored in further passes, each of which keeps a
text's best language so far and the sum of all odds, so that a task holds one
pass's columns of the matrix; the driver holds 64 kB a language.

Defined results. A text that is null or has no letter: ``und``, score 0. Where
nothing can be learned (no labelled rows) every text is ``und``. Ties go to the
language that sorts first. doc_id may be null or repeat: each row is scored by
itself. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm._tables import table
from matchspark.llm._text import trimmed

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
PER_LANG = 3000
#: Languages that one pass counts or scores; bounds the matrix that every task holds.
LANGS_A_PASS = 500
UNKNOWN = "und"
#: Characters that one numpy pass takes, unless a single text is longer.
BLOCK_CHARS = 1 << 19
_LETTER = regex.compile(r"\p{L}")


def folded(text: str) -> str:
    return " " + text.lower().replace("\0", " ") + " "


def gram_buckets(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the buckets of the n-grams of the lower-cased texts, and the bounds of each text in them."""
    return _buckets_of([folded(t) for t in texts], buckets)


def _buckets_of(low: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = np.fromiter(map(len, low), np.int64, len(low))
    ends = np.cumsum(size)
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(points) - n + 1] if n > 1 else h
        h = (h + points[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            rows = np.maximum(size - n + 1, 0)
            within = np.ones(len(h), bool)
            for k in range(1, n):  # n-grams that start in the last n - 1 places of a text would reach into the next
                past = ends - k
                within[past[past < len(h)]] = False
            yield ((h * np.uint64(0xBF58476D1CE4E5B9)) >> shift)[within].astype(np.int64), np.concatenate([np.zeros(1, np.int64), np.cumsum(rows)])


def _in_blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at, held, n = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t)
        n += len(t)
        if n >= BLOCK_CHARS or i + 1 == len(texts):
            yield at, held
            at, held, n = i + 1, [], 0


def train(labelled: DataFrame, buckets: int = BUCKETS, per_lang: int = PER_LANG) -> dict:
    """Languages, log priors and the log-probability matrix, from doc_id, text and non-null lang."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {"langs": [], "prior": np.zeros(0), "matrix": np.zeros((buckets, 0), np.float32)}
    langs = sorted(sizes)
    counts = np.zeros((buckets, len(langs)), np.float32)
    for at in range(0, len(langs), LANGS_A_PASS):
        own = langs[at : at + LANGS_A_PASS]
        for r in _counted(rows, {x: sizes[x] for x in own}, buckets, per_lang).collect():
            counts[r["bucket"], at + r["lang"]] = r["n"]
    smooth = counts + np.float32(0.5)
    n = np.array([sizes[x] for x in langs], float)
    return {"langs": langs, "prior": np.log(n / n.sum()), "matrix": np.log(smooth / smooth.sum(axis=0, dtype=np.float64)).astype(np.float32)}


def _counted(rows: DataFrame, sizes: dict[str, int], buckets: int, per_lang: int) -> DataFrame:
    """lang (its place), bucket, n: n-grams of the sample of some languages."""
    place = {lang: k for k, lang in enumerate(sizes)}
    parts = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1_000_000, per_lang * 1_000_000 // n + 1))))
    chosen = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000)) < F.coalesce(F.try_element_at(parts, F.col("lang")), F.lit(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), buckets), np.int64)
        for batch in batches:
            own = np.array([place[x] for x in batch.column(1).to_pylist()])
            for at, texts in _in_blocks(batch.column(0).to_pylist()):
                for found, bounds in gram_buckets(texts, buckets):
                    who = np.repeat(own[at : at + len(texts)], np.diff(bounds))
                    total += np.bincount(who * buckets + found, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    return rows.where(chosen).select("text", "lang").mapInArrow(trimmed(count), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _sums(low: list[str], columns: list[np.ndarray], buckets: int) -> np.ndarray:
    """Log-probabilities of the n-grams of each folded text, by language."""
    total = np.zeros((len(low), len(columns)))
    for found, bounds in _buckets_of(low, buckets):
        for k, column in enumerate(columns):
            sums = np.concatenate([np.zeros(1), np.cumsum(column[found], dtype=np.float64)])
            total[:, k] += sums[bounds[1:]] - sums[bounds[:-1]]
    return total


def _long_sums(text: str, columns: list[np.ndarray], buckets: int) -> np.ndarray:
    """The same of one long text, slice by slice: slices overlap by what the longest n-gram needs, and the overlaps' own n-grams are taken off."""
    low, more = folded(text), max(ORDERS) - 1
    total = np.zeros((1, len(columns)))
    for at in range(0, len(low), BLOCK_CHARS):
        total += _sums([low[at : at + BLOCK_CHARS + more]], columns, buckets)
        if at + BLOCK_CHARS < len(low):
            total -= _sums([low[at + BLOCK_CHARS : at + BLOCK_CHARS + more]], columns, buckets)
    return total


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score, the posterior probability of lang_pred."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.lit("").alias("best"), F.lit(float("-inf")).alias("log"), F.lit(0.0).alias("odds"), "text")
    for at in range(0, max(1, len(model["langs"])), LANGS_A_PASS):
        some = slice(at, at + LANGS_A_PASS)
        rows = _pass(rows, model["langs"][some], model["prior"][some], model["matrix"][:, some], at + LANGS_A_PASS >= len(model["langs"]))
    sure = F.col("best") != ""
    return rows.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("lang_pred"), F.when(sure, 1 / F.col("odds")).otherwise(0.0).alias("score"))


def _pass(rows: DataFrame, langs: list[str], prior: np.ndarray, matrix: np.ndarray, last: bool) -> DataFrame:
    """rows (…, best, log, odds, text) after some more languages: the best one (of equals the first), its log-probability, the sum of all odds against it. The last pass drops the text."""
    sent = rows.sparkSession.sparkContext.broadcast((langs, prior, matrix))
    buckets, own_columns = len(matrix), rows.columns[:-4]
    names = [*own_columns, "best", "log", "odds", *([] if last else ["text"])]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, matrix = sent.value
        columns = [np.ascontiguousarray(matrix[:, k]) for k in range(len(langs))]
        for batch in batches:
            size = pc.fill_null(pc.utf8_length(batch.column(batch.num_columns - 1)), 0).to_numpy().cumsum()
            at = 0
            while at < batch.num_rows:  # slices of about BLOCK_CHARS, so that what is held in Python stays small
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_CHARS, side="right")))
                part = batch.slice(at, to - at)
                at = to
                own = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                best, log, odds = part.column(len(own_columns)).to_pylist(), part.column(len(own_columns) + 1).to_numpy(), part.column(len(own_columns) + 2).to_numpy()
                if langs:
                    total = prior + (_sums([folded(t) for t in own], columns, buckets) if len(own) > 1 or len(own[0]) <= BLOCK_CHARS else _long_sums(own[0], columns, buckets))
                    here = total.max(axis=1)
                    top = np.maximum(log, here)
                    odds = odds * np.exp(log - top) + np.exp(total - top[:, None]).sum(axis=1)
                    best = [b if old >= new or _LETTER.search(t) is None else langs[k] for b, old, new, k, t in zip(best, log.tolist(), here.tolist(), total.argmax(axis=1).tolist(), own)]
                    log = top
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(own_columns))), pa.array(best, pa.string()), pa.array(log), pa.array(odds), *([] if last else [part.column(part.num_columns - 1)])], names)

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(trimmed(score), schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE_SQL: dict[str, str] = {}
