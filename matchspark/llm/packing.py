"""Packing along a space-filling curve.

Each document becomes a hashed bag of its tokens, projected to ``DIMS`` dimensions
with fixed Gaussian directions; the coordinates are put to normal quantiles of
the corpus and interleaved to a Hilbert key. Documents are range-sorted by that
key, their token counts summed along the curve, and the curve cut every
``sequence`` tokens: neighbours share sequences, and only the last sequence of
all has padding.

Steps: (1) ids, counts and coordinates are made once and written as a table;
(2) the narrow columns alone are range-sorted and summed, first within
partitions and then over the totals of the partitions (one row each); (3) ids
join their places and are cut into pieces.

Ids are those of the tokenizer with its defaults, so a special token's string
inside a text is that token.

Defined results. Null or empty text: just the end id. A text of any length is
cut where the sequences end. Equal keys go by doc_id (null first), then by row.
Repeated rows are packed as often as they stand there. Further columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm._encode import LATIN, MARKS, PieceEncoder
from matchspark.llm._tables import keep, table
from matchspark.llm._text import mix, trimmed

DIMS, BITS = 4, 8
HASHED = 256
SEQUENCE = 1024
END_ID = 0
#: A word of Latin letters, and marks after it.
_WORD = re.compile(f"( ?[{LATIN}]+)([{MARKS}]*)")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _special(path: str) -> tuple[str, ...]:
    """Strings that the tokenizer takes out of a text before its pattern sees it."""
    return tuple(x.content for x in _tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def _byte_letters(path: str) -> dict[int, str]:
    """The letter that the tokenizer's model has for each byte of a word."""
    split = _tokenizer(path).pre_tokenizer.pre_tokenize_str
    found = {}
    for c in map(chr, range(0x21, 0x250)):
        found |= dict(zip(c.encode(), "".join(x for x, _ in split(c))))
    found[0x20] = split(" a")[0][0][0]
    return found


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer, letters = _tokenizer(path), _byte_letters(path)
    model = tokenizer.model

    def encode(piece: str) -> list[int]:
        word = _WORD.fullmatch(piece)
        if word is None:
            return tokenizer.encode(piece, add_special_tokens=False).ids
        # one match of the pattern, or two: straight to the model
        return [t.id for part in word.groups() if part for t in model.tokenize(part.encode().decode("latin-1").translate(letters))]

    begins = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    begins[[i for token, i in tokenizer.get_vocab().items() if token.startswith(letters[0x20])]] = True
    joined = lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
    with open(path, encoding="utf-8") as file:
        told = json.load(file)["model"]
    # words as the model has them, one at a time; each is new to it, so that its cache would not be hit
    told |= {"merges": [tuple(x.split(" ") if isinstance(x, str) else x) for x in told["merges"]], "cache_capacity": 0}
    bare = Tokenizer(models.BPE(**{k: v for k, v in told.items() if k != "type" and v is not None}))
    bare.pre_tokenizer = pre_tokenizers.Split(letters[0x20], "merged_with_next")
    words = lambda text: bare.encode_batch_fast([text.encode().decode("latin-1").translate(letters)], add_special_tokens=False)[0].ids
    return PieceEncoder(encode, _special(path), lambda text: tokenizer.encode(text, add_special_tokens=False).ids, encode_joined=joined, encode_words=words, spaced=begins)


@lru_cache(maxsize=2)
def _directions(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place and sign of each token in the bag, and the directions of its places."""
    rng = np.random.default_rng(7)
    rows = rng.standard_normal((HASHED, DIMS))
    h = mix(np.arange(vocabulary, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    place, sign = (h >> np.uint64(56)).astype(np.int64) % HASHED, 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    return place, sign, rows


def coordinates(ids: np.ndarray, bounds: np.ndarray, vocabulary: int) -> np.ndarray:
    """The hashed token counts of each text, at unit length, along the fixed directions."""
    place, sign, rows = _directions(vocabulary)
    n = len(bounds) - 1
    who = np.repeat(np.arange(n) * HASHED, np.diff(bounds))
    bag = np.bincount(who + place[ids], weights=sign[ids], minlength=n * HASHED).reshape(n, HASHED)
    size = np.sqrt((bag * bag).sum(axis=1, keepdims=True))
    return (bag / np.where(size == 0, 1, size)) @ rows


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dims) of ``bits`` bits each (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, row (a number of its own for each row), n, ids (little-endian, 2 or 4 bytes each, with the end id), and the coordinates c0 …"""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "row", "n", "ids", *(f"c{i}" for i in range(DIMS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = max(_tokenizer(tokenizer_file).get_vocab().values()) + 1
        width = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, ids, bounds in _encoder(tokenizer_file).rows(batch.column(1)):
                n = len(bounds) - 1
                full = np.insert(ids.astype(width), bounds[1:], END_ID)
                ends = bounds + np.arange(n + 1)
                raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((ends * width.itemsize).astype(np.int64)), pa.py_buffer(full)]).cast(pa.binary())
                where = coordinates(ids, bounds, vocabulary)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(np.arange(row, row + n)), pa.array(np.diff(ends)), raw, *(pa.array(where[:, i]) for i in range(DIMS))], names)
                row += n

    schema = f"doc_id {kind}, row long, n long, ids binary, " + ", ".join(f"c{i} double" for i in range(DIMS))
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


def with_key(made: DataFrame) -> DataFrame:
    """doc_id, row, n and the Hilbert key of the coordinates at their normal quantiles in this corpus."""
    stats = made.agg(*(f(f"c{i}").alias(f"{a}{i}") for i in range(DIMS) for a, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(DIMS)])
    spread = np.array([stats[f"s{i}"] or 1.0 for i in range(DIMS)])
    kind = made.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = (np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(DIMS)], axis=1) - mean) / spread
            share = 1 / (1 + np.exp(-1.702 * np.clip(z, -8, 8)))  # close to the normal distribution function
            key = hilbert_key(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(key)], ["doc_id", "row", "n", "key"])

    return made.select("doc_id", "row", "n", *(f"c{i}" for i in range(DIMS))).mapInArrow(trimmed(run), f"doc_id {kind}, row long, n long, key long")


def placed(keyed: DataFrame) -> DataFrame:
    """row and first, the tokens before it along the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - n), batch.column(1), pa.array(np.full(len(n), part))], ["row", "within", "n", "part"])
            total = int(ends[-1]) if len(n) else total

    order = ["key", F.col("doc_id").asc_nulls_first(), "row"]
    along = keep(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n").mapInArrow(trimmed(run), "row long, within long, n long, part long"), "curve")
    totals = sorted((r["part"], r["n"]) for r in along.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row for each partition
    base, bases = 0, []
    for part, n in totals:
        bases.append((part, base))
        base += n
    return along.join(F.broadcast(along.sparkSession.createDataFrame(bases, "part long, base long")), "part").select("row", (F.col("base") + F.col("within")).alias("first"))


def pack(docs: DataFrame, tokenizer_file: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    made = keep(tokenized(docs, tokenizer_file), "tokens")
    kind = made.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            who: list[int] = []
            for i, (n, raw, first) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist())):
                view = raw.as_buffer()
                wide = np.frombuffer(view, f"<u{len(view) // n}").astype("<u4")
                at = 0
                while at < n:
                    length = min(n - at, sequence - (first + at) % sequence)
                    out.append((at, length, zlib.crc32(wide[at : at + length]), n, (first + at) // sequence, (first + at) % sequence))
                    who.append(i)
                    at += length
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int32())), *(pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 6))], names)

    joined = made.select("doc_id", "row", "n", "ids").join(placed(with_key(made)).hint("merge"), "row")
    return joined.select("doc_id", "n", "ids", "first").mapInArrow(trimmed(cut), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:]))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_packing": op10_packing}
ORACLE_SQL: dict[str, str] = {}
