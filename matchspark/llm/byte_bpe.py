"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts are cut at safe boundaries before they reach tiktoken (see ``_encode``),
so that a text of any length costs no more per byte than a short one. A run of
white space is one match of the pattern by itself; it is encoded with a pattern
that takes the whole run, as the other one's look-ahead costs a stack that grows
with the run.

Null text counts as empty: no ids, the digest of nothing. ``doc_id`` may be
null or repeat; each row is encoded by itself and keeps its place. Further
columns of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm._encode import PieceEncoder, is_white
from matchspark.llm._tables import table

#: A pattern that matches a text as one.
WHOLE = r"(?s:.+)"


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=_ranks(rank_file), special_tokens={})


@lru_cache(maxsize=2)
def _encoder(rank_file: str, pattern: str) -> PieceEncoder:
    own, whole = encoding(rank_file, pattern), encoding(rank_file, WHOLE)
    return PieceEncoder(lambda piece: (whole if is_white(piece) else own).encode_ordinary(piece))


@lru_cache(maxsize=2)
def _token_bytes(rank_file: str) -> list[bytes]:
    ranks = _ranks(rank_file)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``ids``, the array of token ids of each whole text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, bounds in _encoder(rank_file, pattern).rows(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(bounds) - 1), lists], ["id", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, rank_file: str, ids_col: str = "ids", out_col: str = "raw") -> DataFrame:
    """df with the raw bytes of an array of ids; ids outside the vocabulary are an error, a null array stays null."""

    @F.pandas_udf("binary")
    def raw(ids):
        token = _token_bytes(rank_file)
        return ids.map(lambda x: None if x is None else b"".join([token[i] for i in x]))

    return df.withColumn(out_col, raw(ids_col))


def round_trip(df: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _token_bytes(rank_file)
        digits = [str(i) for i in range(len(token))]
        for batch in batches:
            for at, ids, bounds in _encoder(rank_file, pattern).rows(batch.column(1)):
                shas, raws, b = [], [], bounds.tolist()
                for s, e in zip(b, b[1:]):
                    own = ids[s:e].tolist()
                    shas.append(hashlib.sha256(",".join(map(digits.__getitem__, own)).encode()).hexdigest())
                    raws.append(hashlib.sha256(b"".join(map(token.__getitem__, own))).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(b) - 1), pa.array(np.diff(bounds), pa.int64()), pa.array(shas, pa.string()), pa.array(raws, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
