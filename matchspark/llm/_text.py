"""Vectorised helpers that run inside Arrow batches: blocks of rows, word spans, hashes."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds, unless a single text is longer.
BLOCK_BYTES = 1 << 20
#: Bytes that one pass of the span hash takes, and the length from which a span is hashed by itself.
PASS_BYTES = 1 << 20

#: A Mersenne prime, and two fixed bases of the rolling hashes modulo it. Powers of two as moduli would let
#: texts that repeat themselves in opposition (Thue and Morse's) collide whatever the base.
PRIME = np.uint64((1 << 31) - 1)
BASES = (1_337_006_139, 774_615_667)

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which gives back what it freed at the end of its task: workers live on, and would hold the most that any task took."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


def _computed(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    size = 1
    while size < n:
        out[size : 2 * size] = _mod(out[: min(size, n - size)] * np.uint64(pow(base, size, int(PRIME))))
        size *= 2
    return out


@lru_cache(maxsize=4)
def _powers_of(base: int) -> np.ndarray:
    return _computed(base, PASS_BYTES + 1)


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 … base**(n-1) modulo PRIME, or those of its inverse. Only those of one pass are kept."""
    if inverse:
        base = pow(base, -1, int(PRIME))
    return _powers_of(base)[:n] if n <= PASS_BYTES + 1 else _computed(base, n)


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row offsets of runs of rows of about BLOCK_BYTES. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash (two rolling hashes modulo a prime, 62 bits, and the length) of each span of bytes; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = int(np.searchsorted(ends, low + PASS_BYTES, side="right"))
        if to <= at:  # one span longer than a pass
            out[at] = int.from_bytes(hashlib.blake2b(buf[low : int(ends[at])].tobytes(), digest_size=8).digest(), "little")
            at += 1
            continue
        s, e = starts[at:to] - low, ends[at:to] - low
        part = buf[low : int(ends[to - 1])].astype(np.uint64) + np.uint64(1)
        halves = []
        for base in BASES:
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * powers(base, len(part)), out=sums[1:])  # below 2**31 * 2**9 * 2**20
            halves.append(_mod(_mod(sums[e] - sums[s]) * powers(base, len(part) + 1, inverse=True)[s]))
        out[at:to] = mix((halves[0] | (halves[1] << np.uint64(31))) + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = to
    return out


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each row (with an end)."""
    sep = _SEPARATOR[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    inside = ~sep
    before = np.empty_like(sep)
    before[:1] = True
    before[1:] = sep[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty_like(sep)
    after[-1:] = True
    after[:-1] = sep[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    hashes = span_hashes(_LOWER[buf] if lower else buf, starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def sequence_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of word hashes h[start:end], made as that of a span."""
    n = len(h)
    halves = []
    for k, base in enumerate(BASES):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mod(_mod(h >> np.uint64(2 * k)) * powers(base, n)), out=sums[1:])
        halves.append(_mod(_mod(sums[ends] - sums[starts]) * powers(base, n + 1, inverse=True)[starts]))
    return mix((halves[0] | (halves[1] << np.uint64(31))) + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
