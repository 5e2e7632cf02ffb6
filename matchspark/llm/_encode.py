"""Byte-level BPE of whole texts in Arrow batches, piece by piece.

The pre-tokeniser's pattern looks ahead by one character and never back. A run
of white space before anything else gives up its last character to what follows,
so these are boundaries of its matches whatever stands around them: before a
white-space character that follows none, and before the last white-space
character of a run. A text whose spaces all stand at such places is cut at its
spaces, any other one by a pattern that finds the places. Arrow splits a block
of texts and numbers its distinct pieces, so only those meet Python. They are
encoded one by one, and remembered as strings, or joined again and encoded in
one call: the only token of a piece that begins with a space is its first.
There, words of Latin letters are parted from the marks after them, so that each
is encoded once whatever follows it, and by the model alone: the pattern leaves
such a word whole. Words are remembered from block to block as Arrow strings.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the pattern engines of both libraries know it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{WHITE}]?[^{WHITE}]+|[{WHITE}]+(?=[{WHITE}][^{WHITE}])|[{WHITE}]+")
_CUT = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
_BLANK = re.compile(f"[{WHITE}]+")
#: A space inside a run of white space, but for the last place of one that something follows (for Arrow's engine).
_WHITE_RE2 = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_INSIDE = f"[{_WHITE_RE2}] (?:[{_WHITE_RE2}]|$)"
#: Letters of plain words, and marks after them (both engines).
LATIN, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", ".,;:!?"
#: Characters after which a long text is cut at the next boundary, and bytes of texts that go through together.
STRETCH, BLOCK = 1 << 18, 1 << 21
#: Where pieces are joined: how many at once, and bytes of texts whose distinct pieces are.
JOINED, JOINED_BLOCK = 4096, 1 << 22
#: Plain words that are remembered where pieces are joined; beyond them, those of the last block.
MOST_WORDS = 1 << 19


def is_white(piece: str) -> bool:
    return _BLANK.fullmatch(piece) is not None


def stretches(text: str) -> Iterator[str]:
    """The text in parts of about STRETCH characters, cut at boundaries."""
    at = 0
    while len(text) - at > STRETCH:
        cut = _CUT.search(text, at + STRETCH)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:] if at else text


class PieceEncoder:
    """Ids of texts by ``encode``, which takes one piece. Pieces of up to ``longest`` characters are remembered, of ``most`` in all.

    Texts that hold one of ``apart`` go to ``encode_whole`` as they are. Where ``encode_joined`` is given, with a mark
    of the ids whose token begins with a space, it takes what follows a space, joined. ``encode_words`` is the same for words of LATIN letters alone, up to MOST_WORDS of which are remembered.
    """

    def __init__(self, encode: Callable[[str], list[int]], apart: tuple[str, ...] = (), encode_whole: Callable[[str], list[int]] | None = None, most: int = 4_000_000, longest: int = 64, encode_joined: Callable[[str], list[int]] | None = None, encode_words: Callable[[str], list[int]] | None = None, spaced: np.ndarray | None = None):
        self.encode_joined, self.encode_words, self.spaced = encode_joined, encode_words or encode_joined, spaced
        self.words, self.word_ids, self.word_count = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.encode, self.apart, self.encode_whole = encode, apart, encode_whole
        self.most, self.longest, self.held = most, longest, 0
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # what was known before the last ageing

    def rows(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of rows: the first row, all ids, and where those of each row begin (with an end). Null: empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        for at, to in _runs(texts, JOINED_BLOCK if self.encode_joined else BLOCK):
            part = texts.slice(at, to - at)
            flat, count, which, bounds = self._numbered(part)
            begin = np.cumsum(count) - count
            for low, high in _runs(part, BLOCK):
                own = which[bounds[low] : bounds[high]]
                n = count[own]
                ends = np.cumsum(n)
                yield at + low, _gathered(flat, begin[own], n), np.append(0, ends)[bounds[low : high + 1] - bounds[low]]

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct pieces one after the other, how many each has, the numbers of the pieces of all texts, and where those of each text begin (with an end)."""
        if 2 * self.held > self.most:
            self.known, self.before, self.held = {}, self.known, 0
        odd = pc.match_substring_regex(texts, _INSIDE)
        for mark in self.apart:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        alone = {i: self._alone(texts[i].as_py()) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        parts = split.flatten()
        numbered = parts.dictionary_encode()
        first = _strings(parts.take(pa.array(bounds[:-1])))
        flat, count = self._joined(numbered.dictionary) if self.encode_joined else _flat(self._after_space(_strings(numbered.dictionary)))
        begun, more = _flat([alone[i] if i in alone else self._cut(x) for i, x in enumerate(first)])
        which = numbered.indices.to_numpy().copy()
        which[bounds[:-1]] = len(numbered.dictionary) + np.arange(len(first))  # what begins a text has no space before it
        return np.concatenate([flat, begun]), np.concatenate([count, more]), which, bounds

    def _joined(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a space and each part, and how many each has. Parts that are empty or hold other white space stand between words, so that no two of them meet."""
        stem = pc.utf8_rtrim(parts, MARKS)
        plain = pc.match_substring_regex(stem, f"^[{LATIN}]+$")
        stems = stem.filter(plain).dictionary_encode()
        marks = pc.replace_substring_regex(parts.filter(plain), f"^[{LATIN}]+", "").dictionary_encode()
        plain = plain.to_numpy(zero_copy_only=False)
        white = pc.match_substring_regex(parts, f"[{_WHITE_RE2}]|^$").to_numpy(zero_copy_only=False)
        rest, mixed = np.flatnonzero(~plain & ~white), np.flatnonzero(white)
        made = [self._words(stems.dictionary), _flat(self._raws(_strings(marks.dictionary))), self._called(self.encode_joined, parts.take(pa.array(rest))), self._called(self.encode_joined, parts.take(pa.array(mixed)), " a")]
        flat, n = np.concatenate([ids for ids, _ in made]), np.concatenate([n for _, n in made])
        begin, (_, marked, left, _) = np.cumsum(n) - n, np.cumsum([0, *(len(n) for _, n in made[:3])])
        pieces = np.full((len(parts), 2), len(n))  # a word and its marks, or the whole and nothing
        pieces[plain, 0], pieces[plain, 1] = stems.indices.to_numpy(), marked + marks.indices.to_numpy()
        pieces[np.append(rest, mixed), 0] = left + np.arange(len(rest) + len(mixed))
        begin, n = np.append(begin, 0), np.append(n, 0)
        return _gathered(flat, begin[pieces].ravel(), n[pieces].ravel()), n[pieces].sum(axis=1)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What _joined returns, for distinct plain words; those that are new are encoded and remembered."""
        place = pc.index_in(words, value_set=self.words)
        new = place.is_null()
        ids, n = self._called(self.encode_words, words.filter(new))
        which = place.fill_null(0).to_numpy().astype(np.int64)
        which[new.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(n))
        flat, count = np.append(self.word_ids, ids), np.append(self.word_count, n)
        own = _gathered(flat, (np.cumsum(count) - count)[which], count[which]), count[which]
        if len(count) > MOST_WORDS:
            self.words, self.word_ids, self.word_count = words, *own
        elif len(n):
            self.words, self.word_ids, self.word_count = pa.concat_arrays([self.words, words.filter(new)]), flat, count
        return own

    def _called(self, encode: Callable[[str], list[int]], parts: pa.Array, filler: str = "") -> tuple[np.ndarray, np.ndarray]:
        """What _joined returns, JOINED parts a call, with the filler after each."""
        own, count, texts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], _strings(parts)
        for k in range(0, len(texts), JOINED):
            some = texts[k : k + JOINED]
            ids = np.array(encode("".join([f" {x}{filler}" for x in some])), np.uint32)
            begin = np.flatnonzero(self.spaced[ids])
            n = np.diff(np.append(begin, len(ids)))
            if filler:
                ids, n = ids[np.repeat(np.arange(len(n)) % 2 == 0, n)], n[::2]
            if len(n) != len(some) or begin[0]:
                raise ValueError("a piece does not begin with a token of its own")
            own.append(ids)
            count.append(n)
        return np.concatenate(own), np.concatenate(count)

    def _alone(self, text: str) -> bytes:
        if any(mark in text for mark in self.apart):
            return array("I", self.encode_whole(text)).tobytes()
        return b"".join(map(self._cut, stretches(text)))

    def _cut(self, text: str) -> bytes:
        return b"".join(self._raws(_PIECE.findall(text)))

    def _raws(self, pieces: list[str]) -> list[bytes]:
        out = list(map(self.known.get, pieces))
        for i, raw in enumerate(out):
            if raw is None:
                out[i] = self._learned(pieces[i])
        return out

    def _after_space(self, parts: list[str]) -> list[bytes]:
        """Raw ids of a space and each part; parts may hold other white space, and so more than one piece."""
        pieces = [" " + x for x in parts]
        out = list(map(self.known.get, pieces))
        for i, raw in enumerate(out):
            if raw is None:
                out[i] = self._learned(pieces[i]) if parts[i].isalpha() or len(_PIECE.findall(pieces[i])) == 1 else self._cut(pieces[i])
        return out

    def _learned(self, piece: str) -> bytes:
        raw = self.before.get(piece)
        if raw is None:
            raw = array("I", self.encode(piece)).tobytes()
        if len(piece) <= self.longest:
            self.known[piece] = raw
            self.held += len(piece)
        return raw


def _runs(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many bytes, one row at least."""
    sizes, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, side="right")))
        yield at, to
        at = to


def _gathered(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches of flat one after the other."""
    ends = np.cumsum(n)
    return flat[np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _flat(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raw), np.uint32), np.fromiter(map(len, raw), np.int64, len(raw)) // 4


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()
