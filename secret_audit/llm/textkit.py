"""Vectorised text primitives for Python workers: code points, character classes, word spans and word hashes.

Everything here works on one slice of rows at a time, so memory follows the slice and not the partition.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_CHARS = 1 << 20
OTHER, LETTER, NUMBER, SPACE, MARK = range(5)
#: Code points of the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, mark or other."""
    names = {"L": LETTER, "N": NUMBER, "M": MARK}
    out = np.fromiter((names.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _char_values() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=np.uint64))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_CHARS + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and where each begins (one more entry than texts)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=ends[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points; equal spans have equal hashes wherever they lie."""
    up, down = _powers(len(cp) + 1)
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(_char_values()[cp] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` units (code points or bytes)."""
    up, down = _powers(len(units) + 1)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(_char_values()[units] * up[:-1], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: len(sums) - size])


def runs(flags: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true flags; a run never crosses a border."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(flags) + 1, bool)
    cut[borders] = True
    before = np.concatenate(([False], flags[:-1])) & ~cut[:-1]
    after = np.concatenate((flags[1:], [False])) & ~cut[1:]
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


def pieces_of(text: str, limit: int = SLICE_CHARS) -> list[str]:
    """A very long text in pieces that end before a blank between two letters, where no word or token is cut."""
    out, at = [], 0
    while len(text) - at > limit:
        end = text.find(" ", at + limit)
        while end > 0 and not (text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end = text.find(" ", end + 1)
        if end < 0:
            break
        out.append(text[at:end])
        at = end
    out.append(text[at:])
    return out


def grouped_pieces(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[list[str], np.ndarray]]:
    """Pieces of all texts in groups of about one slice, with the number of the text that each belongs to."""
    group, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces_of(text, limit) if len(text) > limit else (text,):
            if group and size + len(piece) > limit:
                yield group, np.array(owner, np.int64)
                group, owner, size = [], [], 0
            group.append(piece)
            owner.append(i)
            size += len(piece)
    if group:
        yield group, np.array(owner, np.int64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts in order, and the number of words of each text.

    A word is a run of letters, marks and digits.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for group, owner in grouped_pieces(texts):
        cp, ends = codepoints([t.lower() for t in group])
        kind = char_classes()[cp]
        start, end = runs((kind == LETTER) | (kind == NUMBER) | (kind == MARK), ends)
        hashes.append(span_hashes(cp, start, end))
        words = np.searchsorted(start, ends[1:]) - np.searchsorted(start, ends[:-1])
        np.add.at(counts, owner, words)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about ``limit`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes.astype(np.int64)), 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a slice; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def spread(counts: np.ndarray) -> np.ndarray:
    """Row number of every element, given the number of elements of each row."""
    return np.repeat(np.arange(len(counts)), counts)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift
