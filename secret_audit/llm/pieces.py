"""Pre-tokens of byte-pair tokenizers as spans of code points, and a table that encodes each distinct one once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from secret_audit.llm.textkit import LETTER, MARK, NUMBER, OTHER, SPACE, char_classes, span_hashes

#: Letters that may follow an apostrophe as a pre-token of their own: fixed values of both patterns.
SHORT_FORMS = ("s", "t", "m", "d", "re", "ve", "ll")


def _kinds(cp: np.ndarray) -> np.ndarray:
    kind = char_classes()[cp]
    return np.where(kind == MARK, OTHER, kind)


def _short_forms(cp, kind, borders, starts, blocked) -> tuple[np.ndarray, np.ndarray]:
    """Positions of apostrophes that begin a short form, and the length of the form's letters."""
    room = np.zeros(len(cp) + 3, np.uint32)
    room[: len(cp)] = cp
    at = np.flatnonzero((cp == 39) & starts & ~blocked)
    after = borders[np.searchsorted(borders, at, side="right")] - at - 1
    size = np.zeros(len(at), np.int64)
    for form in SHORT_FORMS:
        fits = after >= len(form)
        for j, c in enumerate(form):
            fits &= room[at + 1 + j] == ord(c)
        size = np.where((size == 0) & fits, len(form), size)
    return at[size > 0], size[size > 0]


def _class_starts(kind: np.ndarray, borders: np.ndarray) -> np.ndarray:
    starts = np.ones(len(kind), bool)
    starts[1:] = kind[1:] != kind[:-1]
    starts[borders[borders < len(kind)]] = True
    return starts


def _with_short_forms(starts: np.ndarray, kind: np.ndarray, at: np.ndarray, size: np.ndarray, borders: np.ndarray) -> None:
    """Join an apostrophe with its letters; what is left of the letters begins anew."""
    starts[at + 1] = False
    rest = at + 1 + size
    inside = rest[rest < len(kind)]
    same = ~np.isin(inside, borders) & (kind[inside] == LETTER)
    starts[inside[same]] = True


def word_spans(cp: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Short forms, runs of letters, single digits and runs of other characters; white space is left out."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _kinds(cp)
    starts = _class_starts(kind, borders)
    at, size = _short_forms(cp, kind, borders, starts, np.zeros(len(cp), bool))
    starts |= kind == NUMBER
    _with_short_forms(starts, kind, at, size, borders)
    begin = np.flatnonzero(starts)
    end = np.append(begin[1:], len(cp))
    kept = kind[begin] != SPACE
    return begin[kept], end[kept]


def byte_spans(cp: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Short forms and runs of letters, digits or other characters, each with one blank before it, and white space."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _kinds(cp)
    starts = _class_starts(kind, borders)
    blocked = np.zeros(len(cp), bool)
    blocked[1:] = (cp[:-1] == 32) & ~np.isin(np.arange(1, len(cp)), borders)
    at, size = _short_forms(cp, kind, borders, starts, blocked)
    _with_short_forms(starts, kind, at, size, borders)
    # The last white space before other characters of the same text stands alone, or is their blank.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE))
    last = last[~np.isin(last + 1, borders)]
    starts[last] = True
    blank = last[cp[last] == 32]
    starts[blank + 1] = False
    begin = np.flatnonzero(starts)
    return begin, np.append(begin[1:], len(cp))


class PieceTable:
    """Ids of the distinct pre-tokens met so far; emptied when it holds ``limit`` of them, which changes no result."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.added: list[str] = []

    def refs(self, joined: str, cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Entry of each span, in ``starts`` and ``sizes``; the spans are slices of the joined text."""
        self.added = []
        distinct, first, inverse = np.unique(span_hashes(cp, begin, end), return_index=True, return_inverse=True)
        if len(self.hashes) > self.limit:
            self.clear()
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        entry = np.zeros(len(distinct), np.int64)
        entry[known] = self.places[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            self.added = [joined[s:e] for s, e in zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            ids, sizes = self.encode(self.added)
            entry[new] = len(self.sizes) + np.arange(len(new))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))
            where = np.searchsorted(self.hashes, distinct[new])
            self.hashes, self.places = np.insert(self.hashes, where, distinct[new]), np.insert(self.places, where, entry[new])
        return entry[inverse]
