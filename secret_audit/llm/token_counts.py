"""Numbers of word pieces by a linear longest-match automaton.

Texts are split as the byte-level pattern does (short forms, letters, digits, others, each with one blank before it), and
every pre-token is covered by the longest vocabulary entry again and again. A trie over the entries has failure links: where
no edge goes on, the entries that are then certain are popped and matching goes on in the state that the rest leads to. Only
the number of popped entries is kept with a state, so lengths come out in one pass over the bytes and no piece is built.

Defined results: a null or empty text has no tokens. A pre-token that the vocabulary can't cover counts as one unknown token.
Special tokens written out in a text are ordinary text. Repeated rows give repeated results; an empty table an empty one.
Very long texts are read piece by piece, cut only before a blank between letters. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secret_audit.llm.bpe import byte_chars
from secret_audit.llm.pieces import PieceTable, byte_spans
from secret_audit.llm.spark_tools import map_slices
from secret_audit.llm.textkit import codepoints, grouped_pieces, texts_of

#: So few words that are left are followed one by one.
FEW_WORDS = 16
_COUNTERS: dict[bytes, PieceCounter] = {}


class LongestMatch:
    """The automaton over byte strings: edges as sorted keys, failure states and popped-token counts as arrays."""

    def __init__(self, entries: list[bytes]):
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for entry in entries:
            state = 0
            for b in entry:
                after = edges[state].get(b)
                if after is None:
                    after = edges[state][b] = len(edges)
                    edges.append({})
                    final.append(False)
                state = after
            final[state] = state > 0
        fail, pops = [-1] * len(edges), [0] * len(edges)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for b, state in edges[parent].items():
                queue.append(state)
                if final[state]:
                    fail[state], pops[state] = 0, 1
                    continue
                popped, rest = pops[parent], fail[parent]
                while rest >= 0 and b not in edges[rest]:
                    popped, rest = popped + pops[rest], fail[rest]
                if rest >= 0:
                    fail[state], pops[state] = edges[rest][b], popped
        keys = np.array([s * 256 + b for s, out in enumerate(edges) for b in out], np.int64)
        after = np.array([t for out in edges for t in out.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.after = keys[order], after[order]
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        self.edges: dict[int, int] | None = None

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state of each word over an edge, and whether there is one."""
        if not len(self.keys):
            return state, np.zeros(len(state), bool)
        key = state * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.after[at], self.keys[at] == key

    def lengths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of pieces of each word (1 where it can't be covered) and whether it is covered; all words move in step."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat, begin = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        state, count, dead = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        alive_until = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), side="right")
        for place, n in enumerate(alive_until.tolist()):
            if n <= FEW_WORDS and len(alive_until) - place > FEW_WORDS:
                for w in order[:n].tolist():  # a few long words: step by step is faster than arrays of one
                    if not dead[w]:
                        state[w], more, dead[w] = self.follow(int(state[w]), flat[begin[w] + place : begin[w] + size[w]])
                        count[w] += more
                break
            word = order[:n]
            word = word[~dead[word]]
            byte = flat[begin[word] + place]
            while len(word):
                after, found = self.step(state[word], byte)
                state[word[found]] = after[found]
                word, byte = word[~found], byte[~found]
                word, byte = self._fail(word, byte, state, count, dead)
        word = np.flatnonzero(~dead & (state > 0))
        while len(word):
            word, _ = self._fail(word, word, state, count, dead)
            word = word[state[word] > 0]
        return np.where(dead, 1, count), ~dead

    def follow(self, state: int, rest: np.ndarray) -> tuple[int, int, bool]:
        """State after the rest of one word, the tokens popped on the way, and whether the word can't be covered."""
        if self.edges is None:
            self.edges = dict(zip(self.keys.tolist(), self.after.tolist(), strict=True))
            self.plain = self.fail.tolist(), self.pops.tolist()
        edges, (fail, pops), count = self.edges, self.plain, 0
        for byte in rest.tolist():
            while (after := edges.get(state * 256 + byte)) is None:
                if fail[state] < 0:
                    return state, count, True
                count += pops[state]
                state = fail[state]
            state = after
        return state, count, False

    def _fail(self, word, byte, state, count, dead) -> tuple[np.ndarray, np.ndarray]:
        lost = self.fail[state[word]] < 0
        dead[word[lost]] = True
        word, byte = word[~lost], byte[~lost]
        count[word] += self.pops[state[word]]
        state[word] = self.fail[state[word]]
        return word, byte


class PieceCounter:
    """Lengths of the distinct pre-tokens met so far, for the vocabulary of a byte-level tokenizers file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        special = {t["content"] for t in spec["added_tokens"]}
        number = {c: b for b, c in enumerate(byte_chars())}
        self.automaton = LongestMatch([bytes(number[c] for c in entry) for entry in spec["model"]["vocab"] if entry not in special])
        self.table = PieceTable(self._measure)
        self.covered = np.zeros(0, bool)

    def _measure(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, covered = self.automaton.lengths([p.encode("utf-8", "surrogatepass") for p in pieces])
        self.covered = np.concatenate((self.covered[: len(self.table.sizes)], covered))
        return np.zeros(0, np.int64), sizes  # no ids are built

    def count(self, texts: list[str]) -> np.ndarray:
        """Per text: pre-tokens, tokens and unknown tokens."""
        out = np.zeros((len(texts), 3), np.int64)
        for group, owner in grouped_pieces(texts):
            cp, ends = codepoints(group)
            begin, end = byte_spans(cp, ends)
            refs = self.table.refs("".join(group), cp, begin, end)
            doc = owner[np.searchsorted(ends, begin, side="right") - 1]
            for j, n in enumerate((np.ones(len(refs)), self.table.sizes[refs], ~self.covered[refs])):
                out[:, j] += np.bincount(doc, n, minlength=len(texts)).astype(np.int64)
        return out


def piece_counter(data: bytes) -> PieceCounter:
    key = hashlib.sha256(data).digest()
    if key not in _COUNTERS:
        _COUNTERS[key] = PieceCounter(data)
    return _COUNTERS[key]


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_pretokens, n_tokens and n_unknown; columns of these names are replaced. ``keep`` names the columns that stay."""
    names = ["n_pretokens", "n_tokens", "n_unknown"]
    keep = [c for c in df.columns if c.lower() not in names] if keep is None else keep
    with open(path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file of a few MB
    column = "_text_beside_" + "_".join(keep)

    def make():
        counter = piece_counter(data.value)
        return lambda part: [pa.array(x) for x in counter.count(texts_of(part, column)).T]

    fields = [T.StructField(n, T.LongType()) for n in names]
    return map_slices(df.withColumn(column, F.col(f"`{text}`").cast("string")), keep, column, fields, make)
