"""Byte-pair encoding and decoding in batched numpy merge rounds.

``bpe_encode`` gives the ids of whole texts for a tokenizers file whose model is BPE with a word-end suffix, a lower-casing
normaliser and a splitter into short forms, letters, digits and others (the layout of ``word_bpe_49k.json``).

The symbols of all distinct words of a slice lie in one flat array. In each round every word finds its lowest-ranked
adjacent pair by binary search over the sorted pair keys, and all occurrences of that pair in it are merged from left to
right. Words without a pair left retire. A word of very many characters, which would need thousands of rounds of its whole
length, is merged by a heap of its pairs instead. A pre-token is encoded once per worker and looked up by a 64-bit hash afterwards.

Defined results: a null or empty text has no ids and decodes to the empty text. Special tokens written out in a text become
their ids, as in the library. Repeated rows give repeated results; an empty table gives an empty one; columns of the input
other than those named are ignored. Very long texts are encoded piece by piece, cut only before a blank between letters.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secret_audit.llm.pieces import PieceTable, word_spans
from secret_audit.llm.spark_tools import map_slices
from secret_audit.llm.textkit import codepoints, grouped_pieces, spread, texts_of

#: Words of more characters are merged by a heap, since each round costs the whole word.
LONG_WORD = 2000
_NONE = np.iinfo(np.int64).max
_MODELS: dict[bytes, BpeModel] = {}


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class BpeModel:
    """Pair keys, ranks and symbols of a tokenizers file, and a table of the words met so far."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = max(vocab.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: w for w, i in vocab.items()} | {i: w for w, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pairs: dict[int, int] | None = None
        self.words = PieceTable(self.encode_words)
        self.id_texts: list[str] = []
        self.decoded: list[str] = []

    def rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair is left; ``word`` is the ascending number of the word that each symbol belongs to."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            inside = word[1:] == word[:-1]
            keys = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = np.where(inside & (self.keys[at] == keys), self.ranks[at], _NONE)
            begin = np.flatnonzero(np.concatenate(([True], ~inside)))
            least = np.minimum.reduceat(rank, begin)
            sizes = np.diff(np.append(begin, len(symbols)))
            least = np.repeat(least, sizes)
            left = np.flatnonzero((rank == least) & (least < _NONE))
            if len(left):  # in a row of overlapping pairs every second one counts
                fresh = np.concatenate(([True], np.diff(left) != 1))
                offset = np.arange(len(left)) - np.maximum.accumulate(np.where(fresh, np.arange(len(left)), 0))
                left = left[offset % 2 == 0]
            symbols[left] = self.merged[rank[left]]
            keep = np.ones(len(symbols), bool)
            keep[left + 1] = False
            over = least == _NONE
            if over.any():
                done.append((symbols[over], word[over]))
                keep &= ~over
            symbols, word = symbols[keep], word[keep]
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def merged_alone(self, symbols: list[int]) -> list[int]:
        """As ``rounds`` for one long word: a heap of pairs over linked symbols, n log n steps instead of a round per pair."""
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        pairs, merged, size, n = self.pairs, self.merged.tolist(), self.size, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, key) for i in range(n - 1) if (rank := pairs.get(key := symbols[i] * size + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, key = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or symbols[i] * size + symbols[j] != key:  # merged away meanwhile
                continue
            symbols[i], symbols[j], k = merged[rank], -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (rank := pairs.get(key := symbols[i] * size + symbols[k])) is not None:
                    heapq.heappush(heap, (rank, i, key))
            h = before[i]
            if h >= 0 and (rank := pairs.get(key := symbols[h] * size + symbols[i])) is not None:
                heapq.heappush(heap, (rank, h, key))
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word one after the other, and their numbers; very long words are merged by themselves."""
        long = {i for i, w in enumerate(words) if len(w) > LONG_WORD}
        if not long:
            return self._encode_words(words)
        ids, counts = self._encode_words([w for i, w in enumerate(words) if i not in long])
        short, parts = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else ()), []
        for i, w in enumerate(words):
            if i in long:
                flat = np.frombuffer(w.encode("utf-8", "surrogatepass"), np.uint8)
                parts.append(np.array(self.merged_alone([*self.inner[flat[:-1]].tolist(), int(self.final[flat[-1]])]), np.int64))
            else:
                parts.append(next(short))
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[flat[ends]]
        ids, word = self.rounds(symbols, spread(lengths))
        return ids, np.bincount(word, minlength=len(words)).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by blanks, as the library does for a file without a decoder."""
        return " ".join(self.texts[i] for i in ids if i in self.texts)

    def normalise(self, text: str) -> str:
        """Composed and lower case, character by character (no final sigma)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def entries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table entry of every word of plain texts, and the number of words of each text."""
        joined = "".join(texts)
        cp, ends = codepoints(texts)
        begin, end = word_spans(cp, ends)
        words = self.words
        before = len(words.sizes)
        refs = words.refs(joined, cp, begin, end)
        if len(words.sizes) < before or not before:
            self.id_texts, self.decoded = [], []
        at = len(self.id_texts)
        for s, n in zip(words.starts[at:].tolist(), words.sizes[at:].tolist(), strict=True):
            ids = words.ids[s : s + n].tolist()
            self.id_texts.append(" ".join(map(str, ids)))
            self.decoded.append(self.decode(ids))
        return refs, np.searchsorted(begin, ends[1:]) - np.searchsorted(begin, ends[:-1])

    def parts(self, text: str) -> list[str]:
        return self.split.split(text) if "<" in text and self.special else [text]

    def encode(self, texts: list[str]) -> list[tuple[int, list[str], list[str]]]:
        """Per text: number of ids, ids as text and decoded text, both in parts that a blank joins."""
        out: list[tuple[int, list[str], list[str]]] = [(0, [], []) for _ in texts]
        plain, owner = [], []
        for i, text in enumerate(texts):
            for part in self.parts(text):
                plain.append(part if part in self.special else self.normalise(part))
                owner.append(i)
        for group, member in grouped_pieces(plain):
            special = [g in self.special and plain[m] == g for g, m in zip(group, member.tolist(), strict=True)]
            refs, counts = self.entries(["" if s else g for g, s in zip(group, special, strict=True)])
            sizes = np.add.reduceat(np.append(self.words.sizes[refs], 0), np.append(0, np.cumsum(counts)[:-1])) * (counts > 0)
            refs, at = refs.tolist(), 0
            for g, s, m, n, size in zip(group, special, member.tolist(), counts.tolist(), sizes.tolist(), strict=True):
                count, ids, decoded = out[owner[m]]
                if s:
                    ids.append(str(self.special[g]))
                    decoded.append(g)
                    size = 1
                elif n:
                    own = refs[at : at + n]
                    ids.extend(map(self.id_texts.__getitem__, own))
                    decoded.extend(map(self.decoded.__getitem__, own))
                out[owner[m]] = (count + size, ids, decoded)
                at += n
        return out


def bpe_model(data: bytes) -> BpeModel:
    """The model of a file's bytes; one per worker process."""
    key = hashlib.sha256(data).digest()
    if key not in _MODELS:
        _MODELS[key] = BpeModel(data)
    return _MODELS[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def bpe_encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Ids of every text as ``ids`` (array of int), their number ``n_tokens`` and the text decoded from them ``decoded``.

    ``keep`` names the columns that stay (default: all but the text).
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def columns(done):
        ids = [np.fromstring(" ".join(x), np.int32, sep=" ") if x else np.zeros(0, np.int32) for _, x, _ in done]
        return [pa.array([n for n, _, _ in done], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([" ".join(d) for _, _, d in done], pa.string())]

    return _mapped(df, path, text, keep, fields, columns)


def bpe_digests(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As ``bpe_encode``, with SHA-256 digests in place of ids and decoded text, so that no ids leave the worker."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def digest(parts: list[str]) -> str:
        return hashlib.sha256(" ".join(parts).encode("utf-8", "surrogatepass")).hexdigest()

    def columns(done):
        return [pa.array([n for n, _, _ in done], pa.int64()), pa.array([digest(i) for _, i, _ in done], pa.string()), pa.array([digest(d) for _, _, d in done], pa.string())]

    return _mapped(df, path, text, keep, fields, columns)


def _mapped(df, path, text, keep, fields, columns) -> DataFrame:
    made = {f.name for f in fields}
    keep = [c for c in df.columns if c != text and c.lower() not in made] if keep is None else keep
    data = df.sparkSession.sparkContext.broadcast(_read(path))  # a vocabulary file of a few MB

    def make():
        model = bpe_model(data.value)
        return lambda part: columns(model.encode(texts_of(part, text)))

    return map_slices(df.withColumn(text, F.col(f"`{text}`").cast("string")), keep, text, fields, make)
