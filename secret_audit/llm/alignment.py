"""Alignment of the tokens of two tokenizers: a byte-level BPE file (A) and a SentencePiece BPE model (B).

Both read a blank and the text. A group is a stretch of bytes between two places where a token of A and a token of B end
together; a link is a pair of tokens, one of each side, in the same group.

``token_groups`` gives the groups of every document, ``pair_documents`` in how many documents each pair of ids is linked, and
``alignment_digests`` both as numbers and a digest per document.

A batch goes through two ``merge_asof`` calls keyed by document: the start of each token finds the token of the other side
that covers it. Both directions together are the overlaps, and an overlap whose ends are equal closes a group. Both
tokenizers cut before a blank that follows a visible character, so a document is a chain of passages that begin there; a
passage that a worker has aligned before is looked up by a 64-bit hash and not aligned again. Where a document is very long it
is read in pieces that end at such a place.

Every text is read once. What it yields is stored: its numbers, its digest and its distinct pairs of ids with the number of
links of each. From that table the pairs are counted, in the worker first and then by Spark, and the counts looked up: the
most frequent ones, at most ``TABLE_PAIRS``, in a broadcast table; links of rarer pairs, where there are more, meet theirs in a
join.

Defined results: a text that is null or empty has no tokens, and neither has one whose tokens of either side don't spell a
blank and the text (the character U+2581 does that): zeros and an empty digest. Special tokens written out in a text are
ordinary text. Rows that repeat a document count as documents of their own. An empty table gives an empty result; columns of
the input that are not kept are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secret_audit.llm.packing import byte_coder
from secret_audit.llm.spark_tools import free_name, map_slices, quoted, stored
from secret_audit.llm.textkit import SPACE, char_classes, codepoints, grouped_pieces, ranges, span_hashes, spread, texts_of

#: Most pairs in the broadcast table of counts: 16 bytes each.
TABLE_PAIRS = 2_000_000
#: Passages that a worker remembers, and pairs that it sums up before it hands them on.
PASSAGES, SUMMED = 800_000, 1_000_000
#: Pairs of one group that are made at a time.
AT_ONCE = 1 << 22
#: Passages that are encoded in a row, and signs that may end one of them.
JOINED, VISIBLE = 256, ".,;:!?)]}\"'%"
BLANK = "▁"  # the piece model's blank
_ALIGNERS: dict[bytes, Aligner] = {}


class Words:
    """Token bytes of one side: all entries in one array, with the begin and the length of each."""

    def __init__(self, entries: list[bytes]):
        self.size = np.fromiter(map(len, entries), np.int64, len(entries))
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ranges(self.begin[ids], self.size[ids])]


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Pairs of tokens that share a byte, in order; both sides have document, start and token, sorted by start."""
    left = pd.merge_asof(a, b, on="start", by="document", suffixes=("_a", "_b"))
    right = pd.merge_asof(b, a, on="start", by="document", suffixes=("_b", "_a"))
    both = pd.concat([left, right])[["token_a", "token_b"]]
    return both.drop_duplicates().sort_values(["token_a", "token_b"], ignore_index=True)


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of the weights of each."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights[order], first)


class Aligner:
    """Both tokenizers and the passages aligned so far."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.coder = byte_coder(byte_file)
        self.plain = Tokenizer.from_str(byte_file.decode("utf-8"))
        self.plain.encode_special_tokens = True
        self.pieces = SentencePieceProcessor(model_proto=piece_file)
        number = {c: b for b, c in self.coder.chars.items()}
        vocab = {i: w for w, i in self.coder.whole.get_vocab().items()}
        self.a = Words([bytes(number[c] for c in vocab.get(i, "") if c in number) for i in range(max(vocab) + 1)])
        ids = range(self.pieces.get_piece_size())
        names = [self.pieces.id_to_piece(i) for i in ids]
        self.b = Words([bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in zip(ids, names, strict=True)])
        self.blank = self.pieces.piece_to_id(BLANK)
        self.crossing = any(BLANK in n.lstrip(BLANK) for n in names)  # then no passage can be cut off from the next
        self.names = np.array([f"{i}{end}" for end in ",|;" for i in range(max(len(self.a.size), len(self.b.size)))], object)
        self.clear()

    def clear(self) -> None:
        none, small = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.hashes, self.places = np.zeros(0, np.uint64), small
        self.facts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.bad = np.zeros(0, bool)
        self.pair, self.times, self.pair_begin, self.pair_size = small, none, none, small
        self.end, self.end_begin, self.end_size = small, none, small
        self.texts: list[str] = []

    # passages

    def spans(self, cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each passage."""
        starts = np.zeros(len(cp), bool)
        if not self.crossing:
            starts[1:] = (cp[1:] == 32) & (char_classes()[cp[:-1]] != SPACE)
        starts[ends[:-1][ends[:-1] < len(cp)]] = True
        begin = np.flatnonzero(starts)
        return begin, np.append(begin[1:], len(cp))

    def refs(self, group: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each passage of the texts, and the number of passages of each text."""
        joined = "".join(group)
        cp, ends = codepoints(group)
        begin, end = self.spans(cp, ends)
        hashes, first, inverse = np.unique(span_hashes(cp, begin, end), return_index=True, return_inverse=True)
        if len(self.hashes) > PASSAGES:
            self.clear()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        entry = np.zeros(len(hashes), np.int64)
        entry[known] = self.places[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.argsort(first[new])]
            entry[new] = len(self.facts) + np.arange(len(new))
            span = first[new]
            document = np.searchsorted(ends, begin[span], side="right") - 1
            self.add([joined[s:e] for s, e in zip(begin[span].tolist(), end[span].tolist(), strict=True)], document)
            order = np.argsort(hashes[new])
            where = np.searchsorted(self.hashes, hashes[new][order])
            self.hashes = np.insert(self.hashes, where, hashes[new][order])
            self.places = np.insert(self.places, where, entry[new][order].astype(np.int32))
        return entry[inverse], np.searchsorted(begin, ends[1:]) - np.searchsorted(begin, ends[:-1])

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B: ids of texts that begin with a blank, one after the other, and the number of ids of each."""
        a = [x.ids for x in self.plain.encode_batch(texts, add_special_tokens=False)]
        b = self.pieces.encode([t[1:] for t in texts], num_threads=1)  # the model puts the blank before
        b = [ids if len(t) > 1 else [self.blank] for t, ids in zip(texts, b, strict=True)]
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
        return [(np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())), n) for x, n in zip((a, b), sizes, strict=True)]

    def tokens(self, passages: list[str], rows: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and their numbers, ids of B and their numbers, and the passages that the tokens of one side don't spell.

        Passages that end in a visible character keep their tokens when others follow, so they are encoded in rows.
        """
        rows = rows and not self.crossing
        alone = np.array([not rows or not (p[-1].isalnum() or p[-1] in VISIBLE) or BLANK in p for p in passages], bool)
        order = np.concatenate((np.flatnonzero(~alone), np.flatnonzero(alone)))
        own = [passages[i] for i in order.tolist()]
        first = len(own) - int(alone.sum())
        cut = [*range(0, first, JOINED), *range(first, len(own) + 1)]
        cut = np.array(sorted({*cut, first, len(own)}))
        texts = ["".join(own[s:e]) for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        raw = [p.encode("utf-8", "surrogatepass") for p in own]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat, stop = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(size)))
        unlike, out = np.zeros(len(texts), bool), []
        found = self.encoded(texts)
        for words, (ids, n) in zip((self.a, self.b), found, strict=True):
            unlike |= np.bincount(spread(n), words.size[ids], len(texts)).astype(np.int64) != np.diff(stop[cut])
        fits = np.repeat(~unlike, np.diff(stop[cut]))
        for words, (ids, n) in zip((self.a, self.b), found, strict=True):
            kept = ids[np.repeat(~unlike, n)]
            wrong = np.flatnonzero(fits)[words.spelled(kept) != flat[fits]]
            unlike[np.searchsorted(stop[cut], wrong, side="right") - 1] = True
        bad = np.repeat(unlike, np.diff(cut))
        if rows and bad[:first].any():  # no known model does this
            return self.tokens(passages, rows=False)
        back = np.argsort(order)
        for words, (ids, n) in zip((self.a, self.b), found, strict=True):
            ids = ids[np.repeat(~unlike, n)]
            ends = np.cumsum(np.where(bad, 0, size))
            ends = np.searchsorted(np.cumsum(words.size[ids]), ends, side="right")
            count = np.diff(np.concatenate(([0], ends)))
            out += [ids[ranges((ends - count)[back], count[back])], count[back]]
        return (*out, bad[back])

    def add(self, passages: list[str], document: np.ndarray) -> None:
        """Align passages that are new, in the order of the batch."""
        a, n_a, b, n_b, bad = self.tokens(passages)
        of_a, of_b = spread(n_a), spread(n_b)
        start_a, start_b = (np.cumsum(w.size[x]) - w.size[x] for w, x in ((self.a, a), (self.b, b)))
        frame = lambda of, start: pd.DataFrame({"document": document[of], "start": start, "token": np.arange(len(start))})
        both = overlaps(frame(of_a, start_a), frame(of_b, start_b))
        x, y = both["token_a"].to_numpy(), both["token_b"].to_numpy()
        end_a, end_b = start_a + self.a.size[a], start_b + self.b.size[b]
        closes = end_a[x] == end_b[y]
        group = np.cumsum(closes) - closes
        group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        group_a[x], group_b[y] = group, group
        n_groups = int(closes.sum())
        owner = np.zeros(n_groups, np.int64)
        owner[group] = of_a[x]
        size_a, size_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        key, times = self.linked(a, group_a, b, group_b, owner)
        pair = key % self.pairs
        facts = np.zeros((len(passages), 4), np.int64)
        facts[:, 0], facts[:, 1] = np.bincount(of_a, minlength=len(passages)), np.bincount(of_b, minlength=len(passages))
        facts[:, 2] = np.bincount(owner, minlength=len(passages))
        np.add.at(facts[:, 3], owner, size_a * size_b)
        sizes = np.bincount(key // self.pairs, minlength=len(passages))
        self.pair_begin = np.concatenate((self.pair_begin, len(self.pair) + np.cumsum(sizes) - sizes))
        self.pair, self.times = np.concatenate((self.pair, pair.astype(np.int32))), np.concatenate((self.times, times))
        self.pair_size, self.facts = np.concatenate((self.pair_size, sizes.astype(np.int32))), np.concatenate((self.facts, facts))
        self.bad = np.concatenate((self.bad, bad))
        self.write(a, group_a, b, group_b, owner, len(passages), end_a, of_a, facts[:, 0])

    @property
    def pairs(self) -> int:
        return len(self.a.size) * len(self.b.size)

    def linked(self, a, group_a, b, group_b, owner) -> tuple[np.ndarray, np.ndarray]:
        """Passage and pair of ids as one number, in order, and how many links each has; a huge group is taken in steps."""
        ids_a, n_a = counted(group_a * len(self.a.size) + a, np.ones(len(a), np.int64))
        ids_b, n_b = counted(group_b * len(self.b.size) + b, np.ones(len(b), np.int64))
        in_b = np.bincount(ids_b // len(self.b.size), minlength=len(owner))
        first_b = np.cumsum(in_b) - in_b
        width = in_b[ids_a // len(self.a.size)]
        total, keys, sums, at = np.cumsum(width), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while at < len(ids_a):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, side="right")))
            g, w = ids_a[at:end] // len(self.a.size), width[at:end]
            j = ranges(first_b[g], w)
            pair = np.repeat(ids_a[at:end] % len(self.a.size), w) * len(self.b.size) + ids_b[j] % len(self.b.size)
            made, n = counted(np.repeat(owner[g], w) * self.pairs + pair, np.repeat(n_a[at:end], w) * n_b[j])
            keys, sums = counted(np.concatenate((keys, made)), np.concatenate((sums, n))) if len(keys) else (made, n)
            at = end
        return keys, sums

    def write(self, a, group_a, b, group_b, owner, n, end_a, of_a, n_a) -> None:
        """The groups of each new passage as text, and where they end in the passage."""
        ids, group = np.concatenate((a, b)), np.concatenate((group_a, group_b))
        side = np.concatenate((np.zeros(len(a), np.int64), np.ones(len(b), np.int64)))
        order = np.lexsort((np.arange(len(ids)), side, group))
        ids, group, side = ids[order], group[order], side[order]
        mark = np.full(len(ids), 2)
        mark[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])
        names = self.names[mark * (len(self.names) // 3) + ids].tolist()
        cut = np.searchsorted(owner[group], np.arange(n + 1)).tolist()
        self.texts += ["".join(names[s:e])[:-1] for s, e in zip(cut[:-1], cut[1:], strict=True)]
        last = np.flatnonzero(np.concatenate((group_a[1:] != group_a[:-1], [True]))) if len(a) else np.zeros(0, np.int64)
        base = np.concatenate(([0], end_a))[np.cumsum(n_a) - n_a]
        sizes = np.bincount(of_a[last], minlength=n)
        self.end_begin = np.concatenate((self.end_begin, len(self.end) + np.cumsum(sizes) - sizes))
        self.end_size = np.concatenate((self.end_size, sizes.astype(np.int32)))
        self.end = np.concatenate((self.end, (end_a[last] - base[of_a[last]]).astype(np.int32)))

    # documents

    def read(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each part of a slice: the text that each passage belongs to, and its entry."""
        for group, owner in grouped_pieces([" " + t if t else "" for t in texts]):
            refs, n = self.refs(group)
            yield np.repeat(owner, n), refs

    def links(self, owner: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct text and pair of ids as one number, in order, and the number of links of each."""
        once, n = counted(owner * len(self.facts) + refs, np.ones(len(refs), np.int64))
        owner, refs = once // len(self.facts), once % len(self.facts)
        size = self.pair_size[refs].astype(np.int64)
        at = ranges(self.pair_begin[refs], size)
        return counted(np.repeat(owner, size) * self.pairs + self.pair[at], np.repeat(n, size) * self.times[at])

    def describe(self, texts: list[str], parts: bool = False, pairs: bool = False):
        """Numbers of each text (the columns of ``facts``), the text of its groups in parts, their ends on demand, and its pairs.

        The pairs come as ``links`` gives them, for texts that the tokens of both sides spell.
        """
        facts, bad = np.zeros((len(texts), 4), np.int64), np.zeros(len(texts), bool)
        groups, ends, found = [[] for _ in texts], [[] for _ in texts], []
        for owner, refs in self.read(texts):
            np.add.at(facts, owner, self.facts[refs])
            bad[owner[self.bad[refs]]] = True
            if pairs:
                found.append(self.links(owner, refs))
            cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else [0]
            refs = refs.tolist()
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                groups[owner[s]].append(";".join([self.texts[r] for r in refs[s:e]]))
                if parts:
                    ends[owner[s]] += [self.end[self.end_begin[r] : self.end_begin[r] + self.end_size[r]].astype(np.int64) for r in refs[s:e]]
        for i in np.flatnonzero(bad).tolist():
            facts[i], groups[i], ends[i] = 0, [], []
        if not pairs:
            return facts, groups, ends
        key, n = found[0] if len(found) == 1 else counted(*(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ()))))
        kept = ~bad[key // self.pairs]
        return facts, groups, (key[kept], n[kept])


def aligner(byte_file: bytes, piece_file: bytes) -> Aligner:
    """The aligner of two files; one per worker process."""
    key = hashlib.sha256(byte_file + piece_file).digest()
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(byte_file, piece_file)
    return _ALIGNERS[key]


def _models(df: DataFrame, byte_path: str, piece_path: str):
    data = []
    for path in (byte_path, piece_path):
        with open(path, "rb") as f:
            data.append(f.read())
    return df.sparkSession.sparkContext.broadcast(tuple(data))  # vocabulary files of a few MB


def token_groups(df: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``groups`` (``a1,a2|b1;a3|b2,b3``) and ``group_ends`` (bytes of the blank and the text up to each group's end)."""
    keep = [c for c in df.columns if c.lower() not in ("groups", "group_ends")] if keep is None else keep
    models, column = _models(df, byte_path, piece_path), free_name(df, "_text")

    def make():
        own = aligner(*models.value)

        def run(part: pa.RecordBatch) -> list[pa.Array]:
            _, groups, ends = own.describe(texts_of(part, column), parts=True)
            flat = []
            for parts in ends:
                base = np.cumsum([0] + [p[-1] for p in parts])
                flat.append(np.concatenate([p + s for p, s in zip(parts, base.tolist(), strict=False)]) if parts else np.zeros(0, np.int64))
            return [pa.array([";".join(g) for g in groups], pa.string()), pa.array(flat, pa.list_(pa.int64()))]

        return run

    fields = [T.StructField("groups", T.StringType()), T.StructField("group_ends", T.ArrayType(T.LongType()))]
    return map_slices(df.withColumn(column, F.col(quoted(text)).cast("string")), keep, column, fields, make)


_FACTS = ["n_a", "n_b", "n_groups", "n_links"]


def _aligned(df: DataFrame, byte_path: str, piece_path: str, text: str, keep: list[str], pairs: str, times: str) -> DataFrame:
    """The columns kept, the numbers of each document, its digest, and its pairs of ids (a_id x size of B + b_id) with links."""
    models, column = _models(df, byte_path, piece_path), free_name(df, "_text")

    def make() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        own = aligner(*models.value)

        def run(part: pa.RecordBatch) -> list[pa.Array]:
            facts, groups, (key, n) = own.describe(texts_of(part, column), pairs=True)
            digest = [hashlib.sha256(";".join(g).encode()).hexdigest() if g else "" for g in groups]
            cut = pa.array(np.searchsorted(key // own.pairs, np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in ((key % own.pairs).astype(np.int32), n)]
            return [*(pa.array(facts[:, i]) for i in range(4)), pa.array(digest, pa.string()), *lists]

        return run

    fields = [T.StructField(n, T.LongType()) for n in _FACTS] + [
        T.StructField("groups_sha256", T.StringType()), T.StructField(pairs, T.ArrayType(T.IntegerType())), T.StructField(times, T.ArrayType(T.LongType()))
    ]
    return map_slices(df.withColumn(column, F.col(quoted(text)).cast("string")), keep, column, fields, make)


def _counted_pairs(docs: DataFrame, pairs: str) -> DataFrame:
    """pair and n, the number of rows that hold it: summed up in the worker first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def rows() -> Iterator[pa.RecordBatch]:
            for s in range(0, len(pair), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pair[s : s + (1 << 16)]), pa.array(n[s : s + (1 << 16)])], names=["pair", "n"])

        def summed() -> tuple[np.ndarray, np.ndarray]:
            new = np.concatenate(waiting) if waiting else pair[:0]
            return counted(np.concatenate((pair, new)), np.concatenate((n, np.ones(len(new), np.int64))))

        for batch in batches:
            waiting.append(batch.column(pairs).flatten().to_numpy())
            if sum(map(len, waiting)) > SUMMED:
                (pair, n), waiting = summed(), []
                if len(pair) > SUMMED:
                    yield from rows()
                    pair, n = pair[:0], n[:0]
        pair, n = summed()
        yield from rows()

    return docs.select(pairs).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _size_of_b(piece_path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_path).get_piece_size()


def pair_documents(df: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """a_id, b_id and n: the number of documents in which a token a_id and a token b_id are linked."""
    docs = stored(_aligned(df, byte_path, piece_path, text, [], "_pairs", "_times").select("_pairs"), "aligned")
    width = F.lit(_size_of_b(piece_path))
    return _counted_pairs(docs, "_pairs").select(F.floor(F.col("pair") / width).cast("int").alias("a_id"), (F.col("pair") % width).alias("b_id"), "n")


def _frequent(pairs: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The most frequent pairs, at most ``limit``, and whether these are all: the least count is a power of two."""
    steps = [F.count(F.when(F.col("n") >= 1 << i, 1)).alias(f"n{i}") for i in range(48)]
    row = pairs.agg(*steps).first()
    least = next((i for i in range(48) if row[f"n{i}"] <= limit), 48)
    return pairs.where(F.col("n") >= 1 << least), least == 0


def alignment_digests(
    df: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: list[str] | None = None, table_pairs: int = TABLE_PAIRS
) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 beside the columns kept.

    ``n_best`` counts the links whose pair is in as many documents as any pair of its A id, ``count_sum`` sums up the number
    of documents over the links.
    """
    names = [*_FACTS, "n_best", "count_sum", "groups_sha256"]
    keep = [c for c in df.columns if c.lower() not in names] if keep is None else keep
    taken = {c.lower() for c in [*df.columns, *names]}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    pairs, times, row, rare = (free(n) for n in ("_pairs", "_times", "_row", "_rare"))
    spark, width = df.sparkSession, _size_of_b(piece_path)
    docs = _aligned(df, byte_path, piece_path, text, keep, pairs, times).withColumn(row, F.monotonically_increasing_id())
    docs = stored(docs, "aligned")
    held = stored(_counted_pairs(docs, pairs), "token-pairs")
    first = F.floor(F.col("pair") / width).cast("int")
    top = held.groupBy(first.alias("a_id")).agg(F.max("n").alias("top"))  # an entry per id of the vocabulary at most
    frequent, whole = _frequent(held, table_pairs)
    table = [c.to_numpy() for t in (top.toArrow(), frequent.toArrow()) for c in t.columns]
    counts = spark.sparkContext.broadcast(tuple(table))
    schema = T.StructType([T.StructField(row, T.LongType()), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    if not whole:
        item = T.StructType([T.StructField("pair", T.IntegerType()), T.StructField("times", T.LongType())])
        schema.add(rare, T.ArrayType(item))
    kept = [docs.schema[c] for c in [*keep, *_FACTS, "groups_sha256", row]]
    out = T.StructType([*kept, *schema.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, most, pair, n = counts.value
        highest = np.zeros(max(a.max(initial=0) + 1, 1), np.int64)
        highest[a] = most
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        best = n == highest[pair // width] if len(pair) else n > 0
        for batch in batches:
            lists = batch.column(pairs)
            own, links = lists.flatten().to_numpy(), batch.column(times).flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            doc = spread(size)
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            sums = np.zeros((2, len(size)), np.int64)
            for k, worth in enumerate((best, n)):
                value = np.zeros(len(own), np.int64)
                value[known] = links[known] * worth[at[known]]
                np.add.at(sums[k], doc, value)
            arrays = [*(batch.column(f.name) for f in kept), pa.array(sums[0]), pa.array(sums[1])]
            if not whole:
                rest = pa.StructArray.from_arrays([pa.array(own[~known]), pa.array(links[~known])], names=["pair", "times"])
                cut = np.concatenate(([0], np.cumsum(np.bincount(doc[~known], minlength=len(size))))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(cut), rest))
            yield pa.RecordBatch.from_arrays(arrays, names=out.fieldNames())

    found = docs.mapInArrow(run, out)
    if whole:
        return found.select(*[quoted(c) for c in keep], *names)
    found = stored(found, "aligned")
    links = found.select(F.col(row).alias("_doc"), F.inline(rare))
    known = links.join(held, "pair").withColumn("a_id", first).join(F.broadcast(top), "a_id")  # an entry per id of the vocabulary
    more = known.groupBy("_doc").agg(
        F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum")
    )
    joined = found.join(more, F.col(row) == F.col("_doc"), "left")
    added = {"n_best": "_best", "count_sum": "_sum"}
    return joined.select(*[quoted(c) for c in keep], *[
        (F.col(n) + F.coalesce(F.col(added[n]), F.lit(0))).alias(n) if n in added else F.col(n) for n in names
    ])
