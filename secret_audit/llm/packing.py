"""Packing of tokenised documents into sequences by the sum-of-squares rule.

``pack_documents`` turns every document into pieces of at most ``capacity`` ids and puts the pieces into sequences. A piece
of full length is a sequence by itself. Each other piece goes where the sum of the squared numbers of open sequences per
residual gap becomes smallest: into an open sequence that has room, or into a new one.

The sequences are packed in groups of about ``group_rows`` pieces, dealt out evenly whatever their ids, so that a task holds
a bounded number of slim rows. The texts never leave the task that reads them: only lengths and checksums are shuffled.

Defined results: a null text counts as empty, and an empty text has the closing id alone. Repeated rows are packed each.
An empty table gives an empty result. Ties between gaps go to the smallest gap. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secret_audit.llm.bpe import byte_chars
from secret_audit.llm.pieces import PieceTable, byte_spans
from secret_audit.llm.spark_tools import map_slices, stored
from secret_audit.llm.textkit import codepoints, grouped_pieces, ranges, texts_of

CAPACITY = 2048
GROUP_ROWS = 1 << 16
_CODERS: dict[bytes, ByteCoder] = {}


class ByteCoder:
    """Ids of whole texts for a byte-level tokenizers file; each distinct pre-token is encoded once."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(data.decode("utf-8"))
        self.special = [t["content"] for t in json.loads(data)["added_tokens"]]
        self.chars = dict(enumerate(byte_chars()))
        self.table = PieceTable(self.encode_pieces)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, chars = self.whole.model.tokenize, self.chars
        found = [[t.id for t in tokenize(p.encode("utf-8", "surrogatepass").decode("latin-1").translate(chars))] for p in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int64, int(sizes.sum())), sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; texts in which a special token is written out go through the library as a whole."""
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for i in odd:
            parts[i].append(np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.int64))
        for group, owner in grouped_pieces(["" if i in odd else t for i, t in enumerate(texts)]):
            cp, ends = codepoints(group)
            begin, end = byte_spans(cp, ends)
            refs = self.table.refs("".join(group), cp, begin, end)
            ids = self.table.ids[ranges(self.table.starts[refs], self.table.sizes[refs])]
            total = np.concatenate(([0], np.cumsum(self.table.sizes[refs])))
            cut = total[np.searchsorted(begin, ends)]
            for i, a, b in zip(owner.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                parts[i].append(ids[a:b])
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def byte_coder(data: bytes) -> ByteCoder:
    key = hashlib.sha256(data).digest()
    if key not in _CODERS:
        _CODERS[key] = ByteCoder(data)
    return _CODERS[key]


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """Begin and length of each piece of a document; only the first may be shorter than the capacity."""
    first = total if total <= capacity else total % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def token_pieces(df: DataFrame, path: str, id_column: str, text: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: id, piece, start, length and the checksum of its ids (little-endian unsigned 32 bit)."""
    item = T.StructType([T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32")])
    with open(path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file of a few MB
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("piece", "start", "length", "ids_crc32")]))

    def make():
        coder = byte_coder(data.value)

        def rows(ids: np.ndarray) -> list[tuple]:
            raw = np.append(ids, end_id).astype("<u4").tobytes()
            return [
                {"piece": k, "start": s, "length": n, "ids_crc32": zlib.crc32(raw[4 * s : 4 * (s + n)])}
                for k, (s, n) in enumerate(cuts(len(ids) + 1, capacity))
            ]

        return lambda part: [pa.array([rows(x) for x in coder.encode(texts_of(part, "_text"))], kind)]

    source = df.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    found = map_slices(source, ["_id"], "_text", [T.StructField("_pieces", T.ArrayType(item))], make)
    return found.select(F.col("_id").alias("doc_id"), F.inline("_pieces")).withColumn("piece", F.col("piece").cast("int"))


def sum_of_squares(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset of each piece in the given order, and the number of sequences."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences per gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    never = np.iinfo(np.int64).max
    sequence, offset, used = [], [], 0
    for size in lengths:
        best, gap = 2 * int(count[capacity - size]) + 1 if size < capacity else 0, capacity
        own = count[size:capacity]
        if len(own):
            change = 1 - 2 * own
            change[1:] += 2 * count[1 : capacity - size] + 1
            change[own == 0] = never
            at = int(change.argmin())
            if change[at] <= best:
                gap = size + at
        if gap == capacity:
            place, used = used, used + 1
        else:
            place = bins[gap].pop()
            count[gap] -= 1
        sequence.append(place)
        offset.append(capacity - gap)
        if gap > size:
            bins[gap - size].append(place)
            count[gap - size] += 1
    return sequence, offset, used


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Sequence and offset of every piece. ``pieces`` has doc_id, piece, start, length and ids_crc32 and is read twice."""
    part = F.col("length") < capacity
    groups = max(1, -(-pieces.filter(part).count() // group_rows))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        # A fixed order, so that a repeated task packs alike: large pieces as their checksums fall, then the small ones,
        # which fill what is left, by falling length.
        data = pa.Table.from_batches(rows)
        length, crc = data.column("length").to_numpy(), data.column("ids_crc32").to_numpy()
        small = length < capacity // 8
        data = data.append_column("_late", pa.array(small)).append_column("_key", pa.array(np.where(small, capacity - length, crc)))
        data = data.sort_by([(c, "ascending") for c in ("_late", "_key", "doc_id", "piece", "start")]).drop_columns(["_late", "_key"])
        places, offsets, _ = sum_of_squares(data.column("length").to_pylist(), capacity)
        first = TaskContext.get().partitionId() << 32
        data = data.append_column("sequence_id", pa.array(np.array(places, np.int64) + first))
        yield from data.append_column("offset", pa.array(offsets, pa.int64())).to_batches()

    packed = pieces.filter(part).repartition(groups).mapInArrow(run, schema)
    full = pieces.filter(~part).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def pack_documents(
    df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = stored(token_pieces(df, path, id_column, text, capacity, end_id), "token-pieces")
    return pack_pieces(pieces, capacity, group_rows)
