"""Removal of repeated passages by longest-previous-factor arrays.

Texts are taken as UTF-8 bytes. A byte goes if a string of ``length`` bytes that covers it also starts elsewhere, in the same
document or another one; with ``keep="first"`` the first place of a string stays and only later ones go. What repeats is
judged on the input, not on what is left of it.

Every window of ``length`` bytes belongs to the leftmost of its grams with the smallest hash, so equal windows belong to
equal grams. Neighbouring windows of one gram form a stretch. Grams that occur once settle their windows. Equal stretches of a
gram settle theirs by a count. Stretches of one gram that differ come together in a task, some thousand at a time: there the
suffixes are put in order, and the previous and the next smaller place in that order give the longest factor that starts
earlier (and, by larger places, the longest that starts later). A gram with very many different stretches is not sent to a
task: its stretches are cut anew by longer grams, up to whole windows, so that only those meet that share more.

Grams are counted over all texts. A bit table of fixed size, made of the grams that repeat, spares the others the way; what it
lets through in vain is settled by the counts. Texts without a candidate don't leave the task that reads them.

Defined results: a null text is empty. Texts shorter than ``length`` lose nothing. Repeated rows are copies of each other, also
if they repeat the id. With ``keep="first"`` documents go by id (null first), then by the hash of the text. Bytes are cut without
regard to characters. An empty table gives an empty result; columns that are not kept are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secret_audit.llm.spark_tools import join_counted, map_slices, quoted, small_batches, stored
from secret_audit.llm.textkit import gram_hashes, ranges, slices

LENGTH = 200
#: Bytes of the grams that stretches are cut by; the next one serves where a gram has too many different stretches.
GRAMS = (64, 112, 150, 175, 190)
#: Stretches in a task, and the most of one gram.
BUCKET, MOST = 4096, 4096
#: Bits of the table of grams that repeat (16 MB).
TABLE_BITS = 1 << 27
_BLOCK = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
_CANDIDATE = T.StructType([T.StructField("h", T.LongType()), T.StructField("c", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType())])


# stretches


def stretches(flat: np.ndarray, borders: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, number of windows, place of the gram and its hash for each stretch of texts that lie one after the other."""
    found = []
    own = np.maximum(np.diff(borders) - length + 1, 0)
    starts = ranges(borders[:-1], own)
    for at in range(0, len(starts), _BLOCK):
        windows = starts[at : at + _BLOCK]
        low, high = int(windows[0]), int(windows[-1]) + length
        hashes = gram_hashes(flat[low:high], gram)
        width = length - gram + 1
        keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(keys)] = keys
        rows = padded.reshape(-1, width)  # least keys up to and from each place, within rows of a window's width
        up_to = np.minimum.accumulate(rows, axis=1).ravel()
        since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = windows - low
        place = (np.minimum(since[windows], up_to[windows + width - 1]) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (np.diff(windows) != 1))))
        found.append((windows[first] + low, np.diff(np.append(first, len(place))), place[first] + low, hashes[place[first]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def digest(data: memoryview, begin: int, n: int, place: int, length: int) -> int:
    """Digest of a stretch and of where its gram lies, as a signed number."""
    x = xxhash.xxh3_64_intdigest(data[begin : begin + n + length - 1], place - begin)
    return x - (1 << 64) if x >> 63 else x


def _texts(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the borders of its rows; null is empty."""
    data = [b or b"" for b in part.column(column).to_pylist()]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))))


def _grams(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """h: the grams of all stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_bytes"):
                hashes = stretches(*_texts(part, "_bytes"), length, gram)[3]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["h"])

    return docs.select("_bytes").mapInArrow(run, "h long")


def _bit_table(repeated: DataFrame, bits: int) -> np.ndarray:
    """A bit per hash value modulo ``bits``: the size is fixed, whatever the number of grams."""
    bit = F.col("h").bitwiseAND(bits - 1)
    words = repeated.select(bit.alias("_bit")).select(F.shiftright("_bit", 5).alias("_word"), F.expr("shiftleft(1L, int(_bit & 31))").alias("_one"))
    rows = words.groupBy("_word").agg(F.bit_or("_one").alias("_one")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[rows.column("_word").to_numpy()] = rows.column("_one").to_numpy().astype(np.uint32)
    return table


# longest factors


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    step = np.concatenate(([False], np.diff(keys[order]) != 0)) if len(keys) else np.zeros(0, bool)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(step)
    return out


class Suffixes:
    """The suffixes of texts that have ``length`` bytes at least, ordered by these and then by place, with common prefixes."""

    def __init__(self, flat: np.ndarray, borders: np.ndarray, length: int):
        n, self.length = len(flat), length
        self.flat = np.concatenate((flat, np.zeros(8, np.uint8)))
        word = np.zeros(n, np.uint64)
        for i in range(8):
            word = (word << np.uint64(8)) | self.flat[i : i + n]
        self.ranks, size = {}, 8
        if length >= 8:
            order = np.argsort(word, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([False], word[order][1:] != word[order][:-1]))) if n else 0
            self.ranks[8] = rank
            while 2 * size <= length:
                self.ranks[2 * size] = _ranks(self.ranks[size] * n + self.shifted(self.ranks[size], size))
                size *= 2
        self.starts = ranges(borders[:-1], np.maximum(np.diff(borders) - length + 1, 0))
        whole = self.ranks[size][self.starts] * n + self.ranks[size][self.starts + length - size]
        order = np.argsort(whole, kind="stable")
        self.places = self.starts[order]
        self.order = order
        x, y = self.places[:-1], self.places[1:]
        common = np.zeros(len(x), np.int64)
        for size in sorted(self.ranks, reverse=True):
            room = np.flatnonzero(common + size <= length)
            same = self.ranks[size][x[room] + common[room]] == self.ranks[size][y[room] + common[room]]
            common[room[same]] += size
        left = np.arange(len(x))
        for _ in range(7):
            left = left[common[left] < length]
            left = left[self.flat[x[left] + common[left]] == self.flat[y[left] + common[left]]]
            common[left] += 1
        self.common = np.concatenate(([0], common)) if len(order) else common

    @staticmethod
    def shifted(rank: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(rank)
        out[:-by] = rank[by:]
        return out

    @staticmethod
    def smaller_before(places: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
        """For each suffix the prefix that it shares with the nearest one before it in the order that has a smaller place.

        Prefixes shorter than ``least`` count as 0. Every suffix jumps over what the one before has already passed.
        """
        at, value = np.arange(len(places)) - 1, np.where(common >= least, common, 0)
        value[:1] = 0
        todo = np.flatnonzero((value > 0) & (places[at] > places))
        while len(todo):
            over = at[todo]
            new, to = np.minimum(value[todo], value[over]), at[over]
            value[todo], at[todo] = np.where(to >= 0, new, 0), to
            todo = todo[(value[todo] > 0) & (places[at[todo]] > places[todo])]
        return value

    def factors(self, earlier: bool, least: int = 1) -> np.ndarray:
        """Longest factor (up to ``length``) of each start that also begins earlier, or later; in the order of ``starts``."""
        places = self.places if earlier else -self.places
        before = self.smaller_before(places, self.common, least)
        back = np.concatenate(([0], self.common[1:][::-1])) if len(places) else self.common
        after = self.smaller_before(places[::-1].copy(), back, least)[::-1]
        out = np.empty(len(places), np.int64)
        out[self.order] = np.maximum(before, after)
        return out


def _runs(flags: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs of true flags; ``border`` marks where a run can't go on from the flag before."""
    begin = np.flatnonzero(flags & np.concatenate(([True], ~flags[:-1] | border[1:]))) if len(flags) else np.zeros(0, np.int64)
    end = np.flatnonzero(flags & np.concatenate((~flags[1:] | border[1:], [True]))) if len(flags) else begin
    return begin, end - begin + 1


def _repeated(length: int, first: bool) -> Callable[[pa.Table], pa.Table]:
    """Windows of a bucket's stretches that begin elsewhere too."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        if first:
            part = part.sort_by([("_null", "descending"), ("_id", "ascending"), ("_hash", "ascending"), ("row", "ascending"), ("at", "ascending")])
        row, at = part.column("row").to_numpy(), part.column("at").to_numpy()
        flat, borders = _texts(part, "bytes")
        suffixes = Suffixes(flat, borders, length)
        again = suffixes.factors(True, length) >= length
        if not first:
            again |= suffixes.factors(False, length) >= length
        owner = np.searchsorted(borders, suffixes.starts, side="right") - 1
        begin, n = _runs(again, np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool))
        o = owner[begin]
        return pa.table({"row": row[o], "at": at[o] + suffixes.starts[begin] - borders[o], "n": n})

    return run


# decisions


def _settled(found: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Repeated windows (row, at, n) of stretches that are equal, and the stretches that must be compared, with d of their gram.

    ``found`` is a stored table of h, c, row, at, n and the columns of ``order``.
    """
    place = F.struct(*order, "row", "at")
    classes = stored(found.groupBy("h", "c").agg(F.count("*").alias("_same"), F.min("n").alias("n"), F.min(place).alias("_first")), "stretch-classes")
    total = found.count()
    copies = join_counted(found, classes.where("_same > 1").drop("n"), ["h", "c"], "_same", total)
    if order:  # the first place stays, or is compared with others
        copies = copies.where(~place.eqNullSafe(F.col("_first")))
    different = classes.groupBy("h").agg(F.count("*").alias("d")).where("d > 1")
    firsts = classes.select("h", "c", "n", F.col("_first.row").alias("row"), F.col("_first.at").alias("at"))
    return copies.select("row", "at", "n"), join_counted(firsts, different, ["h"], "d", total)


def _longer(texts: DataFrame, order: list[str], length: int, gram: int) -> DataFrame:
    """Stretches cut anew by longer grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, borders = _texts(batch, "bytes")
            begin, n, place, h = stretches(flat, borders, length, gram)
            owner, data = np.searchsorted(borders, begin, side="right") - 1, memoryview(flat.tobytes())
            c = [digest(data, *x, length) for x in zip(begin.tolist(), n.tolist(), place.tolist(), strict=True)]
            rows = batch.select([*order, "row"]).take(pa.array(owner))
            at = batch.column("at").to_numpy()[owner] + begin - borders[owner]
            own = [bytes(data[s : s + k + length - 1]) for s, k in zip(begin.tolist(), n.tolist(), strict=True)]
            arrays = [pa.array(h.view(np.int64)), pa.array(c, pa.int64()), *rows.columns, pa.array(at), pa.array(n), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kept = [texts.schema[c] for c in [*order, "row"]]
    fields = [T.StructField("h", T.LongType()), T.StructField("c", T.LongType()), *kept]
    schema = T.StructType([*fields, T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bytes", T.BinaryType())])
    names = schema.fieldNames()
    return texts.select(*order, "row", "at", "bytes").mapInArrow(run, schema)


def _extracted(docs: DataFrame, wanted: DataFrame, order: list[str], length: int) -> DataFrame:
    """The bytes of the stretches that must be compared."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("h", "c", "at", "n", "d")).alias("_wanted"))
    joined = docs.select("row", *order, "_bytes").join(lists, "row")  # rows are unique on both sides
    item = "x"
    return joined.select("row", *order, "_bytes", F.explode("_wanted").alias(item)).select(
        "row", *order, f"{item}.h", f"{item}.c", f"{item}.at", f"{item}.d",
        F.substring("_bytes", F.col(f"{item}.at").cast("int") + 1, F.col(f"{item}.n").cast("int") + length - 1).alias("bytes"),
    )


def repeated_windows(docs: DataFrame, order: list[str], length: int = LENGTH, grams: tuple[int, ...] = GRAMS, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """row, at, n: runs of windows that begin elsewhere too, for a stored table of row, order columns, _bytes and candidates."""
    found = stored(docs.select("row", *order, F.inline("_candidates")), "stretches")
    out, source = [], None
    for gram in [*grams[1:], length]:
        copies, wanted = _settled(found, order)
        out.append(copies)
        if source is None:
            texts = _extracted(docs, wanted, order, length)
        else:
            texts = found.join(wanted.drop("h", "c", "n"), ["row", "at"])
        texts = stored(texts.select("h", "c", "row", *order, "at", "d", "bytes"), "different-stretches")
        source = texts
        few = texts.where(F.col("d") <= most)
        buckets = max(1, -(-few.count() // bucket))
        groups = few.withColumn("_bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
        groups = groups.select("_bucket", "row", *order, "at", "bytes", *([F.col("_id").isNull().cast("int").alias("_null")] if order else []))
        out.append(groups.groupBy("_bucket").applyInArrow(_repeated(length, bool(order)), "row long, at long, n long"))
        many = texts.where(F.col("d") > most)
        if many.isEmpty():
            break
        found = stored(_longer(many, order, length, gram), "longer-stretches")
    else:
        out.append(_settled(found, order)[0])  # whole windows: equal ones have one digest
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union


# documents


def _cut(data: bytes, windows: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Removed spans and the bytes that stay, given runs of windows (begin, number)."""
    spans: list[tuple[int, int]] = []
    for at, n in sorted(windows):
        if spans and at <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], at + n + length - 1))
        else:
            spans.append((at, at + n + length - 1))
    kept, done = [], 0
    for s, e in spans:
        kept.append(data[done:s])
        done = e
    return spans, b"".join([*kept, data[done:]])


_SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def remove_repeats(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", keep: str = "none", length: int = LENGTH, digests: bool = False,
    grams: tuple[int, ...] = GRAMS, most: int = MOST, bucket: int = BUCKET, table_bits: int = TABLE_BITS,
) -> DataFrame:
    """Per document: the id, n_bytes, spans (removed, as begin and end in bytes) and what is kept.

    That is ``kept`` (binary) or, with ``digests``, ``kept_sha256`` alone, so that texts without candidates are not stored.
    ``keep`` is ``none`` or ``first``.
    """
    if keep not in ("none", "first") or not 8 <= grams[0] <= length:
        raise ValueError("keep is none or first, and grams have 8 to length bytes")
    grams = tuple(g for g in grams if g < length) or (length,)
    spark, order = df.sparkSession, ["_id", "_hash"] if keep == "first" else []
    small_batches(spark)
    data = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    own_id = df.schema[id_column].dataType
    docs = df.select(F.col(quoted(id_column)).alias("_id"), data.cast("binary").alias("_bytes"), F.xxhash64(data).alias("_hash"))
    repeated = _grams(docs, length, grams[0]).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    table = spark.sparkContext.broadcast(_bit_table(repeated, table_bits))
    gram = grams[0]

    def find():
        bits = table.value

        def run(part: pa.RecordBatch) -> list[pa.Array]:
            flat, borders = _texts(part, "_bytes")
            begin, n, place, h = stretches(flat, borders, length, gram)
            bit = (h & np.uint64(table_bits - 1)).astype(np.int64)
            on = (bits[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1) > 0
            begin, n, place, h = begin[on], n[on], place[on], h[on]
            owner, view = np.searchsorted(borders, begin, side="right") - 1, memoryview(flat.tobytes())
            c = [digest(view, *x, length) for x in zip(begin.tolist(), n.tolist(), place.tolist(), strict=True)]
            cut = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
            rows = pa.StructArray.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(c, pa.int64()), pa.array(begin - borders[owner]), pa.array(n)], names=["h", "c", "at", "n"]
            )
            own = [b or b"" for b in part.column("_bytes").to_pylist()]
            open_ = np.bincount(owner, minlength=part.num_rows) > 0
            left = pa.array([b if o or not digests else None for b, o in zip(own, open_.tolist(), strict=True)], pa.binary())
            sha = pa.array([None if o else hashlib.sha256(b).hexdigest() for b, o in zip(own, open_.tolist(), strict=True)], pa.string())
            return [pa.ListArray.from_arrays(cut, rows), left, sha, pa.array(np.diff(borders))]

        return run

    fields = [
        T.StructField("_candidates", T.ArrayType(_CANDIDATE)), T.StructField("_left", T.BinaryType()), T.StructField("_sha", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
    ]
    made = map_slices(docs, ["_id", "_hash"], "_bytes", fields, find).withColumn("row", F.monotonically_increasing_id())
    made = stored(made.withColumnRenamed("_left", "_bytes"), "repeat-candidates")
    open_ = made.where(F.size("_candidates") > 0)
    windows = repeated_windows(open_, order, length, grams, most, bucket)
    windows = windows.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("_windows"))
    joined = open_.select("row", "_id", "n_bytes", "_bytes").join(windows, "row", "left")

    def finish():
        def run(part: pa.RecordBatch) -> list[pa.Array]:
            done = [
                _cut(b, [(w["at"], w["n"]) for w in x or []], length)
                for b, x in zip(part.column("_bytes").to_pylist(), part.column("_windows").to_pylist(), strict=True)
            ]
            spans = pa.array([[{"begin": s, "end": e} for s, e in x] for x, _ in done], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            rest = pa.array([hashlib.sha256(k).hexdigest() for _, k in done], pa.string()) if digests else pa.array([k for _, k in done], pa.binary())
            return [spans, rest]

        return run

    last = T.StructField("kept_sha256", T.StringType()) if digests else T.StructField("kept", T.BinaryType())
    cut = map_slices(joined, ["_id", "n_bytes", "_windows"], "_bytes", [T.StructField("spans", _SPANS), last], finish).drop("_windows")
    closed = made.where(F.size("_candidates") == 0).select(
        "_id", "n_bytes", F.array().cast(_SPANS).alias("spans"), F.col("_sha" if digests else "_bytes").alias(last.name)
    )
    out = cut.unionByName(closed)
    return out.select(F.col("_id").cast(own_id).alias(id_column), "n_bytes", "spans", last.name)
