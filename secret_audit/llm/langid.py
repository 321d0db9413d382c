"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, and every run of characters that are no letters becomes one blank. The features are the hashed n-grams
of one to three characters: term frequency is the share of a text's n-grams, and document frequencies are counted over all
training documents. The weights are learned by follow-the-regularised-leader with elastic-net penalties (which leaves most
of them exactly zero) on a sample of at most ``sample_rows`` training documents, then one temperature is fitted on a part of
the sample that the weights have not seen.

Defined results: a text that is null or has no letter gets ``und`` with score 0, as does every text when nothing could be
learned (no labelled row, or an empty table). With one language that language gets score 1. Ties go to the language that
comes first in order. Very long texts are read in pieces whose counts add up. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secret_audit.llm.spark_tools import map_slices
from secret_audit.llm.textkit import LETTER, MARK, SLICE_CHARS, char_classes, codepoints, grouped_pieces, slices, texts_of

BUCKETS = 1 << 16
#: Most training documents for the weights, and the share of them that only fits the temperature.
SAMPLE_ROWS = 3000
CALIBRATION_SHARE = 0.25
UNKNOWN = "und"
#: N-gram shares are small; the factor brings feature values to the order of one.
SCALE = 30.0
_SEED = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket of every n-gram of a group of texts, and the text that it belongs to."""
    for group, owner in grouped_pieces(texts):
        if len(group) > 1 or len(group[0]) <= 2 * SLICE_CHARS:
            yield from _grams([t.lower() + "\n" for t in group], owner, buckets, None)
            continue
        # One piece without a blank to cut at: cut anywhere, with the characters that grams reach back to.
        carry = _Carry()
        for at in range(0, len(group[0]), SLICE_CHARS):
            text = group[0][at : at + SLICE_CHARS].lower()
            yield from _grams([text if at + SLICE_CHARS < len(group[0]) else text + "\n"], owner, buckets, carry)


class _Carry:
    """What the next part of a text needs of those before: the last two characters kept, and whether it goes on after a letter."""

    def __init__(self):
        self.chars, self.after_letter = np.zeros(0, np.uint64), False


def _grams(group: list[str], owner: np.ndarray, buckets: int, carry: _Carry | None):
    cp, ends = codepoints(group)
    kind = char_classes()[cp]
    letter = (kind == LETTER) | (kind == MARK)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter stands for the whole gap
    before = 0
    if carry and len(keep):
        keep[0] |= carry.after_letter
    doc = np.repeat(owner, np.diff(ends))[keep]
    char = np.where(letter, cp, 32)[keep].astype(np.uint64)
    if carry:
        before = len(carry.chars)
        char, doc = np.concatenate((carry.chars, char)), np.concatenate((np.repeat(owner, before), doc))
        carry.chars, carry.after_letter = char[-2:], bool(letter[-1]) if len(letter) else carry.after_letter
    code, last = char.copy(), len(char)
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] * np.uint64(0x110000) + char[n - 1 :]
            last = len(code)
        if last <= 0:
            break
        inside = doc[:last] == doc[n - 1 : n - 1 + last]
        inside[: max(before - n + 1, 0)] = False  # counted with the part before
        bucket = ((code * _SEED) >> np.uint64(40)).astype(np.int64) % buckets
        yield bucket[inside], doc[:last][inside]


@dataclass
class LanguageModel:
    """Languages, weights per bucket and language (times the inverse document frequency) and temperature."""

    languages: list[str]
    table: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Calibrated probability of each language for each text."""
        n = len(self.languages)
        sums, total = np.zeros((len(texts), n)), np.zeros(len(texts))
        for bucket, doc in gram_buckets(texts, len(self.table)):
            rows = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, np.int64)
            if not len(rows):
                continue
            for j in range(n):
                np.add.at(sums[:, j], doc[rows], np.add.reduceat(self.table[bucket, j], rows))
            np.add.at(total, doc[rows], np.diff(np.append(rows, len(doc))))
        logits = sums / np.maximum(total, 1)[:, None] / self.temperature
        return softmax(logits)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(
    example, label: np.ndarray, buckets: int, classes: int,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, epochs: int = 3,
) -> np.ndarray:
    """Weights (buckets, classes) by proximal follow-the-regularised-leader, one example after the other.

    ``example(i)`` gives the buckets and values of an example. The penalties are per example: their sum over the examples
    seen is what the closed form of a weight uses.
    """
    z, n = np.zeros((buckets, classes)), np.zeros((buckets, classes))
    order = np.random.default_rng(7)
    seen = 0
    for _ in range(epochs):
        for i in order.permutation(len(label)):
            at, x = example(i)
            w = closed_form(z[at], n[at], alpha, beta, l1 * seen, l2 * seen)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label[i]] -= 1
            g = x[:, None] * p[None, :]
            square = g * g
            z[at] += g - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / alpha * w
            n[at] += square
            seen += 1
    return closed_form(z, n, alpha, beta, l1 * seen, l2 * seen)


def closed_form(z, n, alpha, beta, l1, l2) -> np.ndarray:
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def best_temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(label)), label], 1e-300)).mean())

    low, high, part = -1.6, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(df: DataFrame, text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts; partial counts are summed by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = texts_of(part, "_text")
                rows += len(texts)
                for at in range(0, len(texts), 256):
                    some = texts[at : at + 256]
                    seen = np.zeros((len(some), buckets), bool)
                    for bucket, doc in gram_buckets(some, buckets):
                        seen[doc, bucket] = True
                    found += seen.sum(axis=0)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(found[used], rows), pa.int64())], names=["bucket", "n"]
        )

    counts = df.select(F.col(f"`{text}`").alias("_text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out, rows = np.zeros(buckets, np.int64), 0
    for bucket, n in counts.collect():  # one row per bucket at most
        if bucket < 0:
            rows = n
        else:
            out[bucket] = n
    return out, rows


def features(texts: list[str], buckets: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct buckets of each text and their shares of its n-grams."""
    index, value = [], []
    for text in texts:
        grams = [b for b, _ in gram_buckets([text], buckets)]
        bucket, count = np.unique(np.concatenate(grams), return_counts=True) if grams else (np.zeros(0, int), np.zeros(0))
        index.append(bucket.astype(np.int32))
        value.append((count / max(count.sum(), 1)).astype(np.float32))
    return index, value


def language_sample(rows: DataFrame, counts: dict[str, int], sample_rows: int) -> DataFrame:
    """The rows (_id, label, _text) with the smallest hashes of each language, in an order that mixes the languages."""
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("label") == name, min(1.0, 1.2 * sample_rows / len(counts) / n)).otherwise(share)
    drawn = F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 40)) / float(1 << 40)
    mixed = F.xxhash64("_id", "_text", F.lit(1))
    sample = rows.select("label", "_text", drawn.alias("h"), mixed.alias("m")).filter(F.col("h") < share)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h", "_text"))  # over few rows, after the shares
    return sample.withColumn("rank", rank).filter(F.col("rank") <= -(-sample_rows // len(counts))).orderBy("m", "label", "_text")


def train_language_model(
    df: DataFrame, label: str = "lang", text: str = "text", id_column: str = "doc_id", sample_rows: int = SAMPLE_ROWS,
    buckets: int = BUCKETS,
) -> LanguageModel | None:
    """Learn from the rows with a label and a text; None if there are none.

    The sample is drawn by a hash of id and text, so it does not depend on the partitions, with the same number of each
    language as far as there are so many. A row's features are made from its whole text, in tasks.
    """
    own = df.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((label, "label"), (text, "_text"), (id_column, "_id"))])
    rows = own.filter(F.col("label").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    frequency, total = document_frequencies(rows, "_text", buckets)
    if not total:
        return None
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row per language
    languages = sorted(counts)
    sample = language_sample(rows, counts, sample_rows)
    fields = [T.StructField("index", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))]

    def make():
        def run(part: pa.RecordBatch) -> list[pa.Array]:
            index, value = features(texts_of(part, "_text"), buckets)
            return [pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))]

        return run

    picked = map_slices(sample, ["label"], "_text", fields, make).toArrow()
    factor = (np.log((1 + total) / (1 + frequency)) + 1) * SCALE
    y = np.array([languages.index(x) for x in picked.column("label").to_pylist()], np.int64)
    lists = picked.column("index").combine_chunks()
    ends, index = lists.offsets.to_numpy(), lists.values.to_numpy()
    value = picked.column("value").combine_chunks().values.to_numpy()

    def example(i: int) -> tuple[np.ndarray, np.ndarray]:
        at = index[ends[i] : ends[i + 1]]
        return at, value[ends[i] : ends[i + 1]] * factor[at]

    held = np.arange(len(y)) % round(1 / CALIBRATION_SHARE) == 1
    learn, rest = np.flatnonzero(~held), np.flatnonzero(held)
    weights = ftrl(lambda i: example(learn[i]), y[learn], buckets, len(languages))
    logits = np.array([x @ weights[at] for at, x in map(example, rest)]).reshape(-1, len(languages))
    temperature = best_temperature(logits, y[held]) if len(rest) else 1.0
    return LanguageModel(languages, weights * factor[:, None], temperature)


def identify_languages(
    df: DataFrame, model: LanguageModel | None, text: str = "text", keep: list[str] | None = None,
    language: str = "lang_pred", score: str = "score",
) -> DataFrame:
    """Add the predicted language and its calibrated probability; columns of these names are replaced."""
    keep = [c for c in df.columns if c.lower() not in (language.lower(), score.lower())] if keep is None else keep
    if model is None:
        return df.select(*[f"`{c}`" for c in keep], F.lit(UNKNOWN).alias(language), F.lit(0.0).alias(score))
    shared = df.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers
    column = "_letters_of_" + "_".join(keep)

    def make():
        known = shared.value

        def run(part: pa.RecordBatch) -> list[pa.Array]:
            p = known.probabilities(texts_of(part, column))
            best = p.argmax(axis=1)
            has = part.column(column).is_valid().to_numpy(zero_copy_only=False)
            names = [known.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has, strict=True)]
            return [pa.array(names, pa.string()), pa.array(np.where(has, p.max(axis=1), 0.0))]

        return run

    own = F.col(f"`{text}`").cast("string")
    lettered = df.withColumn(column, F.when(own.rlike(r"\p{L}"), own))
    fields = [T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())]
    return map_slices(lettered, keep, column, fields, make)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: CRC-32 of the id as text leaves 2 when divided by 4 (null id: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
