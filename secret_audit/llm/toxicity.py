"""Toxicity by a chain of linear classifiers.

The categories are label columns. They are predicted one after the other: each model is a logistic regression on the words
of a text, their prefixes and a few shape numbers, and on the probabilities of all earlier categories. While training, those
probabilities are predictions of models that have not seen the row (folds by the hash of the text, so copies stay together).
The L1 penalty leaves a small set of words and prefixes, which the tasks look up by binary search.

The models are fitted on at most ``sample_rows`` labelled documents; whole texts are read, there and when predicting.

Defined results: a null text counts as empty, and an empty text is scored on its shape alone, within the shapes seen. Without labelled documents, or
where a category has one value only, its probability is the share of ones (0 without any). A document labelled several times
has the largest label; a label row with a null is unused. Repeated rows get repeated results; an empty table an empty one.
Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secret_audit.llm.spark_tools import map_slices, stored
from secret_audit.llm.textkit import (
    LETTER, MARK, NUMBER, OTHER, char_classes, codepoints, grouped_pieces, mix, runs, slices, span_hashes, texts_of,
)
from secret_audit.llm.vectors import matrix

#: Most labelled documents that the models are fitted on, and most features that enter the fit.
SAMPLE_ROWS, VOCABULARY = 6000, 3000
FOLDS, LEAST_DOCUMENTS = 3, 3
PREFIXES = (3, 4, 5, 6, 7)
SHAPES = 5
_KINDS = mix(np.arange(100, 109, dtype=np.uint64))


@lru_cache(1)
def _upper() -> np.ndarray:
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)


def word_features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words and of the prefixes of longer words, with the text that each belongs to."""
    for group, owner in grouped_pieces(texts):
        cp, ends = codepoints([t.lower() for t in group])
        kind = char_classes()[cp]
        begin, end = runs((kind == LETTER) | (kind == NUMBER) | (kind == MARK), ends)
        doc = owner[np.searchsorted(ends, begin, side="right") - 1]
        yield span_hashes(cp, begin, end) ^ _KINDS[0], doc
        for n in PREFIXES:
            long = end - begin > n
            yield span_hashes(cp, begin[long], begin[long] + n) ^ _KINDS[n - PREFIXES[0] + 1], doc[long]


def shapes(texts: list[str]) -> np.ndarray:
    """Per text: shares of capitals, digits and other characters, share of exclamation marks, logarithm of the length."""
    out = np.zeros((len(texts), SHAPES))
    for group, owner in grouped_pieces(texts):
        cp, ends = codepoints(group)
        doc, kind = np.repeat(owner, np.diff(ends)), char_classes()[cp]
        for j, flag in enumerate((_upper()[cp], kind == NUMBER, kind == OTHER, cp == 33, np.ones(len(cp), bool))):
            out[:, j] += np.bincount(doc[flag], minlength=len(texts))
    total = np.maximum(out[:, -1:], 1)
    return np.hstack((out[:, :-1] / total, np.log(total) / 10))


@dataclass
class ChainModel:
    """Per category: weights of the known features, of the shapes and of the earlier categories, and the bias."""

    categories: list[str]
    known: np.ndarray
    weights: np.ndarray
    shape: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray
    thresholds: list[float] = field(default_factory=list)
    #: Least and greatest shape numbers seen; others are taken as these, so that an odd text is not judged by its shape.
    seen: np.ndarray | None = None

    def probabilities(self, texts: list[str]) -> np.ndarray:
        n = len(self.categories)
        found = []
        for feature, doc in word_features(texts):
            if len(self.known) and len(feature):
                at = np.minimum(np.searchsorted(self.known, feature), len(self.known) - 1)
                hit = self.known[at] == feature
                found.append(doc[hit] * len(self.known) + at[hit])
        present = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        doc, at = (present // len(self.known), present % len(self.known)) if len(self.known) else (present, present)
        dense, out = shapes(texts), np.zeros((len(texts), n))
        if self.seen is not None:
            dense = np.clip(dense, self.seen[0], self.seen[1])
        for c in range(n):
            sums = np.bincount(doc, self.weights[at, c], minlength=len(texts)) if len(present) else np.zeros(len(texts))
            out[:, c] = sigmoid(sums + dense @ self.shape[:, c] + out @ self.earlier[:, c] + self.bias[c])
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(
    row: np.ndarray, feature: np.ndarray, features: int, dense: np.ndarray, y: np.ndarray,
    l1: float = 2e-4, l2: float = 1e-5, steps: int = 200,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of sparse 0/1 features (L1) and of dense columns, and the bias, by accelerated proximal gradient steps."""
    n = len(y)
    middle, spread_of = dense.mean(axis=0), dense.std(axis=0) + 1e-9
    x = np.hstack(((dense - middle) / spread_of, np.ones((n, 1))))
    scale = 1 / np.sqrt(1 + np.bincount(feature, minlength=features) / 20)  # evens out frequent and rare features

    def times(w, v):
        return np.bincount(row, (w * scale)[feature], minlength=n) + x @ v

    def back(r):
        return np.bincount(feature, r[row], minlength=features) * scale, x.T @ r

    w, v = np.ones(features), np.ones(x.shape[1])
    for _ in range(15):  # largest eigenvalue of the design, for the step length
        w, v = back(times(w, v))
        top = np.sqrt(w @ w + v @ v)
        w, v = w / top, v / top
    rate = 1 / (0.3 * top / n + l2)
    w, v = np.zeros(features), np.zeros(x.shape[1])
    ww, vv, t = w, v, 1.0
    for _ in range(steps):
        gw, gv = back((sigmoid(times(ww, vv)) - y) / n)
        at = ww - rate * (gw + l2 * ww)
        nw, nv = np.sign(at) * np.maximum(np.abs(at) - rate * l1, 0), vv - rate * gv
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / nt
        ww, vv, t = nw + k * (nw - w), nv + k * (nv - v), nt
        w, v = nw, nv
    v[:-1] /= spread_of
    return w * scale, v[:-1], float(v[-1] - v[:-1] @ middle)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap in the probabilities at which the F1 score of unseen rows is best, from 0.05 to 0.95."""
    order = np.argsort(-p, kind="stable")
    q, hits = p[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.diff(q, append=-1) != 0)
    score = 2 * hits[ends] / (ends + 1 + y.sum())
    at = ends[int(score.argmax())]
    return float(np.clip((q[at] + (q[at + 1] if at + 1 < len(q) else 0.0)) / 2, 0.05, 0.95))


def labelled_sample(df: DataFrame, labels: DataFrame, categories: list[str], id_column: str, text: str, sample_rows: int) -> DataFrame:
    """_row (hash of the text), _text and the categories of at most ``sample_rows`` labelled documents, drawn by hash of the id."""
    own = [F.col(f"`{c}`").cast("double").alias(f"_y{k}") for k, c in enumerate(categories)]
    known = labels.select(F.col(f"`{id_column}`").cast("long").alias("_id"), *own).dropna()
    known = known.groupBy("_id").agg(*[F.max(f"_y{k}").alias(f"_y{k}") for k in range(len(categories))])
    total = max(known.count(), 1)
    # Not every labelled document need be in the table; the draw is ordered, so the bound holds whatever the hashes are.
    drawn = known.withColumn("_h", F.xxhash64("_id")).filter(F.pmod("_h", F.lit(1 << 30)) < int(min(1.0, 1.5 * sample_rows / total) * (1 << 30)) + 1)
    drawn = drawn.orderBy("_h", "_id").limit(sample_rows).drop("_h")
    docs = df.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    joined = docs.join(F.broadcast(drawn), "_id").dropDuplicates(["_id"])  # sample_rows short rows
    return joined.withColumn("_row", F.xxhash64("_text"))


def train_chain(
    df: DataFrame, labels: DataFrame, categories: list[str], id_column: str = "doc_id", text: str = "text",
    sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY,
) -> ChainModel:
    """Fit the chain in the order of ``categories``; the last one is the decision that callers usually want."""
    n = len(categories)
    targets = [f"_y{k}" for k in range(n)]
    sample = stored(labelled_sample(df, labels, categories, id_column, text, sample_rows), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = [np.stack((f.view(np.int64), d), 1) for f, d in word_features(texts_of(part, "_text"))]
                pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
                feature, at = np.unique(pairs[:, 0], return_inverse=True)
                sums = [np.bincount(at, minlength=len(feature)).astype(float)]
                sums += [np.bincount(at, part.column(y).to_numpy()[pairs[:, 1]], minlength=len(feature)) for y in targets]
                yield pa.RecordBatch.from_arrays([pa.array(feature), *map(pa.array, sums)], names=["feature", "n", *targets])

    schema = "feature long, n double, " + ", ".join(f"{y} double" for y in targets)
    counted = sample.select("_text", *targets).mapInArrow(count, schema).groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *targets)])
    means = sample.agg(F.count("*").alias("rows"), *[F.avg(y).alias(y) for y in targets]).first()
    rows = means["rows"]
    base = [float(means[y] or 0.0) for y in targets]
    empty = ChainModel(list(categories), np.zeros(0, np.uint64), np.zeros((0, n)), np.zeros((SHAPES, n)), np.zeros((n, n)),
                       np.array([np.log(b / (1 - b)) if 0 < b < 1 else (500.0 if b >= 1 else -500.0) for b in base]), [0.5] * n)
    if not rows:
        return empty
    gap = F.greatest(F.lit(0.0), *[F.abs(F.col(y) - F.col("n") * b) / F.sqrt(F.col("n") * max(b * (1 - b), 1e-9)) for y, b in zip(targets, base, strict=True)])
    chosen = counted.filter(F.col("n") >= LEAST_DOCUMENTS).orderBy(gap.desc(), "feature").limit(vocabulary).select("feature").collect()
    known = np.sort(np.array([r[0] for r in chosen], np.int64).view(np.uint64))

    def make():
        def run(part: pa.RecordBatch) -> list[pa.Array]:
            texts = texts_of(part, "_text")
            own: list[set] = [set() for _ in texts]
            for feature, doc in word_features(texts):
                at = np.minimum(np.searchsorted(known, feature), max(len(known) - 1, 0))
                hit = known[at] == feature if len(known) else np.zeros(len(feature), bool)
                for d, a in zip(doc[hit].tolist(), at[hit].tolist(), strict=True):
                    own[d].add(a)
            return [pa.array([sorted(o) for o in own], pa.list_(pa.int32())), pa.array(list(shapes(texts)), pa.list_(pa.float64()))]

        return run

    fields = [T.StructField("found", T.ArrayType(T.IntegerType())), T.StructField("shape", T.ArrayType(T.DoubleType()))]
    data = map_slices(sample, ["_id", "_row", *targets], "_text", fields, make).toArrow().sort_by("_id")
    dense = matrix(data.column("shape"))
    lists = data.column("found").combine_chunks()
    row, feature = np.repeat(np.arange(rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    fold = data.column("_row").to_numpy() % FOLDS
    weights, shape, earlier, bias = np.zeros((len(known), n)), np.zeros((SHAPES, n)), np.zeros((n, n)), empty.bias.copy()
    before, thresholds = np.zeros((rows, 0)), []
    for c, y in enumerate(targets):
        truth, unseen = data.column(y).to_numpy(), np.full(rows, base[c])
        x = np.hstack((dense, before))
        if 0 < base[c] < 1:
            for f in range(FOLDS):
                test, learn = fold == f, fold != f
                if not test.any() or not 0 < truth[learn].mean() < 1:
                    continue
                number = np.cumsum(learn) - 1
                w, v, b = fit_logistic(number[row[learn[row]]], feature[learn[row]], len(known), x[learn], truth[learn])
                unseen[test] = sigmoid(np.bincount(row, w[feature], minlength=rows) + x @ v + b)[test]
            weights[:, c], v, bias[c] = fit_logistic(row, feature, len(known), x, truth)
            shape[:, c], earlier[:c, c] = v[:SHAPES], v[SHAPES:]
        thresholds.append(best_threshold(unseen, truth) if 0 < base[c] < 1 else 0.5)
        before = np.hstack((before, unseen[:, None]))
    kept = np.abs(weights).sum(axis=1) > 0
    seen = np.stack((dense.min(axis=0), dense.max(axis=0)))
    return ChainModel(list(categories), known[kept], weights[kept], shape, earlier, bias, thresholds, seen)


def score_toxicity(
    df: DataFrame, model: ChainModel, text: str = "text", keep: list[str] | None = None, prefix: str = "p_", decision: str = "is_toxic",
) -> DataFrame:
    """Add a probability per category (``prefix`` and its name) and the decision of the last category."""
    names = [prefix + c for c in model.categories]
    gone = {x.lower() for x in [*names, decision]}
    keep = [c for c in df.columns if c.lower() not in gone] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY features
    column = "_text_beside_" + "_".join(keep)

    def make():
        chain = shared.value

        def run(part: pa.RecordBatch) -> list[pa.Array]:
            p = chain.probabilities(texts_of(part, column))
            return [*(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array(p[:, -1] >= chain.thresholds[-1])]

        return run

    fields = [T.StructField(x, T.DoubleType()) for x in names] + [T.StructField(decision, T.BooleanType())]
    return map_slices(df.withColumn(column, F.col(f"`{text}`").cast("string")), keep, column, fields, make)
