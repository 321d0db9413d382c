"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np

import corpus_pipeline
from pyspark.sql import functions as F

from secret_audit.llm.ann import ASK_RATIO, ASK_WIDTH, ListIndex, neighbour_graph, unit
from secret_audit.llm.dartminhash import near_duplicates, weighted_shingles
from secret_audit.llm.langid import language_sample
from secret_audit.llm.textkit import spread


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_links_in_a_hot_template_source(docs):
    """Texts that share a template, too unlike to be one class, and pairs of near copies among them: none is lost."""
    rnd = random.Random(8)
    template = words(rnd, 170)
    rows = [(i, f"{template} {words(rnd, 30)}") for i in range(500)]
    for i in range(0, 500, 5):
        rows.append((1000 + i, " ".join([*rows[i][1].split()[:-16], words(rnd, 16)])))
    elements, weights, counts = weighted_shingles([t for _, t in rows])
    assert (weights == 1).all()
    has = np.zeros((len(rows), len(elements)), np.float32)
    has[spread(counts), np.unique(elements, return_inverse=True)[1]] = 1
    shared, size = has @ has.T, counts[:, None] + counts[None, :]
    links = {(rows[i][0], rows[j][0]) for i, j in np.argwhere(shared / (size - shared) >= 0.8).tolist() if i < j}
    assert links == {(i, 1000 + i) for i in range(0, 500, 5)}
    assert {(r["class_id"], r["doc_id"]) for r in near_duplicates(docs(rows)).collect() if r["class_id"] != r["doc_id"]} == links


def test_ratio_alone_ends_the_choice_of_lists():
    rng = np.random.default_rng(4)
    centers, x = unit(rng.normal(size=(1500, 64))), unit(rng.normal(size=(40, 64)))
    index = ListIndex(centers, neighbour_graph(centers), np.full(1500, 10))
    near = 1 - x @ centers.T
    want = near <= ASK_RATIO**2 * near.min(axis=1, keepdims=True)
    assert (want.sum(axis=1) > ASK_WIDTH).sum() > 20
    got = np.zeros_like(want)
    for row, lists in enumerate(index.asked(x, 6)):
        got[row, lists] = True
    assert (got & want).sum() >= 0.995 * want.sum() and not (got & ~want).any()


def test_language_id_without_labels_keeps_texts(spark):
    table = spark.createDataFrame([(1, "the cat", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, table, "").collect()] == [1]


def test_rare_languages_keep_their_share_of_the_sample(spark):
    counts = {f"l{n}": 600 if n < 8 else 24 for n in range(10)}
    rows = [(f"{k} {i}", k, f"text {i}") for k, n in counts.items() for i in range(n)]
    sample = language_sample(spark.createDataFrame(rows, "_id string, label string, _text string"), counts, 200)
    got = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    assert got["l8"] == got["l9"] == 20 and sum(got.values()) <= 200
