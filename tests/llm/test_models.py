"""The trained operators beside plain restatements: TF-IDF and FTRL in dictionaries, and a chain refitted fold by fold."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from secret_audit.llm import langid, toxicity

BUCKETS = 1 << 10


def grams(text):
    """Buckets of the 1- to 3-grams of letters, a gap of other characters being one blank."""
    kept, after = [], False
    for c in text.lower() + "\n":
        letter = unicodedata.category(c)[0] in "LM"
        if letter or after:
            kept.append(ord(c) if letter else 32)
        after = letter
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(kept) - n + 1):
            code = 0
            for c in kept[i : i + n]:
                code = (code * 0x110000 + c) % 2**64
            out[(code * 0x9E3779B97F4A7C15 % 2**64 >> 40) % BUCKETS] += 1
    return out


def plain_ftrl(examples, labels, classes, alpha=0.5, beta=1.0, l1=2e-4, l2=1e-4, epochs=3):
    z, n, seen, order = {}, {}, 0, np.random.default_rng(7)

    def weight(b, c, seen):
        value = z.get((b, c), 0.0)
        if abs(value) <= l1 * seen:
            return 0.0
        return -(value - math.copysign(l1 * seen, value)) / ((beta + math.sqrt(n.get((b, c), 0.0))) / alpha + l2 * seen)

    for _ in range(epochs):
        for i in order.permutation(len(labels)):
            w = {(b, c): weight(b, c, seen) for b in examples[i] for c in range(classes)}
            logits = [sum(x * w[b, c] for b, x in examples[i].items()) for c in range(classes)]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            for c in range(classes):
                error = e[c] / sum(e) - (labels[i] == c)
                for b, x in examples[i].items():
                    g, old = x * error, n.get((b, c), 0.0)
                    z[b, c] = z.get((b, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[b, c]
                    n[b, c] = old + g * g
            seen += 1
    return {key: weight(*key, seen) for key in z}


def test_language_model_equals_dictionaries(spark):
    rnd = random.Random(2)
    alphabets = {"aa": "abcdeé ", "bb": "cdefgß  ", "cc": "αβγδa "}
    rows = [(i, "".join(rnd.choices(alphabets[lang], k=60)) + "x", lang) for i, lang in enumerate([*alphabets] * 4)] + [(20, None, "aa"), (21, "12 34", "bb"), (22, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_language_model(df, buckets=BUCKETS)
    used = [(t, lang) for _, t, lang in rows[:12]]
    counted = [grams(t) for t, _ in used]
    frequency = Counter(b for c in counted for b in c)
    factor = {b: (math.log((1 + len(used)) / (1 + n)) + 1) * langid.SCALE for b, n in frequency.items()}
    # The order of the sample is the sampler's; weights and temperature are restated.
    own = df.select(*[F.col(c).cast("string").alias(n) for c, n in (("lang", "label"), ("text", "_text"), ("doc_id", "_id"))]).where("doc_id < 12")
    ordered = [(r["_text"], r["label"]) for r in langid.language_sample(own, dict(Counter(x for _, x in used)), langid.SAMPLE_ROWS).collect()]
    assert sorted(ordered) == sorted(used)
    example = lambda t: {b: n / sum(grams(t).values()) * factor[b] for b, n in grams(t).items()}
    held = [i for i in range(12) if i % 4 == 1]
    learn = [i for i in range(12) if i % 4 != 1]
    languages = sorted(alphabets)
    weights = plain_ftrl([example(ordered[i][0]) for i in learn], [languages.index(ordered[i][1]) for i in learn], 3)

    def logits(text):
        return [sum(x * weights.get((b, c), 0.0) for b, x in example(text).items()) for c in range(3)]

    assert model.languages == languages
    for t, _ in ordered:
        e = [math.exp(v / model.temperature) for v in logits(t)]
        assert np.allclose(model.probabilities([t])[0], [x / sum(e) for x in e], atol=1e-4)

    def loss(temperature):
        return -sum(math.log(math.exp(logits(t)[languages.index(x)] / temperature) / sum(math.exp(v / temperature) for v in logits(t))) for t, x in (ordered[i] for i in held))

    assert all(loss(model.temperature) <= loss(model.temperature * k) + 1e-3 for k in (0.8, 0.9, 1.1, 1.25))


def test_earlier_probabilities_come_from_models_that_did_not_see_the_row(spark, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{chr(97 + i)}{chr(97 + i % 7)}" for i in range(20)]
    docs, labels = [], []
    for i in range(160):
        own = rnd.choices(words, k=25)
        first = int(own.count(words[0]) + own.count(words[1]) >= 3)
        docs.append((i, " ".join(own)))
        labels.append((i, first, int(first and words[2] in own or rnd.random() < 0.1)))
    calls, fit = [], toxicity.fit_logistic

    def spy(row, feature, features, dense, y, **more):
        calls.append((row, feature, features, dense, y))
        return fit(row, feature, features, dense, y, **more)

    monkeypatch.setattr(toxicity, "fit_logistic", spy)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    toxicity.train_chain(df, spark.createDataFrame(labels, "doc_id long, first int, second int"), ["first", "second"])
    fold = np.array([r.f for r in df.orderBy("doc_id").select(F.xxhash64("text").alias("f")).collect()]) % toxicity.FOLDS
    whole = [c for c in calls if len(c[4]) == len(docs)]
    assert len(whole) == 2
    (row, feature, features, dense, y), (_, _, _, chained, _) = whole
    assert chained.shape[1] == dense.shape[1] + 1
    before = chained[:, -1]
    for f in range(toxicity.FOLDS):
        test, learn = fold == f, fold != f
        number = np.cumsum(learn) - 1
        w, v, b = fit(number[row[learn[row]]], feature[learn[row]], features, dense[learn], y[learn])
        want = toxicity.sigmoid(np.bincount(row, w[feature], minlength=len(docs)) + dense @ v + b)
        assert test.any() and np.allclose(before[test], want[test])
    seen = toxicity.sigmoid(np.bincount(row, (got := fit(row, feature, features, dense, y))[0][feature], minlength=len(docs)) + dense @ got[1] + got[2])
    assert not np.allclose(before, seen)
