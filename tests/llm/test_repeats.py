"""Removal of repeated passages beside a dictionary of all windows, and longest factors beside a plain search."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from secret_audit.llm.repeats import Suffixes, remove_repeats, stretches


def brute(rows, length, keep):
    """n_bytes, spans and kept bytes of each (id, text), in order."""
    data = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen = defaultdict(int)
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    gone, met = [np.zeros(len(b), bool) for b in data], set()
    for k in order:
        b = data[k]
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if seen[w] > 1 and (keep == "none" or w in met):
                gone[k][i : i + length] = True
            met.add(w)
    out = []
    for b, g in zip(data, gone, strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], g.astype(int), [0]))))
        out.append((len(b), [tuple(x) for x in edge.reshape(-1, 2).tolist()], bytes(np.frombuffer(b, np.uint8)[~g])))
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß中 ") for _ in range(rnd.randint(2, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(30) for _ in range(4)] + ["ab" * 90, "z" * 150, prose(12)]
    texts = [None, "", "short", passages[0], passages[0], "x" * 400, passages[1] + passages[1]]
    for _ in range(n):
        parts = [prose(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 2)):
            parts += [rnd.choice(passages), prose(rnd.randint(0, 20))]
        texts.append(" ".join(parts))
    texts += [texts[9]] * 5 + [texts[10][:-3] + "!"] + ["common line that is quite long, " * 2 + prose(20) for _ in range(30)]
    return texts


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize(("length", "grams", "most"), [(50, (16, 25, 40), 4096), (50, (8, 20, 30, 45), 3), (21, (8,), 2), (8, (8,), 4096), (200, (64, 112, 150), 4096)])
def test_against_all_windows(spark, docs, keep, length, grams, most):
    rows = list(enumerate(corpus(length, 40)))
    df = docs(rows).repartition(4)
    got = {r["doc_id"]: r for r in remove_repeats(df, keep=keep, length=length, grams=grams, most=most, bucket=20, table_bits=1 << 12).collect()}
    for (i, _), (n, spans, kept) in zip(rows, brute(rows, length, keep), strict=True):
        assert (got[i]["n_bytes"], [tuple(s) for s in got[i]["spans"]], bytes(got[i]["kept"])) == (n, spans, kept), i


def test_digests_and_repeated_ids(spark, docs):
    texts = corpus(3, 20)
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(texts)] + [(1, texts[8]), (1, texts[8])]
    got = remove_repeats(docs(rows), length=40, grams=(16, 30), digests=True)
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept_sha256"]
    want = sorted((str(i), n, spans, hashlib.sha256(kept).hexdigest()) for (i, _), (n, spans, kept) in zip(rows, brute(rows, 40, "none"), strict=True))
    assert sorted((str(r["doc_id"]), r["n_bytes"], [tuple(s) for s in r["spans"]], r["kept_sha256"]) for r in got.collect()) == want
    # Of equal rows the first keeps the text.
    kept = [bytes(r["kept"]) for r in remove_repeats(docs([(1, texts[8])] * 3), keep="first", length=40, grams=(16, 30)).collect()]
    assert sorted(map(len, kept))[:2] == [0, 0] and max(map(len, kept)) == len(texts[8].encode())
    assert remove_repeats(docs([])).count() == 0


def test_copies_over_many_partitions(spark, docs):
    base = corpus(5, 12)
    rows = [(i, (base[i % len(base)] or "") + ("" if i % 3 else f" tail {i}")) for i in range(200)]
    df = docs(rows).repartition(16, F.col("doc_id"))
    got = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(df, length=60, grams=(20, 40), most=8).collect()}
    assert [got[i] for i, _ in rows] == [k for _, _, k in brute(rows, 60, "none")]


@pytest.mark.parametrize("length", [8, 13, 16, 40])
def test_longest_factors(length):
    rnd = random.Random(length)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 90))).encode() for _ in range(12)] + [b"a" * 60, b"\0" * 30]
    flat, borders = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    suffixes = Suffixes(flat, borders, length)
    whole = [flat[s : s + length].tobytes() for s in suffixes.starts.tolist()]
    assert [whole[i] for i in suffixes.order.tolist()] == sorted(whole)

    def common(a, b):
        return next((i for i in range(length) if a[i] != b[i]), length)

    for earlier in (True, False):
        want = [max((common(w, v) for v in (whole[:i] if earlier else whole[i + 1 :])), default=0) for i, w in enumerate(whole)]
        assert suffixes.factors(earlier).tolist() == want
        assert suffixes.factors(earlier, 9).tolist() == [x if x >= 9 else 0 for x in want]


def test_every_window_has_the_same_gram_wherever_it_lies():
    rnd = random.Random(2)
    passage = bytes(rnd.choices(range(256), k=600))
    grams = []
    for before in (b"", b"x" * 77, bytes(rnd.choices(range(256), k=1000))):
        flat = np.frombuffer(before + passage + before, np.uint8)
        begin, n, place, h = stretches(flat, np.array([0, len(flat)]), 200, 64)
        assert np.array_equal(np.concatenate([np.arange(b, b + k) for b, k in zip(begin, n, strict=True)]), np.arange(len(flat) - 199))
        at = {w: (p - w, int(x)) for b, k, p, x in zip(begin.tolist(), n.tolist(), place.tolist(), h.tolist(), strict=True) for w in range(b, b + k)}
        grams.append([at[len(before) + i] for i in range(401)])
    assert grams[0] == grams[1] == grams[2]
