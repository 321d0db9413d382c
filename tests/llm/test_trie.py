"""The prefix trie of conversations beside nested dictionaries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from secret_audit.llm import trie
from secret_audit.llm.trie import SlotTable, conversation_paths, prefix_trie, with_shared_openings

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def conversations(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            out.setdefault(conv, []).append(((turn is not None, turn or 0), role, digest, text))
    return {c: [(r, t) for _, r, _, t in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def expected(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {k: 0 for k in nodes}
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(members) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(k)))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(members), len(k), parent, len(members), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted(tuple(r) for r in df.collect())


def some_rows(seed, n, ids):
    rnd = random.Random(seed)
    texts = ["a", "a b", " b\tc\x0bd ", "", None, "x y z", "long one here"]
    return [(rnd.choice(ids), t, rnd.choice(["user", "assistant", None, ""]), rnd.choice(texts)) for _ in range(n) for t in [rnd.choice([0, 1, 2, 3, 4, None])]]


@pytest.mark.parametrize("segment", [1024, 2])
def test_against_dictionaries(spark, monkeypatch, segment):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "SHARD_ROWS", 37)
    monkeypatch.setattr(trie, "HOT_PARENTS", 3)
    rows = some_rows(1, 160, [*range(0, 45), 100, 119, -3, -21, 2**62, None])
    # A conversation with a third of the turns, copies of one conversation, and turns that repeat.
    rows += [(7, i % 40, "user", f"turn {i // 3}") for i in range(120)] + [(200 + c, t, "user", f"same {t}") for c in range(60) for t in range(3)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"{SCHEMA}, _conv string, _depth int").repartition(5)
    convs = conversations(rows)
    paths = conversation_paths(df)
    assert got(prefix_trie(paths)) == expected(convs)
    assert got(prefix_trie(with_shared_openings(paths))) == expected(rebuilt(convs))


def test_turnless_and_empty(spark):
    # 19 gives up its only turns for those of conversation 0, which is absent.
    own = [(c, 0, "user", "x") for c in range(1, 20)]
    convs = rebuilt(conversations(own))
    assert any(not t for t in convs.values())
    df = spark.createDataFrame(own, SCHEMA)
    assert got(prefix_trie(with_shared_openings(conversation_paths(df)))) == expected(convs)
    assert prefix_trie(with_shared_openings(conversation_paths(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_order_of_turns(spark):
    rows = [(1, 2, "user", "c"), (1, None, "user", "a"), (1, -1, "user", "b"), (1, 2, "assistant", "c"), (1, 2, "user", "c")]
    found = conversation_paths(spark.createDataFrame(rows, SCHEMA)).where("_depth > 0").orderBy("_depth").collect()
    order = [hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest() for r, t in conversations(rows)[1]]
    assert [r["_depth"] for r in found] == [1, 2, 3, 4, 5] and [r["_turn"] for r in found] == order


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_slots_are_minimal_and_perfect(n):
    rnd = np.random.default_rng(n)
    a, b = rnd.integers(0, 50, n), rnd.permutation(n)
    table = SlotTable(a, b)
    slots = table.find(a, b)
    assert sorted(slots.tolist()) == list(range(n))
    assert (table.find(a, b + n) == -1).all() and (table.a[slots] == a).all() and (table.b[slots] == b).all()
