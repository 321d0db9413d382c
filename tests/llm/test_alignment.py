"""Alignment of two tokenizers beside a plain walk over the tokens that the libraries give."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from secret_audit.llm import alignment
from secret_audit.llm.alignment import Aligner, alignment_digests, overlaps, pair_documents, token_groups
from secret_audit.llm.bpe import byte_chars
from secret_audit.llm.textkit import grouped_pieces

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(BYTES)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECES)
NUMBER = {c: b for b, c in enumerate(byte_chars())}
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

TEXTS = [
    None, "", " ", "  ", "a ", "  a", "a\n  b", "a\n b \n c\t", "\n", "\n\n  \n x  ", "x▁y and more", "▁", "<|endoftext|> <s> </s> <0x41> <unk>",
    "日本語 テキスト 123456 🎉🎉👩‍👩‍👧", "a b　 c d", "it's we'll 'S\t\t x", "aaaa" * 700, "́ ́ é ﬁ", "a\0b", "1234567 89,000.00  %", "a b c", "a b c", "c b a",
]


def byte_bytes(i):
    return bytes(NUMBER[c] for c in A.id_to_token(i))


def piece_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def walked(text):
    """Groups of one text, or None."""
    if not text:
        return None
    a, b, whole = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text), (" " + text).encode()
    own_a, own_b = [byte_bytes(i) for i in a], [piece_bytes(i) for i in b]
    if b"".join(own_a) != whole or b"".join(own_b) != whole:
        return None
    ends_a, ends_b = list(accumulate(map(len, own_a))), list(accumulate(map(len, own_b)))
    out, at_a, at_b = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        to_a, to_b = ends_a.index(end) + 1, ends_b.index(end) + 1
        out.append((a[at_a:to_a], b[at_b:to_b], end))
        at_a, at_b = to_a, to_b
    return out


def expected(texts):
    docs = [walked(t) for t in texts]
    links = [[(x, y) for a, b, _ in d or [] for x in a for y in b] for d in docs]
    held = Counter(p for own in links for p in set(own))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for d, own in zip(docs, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b, _ in d or [])
        out.append((
            sum(len(a) for a, _, _ in d or []), sum(len(b) for _, b, _ in d or []), len(d or []), len(own), sum(held[p] == best[p[0]] for p in own),
            sum(held[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if d else "",
        ))
    return out, held


def random_texts(n):
    rnd = random.Random(5)
    signs = list("abcdeABC  01'.,!-\n\t") + ["  ", "é", "ß", "中", "🎉", "́", "the", "ing ", " of", " ", "　"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 80))) for _ in range(n)]


@pytest.mark.parametrize("table_pairs", [1 << 20, 40, 0])
def test_digests(spark, docs, table_pairs):
    texts = TEXTS + random_texts(300)
    df = docs([(i, t) for i, t in enumerate(texts)]).repartition(3)
    got = alignment_digests(df, BYTES, PIECES, keep=["doc_id", "score", "_row"], table_pairs=table_pairs)
    assert got.columns == ["doc_id", "score", "_row", *NAMES]
    rows = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == expected(texts)[0]


def test_pairs(spark, docs):
    texts = TEXTS + random_texts(50)
    got = {(r["a_id"], r["b_id"]): r["n"] for r in pair_documents(docs(list(enumerate(texts))), BYTES, PIECES).collect()}
    assert got == dict(expected(texts)[1])


def test_groups(spark, docs):
    texts = TEXTS + random_texts(50)
    for r in token_groups(docs(list(enumerate(texts))), BYTES, PIECES, keep=["doc_id"]).collect():
        groups = walked(texts[r["doc_id"]]) or []
        assert r["groups"] == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b, _ in groups)
        assert r["group_ends"] == [e for _, _, e in groups]


def test_repeated_ids_null_ids_and_empty_table(spark, docs):
    rows = [(1, "one two"), (1, "three"), (1, "one two"), (None, "one two"), (None, None)]
    got = alignment_digests(docs(rows), BYTES, PIECES, keep=["doc_id"]).collect()
    assert sorted(r["n_a"] for r in got) == [0, 1, 2, 2, 2] and len({r["groups_sha256"] for r in got}) == 3
    assert alignment_digests(docs([]), BYTES, PIECES).count() == 0


def test_pieces_passages_and_forgetting(monkeypatch):
    """Long texts in pieces, a full table and huge groups in steps give the same result."""
    data = [open(p, "rb").read() for p in (BYTES, PIECES)]  # noqa: SIM115
    texts = [t or "" for t in TEXTS] + [" ".join(random_texts(400)), "ab " * 3000]
    monkeypatch.setattr(alignment, "PASSAGES", 50)
    monkeypatch.setattr(alignment, "AT_ONCE", 3)
    monkeypatch.setattr(alignment, "grouped_pieces", lambda t: grouped_pieces(t, 500))
    own = Aligner(*data)
    want, _ = expected(texts)
    facts, groups, (key, links) = own.describe(texts, pairs=True)
    assert [tuple(facts[i]) for i in range(len(texts))] == [w[:4] for w in want]
    assert [hashlib.sha256(";".join(g).encode()).hexdigest() if g else "" for g in groups] == [w[6] for w in want]
    width, counts = len(own.b.size), Counter(dict(zip(key.tolist(), links.tolist(), strict=True)))
    doc_links = [Counter((x, y) for a, b, _ in walked(t) or [] for x in a for y in b) for t in texts]
    assert counts == Counter({i * own.pairs + x * width + y: n for i, c in enumerate(doc_links) for (x, y), n in c.items()})


def test_overlaps_are_both_directions():
    a = pd.DataFrame({"document": [0, 0, 1], "start": [0, 3, 5], "token": [0, 1, 2]})
    b = pd.DataFrame({"document": [0, 0, 0, 1], "start": [0, 2, 4, 5], "token": [0, 1, 2, 3]})
    assert overlaps(a, b).to_numpy().tolist() == [[0, 0], [0, 1], [1, 1], [1, 2], [2, 3]]
