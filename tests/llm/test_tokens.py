"""Encoding, packing and token counts beside the tokenizers library and naive statements of the rules."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from secret_audit.llm.bpe import BpeModel, bpe_digests, bpe_encode, byte_chars
from secret_audit.llm.packing import cuts, pack_documents, sum_of_squares
from secret_audit.llm.pieces import byte_spans, word_spans
from secret_audit.llm.textkit import codepoints, pieces_of
from secret_audit.llm.token_counts import LongestMatch, count_tokens

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
ODD = [
    "", "   ", "it's don't we'll 'LL ''s x's' 12 3½ Ünï ΣΑΣ İ", "aaaaaaa aaaaaa", "<|endoftext|>", "x<|startoftext|><|endoftext|>y <| <|endof",
    "日本語テキスト 한국어 😀😀 é ́", "\n\t a b　c 's \r\n\r\n x", "'re're 've-'d", "don''t ' s", "a" * 5000, "x\u0085y\u001cz",
]


def random_texts(n=400):
    rnd = random.Random(4)
    letters = list("abcsStTmMdlLrReEvV''' \n  12.,é́ß日😀½  ")
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + random_texts() + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_bpe_equals_the_library(spark, docs, texts):
    library = Tokenizer.from_file(WORD)
    library.no_truncation()
    rows = [*enumerate(texts), (-1, None), (0, texts[0])]
    made = bpe_encode(docs(rows).repartition(3), WORD).collect()
    digests = {r["doc_id"]: r for r in bpe_digests(docs(rows), WORD, keep=["doc_id"]).collect()}
    assert len(made) == len(rows)
    for r in made:
        ids = library.encode(texts[r["doc_id"]] if r["doc_id"] >= 0 else "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), decoded)
        d = digests[r["doc_id"]]
        assert d["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe_encode(docs([]), WORD).count() == 0


@pytest.mark.parametrize(("path", "spans"), [(WORD, word_spans), (BYTE, byte_spans)])
def test_spans_equal_the_library(texts, path, spans):
    library = Tokenizer.from_file(path).pre_tokenizer
    cp, ends = codepoints(texts)
    begin, end = spans(cp, ends)
    joined = "".join(texts)
    for i, text in enumerate(texts):
        own = (begin >= ends[i]) & (begin < ends[i + 1])
        got = [joined[a:b] for a, b in zip(begin[own], end[own], strict=True)]
        assert got == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]


def test_long_texts_are_cut_between_words():
    text = "one two,  three " * 3000
    pieces = pieces_of(text, 1000)
    assert "".join(pieces) == text and len(pieces) > 20 and all(p.startswith(" ") for p in pieces[1:])
    assert pieces_of("x" * 5000, 1000) == ["x" * 5000]


def test_packing_equals_the_library(spark, docs, texts):
    library = Tokenizer.from_file(BYTE)
    rows = [*enumerate(texts), (9000, None), (9001, "word " * 9000)]
    made = pack_documents(docs(rows), BYTE).toPandas()
    by_id = dict(list(made.groupby("doc_id")))
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = by_id[i].sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and own["length"].sum() == len(ids)
        assert own["length"].tolist()[1:] == [2048] * (len(own) - 1)
        for s, n, c in zip(own["start"], own["length"], own["ids_crc32"], strict=True):
            assert zlib.crc32(ids[s : s + n].tobytes()) == c
    made = made.sort_values(["sequence_id", "offset"])
    groups = made.groupby("sequence_id")["length"]
    assert (groups.cumsum() - made["length"] == made["offset"]).all() and groups.sum().max() <= 2048
    assert made["sequence_id"].nunique() <= 1.05 * made["length"].sum() / 2048 + 2


def test_packing_of_repeated_and_no_rows(docs):
    made = pack_documents(docs([(1, "a b c"), (1, "a b c"), (None, "")]), BYTE).toPandas()
    assert len(made) == 3 and made["sequence_id"].nunique() == 1 and sorted(made["offset"]) == [0, 1, 5] or sorted(made["offset"]) == [0, 4, 8]
    assert pack_documents(docs([]), BYTE).count() == 0


def test_sum_of_squares_follows_its_rule():
    rnd = random.Random(2)
    capacity, sizes = 20, [rnd.randint(1, 20) for _ in range(300)]
    got, offsets, used = sum_of_squares(sizes, capacity)
    fill: dict[int, int] = {}
    for size, place, offset in zip(sizes, got, offsets, strict=True):
        def cost(fills):
            gaps = [capacity - f for f in fills if f < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        options = [cost([f + size if p == q else f for q, f in fill.items()]) for p in fill if fill[p] + size <= capacity]
        best = min([*options, cost([*fill.values(), size])])
        assert offset == fill.get(place, 0) <= capacity - size
        fill[place] = offset + size
        assert cost(fill.values()) == best
    assert len(fill) == used


def test_cuts():
    assert cuts(5, 8) == [(0, 5)] and cuts(8, 8) == [(0, 8)] and cuts(16, 8) == [(0, 8), (8, 8)]
    assert cuts(17, 8) == [(0, 1), (1, 8), (9, 8)]


def greedy(word: bytes, entries: set[bytes]) -> tuple[int, bool]:
    at, n = 0, 0
    while at < len(word):
        size = next((s for s in range(len(word) - at, 0, -1) if word[at : at + s] in entries), 0)
        if not size:
            return 1, False
        at, n = at + size, n + 1
    return n, True


def test_automaton_is_greedy():
    rnd = random.Random(8)
    for _ in range(40):
        entries = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 12))}
        words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 14))) for _ in range(80)]
        sizes, covered = LongestMatch(sorted(entries)).lengths(words)
        assert list(zip(sizes.tolist(), covered.tolist(), strict=True)) == [greedy(w, entries) for w in words]
    sizes, covered = LongestMatch([]).lengths([b"ab"])
    assert sizes.tolist() == [1] and covered.tolist() == [False]


def test_token_counts(spark, docs, texts):
    spec = Tokenizer.from_file(BYTE)
    number = {c: b for b, c in enumerate(byte_chars())}
    entries = {bytes(number[c] for c in t) for t in spec.get_vocab() if t != "<|endoftext|>"}
    rows = [*enumerate(texts), (-1, None), (0, texts[0])]
    for r in count_tokens(docs(rows), BYTE).collect():
        words = spec.pre_tokenizer.pre_tokenize_str(texts[r["doc_id"]]) if r["doc_id"] >= 0 else []
        want = [greedy(bytes(number[c] for c in w), entries)[0] for w, _ in words]
        assert (r["n_pretokens"], r["n_tokens"], r["n_unknown"], r["score"]) == (len(words), sum(want), 0, "s")
    assert count_tokens(docs([]), BYTE).count() == 0


LONG = {
    "letters": "".join(random.Random(3).choices("etaoinshrdlu", k=1_000_000)), "one": "a" * 1_000_000, "bytes": "é中" * 300_000,
}


@pytest.mark.parametrize("name", list(LONG))
def test_a_word_of_a_million_letters(name):
    """Without a blank to cut at: the same ids as the library, in seconds."""
    path = public_tokenizers.path("word_bpe_49k.json")
    model, begin = BpeModel(open(path, "rb").read()), time.process_time()  # noqa: SIM115
    n, ids, _ = model.encode([f"start {LONG[name]} end"])[0]
    assert time.process_time() - begin < 30
    want = Tokenizer.from_file(path).encode(f"start {LONG[name]} end", add_special_tokens=False).ids
    assert n == len(want) and " ".join(ids) == " ".join(map(str, want))


def test_long_words_among_short_ones():
    path = public_tokenizers.path("word_bpe_49k.json")
    model, rnd = BpeModel(open(path, "rb").read()), random.Random(4)  # noqa: SIM115
    words = ["".join(rnd.choices("abcdeé1", k=rnd.choice([1, 5, 1999, 2000, 2001, 5000]))) for _ in range(40)]
    ids, counts = model.encode_words(words)
    for w, own in zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        alone, _ = model._encode_words([w])
        assert own.tolist() == alone.tolist()


def test_automaton_follows_long_words(monkeypatch):
    rnd = random.Random(6)
    entries = {bytes(rnd.choices(b"abc", k=rnd.randint(1, 5))) for _ in range(40)} | {b"a", b"b"}
    words = [bytes(rnd.choices(b"abc" if i % 3 else b"ab", k=rnd.choice([3, 50, 400, 3000]))) for i in range(30)]
    automaton = LongestMatch(sorted(entries))
    sizes, covered = automaton.lengths(words)
    for w, n, c in zip(words, sizes.tolist(), covered.tolist(), strict=True):
        assert (n, c) == greedy(w, entries)
    begin = time.process_time()
    automaton.lengths([b"ab" * 500_000])
    assert time.process_time() - begin < 10


def test_language_grams_of_a_text_without_blanks(monkeypatch):
    from secret_audit.llm import langid

    rnd = random.Random(7)
    texts = ["".join(rnd.choices("abcé中12-,́", k=5000)), "x" * 301, "1" * 400 + "a", "ab", ""]

    def counts():
        out = [np.zeros(1 << 12) for _ in texts]
        for bucket, doc in langid.gram_buckets(texts, 1 << 12):
            for d in np.unique(doc):
                np.add.at(out[d], bucket[doc == d], 1)
        return np.array(out)

    whole = counts()
    monkeypatch.setattr(langid, "SLICE_CHARS", 100)
    monkeypatch.setattr(langid, "grouped_pieces", lambda t: (([x], np.array([i])) for i, x in enumerate(t)))
    assert (counts() == whole).all()
