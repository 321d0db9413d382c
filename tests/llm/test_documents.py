"""Near-duplicates, language, toxicity, shards, WARC records and the pipeline."""

import base64
import hashlib
import json
import math
import random
import time
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from secret_audit.llm.dartminhash import (
    components, dart_minhash, near_duplicates, similarities, weighted_shingles, without_near_duplicates,
)
from secret_audit.llm.langid import best_temperature, held_out, identify_languages, softmax, train_language_model
from secret_audit.llm.sharding import Shard, Topology, assign_shards, even_topology
from secret_audit.llm.toxicity import best_threshold, score_toxicity, train_chain
from secret_audit.llm.markup import Links, Page
from secret_audit.llm.warc import DERIVED, derived_records, page_text, record_text, response_records, write_warc

SMALL = "/root/testdata/sf0.001"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))


# near-duplicates


def jaccard(a: str, b: str) -> float:
    def shingles(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = shingles(a), shingles(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_similarity_is_weighted_jaccard():
    rnd = random.Random(1)
    base = words(rnd, 60)
    pairs = [(base, base + " " + words(rnd, k)) for k in range(0, 40, 3)] + [("a b", "a b"), ("a b", "b a"), ("x y z u v w " * 9, "x y z u v w " * 4)]
    got = similarities(*map(list, zip(*pairs, strict=True)))
    assert np.allclose(got, [jaccard(a, b) for a, b in pairs])
    assert similarities([""], ["..."]).tolist() == [0.0]


def test_signatures_estimate_similarity():
    rnd = random.Random(2)
    common = words(rnd, 300)
    texts = [common + " " + words(rnd, 75), common + " " + words(rnd, 75), "one two", "", common + " " + ("q r s t u v " * 30)]
    signature = dart_minhash(*weighted_shingles(texts), 2000)
    assert abs((signature[0] == signature[1]).mean() - jaccard(texts[0], texts[1])) < 0.05
    assert abs((signature[0] == signature[4]).mean() - jaccard(texts[0], texts[4])) < 0.05
    assert np.isinf(signature[3]).all() and np.isfinite(signature[[0, 1, 2, 4]]).all()
    again = dart_minhash(*weighted_shingles(texts[::-1]), 2000)
    assert (again[::-1] == signature).all()


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + rnd.randint(0, 40), 100 + rnd.randint(0, 40)) for _ in range(30)]
    parent = {n: n for e in links for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root(n) for e in links if e[0] != e[1] for n in e}


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    texts = {t: i for i, t in sorted(rows, reverse=True)}
    elements, weights, counts = weighted_shingles(list(texts))
    ids, where = list(texts.values()), {}
    pairs = set()
    for doc, element in zip(np.repeat(np.arange(len(ids)), counts).tolist(), elements.tolist(), strict=True):
        pairs.update((o, doc) for o in where.setdefault(element, []))
        where[element].append(doc)
    pairs, body = sorted(pairs), list(texts)
    alike = similarities([body[a] for a, _ in pairs], [body[b] for _, b in pairs]) >= 0.8
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), same in zip(pairs, alike, strict=True):
        if same:
            a, b = sorted((root(ids[a]), root(ids[b])))
            parent[b] = a
    assert got == {i: root(texts[t]) for i, t in rows}


def test_near_duplicates_defined_cases(docs):
    rnd = random.Random(5)
    long = words(rnd, 200)
    rows = [(5, long), (3, long), (9, long + " tail"), (4, ""), (6, ""), (7, None), (8, None), (None, long), (10, "one two"), (11, "One, two!"), (12, "two one"), (3, long)]
    got = near_duplicates(docs(rows)).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in got) == sorted(
        [(5, 3), (3, 3), (3, 3), (9, 3), (4, 4), (6, 4), (7, 7), (8, 8), (-1, -1), (10, 10), (11, 10), (12, 12)]
    )
    left = without_near_duplicates(docs(rows))
    assert left.columns == docs(rows).columns
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 3, 4, 7, 8, 10, 12]
    assert near_duplicates(docs([])).count() == 0 and without_near_duplicates(docs([])).count() == 0


def test_repeated_ids_lose_no_text(docs):
    rnd = random.Random(8)
    a, b, c = (words(rnd, 60) for _ in range(3))
    rows = [(3, a), (7, b), (7, a), (9, c), (9, b), (12, c)]
    left = without_near_duplicates(docs(rows)).select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in left) == sorted([(3, a), (7, b), (9, c)])


def test_repeated_ids_equal_brute_force(docs):
    rnd = random.Random(9)
    bases = [words(rnd, 60) for _ in range(12)]
    texts = [(x if rnd.random() < 0.4 else x + " " + words(rnd, 3)) for x in bases for _ in range(6)]
    rows = [(rnd.randint(1, 25), t) for t in texts] + [(30, None), (30, bases[0]), (30, None), (None, bases[1])]
    got = near_duplicates(docs(rows)).collect()
    known = sorted({t for _, t in rows if t is not None})
    parent = {t: t for t in known}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(known):
        for y in known[:i]:
            if jaccard(x, y) >= 0.8:
                parent[root(x)] = root(y)
    keyed = [(i, t, hashlib.md5(t.encode()).hexdigest()) for i, t in rows if i is not None and t is not None]
    first = {}
    for i, t, d in keyed:
        first[root(t)] = min(first.get(root(t), (i, d)), (i, d))
    want = sorted([(i, *first[root(t)], (i, d) == first[root(t)]) for i, t, d in keyed])
    assert sorted(tuple(r) for r in got if r["class_digest"]) == want
    left = [(r["doc_id"], r["text"]) for r in without_near_duplicates(docs(rows)).collect()]
    assert sorted(x for x in left if None not in x) == sorted({(i, t) for i, t, d in keyed if (i, d) == first[root(t)]})
    assert len([x for x in left if None in x]) == 3
    # Every text that stays is unlike the others, and every text that goes is like one that stays.
    assert len({root(t) for i, t in left if None not in (i, t)}) == len(first)


def test_hot_group_of_near_copies(spark, docs):
    rnd = random.Random(6)
    base = words(rnd, 150).split()
    rows = [(i, " ".join(base[:i % 140] + ["new%d" % i] + base[i % 140 + 1 :])) for i in range(700)]
    assert {r["class_id"] for r in near_duplicates(docs(rows)).collect()} == {0}


# language


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train_language_model(docs.filter(~held_out(F.col("doc_id"))))
    rows = identify_languages(docs, model).filter(held_out(F.col("doc_id"))).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert (np.count_nonzero(model.table) / model.table.size) < 0.2  # elastic net leaves most weights at zero


def test_language_defined_cases(spark, docs):
    rows = [(1, "le chat est là", "fr"), (2, "the cat is there", "en"), (3, "les chats sont là", "fr"), (4, "the cats are there", "en"), (5, None, "en"), (6, "12 !", "fr"), (7, "", None), (8, "the dog", None)]
    table = docs(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify_languages(table, train_language_model(table)).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 9)] == ["fr", "en", "fr", "en", "und", "und", "und", "en"]
    assert got[5]["score"] == 0.0 and "slot" in got[5].asDict()
    assert train_language_model(table.limit(0)) is None
    assert {r["lang_pred"] for r in identify_languages(table, None).collect()} == {"und"}
    one = train_language_model(table.filter("lang = 'fr'"))
    assert {r["score"] for r in identify_languages(table.filter("doc_id < 5"), one).collect()} == {1.0}


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    label = np.array([rng.choice(3, p=p) for p in softmax(logits)])
    assert abs(best_temperature(logits * 3, label) - 3) < 0.4


# toxicity


def test_chain_on_given_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = train_chain(docs, labels, ["quality", "toxic"])
    assert model.earlier[1].tolist() == [0.0, 0.0]  # the second category feeds none
    rows = score_toxicity(docs, model).join(labels, "doc_id").collect()
    truth, said = [r["toxic"] == 1 for r in rows], [r["is_toxic"] for r in rows]
    assert np.mean([a == b for a, b in zip(truth, said, strict=True)]) > 0.98


def test_chain_defined_cases(spark, docs):
    rows = [(i, f"{words(random.Random(i), 12 + i % 5)} {'scum' if i % 3 == 0 else ''}") for i in range(60)] + [(100, None), (101, ""), (0, "x")]
    table = docs(rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(60)] + [(1, None, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, toxic int, other int")
    model = train_chain(table, labels, ["other", "toxic"])
    got = score_toxicity(table, model)
    assert got.columns.count("is_toxic") == 1 and got.count() == len(rows)
    by_id = {r["doc_id"]: r for r in got.filter("doc_id > 0").collect()}
    assert all(by_id[i]["is_toxic"] == (i % 3 == 0) for i in range(1, 60))
    assert not by_id[101]["is_toxic"] and by_id[5]["p_other"] < 0.01
    none = train_chain(table, labels.limit(0), ["toxic"])
    assert {(r["p_toxic"] < 1e-9, r["is_toxic"]) for r in score_toxicity(table, none).collect()} == {(True, False)}
    assert score_toxicity(docs([]), model).count() == 0


def test_threshold():
    assert best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)


# shards


def test_draws_equal_plain_python(docs):
    topology = Topology((Shard(0, "a", "r", 2.0), Shard(1, "a", "s", 1.0), Shard(2, "b", "r", 1.0), Shard(3, "b", "r", 4.0)))
    got = {r["doc_id"]: r["shard"] for r in assign_shards(docs([(i, "x") for i in range(200)]), topology).collect()}
    tree = topology.children()

    def draw(key, name, weight):
        h = xxhash.xxh64(name.encode(), xxhash.xxh64(int(key).to_bytes(8, "little", signed=True), 42).intdigest()).intdigest()
        return -math.log((h % (1 << 53) + 0.5) / (1 << 53)) / weight

    for key, shard in got.items():
        node = ""
        for _ in range(3):
            node = min(tree[node], key=lambda n: draw(key, *n))[0]
        assert int(node.rsplit("/", 1)[1]) == shard


def test_movement_is_confined(docs):
    rows = docs([(i, "x" * (i % 7)) for i in range(6000)])
    topology = even_topology(40)
    grown = topology.grown("region1", "rack2")
    got = assign_shards(rows, topology, grown).toPandas()
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) == {40} and 90 < len(moved) < 220
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own))) and 90 < len(own) < 220
    heavy = assign_shards(rows, topology.reweighted(7, 3.0)).toPandas().set_index("doc_id")["shard"]
    before = got.set_index("doc_id")["shard"]
    changed = before[before != heavy.reindex(before.index)]
    region = lambda n: n % 4
    assert len(changed) and all(region(heavy[i]) == region(7) for i in changed.index)


def test_shards_defined_cases(docs):
    rows = [(1, None), (1, None), (None, "é"), (2, ""), (2, "ab")]
    got = assign_shards(docs(rows), even_topology(3, 2, 2)).toPandas()
    assert sorted(got["size"]) == [16, 16, 16, 18, 18] and got["grown_shard"].isna().all()
    assert got[got["doc_id"] == 1]["shard"].nunique() == 1
    assert set(got["text_crc32"]) >= {0, 0x9E83486D}  # crc32 of "ab"
    assert assign_shards(docs([]), even_topology(40)).count() == 0


# WARC


QUIET = {"script", "style", "template", "iframe", "svg"}
LINE = set(
    "address article aside blockquote body br button caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)


class Plain(HTMLParser):
    """Text and links of well-formed pages by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.quiet = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in QUIET:
            self.handle_data(" ")
        self.quiet += tag in QUIET
        if tag in LINE and not self.quiet:
            self.out.append("\n")
        if not self.quiet and tag in ("a", "img", "link", "area", "base"):
            self.links += [v for k, v in attrs if k in ("href", "src")][:1]

    def handle_comment(self, data):
        self.handle_data(" ")

    def handle_startendtag(self, tag, attrs):
        if tag != "svg":
            self.handle_starttag(tag, attrs)
            self.quiet -= tag in QUIET

    def handle_endtag(self, tag):
        self.quiet -= tag in QUIET
        if tag in LINE and not self.quiet:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.quiet:
            self.out.append(" ".join(data.split(" ")).replace("\n", " "))


def test_text_equals_the_standard_parser(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    pages += ["<p>a &amp; b&nbsp;c &#233; &lt;p&gt;</p><ul><li>x<li>y</ul>", "<div title='a>b'>t</div>", "a<br/>b<h1>c</h1>d<span>e</span>f"]
    pages += ['<p>before</p><svg width="1"/><p>after one</p><p>after two</p>', "<p>x<svg><title>no</title><path d='M0'/></svg>y</p><noscript><p>shown</p></noscript>"]
    pages += ["a<!-- <p>no</p> -->b<!---->c", "<style>p{}</style><template><b>no</b></template>z <a href=x data-src=n SRC='y'>q</a><img alt='>' src=\"i.png\">"]
    for page in pages:
        parser = Plain()
        parser.feed(page)
        parser.close()
        lines = [" ".join(x.split()) for x in "".join(parser.out).split("\n")]
        assert [" ".join(x.split()) for x in page_text(page).split("\n")] == [x for x in lines if x]
        assert [t for _, t in Page(page).links] == [t for t in parser.links if t is not None]


@pytest.mark.parametrize("part", ["<a ", "<div ", "<title>", "<html ", "<", "</", "<!--", "<!", "<?", "<a href=", '<a ">"', "<a '", "<svg>", "<script>", "</script ", "<p>", "&", "&#9", "<a b=\"'>", "<template>"])
@pytest.mark.parametrize("end", ["", ">", "</title>", "'>", '">'])
def test_time_follows_the_length_of_a_page(part, end):
    page, begin = part * (1_000_000 // len(part)) + end, time.process_time()
    found = Page(page)
    own = Links("http://a/")
    found.links = [own.absolute(t) for _, t in found.links]
    assert time.process_time() - begin < 5


def test_links_are_joined_as_the_library_does():
    rnd = random.Random(3)
    bases = ["http://a/b/c?d", "https://u@h:8/", "", "foo://x/y", "mailto:q", "//n/p", "::bad[", "/r/s", "http://a"]
    for _ in range(3000):
        target = "".join(rnd.choice("/a.b,%;?#:-=~ é") for _ in range(rnd.randint(0, 7)))
        base = rnd.choice(bases)
        try:
            want = urljoin(base, target.strip())
        except ValueError:
            want = target.strip()
        assert Links(base).absolute(target) == want, (base, target)


def test_no_text_is_lost():
    assert page_text('<p>before</p><svg width="1"/><p>after one</p><p>after two</p>') == "before\nafter one\nafter two"
    assert page_text("<p>a<svg><g>never closed<p>b</p>c") == "a\nb\nc"
    assert page_text("<noscript>kept</noscript><b title='open>text</b> and <i>more</i>") == "kepttext and more"
    assert page_text("1 < 2 <3 <p>x</p> a<b") == "1 < 2 <3\nx\na<b"
    assert page_text("&#" + "9" * 6000 + ";&#x41;&#0065;&amp;") == "�AA&"
    page = Page("<HTML LANG='de-AT'><title>A &amp;\n<b>B</b></title><title>C</title><base href=/x><a name=q>z</a>")
    assert (page.title, page.language, page.links) == ("A & B", "de-AT", [("base", "/x")])


def test_records_link_and_digest(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    responses = response_records(pages).cache()
    made = derived_records(responses, keep=["page_id"])
    assert made.columns == ["page_id", *DERIVED.names]
    source = {r["record_id"]: r for r in responses.collect()}
    rows = made.collect()
    assert len(rows) == 2 * pages.count() and len({r["record_id"] for r in rows}) == len(rows)
    conversions = {r["record_id"] for r in rows if r["warc_type"] == "conversion"}
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for r in rows:
        s = source[r["refers_to"]]
        assert r["target_uri"] == s["target_uri"] and r["source_payload_digest"] == sha(s["payload"].encode())
        assert r["source_block_digest"] == sha((s["http_header"] + s["payload"]).encode())
        assert r["block_digest"] == sha(r["content"].encode()) and r["content_length"] == len(r["content"].encode())
        if r["warc_type"] == "metadata":
            facts = json.loads(r["content"])
            assert r["concurrent_to"] in conversions and facts["http"]["status"] == "HTTP/1.1 200 OK"
            assert facts["http"]["fields"]["Content-Length"] == [str(len(s["payload"].encode()))]
            assert facts["source"]["payload_digest"] == s["payload_digest"]
    write_warc(made, str(tmp_path / "out"))
    text = "".join(r[0] for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect())
    assert text.count("WARC/1.0\r\n") == len(rows)
    one = made.select(record_text().alias("t"), "content_length").first()
    head, _, body = one["t"].partition("\r\n\r\n")
    assert len(body.encode()) == one["content_length"] and "WARC-Refers-To: <urn:uuid:" in head


def test_records_defined_cases(spark):
    rows = [(1, None, None, "x"), (None, "http://a/b?c", "", "x"), (2, "::bad[", "<script>never closed", "x"), (2, "::bad[", "<script>never closed", "x"),
            (3, "http://a/", "<title>T &amp; U</title><a href='/x'>y</a><base href=\"http://[\">", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")
    made = derived_records(response_records(pages)).collect()
    assert len(made) == 10
    assert [r["content"] for r in made if r["warc_type"] == "conversion"] == ["", "", "", "", "T & U\ny"]
    facts = [json.loads(r["content"]) for r in made if r["warc_type"] == "metadata"]
    assert facts[4]["title"] == "T & U" and facts[4]["links"][0] == {"element": "a", "url": "http://a/x"}
    assert derived_records(response_records(pages.limit(0))).count() == 0


# pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    sf_dir, kept = "/root/testdata/sf0.01", [{r["doc_id"] for r in docs.collect()}]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == docs.columns
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
    gone = kept[0] - kept[1]
    assert sum(labels.get(i) == 1 for i in gone) >= 0.95 * sum(labels.values())
    assert sum(labels.get(i) == 0 for i in gone) <= 0.01 * len(labels)
    assert len(kept[1] - kept[2]) <= 0.02 * len(kept[1])
    classes = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs.filter(F.col("doc_id").isin(list(kept[2])))).collect()}
    assert kept[3] == set(classes.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == kept[3]


def test_pipeline_keeps_odd_rows(spark, tmp_path):
    rows = [(1, "the cat sat on the mat today", "en", None), (None, "the dog sat on the mat today too", None, "s"), (2, None, "en", "s"), (3, "", "en", "s"), (1, "the cat sat on the mat today", "en", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit(1)).withColumn("P_toxic", F.lit(2))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    now = corpus_pipeline.toxicity(spark, now, str(tmp_path))
    assert now.count() == 5
    now = corpus_pipeline.language_id(spark, now, str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in now.collect()) == ["1", "1", "None"]
    now = corpus_pipeline.near_dedup(spark, now, str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in now.collect()) == ["1", "None"] and now.columns == table.columns
    assert corpus_pipeline.packing(spark, now, str(tmp_path)).count() == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
