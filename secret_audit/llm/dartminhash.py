"""Near-duplicate documents by DartMinHash signatures of weighted word shingles.

A document is the weighted set of its runs of five words (weight: how often the run occurs); a shorter one has all its words
as one run. Darts are thrown into the region (weight, rank) of every element: a hashed Poisson process per element and
weight cell, whose arrivals along the rank axis do not depend on the document. Of the darts below the element's weight each
coordinate of the signature keeps the earliest, and its rank is the value. Equal values happen with the probability of the
weighted Jaccard similarity. Bands of a few coordinates are joined, and links are checked exactly.

``near_duplicates`` returns a row per document with its class. Copies are grouped first; after that

1. texts that share a band are linked to the smallest document of the band, and each link is checked on the whole texts;
2. connected links form components; bands that still hold several components are linked anew from other members in up to
   ``rounds`` rounds: from the one with most links so far, and from two drawn by hash;
3. members of bands that hold several components even then are joined on their rarest shingles. Two texts that reach the
   threshold share one of these (prefix filter), so no link between two components of a band is left out.

No band and no group of copies is capped. The rounds only make components fewer; the last step is exact without them.

Defined results: documents with equal texts (also empty ones) are one class; a null text, or a null id, is a class of its
own and never a duplicate. Texts are told apart by their digests: rows with one id and different texts are classed by their
texts, and no text goes because its id has another one. The class id is the smallest document id of the class, and of the
texts with that id the one with the smallest digest is the first; ``class_digest`` tells classes apart that share their
smallest id. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secret_audit.llm.spark_tools import map_slices, stored
from secret_audit.llm.textkit import mix, ranges, slices, spread, texts_of, word_hashes

WORDS, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 30, 5
#: Further rounds of comparisons between the components of a band, and rows in a file of ids.
ROUNDS, SLIM_ROWS = 2, 250_000
#: Counters of the shingles' frequencies, which only order them: shared counters cost time, not links.
COUNTERS = 1 << 18
_SEEDS = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def weighted_shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order of hash, their weights, and their numbers per text."""
    hashes, n = word_hashes(texts)
    first = np.cumsum(n) - n
    count = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    at, doc = ranges(first, count), spread(count)
    last = (first + n)[doc]
    shingle = np.zeros(len(at), np.uint64)
    for j in range(words):
        word = hashes[np.minimum(at + j, len(hashes) - 1)] if len(hashes) else hashes
        shingle += np.where(at + j < last, word, np.uint64(j + 1)) * _SEEDS[j]
    shingle = mix(shingle)
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    weight = np.diff(np.append(begin, len(shingle))).astype(np.float64)
    return shingle[begin], weight, np.bincount(doc[begin], minlength=len(texts)).astype(np.int64)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Signature of every weighted set: k ranks, or infinite ones for an empty set. Weights are positive, of the order of 1."""
    doc = spread(counts)
    total = np.bincount(doc, weights, minlength=len(counts))
    out = np.full((len(counts), k), np.inf)
    limit = np.where(total > 0, (k * math.log(k) + 2 * k) / np.where(total > 0, total, 1), 0)
    todo = counts > 0
    while todo.any():
        own = todo[doc]
        found = _throw(elements[own], weights[own], doc[own], limit, len(counts), k)
        out[todo] = found[todo]
        todo &= np.isinf(out).any(axis=1)
        limit = limit * 2
    return out


def _throw(elements, weights, doc, limit, docs: int, k: int) -> np.ndarray:
    """Earliest rank per document and coordinate among the darts below each document's rank limit."""
    cells = np.where(weights > 1, 1 + np.ceil(np.log2(np.maximum(weights, 1))), 1).astype(np.int64)
    of = spread(cells)
    level = ranges(np.zeros(len(cells), np.int64), cells)
    key = mix(elements[of] + level.astype(np.uint64) * _SEEDS[8])
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    top, own, rank = weights[of], doc[of], np.zeros(len(of))
    best = np.full(docs * k, np.inf)
    at, step = 0, 1
    while len(key):
        h = mix(key[:, None] + np.arange(at + 1, at + step + 1, dtype=np.uint64)[None, :] * _SEEDS[9])
        gap = -np.log1p(-((h >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / width[:, None]
        gap[:, 0] += rank
        ranks = np.cumsum(gap, axis=1)
        other = mix(h)
        height = low[:, None] + width[:, None] * ((other >> np.uint64(32)).astype(np.float64) * 2.0**-32)
        hit = (ranks < limit[own][:, None]) & (height < top[:, None])
        row, col = np.nonzero(hit)
        slot = own[row] * k + ((other[row, col] & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, slot, ranks[row, col])
        rank = ranks[:, -1]
        on = rank < limit[own]
        key, low, width, top, own, rank = key[on], low[on], width[on], top[on], own[on], rank[on]
        at, step = at + step, step if at + step < 4 else step * 2
    return best.reshape(docs, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        key = mix(key * _SEEDS[10] + bits[:, :, r])
    return mix(key + np.arange(bands, dtype=np.uint64)[None, :] * _SEEDS[11]).view(np.int64)


def similarities(left: list[str], right: list[str], words: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; 0 where both have no word."""
    (a, x, n), (b, y, m) = weighted_shingles(left, words), weighted_shingles(right, words)
    pair, element, weight = np.concatenate((spread(n), spread(m))), np.concatenate((a, b)), np.concatenate((x, y))
    order = np.lexsort((element, pair))
    pair, element, weight = pair[order], element[order], weight[order]
    same = (pair[1:] == pair[:-1]) & (element[1:] == element[:-1])
    shared = np.bincount(pair[1:][same], np.minimum(weight[1:], weight[:-1])[same], minlength=len(left))
    total = np.bincount(pair, weight, minlength=len(left)) - shared
    return np.where(total > 0, shared / np.where(total > 0, total, 1), 0.0)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """_id, digest of the text and the band keys (null without a word), for rows whose text is not null."""

    def make():
        def run(part: pa.RecordBatch) -> list[pa.Array]:
            elements, weights, counts = weighted_shingles(texts_of(part, "_text"), words)
            keys = band_keys(dart_minhash(elements, weights, counts, bands * rows), bands, rows)
            return [pa.array([k if n else None for k, n in zip(keys, counts, strict=True)], pa.list_(pa.int64()))]

        return run

    field = T.StructField("_bands", T.ArrayType(T.LongType()))
    digests = docs.filter("_text is not null").select("_id", "_text", F.unhex(F.md5("_text")).alias("_digest"))
    return map_slices(digests, ["_id", "_digest"], "_text", [field], make)


def verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold. ``texts`` is a stored table with one row per _id.

    Both joins are plain ones of a hot key's pairs with a single text, so Spark splits a hot document's pairs over tasks.
    """
    left = pairs.join(texts, F.col("a") == F.col("_id")).select("a", "b", F.col("_text").alias("_left"))
    both = left.join(texts, F.col("b") == F.col("_id")).select("a", "b", "_left", F.col("_text").alias("_right"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_left"):
                keep = similarities(texts_of(part, "_left"), texts_of(part, "_right"), words) >= threshold
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, schema)


def slim(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Store a table of two ids per row in as few files as its number of rows asks for."""
    return stored(df.coalesce(max(1, rows // SLIM_ROWS)), name)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Large-star and small-star steps by turns, each a grouped minimum and a join, until each component is a star.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    rows = edges.count()
    while True:
        # In stars every node has one link, and what it leads to has none.
        linked = edges.groupBy("a").agg(F.count("*").alias("n"))
        inner = edges.select(F.col("b").alias("a"), F.lit(2).alias("n"))
        if linked.join(inner.select("a").distinct(), "a", "left_semi").unionByName(linked.filter("n > 1")).isEmpty():
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).filter("a > b").distinct()
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(small, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        edges = slim(star.filter("a <> b").distinct(), rows, "links")


def _classed(docs: DataFrame, words: int, threshold: float, bands: int, band_rows: int, rounds: int) -> DataFrame:
    """_id, _digest, _class and _class_digest of the rows of (_id, _text) that have neither null.

    A node of the graph of links is a distinct text, whatever ids it has.
    """
    docs = docs.filter("_id is not null and _text is not null")
    signed = stored(signatures(docs, words, bands, band_rows), "signatures")
    firsts = signed.groupBy("_digest").agg(F.min("_id").alias("_first"), F.first("_bands").alias("_bands"))
    # Numbered in the order of the smallest ids: what copies were made from tends to come first and leads its bands.
    firsts = firsts.repartitionByRange("_first", "_digest").sortWithinPartitions("_first", "_digest")
    firsts = stored(firsts.withColumn("node", F.monotonically_increasing_id()), "firsts")
    members = firsts.select("node", F.explode("_bands").alias("key"))
    leaders = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").drop("high")
    shared = stored(members.join(leaders, "key"), "bands")
    needed = firsts.join(shared.select("node").distinct(), "node").select(F.col("_first").alias("_id"), "_digest", "node")
    whole = docs.withColumn("_digest", F.unhex(F.md5("_text"))).join(needed, ["_id", "_digest"]).dropDuplicates(["_id", "_digest"])
    texts = stored(whole.select(F.col("node").alias("_id"), "_text"), "shared-texts")
    tried = stored(shared.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "pairs")
    links = stored(verified(tried, texts, words, threshold), "links")
    found = stored(components(links), "components")
    for turn in range(rounds):
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
        known = found.join(ends.groupBy("node").agg(F.count("*").alias("degree")), "node", "left")
        pairs = stored(_other_pairs(shared.drop("low"), known, turn).join(tried, ["a", "b"], "left_anti"), "pairs")
        more = stored(verified(pairs, texts, words, threshold), "links")
        if more.isEmpty():
            break
        links, tried = links.unionByName(more), tried.unionByName(pairs)
        # The stars so far stand for all earlier links.
        stars = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = stored(components(stars.unionByName(more)), "components")
    rest = stored(_unsettled(shared.drop("low"), found), "unsettled")
    if not rest.isEmpty():
        pairs = stored(_rare_pairs(rest, texts, words, threshold).join(tried, ["a", "b"], "left_anti"), "pairs")
        stars = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = stored(components(stars.unionByName(stored(verified(pairs, texts, words, threshold), "links"))), "components")
    rooted = firsts.join(found, "node", "left").select("_digest", "_first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min(F.struct("_first", "_digest")).alias("_least"))
    classes = rooted.join(least, "root").select("_digest", F.col("_least._first").alias("_class"), F.col("_least._digest").alias("_class_digest"))
    return signed.select("_id", "_digest").join(stored(classes, "classes"), "_digest")


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
    bands: int = BANDS, band_rows: int = BAND_ROWS, rounds: int = ROUNDS,
) -> DataFrame:
    """(doc_id, class_id, class_digest, is_first) per row: the class and whether this is its first document."""
    docs = df.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    rows = _classed(docs, words, threshold, bands, band_rows, rounds)
    first = (F.col("_id") == F.col("_class")) & (F.col("_digest") == F.col("_class_digest"))
    rows = rows.select("_id", "_class", F.lower(F.hex("_class_digest")).alias("_class_digest"), first.alias("is_first"))
    alone = docs.filter("_id is null or _text is null").select("_id", F.col("_id").alias("_class"), F.lit(None).cast("string").alias("_class_digest"), F.lit(True).alias("is_first"))
    both = rows.unionByName(alone)
    return both.select(F.col("_id").alias("doc_id"), F.col("_class").alias("class_id"), F.col("_class_digest").alias("class_digest"), "is_first")


def _other_pairs(shared: DataFrame, known: DataFrame, turn: int) -> DataFrame:
    """Pairs between a few members of every band that holds several components and its members of other components.

    Picked are the member with most links so far, which is likely the text that the others were made from, and two by hash.
    """
    rooted = shared.join(known, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
    orders = [-F.col("degree"), F.xxhash64("node", "key", F.lit(2 * turn)), F.xxhash64("node", "key", F.lit(2 * turn + 1))]
    picks = F.array(*[F.min(F.struct(o.alias("order"), "node", "root")) for o in orders])
    grouped = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), picks.alias("picks"))
    picked = grouped.filter("low < high").select("key", F.explode("picks").alias("p")).select("key", "p.node", "p.root").distinct()
    pairs = rooted.join(picked.toDF("key", "q", "other"), "key").filter("root <> other")
    return pairs.select(F.greatest("node", "q").alias("a"), F.least("node", "q").alias("b")).distinct()


def _unsettled(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root, crowd) of the members of bands that hold several components; crowd: how many of them the root has."""
    rooted = shared.join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    rest = stored(rooted.join(mixed, "key", "left_semi").select("node", "root").distinct(), "unsettled")
    return rest.join(rest.groupBy("root").agg(F.count("*").alias("crowd")), "root").select("node", "root", "crowd")


def shingle_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many texts have a shingle, in COUNTERS counters that shingles share by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                elements = weighted_shingles(texts_of(part, "_text"), words)[0]
                counts += np.bincount((elements % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["counter", "n"])

    rows = texts.select("_text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)  # one row per counter at most
    out[rows.column("counter").to_numpy()] = rows.column("n").to_numpy()
    return out


def prefixes(texts: list[str], counts: np.ndarray, words: int, threshold: float) -> tuple[np.ndarray, ...]:
    """Rarest shingles of each text as rows: number of the text, shingle, weight of the text, weight from the shingle on.

    Texts that reach the threshold share at least its share of the heavier text. So the first shingle that they share, in
    an order common to all texts, has that much weight from it on, and the other shingles need not be looked at.
    """
    elements, weights, n = weighted_shingles(texts, words)
    doc = spread(n)
    order = np.lexsort((elements, counts[(elements % np.uint64(COUNTERS)).astype(np.int64)], doc))
    elements, weights = elements[order], weights[order]
    total = np.bincount(doc, weights, minlength=len(texts))
    left = np.cumsum(total)[doc] - np.cumsum(weights) + weights
    keep = left >= threshold * total[doc] - 1e-6
    return doc[keep], elements[keep].view(np.int64), total[doc][keep], left[keep]


def _rare_pairs(rest: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Pairs of texts of different components that may reach the threshold, by a shared rare shingle.

    The weight from the first shared shingle on bounds what two texts share. By that bound the lighter text of a pair has a
    shorter prefix; shingles of a common template drop out there. In every shingle's group the texts of its largest
    component meet only the others, so a group of near copies is not expanded into pairs.
    """
    spark = texts.sparkSession
    counts = spark.sparkContext.broadcast(shingle_counts(texts, words))  # COUNTERS numbers
    whole = texts.join(rest, F.col("_id") == F.col("node")).select("node", "root", "crowd", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                doc, element, size, left = prefixes(texts_of(part, "_text"), counts.value, words, threshold)
                own = part.select(["node", "root", "crowd"]).take(pa.array(doc))
                most = left * ((1 + threshold) / threshold) - size + 1e-6  # heaviest text that the bound allows
                arrays = [*own.columns, pa.array(element), pa.array(size), pa.array(most)]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "root", "crowd", "element", "size", "most"])

    schema = "node long, root long, crowd long, element long, size double, most double"
    rows = stored(whole.mapInArrow(run, schema), "prefixes")
    ends = [F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("crowd", "root")).alias("top")]
    mixed = rows.groupBy("element").agg(*ends).filter("low < high").select("element", F.col("top.root").alias("main"))
    kept = rows.join(mixed, "element").withColumn("in_main", F.col("root") == F.col("main")).drop("crowd", "main")
    kept = stored(kept, "prefixes")
    heavier = kept.toDF(*[f"{c}_2" if c != "element" else c for c in kept.columns])
    lighter = kept.filter("most >= size")
    bound = F.expr("root <> root_2 and (size < size_2 or size = size_2 and node < node_2) and most >= size_2 and most_2 >= size")
    met = [(lighter.filter("not in_main"), heavier), (lighter.filter("in_main"), heavier.filter("not in_main_2"))]
    found = [x.join(y, (x["element"] == y["element"]) & bound).select("node", "node_2") for x, y in met]
    both = found[0].unionByName(found[1])
    return both.select(F.greatest("node", "node_2").alias("a"), F.least("node", "node_2").alias("b")).distinct()


def without_near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
    bands: int = BANDS, band_rows: int = BAND_ROWS, rounds: int = ROUNDS,
) -> DataFrame:
    """The table with one document of each class, the first; rows that repeat its id and text stay once.

    A row goes by its id and the digest of its text. Rows with a null id or a null text stay as they are.
    """
    number, content = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text}`").cast("string")
    rows = _classed(df.select(number.alias("_id"), content.alias("_text")), words, threshold, bands, band_rows, rounds)
    later = (F.col("_id") != F.col("_class")) | (F.col("_digest") != F.col("_class_digest"))
    own = "_of_" + "_" * max(map(len, df.columns))
    gone = rows.filter(later).select(F.col("_id").alias(f"{own}id"), F.col("_digest").alias(f"{own}digest")).distinct()
    left = df.withColumn(f"{own}id", number).withColumn(f"{own}digest", F.unhex(F.md5(content)))
    fixed = F.col(f"{own}id").isNull() | F.col(f"{own}digest").isNull()
    kept = left.filter(~fixed).join(gone, [f"{own}id", f"{own}digest"], "left_anti").dropDuplicates([f"{own}id", f"{own}digest"])
    return kept.unionByName(left.filter(fixed)).select([F.col("`" + c.replace("`", "``") + "`") for c in df.columns])
