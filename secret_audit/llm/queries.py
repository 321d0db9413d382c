"""Queries of the training-data operators over whole tables, and check SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from secret_audit.llm.alignment import alignment_digests
from secret_audit.llm.ann import nearest_neighbours
from secret_audit.llm.bpe import bpe_digests
from secret_audit.llm.dartminhash import near_duplicates
from secret_audit.llm.langid import held_out, identify_languages, train_language_model
from secret_audit.llm.packing import pack_documents
from secret_audit.llm.repeats import remove_repeats
from secret_audit.llm.sharding import assign_shards, even_topology
from secret_audit.llm.token_counts import count_tokens
from secret_audit.llm.topk import top_inner_products
from secret_audit.llm.toxicity import score_toxicity, train_chain
from secret_audit.llm.trie import conversation_paths, prefix_trie, with_shared_openings
from secret_audit.llm.warc import derived_records, response_records

TOXICITY_LABELS = ["quality", "toxic"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_records(response_records(table(spark, sf_dir, "pages")), keep=["page_id"])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_language_model(docs.filter((F.crc32(F.col("doc_id").cast("string")) % 4) != 2))
    return identify_languages(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS u FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, MAX(CAST(list_inner_product(q.u, c.u) AS BIGINT)) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.u) = len(c.u) WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_chain(docs, table(spark, sf_dir, "labels"), TOXICITY_LABELS)
    return score_toxicity(docs, model, keep=["doc_id"])


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    topology = even_topology(40)
    return assign_shards(table(spark, sf_dir, "documents"), topology, topology.grown("region0", "rack0"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(table(spark, sf_dir, "documents"), path, keep=["doc_id"])


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_digests(table(spark, sf_dir, "documents"), path, keep=["doc_id"])


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), digests=True)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_path, piece_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment_digests(table(spark, sf_dir, "documents"), byte_path, piece_path, keep=["doc_id"])


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_openings(conversation_paths(table(spark, sf_dir, "conversations"))))


OP11_SQL = """
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents
), windows AS (
    SELECT r, unnest(range(0, n - 199)) AS i, unnest(list_transform(range(0, n - 199), lambda i: md5(array_slice(x, i + 1, i + 200)))) AS w FROM docs
), again AS (
    SELECT r, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)
), stepped AS (
    SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM again
), spans AS (
    SELECT r, min(i) AS s, max(i) + 200 AS e FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM stepped) GROUP BY r, g
), gaps AS (
    SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS b FROM spans
    UNION ALL SELECT d.r, coalesce(max(s.e), 0), any_value(d.n) FROM docs d LEFT JOIN spans s ON s.r = d.r GROUP BY d.r
), kept AS (
    SELECT r, list_reduce(list(array_slice(x, a + 1, b) ORDER BY a), lambda p, q: p || q) AS x FROM gaps JOIN docs USING (r) GROUP BY r
), counts AS (
    SELECT r, sum(e - s) AS removed, count(*) AS spans FROM spans GROUP BY r
)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(c.removed, 0) AS BIGINT) AS n_removed, coalesce(c.spans, 0) AS n_spans, sha256(k.x) AS kept_sha256
FROM docs d LEFT JOIN counts c USING (r) LEFT JOIN kept k USING (r)
"""

OP13_SQL = """
WITH RECURSIVE numbered AS (
    SELECT conv_id AS c, sha256(length(r) || ':' || r || x) AS t, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(length(r) || ':' || r || x)) AS d
    FROM (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations) WHERE conv_id IS NOT NULL
), crc AS (
    SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
    ), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM numbered)
), opening AS (
    SELECT crc.c, n.d, n.t, n.words FROM crc JOIN numbered n ON n.c = crc.c - crc.c % 20 AND n.d <= crc.h
), moved AS (
    SELECT crc.c, h, h - (SELECT count(*) FROM opening o WHERE o.c = crc.c) AS less FROM crc
), turns AS (
    SELECT * FROM opening UNION ALL SELECT n.c, n.d - m.less, n.t, n.words FROM numbered n JOIN moved m ON n.c = m.c WHERE n.d > m.h
    UNION ALL SELECT c, 0, '', 0 FROM crc
), paths AS (
    SELECT c, d, words, sha256(string_agg(t, ',') OVER (PARTITION BY c ORDER BY d)) AS k,
           max(d) OVER (PARTITION BY c) AS last FROM turns
), nodes AS (
    SELECT d, k, min(c) AS c, count(*) AS n, any_value(words) AS words, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = last) AS ends
    FROM paths GROUP BY d, k
), linked AS (
    SELECT n.*, up.k AS parent FROM nodes n LEFT JOIN paths up ON up.c = n.c AND up.d = n.d - 1
), children AS (
    SELECT d - 1 AS d, parent AS k, count(*) AS n FROM linked WHERE d > 0 GROUP BY 1, 2
), subtree AS (
    SELECT up.d, up.k, sum(CASE WHEN ch.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((u.n - 1) * u.words) AS saved
    FROM nodes u LEFT JOIN children ch ON ch.d = u.d AND ch.k = u.k JOIN paths up ON up.c = u.c AND up.d <= u.d GROUP BY 1, 2
)
SELECT l.c AS conv_id, CAST(l.d AS BIGINT) AS depth, p.c AS parent_conv_id, l.n AS n_convs, coalesce(ch.n, 0) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(l.ends, '')) AS ends_sha256
FROM linked l JOIN subtree s ON s.d = l.d AND s.k = l.k LEFT JOIN nodes p ON p.d = l.d - 1 AND p.k = l.parent
LEFT JOIN children ch ON ch.d = l.d AND ch.k = l.k
"""


QUERIES = {
    "op1_posting_lists": op1_posting_lists,
    "op2_warc": op2_warc,
    "op3_language_id": op3_language_id,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_bpe": op9_bpe,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_repeated_passages": op11_repeated_passages,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

#: The other results can't be stated in SQL: they rest on trained models, hashed draws, tokenizers or approximate search.
ORACLES: dict[str, str] = {"op4_exact_top_k": OP4_SQL, "op11_repeated_passages": OP11_SQL, "op13_prefix_trie": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
