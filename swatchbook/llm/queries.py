"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchbook.llm import (
    filter_audit,
    language,
    license_scan,
    metric_join,
    minhash,
    mixing,
    packing,
    pii,
    runs,
    secret_scan,
    suffix_dedup,
    token_counts,
    topk,
)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Whoever uses the operator passes a key of their own and keeps it.
PSEUDONYM_KEY = "registered query"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary(), length=2048, end_id=0)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary(), limit=1024)


@query
def op10_block_max_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir).select("vec_id", topk.quantised(F.col("embedding"), 64).alias("vector"))
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


ORACLE["op10_block_max_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.w, d.w) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id <> d.vec_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op5_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(embeddings(spark, sf_dir), cosine=0.93)


ORACLE["op5_metric_range_join"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.w, b.w) >= 0.93
), reach AS (
    SELECT vec_id AS node, vec_id AS other FROM embeddings
    UNION
    SELECT l.b, r.other FROM reach r JOIN links l ON l.a = r.node
), classes AS (
    SELECT node, min(other) AS component_id FROM reach GROUP BY node
), degrees AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN classes c ON c.node = e.vec_id LEFT JOIN degrees d ON d.a = e.vec_id
"""


@query
def op4_minhash_tensored_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_documents(documents(spark, sf_dir), percent=75)


ORACLE["op4_minhash_tensored_banding"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
        END AS s
    FROM words
), named AS (
    SELECT list_sort(s) AS s, min(doc_id) AS doc_id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
), shingles AS (
    SELECT doc_id, n, unnest(s) AS x FROM named
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
    WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), links AS (
    SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
    UNION ALL SELECT s.doc_id, n.doc_id FROM sets s JOIN named n ON list_sort(s.s) = n.s WHERE s.doc_id <> n.doc_id
    UNION ALL SELECT n.doc_id, s.doc_id FROM sets s JOIN named n ON list_sort(s.s) = n.s WHERE s.doc_id <> n.doc_id
), reach AS (
    SELECT doc_id AS node, doc_id AS other FROM sets
    UNION
    SELECT l.b, r.other FROM reach r JOIN links l ON l.a = r.node
), classes AS (
    SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept
FROM sets s JOIN classes c ON c.node = s.doc_id
"""


@query
def op6_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, cap=2)


@query
def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir), key=PSEUDONYM_KEY)


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


@query
def op8_bayesian_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(documents(spark, sf_dir))


@query
def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op2_external_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), length=100)


def folded_words(doc_id: int | None, size: int) -> np.ndarray | None:
    """Of every tenth document, by checksum of its id, the words from one on repeat; a null id's never do."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not size:
        return None
    g = h // 10
    first = g % size
    period = 1 + (size - first) // (3 + g % 8)
    places = np.arange(size)
    return np.where(places < first, places, first + (places - first) % period)


@query
def op11_synchronising_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.word_runs(documents(spark, sf_dir), min_length=6, exponent=4, reorder=folded_words)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", runs.longest_run()).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan_licenses(documents(spark, sf_dir)))


@query
def op13_truth_table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE["op13_truth_table_audit"] = r"""
WITH RECURSIVE named AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), judged AS (
    SELECT doc_id, part,
           CASE WHEN len(w) < 50 THEN 1 ELSE 0 END AS a,
           CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 1 ELSE 0 END AS b,
           CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 1 ELSE 0 END AS c,
           CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
           CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 1 ELSE 0 END AS e
    FROM named
), marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), masks AS (
    SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS m, count(*) AS n,
           coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM judged LEFT JOIN marks USING (doc_id) GROUP BY 1, 2
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS v
), orders AS (
    SELECT f AS filter_order, v AS used FROM letters
    UNION ALL
    SELECT o.filter_order || l.f, o.used + l.v FROM orders o JOIN letters l ON (o.used & l.v) = 0
), steps AS (
    SELECT filter_order, step, v, (SELECT coalesce(sum(x.v), 0) FROM letters x
                                   WHERE strpos(substr(filter_order, 1, CAST(step - 1 AS INTEGER)), x.f) > 0) AS before
    FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders WHERE used = 31) p
    JOIN letters ON f = substr(filter_order, CAST(step AS INTEGER), 1)
), counted AS (
    SELECT part, filter_order, step, v,
           sum(CASE WHEN m & before = 0 AND m & v = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN m & before = 0 AND m & v <> 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN m & before <> 0 AND m & v <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN m = v THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN m & before = 0 AND m & v <> 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN m & before = 0 AND m & v <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM masks CROSS JOIN steps GROUP BY part, filter_order, step, v
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, v) AS BIGINT) AS shapley
FROM counted
"""
