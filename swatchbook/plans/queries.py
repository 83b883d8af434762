"""The registered queries: one per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from swatchbook.cluster import scratch_path, spread, written
from swatchbook.functions import tensors, text, vectors
from swatchbook.operators import (
    batching,
    catalog,
    evaluation,
    inference,
    rejects,
    similarity,
    tokenizer,
    training_set,
)
from swatchbook.plans import jobs
from swatchbook.sources import files, merges, tables
from swatchbook.streaming import feed, images

# A product table made of `part`, as SQL that Spark and DuckDB both read.
PRODUCT_COLUMNS = {
    "product_id": "CAST(p_partkey AS INT)",
    "product_family": "p_type",
    "product_category": "split_part(p_name, ' ', 2)",
    "product_sub_category": "CASE WHEN p_size % 3 = 0 THEN 'N/D' WHEN p_size % 3 = 1 THEN 'None' ELSE p_name END",
    "product_brand": "p_brand",
    "product_gender": (
        "CASE WHEN p_size % 4 = 0 THEN 'MEN' WHEN p_size % 4 = 1 THEN 'WOMEN' "
        "WHEN p_size % 4 = 2 THEN 'UNISEX' ELSE '[N/D]' END"
    ),
    "product_main_colour": "CASE WHEN p_size % 7 = 0 THEN '[N/D]' ELSE split_part(p_name, ' ', 1) END",
    "product_short_description": "CASE WHEN p_size % 11 = 0 THEN NULL ELSE concat(p_type, ' ', p_name) END",
    "product_image_path": "concat('images/', CAST(p_partkey AS STRING), '.jpg')",
    "product_attributes": (
        "CASE WHEN p_size % 6 = 0 THEN '[]' WHEN p_size % 13 = 0 THEN NULL ELSE concat("
        """'[{"attribute_name":"Material","attribute_values":["', p_type, '"]},', """
        """'{"attribute_name":"Condition","attribute_values":["New"]},', """
        """'{"attribute_name":"Fit","attribute_values":["', p_brand, '"]},', """
        """'{"attribute_name":"Sizes","attribute_values":["S","M"]},', """
        """'{"attribute_name":"Rare', CAST(p_size AS STRING), '","attribute_values":["r"]}]') END"""
    ),
}
RARE_ROWS = 30
FAMILIES = ("ECONOMY",)
BATCH = 50
TOP_K = 5
PROJECTED = 16
IMAGE_SHAPE = (3, 8, 8)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def products(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(*[F.expr(sql).alias(name) for name, sql in PRODUCT_COLUMNS.items()])


def joined(values: Column, by: str = "|") -> Column:
    return F.array_join(values, by)


def scaled(values: Column, factor: float) -> Column:
    """Numbers as text, rounded to whole multiples of 1 / factor."""
    return joined(F.transform(values, lambda x: F.round(x.cast("double") * factor).cast("bigint").cast("string")), ",")


# Sources and sinks


@query
def scan_products(spark, sf):
    return products(spark, sf)


@query
def scan_pruned(spark, sf):
    return tables.read_table(spark, f"{sf}/documents.parquet", ["doc_id", "n_chars"])


@query
def sink_roundtrip(spark, sf):
    path = scratch_path(spark, "documents")
    tables.write_table(table(spark, sf, "documents"), path, compression="uncompressed")
    return tables.read_table(spark, path).withColumn("text", F.md5("text"))


def _sides(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("product_id"), "text")
    sides = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("product_id"), "quality", "toxic")
    return texts, sides


def _training_set(spark, sf, counts):
    texts, sides = _sides(spark, sf)
    folders = jobs.build_training_set(texts, sides, scratch_path(spark, "training-set"), counts)
    parts = [
        tables.read_table(spark, path).select("*", F.lit(name).alias("dataset"), F.col("_metadata.file_path").alias("file"))
        for name, path in folders.items()
    ]
    return parts[0].unionByName(parts[1])


@query
def write_training_set(spark, sf):
    rows = _training_set(spark, sf, {"training": 8, "validation": 2})
    return rows.select("product_id", "dataset", F.md5("text").alias("text"), "quality", "toxic")


@query
def split_files(spark, sf):
    rows = _training_set(spark, sf, {"training": 7, "validation": 3})
    return rows.groupBy("dataset").agg(F.countDistinct("file").alias("n_files"), F.count("*").alias("n_rows"))


# Catalogue


@query
def category_stats(spark, sf):
    stats = catalog.category_stats(products(spark, sf)).drop("chunk")
    return stats.withColumn("product_sub_categories", joined(F.col("product_sub_categories")))


@query
def category_values(spark, sf):
    return catalog.category_value_counts(products(spark, sf))


@query
def category_chunks(spark, sf):
    """Sub-categories of each family, three in a row at most."""
    values = products(spark, sf).groupBy("product_family", "product_sub_category").agg(F.count("*").alias("n_rows"))
    sets = catalog.chunked_sets(values, ("product_family",), "product_sub_category", "names", 3, "n_rows")
    return sets.withColumn("names", joined(F.col("names")))


@query
def rare_category_anti(spark, sf):
    kept = catalog.drop_rare_categories(products(spark, sf), RARE_ROWS)
    return kept.select("product_id", "product_family", "product_category")


@query
def family_exclusion(spark, sf):
    return catalog.drop_families(products(spark, sf), FAMILIES).select("product_id", "product_family")


@query
def null_sentinels(spark, sf):
    return catalog.null_missing(products(spark, sf)).drop("product_attributes")


@query
def product_facets(spark, sf):
    return catalog.product_facets(catalog.null_missing(products(spark, sf)))


def _parsed(spark, sf):
    return catalog.parse_attributes(products(spark, sf))


@query
def parse_attributes(spark, sf):
    return _parsed(spark, sf).select(
        "product_id",
        F.size("product_attributes").alias("n_attributes"),
        joined(F.col("product_attributes.attribute_name")).alias("names"),
    )


@query
def explode_attributes(spark, sf):
    return catalog.explode_attributes(_parsed(spark, sf)).withColumn(
        "attribute_values", joined(F.col("attribute_values"))
    )


@query
def attribute_stats(spark, sf):
    stats = catalog.attribute_stats(catalog.explode_attributes(_parsed(spark, sf))).drop("chunk")
    return stats.withColumn("attribute_values", joined(F.col("attribute_values")))


@query
def attribute_values(spark, sf):
    counts = catalog.attribute_value_counts(catalog.explode_attributes(_parsed(spark, sf)))
    return counts.filter("value IS NOT NULL")


@query
def rare_attribute_anti(spark, sf):
    kept = catalog.drop_rare_attributes(catalog.explode_attributes(_parsed(spark, sf)))
    return kept.select("product_id", "attribute_name", joined(F.col("attribute_values")).alias("attribute_values"))


@query
def attribute_filter(spark, sf):
    return catalog.single_valued(catalog.explode_attributes(_parsed(spark, sf)))


@query
def attributes_per_product(spark, sf):
    values = catalog.values_per_product(jobs.kept_attributes(_parsed(spark, sf)))
    return values.withColumn("attribute_values", joined(F.col("attribute_values")))


@query
def product_values(spark, sf):
    return catalog.product_values(jobs.kept_attributes(_parsed(spark, sf)))


@query
def products_with_attributes(spark, sf):
    cleaned = jobs.clean_products(products(spark, sf), RARE_ROWS, FAMILIES)
    return jobs.products_with_values(cleaned).withColumn("attribute_values", joined(F.col("attribute_values")))


@query
def products_with_attributes_in_row(spark, sf):
    cleaned = jobs.clean_products(products(spark, sf), RARE_ROWS, FAMILIES)
    return jobs.products_with_values(cleaned, unique_ids=True).withColumn(
        "attribute_values", joined(F.col("attribute_values"))
    )


@query
def verbalize_list(spark, sf):
    """The attribute names of each product, and the values of each attribute."""
    parsed = _parsed(spark, sf)
    values = catalog.explode_attributes(parsed).select("product_id", F.col("attribute_values").alias("items"))
    names = parsed.select("product_id", F.col("product_attributes.attribute_name").alias("items"))
    lists = values.unionByName(names).filter(F.size("items") > 0)
    return lists.select("product_id", text.list_phrase(F.col("items")).alias("phrase"))


def _described(spark, sf, rare_rows=RARE_ROWS, unique_ids=False):
    return jobs.describe_products(
        products(spark, sf),
        rare_rows,
        FAMILIES,
        choice=text.template_by_key(F.col("product_id")),
        unique_ids=unique_ids,
    )


@query
def verbalize(spark, sf):
    return _described(spark, sf)


@query
def verbalize_in_row(spark, sf):
    return _described(spark, sf, unique_ids=True)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Product descriptions, with a rare-category limit that suits the smallest tables."""
    return _described(spark, sf, rare_rows=1)


# Text


@query
def clean_text(spark, sf):
    cleaned = text.clean_text(F.col("html"))
    return spread(table(spark, sf, "pages").select("page_id", "html")).select(
        "page_id", F.length(cleaned).alias("n_chars"), F.md5(cleaned).alias("cleaned")
    )


def _words(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", tokenizer.words_of(F.col("text")).alias("words"))


@query
def pretokenize(spark, sf):
    return _words(spark, sf).select(
        "doc_id", F.size("words").alias("n_words"), F.md5(joined(F.col("words"), " ")).alias("words")
    )


def _framed(spark, sf):
    # Word lengths stand for ids; start and end id are larger than any of them.
    ids = F.transform("words", lambda w: F.length(w))
    return _words(spark, sf).select("doc_id", ids.alias("ids"))


@query
def frame_sequence(spark, sf):
    ids = F.col("ids")
    framed = text.frame_ids(ids, 1_000_000, 1_000_001)
    return _framed(spark, sf).select(
        "doc_id",
        joined(F.transform(framed, lambda i: i.cast("string")), ",").alias("ids"),
        text.framed_size(ids).alias("n_tokens"),
        text.loses_end(ids).cast("int").alias("truncated"),
    )


@query
def eot_position(spark, sf):
    framed = text.frame_ids(F.col("ids"), 1_000_000, 1_000_001)
    return _framed(spark, sf).select("doc_id", text.end_position(framed).alias("position"))


_MERGE_LISTS: dict[tuple[str, str], str] = {}


def merge_list(spark: SparkSession, sf: str) -> DataFrame:
    """A merge list read from a gz file that holds the documents' own letter pairs.

    Pairs of letters, of a pair and a letter, and of two pairs, inside words of
    plain letters, each kind by falling count. Written once per session.
    """
    known = (spark.sparkContext.applicationId, sf)
    if known not in _MERGE_LISTS:
        docs = spread(table(spark, sf, "documents").select("text"))
        each = tokenizer.chunk_counts(docs, "text").select(F.explode_outer(text.pretokenize(F.col("chunk"))).alias("word"), "n")
        words = each.groupBy("word").agg(F.sum("n").alias("n"))
        words = written(words.filter(F.col("word").rlike("^[a-z]+$")), "words")
        levels = []
        for level, (a, b) in enumerate(((1, 1), (2, 1), (2, 2)), start=1):
            last = F.col("i") + a + b - 1 == F.length("word")
            right = F.substring("word", F.col("i") + a, F.lit(b))
            levels.append(
                words.filter(F.length("word") >= a + b)
                .select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - (a + b - 1))).alias("i"))
                .select(
                    F.lit(level).alias("level"),
                    F.substring("word", F.col("i"), F.lit(a)).alias("left"),
                    F.when(last, F.concat(right, F.lit("</w>"))).otherwise(right).alias("right"),
                    "n",
                )
                .groupBy("level", "left", "right")
                .agg(F.sum("n").alias("n"))
            )
        pairs = levels[0].unionByName(levels[1]).unionByName(levels[2])
        header = spark.range(1).select(
            F.lit(0).alias("level"), F.lit("#version:").alias("left"), F.lit("1").alias("right"), F.col("id").alias("n")
        )
        path = scratch_path(spark, "merges")
        (
            header.unionByName(pairs)
            .orderBy("level", F.desc("n"), "left", "right")
            # A merge list has a fixed maximum length, plus its header line.
            .limit(merges.MAX_MERGES + 1)
            .select(F.concat_ws(" ", "left", "right").alias("value"))
            .coalesce(1)
            .write.option("compression", "gzip")
            .text(path)
        )
        _MERGE_LISTS[known] = path
    return merges.read_merge_list(spark, _MERGE_LISTS[known])


@query
def bpe_vocab(spark, sf):
    return merges.vocabulary(merge_list(spark, sf))


def _id_text(ids: Column) -> Column:
    return joined(ids.cast("array<string>"), ",")


@query
def bpe_encode(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = tokenizer.encode_texts(docs, merge_list(spark, sf), "text")
    return coded.select("doc_id", F.size("ids").alias("n_ids"), F.md5(_id_text(F.col("ids"))).alias("ids"))


@query
def bpe_words(spark, sf):
    docs = table(spark, sf, "documents").select("text")
    words = tokenizer.word_table(docs, merge_list(spark, sf), "text")
    return words.select("word", "n_texts", _id_text(F.col("ids")).alias("ids"))


@query
def bpe_decode(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pairs = merge_list(spark, sf)
    decoded = tokenizer.decode_ids(tokenizer.encode_texts(docs, pairs, "text"), pairs)
    return decoded.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text"))


def _tokens(df: DataFrame, key: str) -> DataFrame:
    return df.select(
        key,
        _id_text(F.col("description_ids")).alias("description_ids"),
        "n_tokens",
        F.col("truncated").cast("int").alias("truncated"),
    )


@query
def tokenize_table(spark, sf):
    docs = table(spark, sf, "documents")
    return _tokens(tokenizer.tokenize_table(docs, merge_list(spark, sf), "doc_id", "text"), "doc_id")


@query
def tokenize_products(spark, sf):
    coded = jobs.tokenize_products(
        products(spark, sf),
        merge_list(spark, sf),
        max_rare_rows=RARE_ROWS,
        families=FAMILIES,
        choice=text.template_by_key(F.col("product_id")),
    )
    return _tokens(coded, "product_id")


# Training set


@query
def path_to_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", training_set.key_from_path(F.col("url"), "html").alias("key"))


@query
def hash_shard(spark, sf):
    return table(spark, sf, "pages").select("page_id", training_set.hash_shard(F.col("url")).alias("shard"))


@query
def pair_inner(spark, sf):
    texts, sides = _sides(spark, sf)
    return training_set.pair(texts, sides).withColumn("text", F.md5("text"))


@query
def pair_large_keys(spark, sf):
    """Ids beyond 32 bits on both sides."""
    texts, sides = (
        df.withColumn("product_id", (F.col("product_id").cast("bigint") + 3_000_000_000).cast(kind))
        for df, kind in zip(_sides(spark, sf), ("bigint", "string"), strict=True)
    )
    return training_set.pair(texts, sides).withColumn("text", F.md5("text"))


@query
def pair_unusable(spark, sf):
    texts, sides = _sides(spark, sf)
    named = sides.withColumn("product_id", F.when(F.col("toxic") == 1, F.concat(F.lit("x"), "product_id")).otherwise(F.col("product_id")))
    return training_set.unusable_keys(texts, named)


@query
def split_label(spark, sf):
    key = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        training_set.split_by_hash(key).alias("by_int_hash"),
        training_set.split_by_hash(key, "bigint").alias("by_bigint_hash"),
        training_set.split_by_hash(key, "string").alias("by_string_hash"),
        training_set.split_by_key(key).alias("by_key"),
    )


@query
def split_counts(spark, sf):
    label = training_set.split_by_hash(F.col("doc_id"))
    return table(spark, sf, "documents").groupBy(label.alias("dataset")).agg(F.count("*").alias("n_rows"))


@query
def work_shard(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")

    def summary(rows):
        out = rows.groupby("shard", as_index=False).agg(n_rows=("doc_id", "size"), n_chars=("n_chars", "sum"))
        return out.astype("int64")

    shards = batching.shard_count(docs, 100)
    return batching.map_by_shard(docs, summary, "shard bigint, n_rows bigint, n_chars bigint", "doc_id", shards)


@query
def map_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")

    def doubled(rows):
        return rows.assign(n_chars=rows["n_chars"] * 2)

    return batching.map_rows(docs, doubled, docs.schema)


@query
def assign_batches(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return batching.assign_batches(docs, "doc_id", BATCH, shuffle=False, epochs=2)


@query
def shuffled_batches(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    batches = batching.assign_batches(docs, "doc_id", BATCH, seed=7, epochs=3)
    sizes = batches.groupBy("batch_id").agg(
        F.count("*").alias("n_rows"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.min("epoch").alias("first_epoch"),
        F.max("epoch").alias("last_epoch"),
    )
    return sizes


@query
def shuffled_epochs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    batches = batching.assign_batches(docs, "doc_id", BATCH, seed=7, epochs=3)
    return batches.groupBy("epoch").agg(
        F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_docs"), F.sum("n_chars").alias("n_chars")
    )


@query
def epoch_order(spark, sf):
    """Every row's place in three epochs."""
    docs = table(spark, sf, "documents").select("doc_id")
    return batching.assign_batches(docs, "doc_id", BATCH, seed=11, epochs=3, first_epoch=4)


@query
def single_batch(spark, sf):
    return batching.single_batch(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", BATCH)


@query
def file_batches(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return batching.file_batches(docs, BATCH).select("doc_id", "slice_id", "pos")


@query
def file_shards(spark, sf):
    path = scratch_path(spark, "files")
    tables.write_table(table(spark, sf, "documents").repartition(7), path)
    dealt = batching.file_shards(tables.read_table(spark, path), 3)
    total = dealt.agg(F.lit(-1).alias("worker"), F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"))
    each = dealt.groupBy("worker").agg(F.count("*").alias("n_files")).withColumn("n_rows", F.lit(None).cast("bigint"))
    return each.unionByName(total)


# Tensors and embeddings


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings")


@query
def l2_normalize(spark, sf):
    grown = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5 + 1))
    unit = similarity.l2_normalize(_embeddings(spark, sf).select("vec_id", grown.alias("v")), "v")
    return unit.select("vec_id", scaled(F.col("v"), 1e6).alias("v"))


@query
def channel_normalize(spark, sf):
    tensor = F.concat("embedding", "embedding", "embedding")
    out = vectors.standardize_channels(F.col("t"), 64, 2.0)
    return _embeddings(spark, sf).select("vec_id", tensor.alias("t")).select("vec_id", scaled(out, 1e6).alias("t"))


def _weights(rows: int, columns: int) -> np.ndarray:
    i, j = np.indices((rows, columns))
    return ((i * 7 + j) % 5 - 2).astype(np.float64)


@query
def project_embedding(spark, sf):
    out = inference.project(_embeddings(spark, sf), "embedding", _weights(64, PROJECTED), "shared")
    return out.select("vec_id", scaled(F.col("shared"), 1e6).alias("shared"))


@query
def embed_table(spark, sf):
    weights = _weights(64, PROJECTED)

    def make_predict():
        return lambda batch: batch.astype(np.float64) @ weights

    out = inference.embed_table(_embeddings(spark, sf), make_predict, "embedding", 64, "shared")
    return out.select("vec_id", scaled(F.col("shared"), 1e6).alias("shared"))


@query
def embed_rejects(spark, sf):
    """A model that refuses the short vectors of one label, and null ones of another."""
    vecs = _embeddings(spark, sf).select(
        "vec_id", F.when(F.col("label") == 7, F.slice("embedding", 1, 63)).when(F.col("label") != 3, F.col("embedding")).alias("v")
    )
    weights = _weights(64, PROJECTED)
    found = inference.embed_with_rejects(vecs, lambda: lambda x: x @ weights, "v", 64, "shared", ["vec_id"])
    return found.select("vec_id", scaled(F.col("shared"), 1e4).alias("shared"), "error")


@query
def tensor_roundtrip(spark, sf):
    stored = _embeddings(spark, sf).select(
        "vec_id", tensors.npy_encode(F.col("embedding"), (4, 16)).alias("cell")
    )
    return stored.select(
        "vec_id",
        joined(tensors.npy_shape(F.col("cell")).cast("array<string>"), ",").alias("shape"),
        scaled(tensors.npy_decode(F.col("cell")), 1e6).alias("v"),
    )


@query
def reject_split(spark, sf):
    # Vectors of one label lose an element, which the transform refuses.
    uneven = F.when(F.col("label") == 7, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))

    def largest(rows):
        if (rows["v"].map(len) != 64).any():
            raise ValueError("not 64 values")
        return np.stack(rows["v"].to_numpy()).max(axis=1).astype(np.float64)

    def block(rows):
        import pandas as pd

        return pd.Series(largest(rows))

    mapped = rejects.map_with_rejects(
        _embeddings(spark, sf).select("vec_id", uneven.alias("v")),
        block,
        StructField("largest", DoubleType()),
        ["vec_id"],
    )
    good = rejects.accepted(mapped).withColumn("largest", F.round("largest", 6))
    return good.unionByName(rejects.rejected(mapped, "largest"), allowMissingColumns=True)


def _pairs(spark, sf):
    """Even vectors as images, the next odd one as the text, in batches by order."""
    half = F.expr("vec_id div 2")
    even = F.col("vec_id") % 2 == 0
    sides = _embeddings(spark, sf).groupBy(half.alias("k")).agg(
        F.max(F.when(even, F.col("embedding"))).alias("img"), F.max(F.when(~even, F.col("embedding"))).alias("txt")
    )
    placed = sides.select(
        F.expr(f"k div {BATCH}").alias("batch_id"), (F.col("k") % BATCH).cast("int").alias("pos"), "img", "txt"
    )
    # An odd number of vectors leaves the last one without a partner.
    whole = placed.filter(F.col("img").isNotNull() & F.col("txt").isNotNull())
    return similarity.l2_normalize(similarity.l2_normalize(whole, "img"), "txt")


def _logits(spark, sf):
    return similarity.inbatch_logits(_pairs(spark, sf), BATCH)


def _predictions(spark, sf):
    return similarity.batch_predictions(_logits(spark, sf))


@query
def inbatch_logits(spark, sf):
    return _logits(spark, sf).select(
        "batch_id", "pos", *[scaled(F.col(c), 1e6).alias(c) for c in ("img_logits", "txt_logits")]
    )


@query
def pair_logit(spark, sf):
    """Only the logits of matching pairs, without their batches."""
    logit = vectors.scaled_cosine(F.col("img"), F.col("txt"))
    return _pairs(spark, sf).select("batch_id", "pos", F.round(logit, 6).alias("logit"))


@query
def inbatch_top1(spark, sf):
    return _predictions(spark, sf).select("batch_id", "pos", "pred_img", "pred_txt")


@query
def retrieval_accuracy(spark, sf):
    scores = evaluation.accuracy(evaluation.confusion(_predictions(spark, sf)))
    return scores.withColumn("accuracy", F.round("accuracy", 6))


@query
def retrieval_prf_macro(spark, sf):
    scores = evaluation.macro_scores(evaluation.confusion(_predictions(spark, sf)))
    return scores.select("direction", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f_score")])


@query
def contrastive_loss(spark, sf):
    losses = evaluation.batch_loss(_predictions(spark, sf))
    return losses.withColumn("loss", F.round("loss", 6))


@query
def eval_report(spark, sf):
    report = jobs.evaluate(_pairs(spark, sf), BATCH)
    return report.select(*[F.round(c, 6).alias(c) for c in report.columns])


@query
def eval_report_dealt(spark, sf):
    """Batches dealt by the row index instead of placed by arithmetic, then evaluated."""
    pairs = _pairs(spark, sf).select((F.col("batch_id") * BATCH + F.col("pos")).alias("k"), "img", "txt")
    dealt = batching.assign_batches(pairs, "k", BATCH, shuffle=False)
    report = jobs.evaluate(dealt.select("batch_id", "pos", "img", "txt"), BATCH)
    return report.select(*[F.round(c, 6).alias(c) for c in report.columns])


@query
def eval_report_tiles(spark, sf):
    """Batches that are scored in tiles of seven pairs."""
    report = jobs.evaluate(_pairs(spark, sf), BATCH, most=7)
    return report.select(*[F.round(c, 6).alias(c) for c in report.columns])


@query
def eval_report_steps(spark, sf):
    report = jobs.evaluate(_pairs(spark, sf), BATCH, max_batches=3)
    return report.select(*[F.round(c, 6).alias(c) for c in report.columns])


@query
def topk_retrieval(spark, sf):
    vecs = _embeddings(spark, sf)
    best = similarity.nearest(vecs, vecs, TOP_K, "vec_id", "embedding", "vec_id", "embedding")
    return best.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query
def embedding_parity(spark, sf):
    ours = _embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    # The other model: rounded values, and other ids for one label.
    theirs = _embeddings(spark, sf).select(
        F.when(F.col("label") == 3, F.col("vec_id") + 1_000_000).otherwise(F.col("vec_id")).alias("id"),
        F.transform("embedding", lambda x: F.round(x.cast("double"), 3)).alias("vec"),
    )
    report = similarity.embedding_parity(ours, theirs)
    return report.withColumn("max_abs_diff", F.round("max_abs_diff", 9))


# History


@query
def running_best(spark, sf):
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    history = (
        table(spark, sf, "events")
        .groupBy(
            F.col("user_id").alias("run"),
            F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("epoch"),
        )
        .agg((cents / F.count("*")).alias("metric"))
    )
    best = evaluation.running_best(history, every=3, block=8)
    return best.withColumns({"metric": F.round("metric", 6), "is_best": F.col("is_best").cast("int")})


# Streams


def _stage_images(spark, sf, folder=None, only="true"):
    """One grey 8 x 8 picture per embedding, as three equal planes of bytes; label 7 loses a byte."""
    byte = lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127.5).cast("bigint")), 2, "0")
    plane = F.array_join(F.transform("embedding", byte), "")
    whole = F.unhex(F.concat(plane, plane, plane))
    content = F.when(F.col("label") == 7, F.substring(whole, 1, 191)).otherwise(whole)
    name = F.format_string("label=%d/%d.jpg", "label", "vec_id")
    folder = folder or scratch_path(spark, "pictures")
    pictures = _embeddings(spark, sf).filter(only).select(name.alias("name"), content.alias("content"))
    files.write_files(pictures, folder, "name", "content")
    return folder


@query
def stream_binary_scan(spark, sf):
    folder = _stage_images(spark, sf)
    out, checkpoint = scratch_path(spark, "scan"), scratch_path(spark, "scan-log")
    rows = images.stream_files(spark, folder).select(
        training_set.key_from_path(F.col("path")).alias("product_id"),
        F.col("length").alias("n_bytes"),
        F.md5("content").alias("content"),
    )
    images.append_new(rows, out, checkpoint, partition_by=())
    return spark.read.parquet(out)


@query
def stream_shard_sink(spark, sf):
    folder = _stage_images(spark, sf)
    out, checkpoint = scratch_path(spark, "tensors"), scratch_path(spark, "tensors-log")
    stream = images.image_tensors(images.stream_files(spark, folder), images.raw_bytes(IMAGE_SHAPE), IMAGE_SHAPE)
    images.append_new(stream, out, checkpoint)
    restored = F.zip_with(
        tensors.npy_decode(F.col("img_array")),
        F.sequence(F.lit(0), F.lit(191)),
        lambda x, i: F.round(
            (
                x * F.get(F.array(*map(F.lit, vectors.CHANNEL_STD)), F.floor(i / 64).cast("int"))
                + F.get(F.array(*map(F.lit, vectors.CHANNEL_MEAN)), F.floor(i / 64).cast("int"))
            )
            * 255
        ).cast("bigint"),
    )
    total = F.aggregate(restored, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    good = images.read_tensors(spark, out).withColumns({"rejected": F.lit(0), "byte_sum": total})
    bad = images.read_rejects(spark, out).withColumns({"rejected": F.lit(1), "byte_sum": F.lit(None).cast("bigint")})
    in_range = F.col("shard").between(0, 9).cast("int").alias("in_range")
    return good.drop("img_array").unionByName(bad.drop("error")).select("product_id", "rejected", "byte_sum", in_range)


@query
def stream_training_set(spark, sf):
    """Pictures arrive in two parts; each run of the stream adds what is new to the training set."""
    tokens = written(_tokenized_products(spark, sf), "tokens")
    folder, path, log = (scratch_path(spark, name) for name in ("pictures", "fed", "fed-log"))
    for part in ("vec_id % 3 = 0", "vec_id % 3 > 0"):
        _stage_images(spark, sf, folder, part)
        stream = images.image_tensors(images.stream_files(spark, folder), images.raw_bytes(IMAGE_SHAPE), IMAGE_SHAPE)
        feed.feed_training_set(stream, tokens, path, log, {"training": 2, "validation": 1}, {"description_ids": [77], "img_array": list(IMAGE_SHAPE)})
    pixels = tensors.npy_decode(F.col("img_array"))
    # Weighted by place, so that the order of the pixels counts.
    weighed = F.aggregate(F.transform(pixels, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    sets = [
        feed.read_split(spark, path, name).select(F.col("product_id").cast("string").alias("product_id"), F.lit(name).alias("dataset"), "n_tokens", F.round(weighed, 2).alias("weighed"))
        for name in ("training", "validation", feed.UNMATCHED)
    ]
    rejected = feed.read_split(spark, path, feed.REJECTED).select("product_id", F.lit(feed.REJECTED).alias("dataset"), F.lit(None).cast("int").alias("n_tokens"), F.lit(None).cast("double").alias("weighed"))
    return sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(rejected)


def _tokenized_products(spark, sf):
    return jobs.tokenize_products(
        products(spark, sf),
        merge_list(spark, sf),
        max_rare_rows=RARE_ROWS,
        families=FAMILIES,
        choice=text.template_by_key(F.col("product_id")),
        unique_ids=True,
    )


@query
def train_batches(spark, sf):
    """The whole way: described and tokenised products, paired with tensors, split, and dealt into batches."""
    # Read several times below; encoded once.
    tokens = written(_tokenized_products(spark, sf), "tokens")
    sides = _embeddings(spark, sf).select(
        F.col("vec_id").cast("string").alias("product_id"),
        tensors.npy_encode(F.col("embedding"), (64,)).alias("img_array"),
    )
    shapes = {"description_ids": [77], "img_array": [64]}
    path = scratch_path(spark, "train")
    folders = jobs.build_training_set(tokens, sides, path, {"training": 4, "validation": 2}, shapes)
    training = tables.read_table(spark, folders["training"], ["product_id", "n_tokens"])
    return batching.assign_batches(training, "product_id", BATCH, shuffle=False)
