"""Plans that must stay free of a shuffle, and filters that must reach the scan."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from swatchbook.cluster import written
from swatchbook.functions import text
from swatchbook.operators import batching, catalog, similarity, tokenizer, training_set
from swatchbook.plans import jobs
from swatchbook.plans.queries import PRODUCT_COLUMNS
from swatchbook.sources import merges


def plan(df, mode="simple"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue().replace("BroadcastExchange", "")


@pytest.fixture(scope="module")
def products(spark):
    parts = spark.range(500).select(
        F.col("id").alias("p_partkey"),
        F.concat(F.lit("red "), (F.col("id") % 5).cast("string")).alias("p_name"),
        F.lit("Acme").alias("p_brand"),
        F.lit("LARGE").alias("p_type"),
        (F.col("id") % 50).cast("int").alias("p_size"),
    )
    return written(parts.select(*[F.expr(sql).alias(name) for name, sql in PRODUCT_COLUMNS.items()]), "products")


def test_sentences_without_a_shuffle(products):
    described = jobs.describe_products(products, 1, unique_ids=True)
    assert "Exchange" not in plan(described)
    assert plan(described).count("from_json") == 1
    pushed = [line for line in plan(described, "formatted").splitlines() if line.startswith("PushedFilters")]
    assert "Not(In(product_family" in pushed[0]


def test_json_is_parsed_once_when_exploded(products):
    assert plan(catalog.explode_attributes(catalog.parse_attributes(products))).count("from_json") == 1


def test_encoding_without_a_shuffle(spark, tmp_path, products):
    path = tmp_path / "merges.txt"
    path.write_text("#version\na b\n")
    pairs = merges.read_merge_list(spark, str(path))
    # One file of one split is dealt out first; a table of enough splits is not.
    assert plan(tokenizer.tokenize_table(products.coalesce(1), pairs, "product_id", "product_short_description")).count("Exchange") == 1
    coded = plan(tokenizer.tokenize_table(products, pairs, "product_id", "product_short_description"))
    assert "Exchange" not in coded and "MapInArrow" in coded
    assert "ReadSchema: struct<product_id:int,product_short_description:string>" in coded


def test_slices_and_labels_without_a_shuffle(products):
    assert "Exchange" not in plan(batching.file_batches(products, 10, shuffle=True))
    assert "Exchange" not in plan(products.select(training_set.split_by_hash(F.col("product_id"))))
    assert "Exchange" not in plan(products.select(text.clean_text(F.col("product_brand"))))


def test_two_shuffles_per_batch_of_scores(spark):
    rows = spark.range(10).select(
        F.lit(0).cast("bigint").alias("batch_id"), F.col("id").cast("int").alias("pos"), F.array(F.lit(1.0)).alias("img"), F.array(F.lit(1.0)).alias("txt")
    )
    assert plan(similarity.inbatch_logits(rows, 10)).count("Exchange") == 2


def test_ranking_limits_rows_before_the_shuffle(spark):
    scores = spark.range(10).select((F.col("id") % 3).alias("query_id"), "id", F.rand().alias("score"))
    assert plan(similarity._ranked(scores, 3)).count("WindowGroupLimit") == 2
