"""The whole jobs: describe products, tokenise them, build the training set, evaluate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchbook.cluster import scratch
from swatchbook.functions.text import template_by_seed
from swatchbook.functions.vectors import LOGIT_SCALE
from swatchbook.operators import catalog
from swatchbook.operators.evaluation import eval_report
from swatchbook.operators.similarity import ROW_BATCH, inbatch_predictions
from swatchbook.operators.tokenizer import tokenize_table
from swatchbook.operators.training_set import pair, split_by_hash
from swatchbook.sources.tables import write_training_set


def clean_products(
    products: DataFrame,
    max_rare_rows: int = catalog.RARE_CATEGORY_ROWS,
    families: Sequence[str] = catalog.SECONDARY_FAMILIES,
) -> DataFrame:
    """Parsed attributes, no rare categories, no secondary families, nulls for missing texts.

    Rare categories are counted over all families, and before missing texts
    become null.
    """
    parsed = catalog.parse_attributes(products)
    kept = catalog.drop_families(catalog.drop_rare_categories(parsed, max_rare_rows), families)
    return catalog.null_missing(kept)


def kept_attributes(products: DataFrame, min_rows: int = catalog.MIN_ATTRIBUTE_ROWS) -> DataFrame:
    """Single-valued attributes with a common name, one row each."""
    return catalog.single_valued(catalog.drop_rare_attributes(catalog.explode_attributes(products), min_rows))


def products_with_values(
    products: DataFrame, min_rows: int = catalog.MIN_ATTRIBUTE_ROWS, unique_ids: bool = False
) -> DataFrame:
    """Facets and attribute values of cleaned products.

    ``unique_ids`` promises one row per product, which saves the attribute
    shuffle and the join back.
    """
    if unique_ids:
        return catalog.facets_with_values_in_row(products, min_rows)
    values = catalog.values_per_product(kept_attributes(products, min_rows))
    return catalog.with_attribute_values(catalog.product_facets(products), values)


def describe_products(
    products: DataFrame,
    max_rare_rows: int = catalog.RARE_CATEGORY_ROWS,
    families: Sequence[str] = catalog.SECONDARY_FAMILIES,
    min_rows: int = catalog.MIN_ATTRIBUTE_ROWS,
    choice: Column | None = None,
    unique_ids: bool = False,
    drop_missing: bool = False,
) -> DataFrame:
    """``(product_id, description)`` from a raw product table."""
    facets = products_with_values(clean_products(products, max_rare_rows, families), min_rows, unique_ids)
    picked = choice if choice is not None else template_by_seed(F.col("product_id"), 0)
    return catalog.describe(facets, picked, drop_missing)


def tokenize_products(
    products: DataFrame, merges: DataFrame, repair: Callable[[Column], Column] | None = None, **options
) -> DataFrame:
    """``(product_id, description_ids, n_tokens, truncated)`` from a raw product table."""
    described = describe_products(products, **options)
    return tokenize_table(described, merges, "product_id", "description", repair=repair)


def build_training_set(
    texts: DataFrame,
    images: DataFrame,
    path: str,
    files: int | Mapping[str, int] | None = None,
    shapes: Mapping[str, Sequence[int]] | None = None,
    key_type: str = "bigint",
) -> dict[str, str]:
    """Join texts and images, label the split by hash, and write it; returns the folders.

    Both should be table reads plus row-wise steps. Tensors are shuffled for
    the join and once more to their files. Intermediate tables are
    removed at the end.
    """
    with scratch(texts.sparkSession):
        labelled, rows = _labelled(texts, images, key_type)
        return write_training_set(labelled, path, files, "dataset", shapes, deal_by=rows)


def _labelled(texts: DataFrame, images: DataFrame, key_type: str) -> tuple[DataFrame, tuple[str, str]]:
    """Pairs with their split label and the row numbers of both sides, by which pairs of one product spread over files."""
    rows = ("_text_row", "_image_row")
    numbered = [df.withColumn(name, F.monotonically_increasing_id()) for df, name in zip((texts, images), rows, strict=True)]
    paired = pair(*numbered, "product_id", key_type)
    return paired.withColumn("dataset", split_by_hash(F.col("product_id"))), rows


def evaluate(
    pairs: DataFrame,
    batch_size: int,
    scale: float = LOGIT_SCALE,
    max_batches: int | None = None,
    alpha: float = 0.5,
    most: int = ROW_BATCH,
) -> DataFrame:
    """The evaluation record of batched pairs of unit vectors, of batches of any size (:func:`inbatch_predictions`)."""
    if max_batches is not None:
        pairs = pairs.filter(F.col("batch_id") < max_batches)
    return eval_report(inbatch_predictions(pairs, batch_size, scale, alpha, most))
