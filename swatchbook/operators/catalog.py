"""Cleaning a product catalogue and its nested attributes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchbook.cluster import global_row_index, sized_join, skew_join, small_side, written
from swatchbook.functions import text

# Fixed values.
MISSING_TEXTS = ("N/D", "[N/D]", "None")
CLEANED_COLUMNS = (
    "product_brand",
    "product_category",
    "product_family",
    "product_sub_category",
    "product_gender",
    "product_main_colour",
    "product_short_description",
    "product_image_path",
)
SECONDARY_FAMILIES = ("Demi-Fine Jewellery", "Fine Jewellery", "Homeware", "Jewellery", "Watches")
IGNORED_ATTRIBUTES = ("Condition", "Occasion")
GENDERS = ("MEN", "WOMEN")
RARE_CATEGORY_ROWS = 10
MIN_ATTRIBUTE_ROWS = 50
ATTRIBUTE_LIST = "array<struct<attribute_name:string,attribute_values:array<string>>>"

# Values in one array at most; a group with more is several rows.
MOST_VALUES = 100_000
# Attribute names that are looked up in a hash set of the plan.
NAMES_IN_PLAN = 10_000


def parse_attributes(products: DataFrame, column: str = "product_attributes") -> DataFrame:
    """JSON text to a typed attribute list; malformed text gives null."""
    return products.withColumn(column, F.from_json(column, ATTRIBUTE_LIST))


def category_value_counts(products: DataFrame) -> DataFrame:
    """``(product_family, product_category, product_sub_category, n_rows)`` in long form."""
    return products.groupBy("product_family", "product_category", "product_sub_category").agg(
        F.count("*").alias("n_rows")
    )


def chunked_sets(
    values: DataFrame, keys: Sequence[str], value: str, out: str, most: int = MOST_VALUES, total: str | None = None
) -> DataFrame:
    """``(keys, out, chunk)``: the sorted distinct values of each group, ``most`` of them in a row at most.

    ``values`` has every (keys, value) once; null values count for the group,
    but are in no list, and a group of nothing else has one empty list. Nearly
    all groups are one row, with ``chunk`` 0. Groups with more values are
    numbered by a sort of all of theirs over range partitions, never in one
    task, and cut by that number: chunk 0 has the smallest ``most`` values,
    and so on. ``total`` is summed over the group and stands in each of its rows.
    """
    stored = written(values, "group-values")
    summed = [F.sum(F.col(total) if total else F.lit(0)).alias("_total")]
    gathered = F.sort_array(F.collect_list(value)).alias(out)
    named = [*keys, out, *([F.col("_total").alias(total)] if total else []), "chunk"]
    # One row per ``most`` values or more.
    large = written(stored.groupBy(*keys).agg(F.count(value).alias("_n"), *summed).filter(F.col("_n") > most), "large-groups")
    first = F.lit(0).cast("bigint")
    if large.isEmpty():
        return stored.groupBy(*keys).agg(gathered, *summed).withColumn("chunk", first).select(*named)

    def with_groups(df: DataFrame, groups: DataFrame, how: str) -> DataFrame:
        """A join in which null keys are equal."""
        other = groups.select(*[F.col(c).alias(f"_g_{c}" if c in keys else c) for c in groups.columns])
        joined = df.join(other, [df[k].eqNullSafe(other[f"_g_{k}"]) for k in keys], how)
        return joined.drop(*[f"_g_{k}" for k in keys])

    one = with_groups(stored, large, "left_anti").groupBy(*keys).agg(gathered, *summed).withColumn("chunk", first)
    many = with_groups(stored.filter(F.col(value).isNotNull()), large, "inner").select(*keys, value, "_total")
    numbered = global_row_index(written(many, "large-values"), [*map(F.col, keys), F.col(value)], name="_number")
    starts = written(numbered.groupBy(*keys).agg(F.min("_number").alias("_start")), "starts")
    chunk = F.expr(f"(_number - _start) div {most}").alias("chunk")
    several = with_groups(numbered, starts, "inner").groupBy(*keys, chunk).agg(gathered, F.first("_total").alias("_total"))
    return one.select(*named).unionByName(several.select(*named))


def category_stats(products: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """Row count and distinct sub-categories of every (family, category).

    The sub-categories are made distinct before they are gathered, so a hot
    category reaches its final task as one row per distinct value. A category
    with more than ``most`` of them has several rows (:func:`chunked_sets`).
    """
    return chunked_sets(
        category_value_counts(products).withColumnRenamed("n_rows", "product_category_count"),
        ("product_family", "product_category"),
        "product_sub_category",
        "product_sub_categories",
        most,
        "product_category_count",
    )


def rare_categories(products: DataFrame, max_rows: int = RARE_CATEGORY_ROWS) -> DataFrame:
    """Categories with at most ``max_rows`` rows in at least one family."""
    return (
        products.groupBy("product_family", "product_category")
        .agg(F.count("*").alias("_n"))
        .filter((F.col("_n") <= max_rows) & F.col("product_category").isNotNull())
        .select("product_category")
        .distinct()
    )


def drop_rare_categories(products: DataFrame, max_rows: int = RARE_CATEGORY_ROWS) -> DataFrame:
    """Remove a category everywhere once it is rare in any family; null categories stay."""
    rare = rare_categories(products, max_rows)
    return sized_join(products, rare, "product_category", "left_anti", "rare-categories")


def drop_families(products: DataFrame, families: Sequence[str] = SECONDARY_FAMILIES) -> DataFrame:
    """Remove the named families. A null family is removed too (NOT IN on null is null)."""
    return products.filter(~F.col("product_family").isin(*families))


def null_missing(products: DataFrame, columns: Sequence[str] = CLEANED_COLUMNS) -> DataFrame:
    """Turn the texts that stand for a missing value into null, in one projection."""
    wanted = set(columns)
    return products.select(
        *[
            F.when(~F.col(c).isin(*MISSING_TEXTS), F.col(c)).alias(c) if c in wanted else F.col(c)
            for c in products.columns
        ]
    )


def explode_attributes(products: DataFrame) -> DataFrame:
    """One row per attribute; products without attributes give no row.

    The outer form, as a plain explode adds filters that parse the JSON again.
    """
    places = products.select("product_id", F.posexplode_outer("product_attributes").alias("_place", "_attribute"))
    return places.filter(F.col("_place").isNotNull()).select("product_id", "_attribute.*")


def attribute_counts(attributes: DataFrame) -> DataFrame:
    return attributes.groupBy("attribute_name").agg(F.count("*").alias("n_rows"))


def attribute_value_counts(attributes: DataFrame) -> DataFrame:
    """``(attribute_name, value, n_rows)`` in long form: any number of values per name.

    A list counts as a row at its first value, or at its only place when it is empty.
    """
    places = attributes.select("attribute_name", F.posexplode_outer("attribute_values").alias("_place", "value"))
    first = F.coalesce(F.col("_place"), F.lit(0)) == 0
    return places.groupBy("attribute_name", "value").agg(F.count_if(first).alias("n_rows"))


def attribute_stats(attributes: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """Row count and all distinct values per attribute name, from one pass over the attributes.

    Values are made distinct over (name, value) before they are gathered, so
    the task of a hot name sees its distinct values and never its rows. A name
    with more than ``most`` values has several rows (:func:`chunked_sets`).
    """
    return chunked_sets(attribute_value_counts(attributes), ("attribute_name",), "value", "attribute_values", most, "n_rows")


def frequent_attribute_names(attributes: DataFrame, min_rows: int = MIN_ATTRIBUTE_ROWS) -> DataFrame:
    return (
        attribute_counts(attributes)
        .filter(F.col("attribute_name").isNotNull() & (F.col("n_rows") >= min_rows))
        .select("attribute_name")
    )


def drop_rare_attributes(attributes: DataFrame, min_rows: int = MIN_ATTRIBUTE_ROWS) -> DataFrame:
    """Keep attributes whose name occurs at least ``min_rows`` times.

    Same rows as an anti join with the rare names, but the kept names are the
    short side. A null name is dropped, and never empties the whole result.
    """
    names = frequent_attribute_names(attributes, min_rows)
    return sized_join(attributes, names, "attribute_name", "left_semi", "attribute-names")


def single_valued(attributes: DataFrame, ignored: Sequence[str] = IGNORED_ATTRIBUTES) -> DataFrame:
    """Drop ignored names and multi-valued lists; the list becomes its only value.

    Empty and null lists stay, with a null value.
    """
    return attributes.filter(
        ~F.col("attribute_name").isin(*ignored) & (F.coalesce(F.size("attribute_values"), F.lit(-1)) <= 1)
    ).withColumn("attribute_values", F.try_element_at("attribute_values", F.lit(1)))


def product_values(attributes: DataFrame) -> DataFrame:
    """``(product_id, attribute_values)``: one row per distinct value of a product, of any number."""
    return attributes.filter(F.col("attribute_values").isNotNull()).select("product_id", "attribute_values").distinct()


def product_value_chunks(attributes: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """``(product_id, attribute_values, chunk)``: sorted set of attribute values per product; null values are left out.

    Values are made distinct before they are gathered. A product with more
    than ``most`` of them has several rows (:func:`chunked_sets`), one whose
    values are all null an empty list. Rows without a product id are no product.
    """
    known = attributes.filter(F.col("product_id").isNotNull())
    each = known.select("product_id", F.col("attribute_values").alias("_value")).distinct()
    return chunked_sets(each, ("product_id",), "_value", "attribute_values", most)


def values_per_product(attributes: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """:func:`product_value_chunks` with the chunks of a product in one row, as its sentence holds all of its values."""
    chunks = F.sort_array(F.collect_list(F.struct("chunk", "attribute_values")))
    per_product = product_value_chunks(attributes, most).groupBy("product_id")
    return per_product.agg(F.flatten(chunks["attribute_values"]).alias("attribute_values"))


def facet_columns() -> list[Column]:
    """The columns a description is made of."""
    return [
        F.col("product_id"),
        F.col("product_family"),
        F.lower(F.coalesce("product_sub_category", "product_category")).alias("desc_category"),
        F.col("product_brand").alias("desc_brand"),
        F.when(F.col("product_gender").isin(*GENDERS), F.lower("product_gender")).alias("desc_gender"),
        F.lower("product_main_colour").alias("desc_color"),
        F.col("product_image_path"),
        F.col("product_short_description"),
    ]


def product_facets(products: DataFrame) -> DataFrame:
    return products.select(*facet_columns())


def with_attribute_values(facets: DataFrame, per_product: DataFrame) -> DataFrame:
    """Add the attribute values of each product; null when it has none.

    ``per_product`` holds one row per product. A product id repeated very often
    on the left is split by the adaptive skew join (left outer, left side).
    """
    return facets.join(per_product, "product_id", "left")


def _row_values(attributes: Column, common: Callable[[Column], Column], ignored: Sequence[str]) -> Column:
    """Sorted distinct values of the attributes in a row whose name is common and not ignored."""
    kept = F.filter(
        attributes,
        lambda a: F.coalesce(common(a["attribute_name"]), F.lit(False))
        & ~a["attribute_name"].isin(*ignored)
        & (F.coalesce(F.size(a["attribute_values"]), F.lit(-1)) <= 1),
    )
    values = F.filter(
        F.transform(kept, lambda a: F.try_element_at(a["attribute_values"], F.lit(1))), lambda v: v.isNotNull()
    )
    return F.when(F.size(kept) > 0, F.sort_array(F.array_distinct(values)))


def facets_with_values_in_row(
    products: DataFrame, min_rows: int = MIN_ATTRIBUTE_ROWS, ignored: Sequence[str] = IGNORED_ATTRIBUTES
) -> DataFrame:
    """:func:`product_facets` plus attribute values, each row's from its own attributes.

    Rows that repeat an id, or have none, keep their own values. The common
    names are written and measured; as a rule they are few, become a hash set
    in the plan, and nothing but their counts is shuffled. Beyond
    ``NAMES_IN_PLAN`` each row's names are looked up by a join that carries a
    row number, with the same result.
    """
    names, small = small_side(frequent_attribute_names(explode_attributes(products), min_rows), "attribute-names", NAMES_IN_PLAN)
    if small:
        known = [r[0] for r in names.collect()]
        rows = products

        def common(name: Column) -> Column:
            return name.isin(known)
    else:
        # Written first: the row number must be the same if a task runs again.
        rows = written(products.withColumn("_row", F.monotonically_increasing_id()), "products")
        each = rows.select("_row", F.explode("product_attributes").alias("a")).select(
            "_row", F.col("a.attribute_name").alias("attribute_name")
        )
        found = skew_join(written(each, "row-names"), names, "attribute_name", "left_semi")
        by_row = found.groupBy("_row").agg(F.collect_set("attribute_name").alias("_common"))
        rows = rows.join(by_row, "_row", "left")

        def common(name: Column) -> Column:
            # A row's own names only.
            return F.array_contains("_common", name)

    return rows.select(*facet_columns(), _row_values(F.col("product_attributes"), common, ignored).alias("attribute_values"))


def describe(facets: DataFrame, choice: Column, drop_missing: bool = False) -> DataFrame:
    """``(product_id, description)``; ``choice`` picks the sentence template of a product.

    The slots are columns of their own, so each is built once per row and not
    once per template, and the generated code stays small.
    """
    filled = [slot.alias(name) for name, slot in text.slot_columns(drop_missing).items()]
    slots = facets.select("product_id", choice.alias("_choice"), *filled)
    return slots.select("product_id", text.sentence(F.col("_choice")).alias("description"))
