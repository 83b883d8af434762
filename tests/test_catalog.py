import json

import pytest
from pyspark.sql import functions as F

from swatchbook.functions import text
from swatchbook.operators import catalog
from swatchbook.plans import jobs

COLUMNS = (
    "product_id int, product_family string, product_category string, product_sub_category string, "
    "product_brand string, product_gender string, product_main_colour string, "
    "product_short_description string, product_image_path string, product_attributes string"
)


def product(i, family="Shoes", category="boots", **other):
    row = {
        "product_id": i,
        "product_family": family,
        "product_category": category,
        "product_sub_category": None,
        "product_brand": "Acme",
        "product_gender": "MEN",
        "product_main_colour": "Red",
        "product_short_description": "A thing",
        "product_image_path": f"{i}.jpg",
        "product_attributes": None,
    }
    row.update(other)
    return tuple(row.values())


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def ids(df):
    return sorted(r["product_id"] for r in df.collect())


def test_missing_texts_become_null(spark):
    values = ["N/D", "[N/D]", "None", "none", None]
    df = table(spark, [product(i, product_brand=v) for i, v in enumerate(values)])
    out = {r["product_id"]: r["product_brand"] for r in catalog.null_missing(df).collect()}
    assert out == {0: None, 1: None, 2: None, 3: "none", 4: None}


def test_category_rare_in_one_family_goes_everywhere(spark):
    rows = [product(i, "X", "boots") for i in range(5)]
    rows += [product(10, "Y", "boots"), product(11, "Y", None), product(12, "X", None)]
    rows += [product(20 + i, "X", "caps") for i in range(3)]
    assert ids(catalog.drop_rare_categories(table(spark, rows), 2)) == [11, 12, 20, 21, 22]


def test_null_family_is_excluded(spark):
    rows = [product(0, None), product(1, "Watches"), product(2, "Shoes")]
    assert ids(catalog.drop_families(table(spark, rows))) == [2]


def attribute(name, values):
    return {"attribute_name": name, "attribute_values": values}


@pytest.fixture
def attributed(spark):
    lists = [
        [attribute("Fit", []), attribute("Material", None), attribute("Cut", ["x"]), attribute("Size", ["x", "y"])],
        [attribute("Condition", ["New"]), attribute("Occasion", ["Day"]), attribute(None, ["z"])],
        [],
        None,
    ]
    texts = [json.dumps(entry) if entry is not None else None for entry in lists] + ["not json"]
    rows = [product(i, product_attributes=t) for i, t in enumerate(texts)]
    return catalog.parse_attributes(table(spark, rows))


def test_single_values(attributed):
    out = catalog.single_valued(catalog.explode_attributes(attributed)).collect()
    assert sorted(tuple(r) for r in out) == [(0, "Cut", "x"), (0, "Fit", None), (0, "Material", None)] or sorted(
        ((r[0], r[1], r[2] or "") for r in out)
    ) == [(0, "Cut", "x"), (0, "Fit", ""), (0, "Material", "")]


def test_values_per_product_leaves_out_nulls(attributed):
    out = catalog.values_per_product(catalog.single_valued(catalog.explode_attributes(attributed)))
    assert [tuple(r) for r in out.collect()] == [(0, ["x"])]


def test_a_null_rare_name_does_not_empty_the_result(spark, attributed):
    kept = catalog.drop_rare_attributes(catalog.explode_attributes(attributed), 1).collect()
    assert {r["attribute_name"] for r in kept} == {"Fit", "Material", "Cut", "Size", "Condition", "Occasion"}
    assert catalog.drop_rare_attributes(catalog.explode_attributes(attributed), 2).count() == 0


def test_attribute_stats(spark):
    rows = [
        product(0, product_attributes=json.dumps([attribute("Fit", ["b", "a"]), attribute("Cut", [])])),
        product(1, product_attributes=json.dumps([attribute("Fit", ["a"]), attribute(None, ["n"])])),
    ]
    stats = catalog.attribute_stats(catalog.explode_attributes(catalog.parse_attributes(table(spark, rows))))
    assert {r[0]: (r[1], r[2]) for r in stats.collect()} == {
        "Fit": (["a", "b"], 2),
        "Cut": ([], 1),
        None: (["n"], 1),
    }


def test_both_routes_to_values_agree(spark, attributed):
    joined = jobs.products_with_values(attributed, 1).collect()
    in_row = jobs.products_with_values(attributed, 1, unique_ids=True).collect()
    key = lambda r: r["product_id"]
    assert sorted(joined, key=key) == sorted(in_row, key=key)
    assert {r["product_id"]: r["attribute_values"] for r in joined}[2] is None


@pytest.mark.parametrize("most", [200_000, 0])
def test_values_in_row_are_the_same_at_every_size(spark, monkeypatch, most):
    """Rows that repeat an id, or have none, keep their own values on either route."""
    rows = [(1, "A"), (1, "B"), (None, "C"), (2, None)]
    listed = F.when(F.col("v").isNotNull(), F.array(F.struct(F.lit("n").alias("attribute_name"), F.array("v").alias("attribute_values"))))
    base = spark.createDataFrame(rows, "product_id int, v string").withColumn("product_attributes", listed)
    others = ["product_family", "product_category", "product_sub_category", "product_brand", "product_gender"]
    others += ["product_main_colour", "product_image_path", "product_short_description"]
    df = base.select("product_id", "product_attributes", *[F.lit("x").alias(c) for c in others])
    monkeypatch.setattr(catalog.small_side, "__defaults__", (most,))
    got = catalog.facets_with_values_in_row(df, 1).select("product_id", "attribute_values").collect()
    assert sorted(map(str, map(tuple, got))) == ["(1, ['A'])", "(1, ['B'])", "(2, None)", "(None, ['C'])"]


def test_large_groups_come_in_chunks(spark):
    """Groups beyond the limit, null keys, null values, and groups that stay whole, in one table."""
    rows = spark.sql(
        "SELECT CASE WHEN id < 10 THEN 'n' WHEN id < 17 THEN NULL WHEN id < 20 THEN 'few' ELSE 'none' END AS attribute_name, "
        "array(CASE WHEN id < 20 THEN lpad(CAST(id % 10 AS STRING), 2, '0') END) AS attribute_values FROM range(22)"
    )
    rows = rows.union(rows.limit(3)).union(spark.sql("SELECT 'n', array(CAST(NULL AS STRING))"))
    got = {(r.attribute_name, r.chunk): (r.attribute_values, r.n_rows) for r in catalog.attribute_stats(rows, 4).collect()}
    assert got == {
        ("n", 0): (["00", "01", "02", "03"], 14),
        ("n", 1): (["04", "05", "06", "07"], 14),
        ("n", 2): (["08", "09"], 14),
        (None, 0): (["00", "01", "02", "03"], 7),
        (None, 1): (["04", "05", "06"], 7),
        ("few", 0): (["07", "08", "09"], 3),
        ("none", 0): ([], 2),
    }
    whole = {r.attribute_name: (r.attribute_values, r.chunk) for r in catalog.attribute_stats(rows, 10).collect()}
    assert whole["n"] == ([f"{n:02d}" for n in range(10)], 0)


def test_a_group_of_many_values_is_no_error(spark):
    df = spark.range(250_000).selectExpr("'n' AS attribute_name", "array(CAST(id AS STRING)) AS attribute_values")
    got = catalog.attribute_stats(df).orderBy("chunk").collect()
    assert [(r.chunk, len(r.attribute_values), r.n_rows) for r in got] == [(0, 100_000, 250_000), (1, 100_000, 250_000), (2, 50_000, 250_000)]
    assert got[0].attribute_values[-1] < got[1].attribute_values[0] and got[1].attribute_values[-1] < got[2].attribute_values[0]


def test_a_product_of_many_values_is_one_row_again(spark):
    df = spark.range(25).selectExpr("CASE WHEN id < 20 THEN 1 ELSE 2 END AS product_id", "CAST(id AS STRING) AS attribute_values")
    assert catalog.product_value_chunks(df, 6).count() == 5
    whole = {r.product_id: r.attribute_values for r in catalog.values_per_product(df, 6).collect()}
    assert whole == {1: sorted(map(str, range(20))), 2: ["20", "21", "22", "23", "24"]}


@pytest.mark.parametrize(
    ("items", "phrase"), [(["A"], "a"), (["A", "B"], "a and b"), (["A", "B", "C"], "a, b and c")]
)
def test_list_phrase(spark, items, phrase):
    df = spark.createDataFrame([(items,)], "x array<string>")
    assert df.select(text.list_phrase(F.col("x"))).first()[0] == phrase


FACETS = "desc_category string, desc_brand string, desc_gender string, desc_color string, product_short_description string, attribute_values array<string>"


@pytest.mark.parametrize(
    ("row", "sentences"),
    [
        (
            ("ring", "Acme", None, None, None, None),
            ["a ring made by Acme   .", "a ring made by Acme ;  .", "ring  from Acme ."],
        ),
        (
            ("ring", "Acme", "men", "red", " Big Ring ", ["Gold", "Tin"]),
            [
                "a ring made by Acme color red with gold and tin for men. big ring",
                "a ring made by Acme with gold and tin; color red for men. big ring",
                "red ring with gold and tin from Acme for men. big ring",
            ],
        ),
        (
            (None, None, "men", None, "x", []),
            ["a None made by None   for men. x", "a None made by None ;  for men. x", "None  from None for men. x"],
        ),
    ],
)
def test_sentences(spark, row, sentences):
    df = spark.createDataFrame([(i, *row) for i in range(3)], "product_id int, " + FACETS)
    out = catalog.describe(df, F.col("product_id")).collect()
    assert [r["description"] for r in sorted(out)] == sentences


def test_missing_parts_can_be_left_out(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, None)], "product_id int, " + FACETS)
    assert catalog.describe(df, F.lit(0), drop_missing=True).first()["description"] == "a  made by    ."


def test_seeded_choice_is_stable_and_spread(spark):
    picks = spark.range(3000).select(
        text.template_by_seed(F.col("id"), 1).alias("a"),
        text.template_by_seed(F.col("id"), 1).alias("b"),
        text.template_by_seed(F.col("id"), 2).alias("c"),
    )
    assert picks.filter("a <> b").count() == 0
    assert picks.filter("a <> c").count() > 1000
    assert all(900 < r["count"] < 1100 for r in picks.groupBy("a").count().collect())
