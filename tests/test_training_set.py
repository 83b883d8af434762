import pytest
from pyspark.sql import functions as F

from swatchbook.cluster import scratch_path, written
from swatchbook.operators import training_set
from swatchbook.plans import jobs
from swatchbook.sources import tables


@pytest.mark.parametrize(("path", "key"), [("a/b/12.jpg", "12"), ("a/njpgx.jpg", "njpgx"), ("x.jpg.jpg", "x.jpg"), ("9", "9")])
def test_key_from_path(spark, path, key):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(training_set.key_from_path(F.col("p"))).first()[0] == key


def test_shards_are_spread_and_in_range(spark):
    paths = spark.range(5000).select(F.concat(F.lit("dbfs:/x/"), "id", F.lit(".jpg")).alias("p"))
    counts = paths.groupBy(training_set.hash_shard(F.col("p")).alias("s")).count().collect()
    assert {r["s"] for r in counts} == set(range(10))
    assert all(400 < r["count"] < 600 for r in counts)


def test_pairs_ignore_names_without_a_number(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "product_id int, description string")
    imgs = written(
        spark.createDataFrame([("1", 10), ("2", 20), ("2", 21), ("x2", 30), (None, 40), ("9", 50)], "product_id string, img int"),
        "imgs",
    )
    rows = training_set.pair(texts, imgs).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "a", 10), (2, "b", 20), (2, "b", 21)]


def test_pairs_with_a_hot_key(spark):
    texts = spark.range(100).select(F.col("id").cast("int").alias("product_id"), F.col("id").alias("t"))
    imgs = written(
        spark.range(3000).select(
            F.when(F.col("id") % 3 == 0, F.lit("5")).otherwise((F.col("id") % 200).cast("string")).alias("product_id"),
            F.col("id").alias("img"),
        ),
        "imgs",
    )
    want = sorted(tuple(r) for r in training_set.pair(texts, imgs).collect())
    got = sorted(tuple(r) for r in training_set.pair(texts, imgs, piece_rows=100).collect())
    assert got == want and len(got) > 1900


def test_split_survives_the_smallest_int_and_depends_on_the_type(spark):
    df = spark.createDataFrame([(1,), (-(2**31),), (None,)], "k bigint")
    labels = df.select(training_set.split_by_hash(F.col("k"))).collect()
    assert {r[0] for r in labels} <= {"training", "validation"}
    many = spark.range(16000).select(training_set.split_by_hash(F.col("id")).alias("d")).groupBy("d").count().collect()
    share = {r["d"]: r["count"] / 16000 for r in many}
    assert abs(share["training"] - 14 / 16) < 0.01
    assert spark.range(32).filter(training_set.split_by_key(F.col("id")) == "validation").count() == 4
    # The hash of the smallest int must not overflow.
    assert spark.sql("SELECT abs(cast(-2147483648 as bigint)) % 16 AS x").first()[0] == 0


def paired(spark, n=800):
    texts = spark.range(n).select(F.col("id").cast("int").alias("product_id"), F.array(F.col("id").cast("int")).alias("description_ids"))
    imgs = written(spark.range(n).select(F.col("id").cast("string").alias("product_id"), F.lit("z").alias("img_array")), "imgs")
    return texts, imgs


def test_a_folder_per_split(spark):
    texts, imgs = paired(spark)
    path = scratch_path(spark, "set")
    shapes = {"description_ids": [1], "img_array": [3, 2, 2]}
    folders = jobs.build_training_set(texts, imgs, path, {"training": 5, "validation": 2}, shapes)
    training, validation = (tables.read_table(spark, folders[n]) for n in ("training", "validation"))
    assert training.columns == ["product_id", "description_ids", "img_array"]
    assert tables.shapes_of(training) == shapes
    keys = [{r[0] for r in t.select("product_id").collect()} for t in (training, validation)]
    assert not keys[0] & keys[1] and keys[0] | keys[1] == set(range(800))
    assert training.select("_metadata.file_path").distinct().count() == 5
    assert validation.select("_metadata.file_path").distinct().count() == 2
    assert all("gz" in f for f in training.inputFiles())
    # A second run replaces the first.
    jobs.build_training_set(texts, imgs, path, {"training": 3, "validation": 2}, shapes)
    spark.catalog.clearCache()
    assert tables.read_table(spark, folders["training"]).count() == len(keys[0])


def test_one_shuffle_after_the_join_and_nothing_staged(spark, monkeypatch):
    texts, imgs = paired(spark)
    labelled, rows = jobs._labelled(texts, imgs, "bigint")
    plan = tables.dealt_to_files(labelled, {"training": 5, "validation": 2}, deal_by=rows)._jdf.queryExecution().executedPlan().toString()
    before, _, after = plan.partition("Join")
    assert before.count("Exchange") == 1 and after
    staged = []
    monkeypatch.setattr(tables, "scratch_path", lambda *a: staged.append(a))
    path = scratch_path(spark, "set")
    jobs.build_training_set(texts, imgs, path, {"training": 5, "validation": 2})
    assert not staged
    # Nothing but the splits is left.
    import os

    assert sorted(os.listdir(path)) == ["training", "validation"]


def test_files_of_a_hot_key_and_of_an_empty_split(spark):
    """All pairs belong to one product: they still spread over the files, and the other split is empty."""
    texts = written(spark.range(40).selectExpr("7 AS product_id", "id AS t"), "texts")
    imgs = written(spark.range(30).selectExpr("'7' AS product_id", "'same' AS img_array"), "imgs")
    path = scratch_path(spark, "set")
    folders = jobs.build_training_set(texts, imgs, path, {"training": 4, "validation": 3})
    sizes = {name: tables.read_table(spark, folder).groupBy("_metadata.file_path").count().collect() for name, folder in folders.items()}
    full, empty = sorted(sizes.values(), key=len, reverse=True)
    assert sum(r["count"] for r in full) == 1200 and len(full) >= 3 and max(r["count"] for r in full) < 600
    assert empty == []
    assert tables.read_table(spark, folders["validation"]).columns == ["product_id", "t", "img_array"]


def test_a_failing_run_keeps_the_old_files(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 5 = 0 THEN 'a b/c' ELSE 'training' END AS dataset")
    path = scratch_path(spark, "set")
    counts = {"training": 2, "a b/c": 1}
    folders = tables.write_training_set(df, path, counts)
    assert [spark.read.parquet(f).count() for f in folders.values()] == [80, 20]
    with pytest.raises(ValueError, match="split labels without a number of files: other"):
        tables.write_training_set(df.withColumn("dataset", F.expr("CASE WHEN id = 99 THEN 'other' ELSE dataset END")), path, counts)
    assert [spark.read.parquet(f).count() for f in folders.values()] == [80, 20]


def test_one_pass_for_all_splits(spark):
    texts, imgs = paired(spark)
    path = scratch_path(spark, "set")
    jobs.build_training_set(texts, imgs, path, 4)
    out = spark.read.parquet(path)
    assert out.count() == 800
    assert {r["dataset"] for r in out.select("dataset").distinct().collect()} == {"training", "validation"}


def test_sink_refuses_to_overwrite_by_default(spark):
    path = scratch_path(spark, "table")
    tables.write_table(spark.range(10), path, compression="gzip", row_group_mb=1)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_table(spark.range(10), path)
    assert tables.read_table(spark, path, ["id"]).count() == 10
