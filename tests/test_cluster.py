import pytest
from pyspark.sql import functions as F

from swatchbook import cluster


def hot_table(spark, n=3000):
    """A third of the rows share key 7, another tenth has no key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 500)
    return cluster.written(spark.range(n).select(key.alias("k"), F.col("id").alias("row")), "hot")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_keeps_every_row(spark, how):
    many = hot_table(spark)
    one = spark.range(0, 300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = many.join(one, "k", how)
    salted = cluster.skew_join(many, one, "k", how, piece_rows=90)
    assert salted.columns == plain.columns
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def partition_sizes(joined):
    return [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("stride", [2, 12, 37])
@pytest.mark.parametrize("side", ["left", "right", "both"])
def test_hot_key_is_spread(spark, stride, side):
    # A hot key at a regular interval, on either side or on both.
    def table(hot, name):
        key = F.when(F.col("id") % stride == 0, F.lit(7)).otherwise(F.col("id") + 1000)
        base = spark.range(2000 * stride if hot else 40)
        return cluster.written(base.select((key if hot else F.col("id")).alias("k"), F.col("id").alias(name)), name)

    many, one = table(side != "right", "a"), table(side != "left", "b")
    if side == "both":
        many, one = many.filter("a < 400 * %d" % stride), one.filter("b < 300 * %d" % stride)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = cluster.skew_join(many, one, "k", "inner", piece_rows=50 if side != "both" else 25).filter("k = 7")
        sizes = partition_sizes(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == (2000 if side != "both" else 400 * 300)
    assert len(sizes) >= 14 and max(sizes) < sum(sizes) / 3


@pytest.mark.parametrize("stride", [2, 12, 40])
def test_salts_are_even(spark, stride):
    many = cluster.written(spark.range(2000 * stride).select(F.when(F.col("id") % stride == 0, 7).otherwise(F.col("id") + 9).alias("k")), "m")
    hot = cluster.hot_keys(many, "k", 50)
    assert [tuple(r) for r in hot.collect()] == [(7, 40)]
    sizes = [r["count"] for r in cluster._salted(many, "k", hot, None, ("_salt", "_other")).filter("k = 7").groupBy("_salt").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 2 * 50


@pytest.mark.parametrize("limit", [0, 1000])
def test_sized_join_takes_either_way(spark, monkeypatch, limit):
    many = hot_table(spark)
    one = spark.range(0, 300).select(F.col("id").alias("k"))
    monkeypatch.setattr(cluster.small_side, "__defaults__", (limit,))
    out = cluster.sized_join(many, one, "k", "left_anti", "one")
    assert out.count() == many.join(one, "k", "left_anti").count()


def test_row_index_is_dense_and_in_order(spark):
    df = cluster.written(spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"), "id"), "rows")
    rows = cluster.global_row_index(df, [F.col("v")], 6).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(5000))
    assert [r["v"] for r in rows] == sorted(r["v"] for r in rows)


def test_row_index_spreads_equal_keys(spark, monkeypatch):
    df = cluster.written(spark.range(4000).select(F.lit(1).alias("v"), "id").repartition(4), "copies")
    folder = cluster.scratch_path(spark, "index")
    monkeypatch.setattr(cluster, "scratch_path", lambda _, label: f"{folder}/{label}")
    path = f"{folder}/row-index"
    rows = cluster.global_row_index(df, [F.col("v")], 4)
    assert sorted(r["row_index"] for r in rows.collect()) == list(range(4000))
    sizes = spark.read.parquet(path).groupBy("_metadata.file_name").count().collect()
    assert len(sizes) == 4
    assert max(r["count"] for r in sizes) < 2000


def test_row_index_with_split_files(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "100")
    try:
        df = spark.range(1000)
        rows = cluster.global_row_index(df, [F.col("id")], 3).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert all(r["id"] == r["row_index"] for r in rows)


def test_row_index_of_nothing(spark):
    assert cluster.global_row_index(spark.range(0), [F.col("id")], 3).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Remote:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Remote()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="shared"):
        cluster.shared_dir(Session())


def test_spread_goes_by_input_splits(spark, monkeypatch):
    df = cluster.written(spark.range(100).coalesce(1), "small")
    assert cluster.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(cluster, "SPREAD_SPLITS", 1)
    assert cluster.spread(df) is df


def test_row_width_counts_variable_columns(spark):
    df = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array_repeat(F.lit(1.0), 50).alias("v"))
    assert cluster.row_bytes(df) == 24 + 1000 + 400


def test_row_index_of_a_join_is_cut_by_its_real_size(spark, monkeypatch):
    a = cluster.written(spark.range(2000), "a")
    joined = a.join(a.withColumnRenamed("id", "b"), F.col("id") == F.col("b"))
    path = []
    original = cluster.scratch_path
    monkeypatch.setattr(cluster, "scratch_path", lambda *x: path.append(original(*x)) or path[-1])
    rows = cluster.global_row_index(joined, [F.col("id")])
    assert all(r["id"] == r["row_index"] for r in rows.collect())
    files = spark.read.parquet(next(p for p in path if "row-index" in p)).inputFiles()
    assert len(files) <= 4


def test_scratch_is_removed(spark):
    import os

    with cluster.scratch(spark) as folder:
        table = cluster.written(spark.range(10), "inside")
        assert table.count() == 10 and os.listdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))


def test_null_keys_are_spread(spark):
    many = cluster.written(spark.range(4000).select(F.lit(None).cast("bigint").alias("k"), "id"), "nulls")
    one = spark.range(10).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = cluster.skew_join(many, one, "k", "left_anti", piece_rows=100)
        parts = kept.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in parts) == 4000
    assert len(parts) == 4
