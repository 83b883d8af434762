import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from swatchbook.cluster import scratch_path, written
from swatchbook.operators import batching


def test_batches_are_full_but_the_last(spark):
    df = written(spark.range(1003).repartition(5), "rows")
    out = batching.assign_batches(df, "id", 50, seed=3, epochs=2).collect()
    sizes = {}
    for r in out:
        sizes.setdefault(r["batch_id"], []).append(r["pos"])
    assert sorted(sizes) == list(range(41))
    assert all(sorted(p) == list(range(50)) for b, p in sizes.items() if b < 40)
    assert sorted(sizes[40]) == list(range(6))
    for epoch in (0, 1):
        assert sorted(r["id"] for r in out if r["epoch"] == epoch) == list(range(1003))


def order(df, **options):
    rows = batching.assign_batches(df, "id", 10, **options).orderBy("batch_id", "pos").collect()
    return [r["id"] for r in rows]


def test_order_follows_seed_and_epoch(spark):
    df = written(spark.range(200).repartition(3), "rows")
    assert order(df, shuffle=False) == list(range(200))
    first = order(df, seed=1)
    assert first == order(df, seed=1, partitions=2) != order(df, seed=2)
    assert first != list(range(200))
    assert order(df, seed=1, first_epoch=1) != first
    assert order(df, seed=1, epochs=2) == first + order(df, seed=1, first_epoch=1)


def test_copies_of_a_key_all_get_a_place(spark):
    df = written(spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("id")), "rows")
    out = batching.assign_batches(df, "id", 100, seed=1).collect()
    assert len({(r["batch_id"], r["pos"]) for r in out}) == 900


def test_an_order_is_a_permutation_of_any_number_of_rows():
    for rows in [*range(200), 997, 1000, 1024, 4099, 65_537, 100_003]:
        order = batching.order_of(rows, 3, rows % 5)
        at = order.place(np.arange(rows))
        for _ in range(order.steps):
            outside = at >= rows
            at[outside] = order.place(at[outside])
        assert np.array_equal(np.sort(at), np.arange(rows)), rows
        assert order.width * order.height < 2 * rows + 4


def test_orders_look_drawn():
    """Neighbours end far apart, no place is favoured, and epochs have little in common."""
    rows = 90_000
    places = [batching.order_of(rows, seed, epoch).place(np.arange(rows)) for seed in (0, 1) for epoch in range(4)]
    for n, at in enumerate(places):
        # In a random order about one of 90,000 neighbours stays one, and a block of 900 rows meets 63 % of 900 buckets.
        assert (np.abs(np.diff(at)) == 1).sum() < 20
        met = [len(np.unique(at[k : k + 900] // 100)) for k in range(0, rows, 9000)]
        assert 480 < min(met) and max(met) < 660
        assert all((at == other).sum() < 20 for other in places[:n])
        assert abs(np.corrcoef(np.arange(rows), at)[0, 1]) < 0.02


def test_the_table_is_written_once_for_all_epochs(spark, monkeypatch):
    df = written(spark.range(103), "rows")
    calls = []
    real = batching.global_row_index
    monkeypatch.setattr(batching, "global_row_index", lambda *a, **k: calls.append(a) or real(*a, **k))
    out = batching.assign_batches(df, "id", 10, seed=5, epochs=40)
    assert len(calls) == 1
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert out.selectExpr("count(DISTINCT batch_id, pos)", "max(batch_id * 10 + pos)").first()[:] == (4120, 4119)
    # The plan follows the plain computation, whichever places are walked on.
    for epoch in (0, 17):
        order = batching.order_of(103, 5, epoch)
        at = order.place(np.arange(103))
        for _ in range(order.steps):
            at = np.where(at < 103, at, order.place(at))
        got = {r.id: r.batch_id * 10 + r.pos - 103 * epoch for r in out.filter(F.col("epoch") == epoch).collect()}
        assert got == dict(enumerate(at.tolist()))


def test_batches_of_an_empty_table(spark):
    df = written(spark.range(0), "none")
    for shuffle in (False, True):
        assert batching.assign_batches(df, "id", 5, shuffle=shuffle, epochs=2).collect() == []


def test_single_batch(spark):
    rows = batching.single_batch(spark.range(100, 0, -1), "id", 7).collect()
    assert sorted((r["pos"], r["id"]) for r in rows) == [(i, i + 1) for i in range(7)]


def test_slices_of_files(spark):
    path = scratch_path(spark, "files")
    spark.range(0, 230, 1, 2).write.parquet(path)
    table = spark.read.parquet(path)
    out = batching.file_batches(table, 50).collect()
    for file in {r["file"] for r in out}:
        rows = sorted((r for r in out if r["file"] == file), key=lambda r: r["id"])
        assert [(r["slice_id"], r["pos"]) for r in rows] == [(i // 50, i % 50) for i in range(115)]
    shuffled = batching.file_batches(table, 50, shuffle=True, seed=5).select("file", "slice_id", "slice_order").distinct()
    assert shuffled.count() == 6
    plan = batching.file_batches(table, 50, shuffle=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_files_are_dealt_out_evenly(spark):
    path = scratch_path(spark, "files")
    spark.range(0, 100, 1, 8).write.parquet(path)
    out = batching.file_shards(spark.read.parquet(path), 3).orderBy("file").collect()
    assert [r["worker"] for r in out] == [0, 1, 2, 0, 1, 2, 0, 1]
    assert sum(r["n_rows"] for r in out) == 100


def test_user_functions(spark):
    df = spark.range(1000).select("id")
    shards = batching.shard_count(df, 90)
    assert shards == 12

    def sizes(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "n": [len(rows)]})

    out = batching.map_by_shard(df, sizes, "shard bigint, n bigint", "id", shards).collect()
    assert len(out) == 12 and sum(r["n"] for r in out) == 1000 and max(r["n"] for r in out) <= 90
    doubled = batching.map_rows(df, lambda rows: rows * 2, "id bigint")
    assert doubled.agg(F.sum("id")).first()[0] == 999000
