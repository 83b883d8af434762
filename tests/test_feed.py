"""The training set fed by a stream: each batch once, whatever fails in between."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swatchbook.cluster import written
from swatchbook.functions import tensors
from swatchbook.sources import tables
from swatchbook.streaming import feed, images

SHAPE = (3, 2, 2)
FILES = {"training": 2, "validation": 1}
SHAPES = {"description_ids": [1], "img_array": [3, 2, 2]}


@pytest.fixture
def texts(spark):
    rows = spark.range(60).select(F.col("id").cast("int").alias("product_id"), F.array(F.col("id").cast("int")).alias("description_ids"))
    # Names used inside, and a null key.
    return written(rows.selectExpr("*", "1 AS n_tokens").union(spark.sql("SELECT CAST(NULL AS INT), array(1), 1")), "texts")


def pictures(folder, names):
    folder.mkdir(exist_ok=True)
    for name in names:
        (folder / f"{name}.jpg").write_bytes(bytes(12) if name != "broken" else b"12")


def run(spark, folder, texts, tmp_path, log="log"):
    stream = images.image_tensors(images.stream_files(spark, str(folder)), images.raw_bytes(SHAPE), SHAPE)
    feed.feed_training_set(stream, texts, str(tmp_path / "set"), str(tmp_path / log), FILES, SHAPES)


def keys(spark, tmp_path, *splits):
    return sorted(r[0] for s in splits for r in feed.read_split(spark, str(tmp_path / "set"), s).select("product_id").collect())


def test_two_runs_add_what_is_new(spark, texts, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "set")
    pictures(folder, [*range(30), "broken", "noname", 77])
    run(spark, folder, texts, tmp_path)
    assert keys(spark, tmp_path, *FILES) == list(range(30))
    pictures(folder, range(30, 50))
    run(spark, folder, texts, tmp_path)
    run(spark, folder, texts, tmp_path)
    assert keys(spark, tmp_path, *FILES) == list(range(50))
    assert keys(spark, tmp_path, feed.UNMATCHED) == [77]
    reasons = {r.product_id: r.error for r in feed.read_split(spark, path, feed.REJECTED).collect()}
    assert reasons.keys() == {"broken", "noname"} and "ValueError" in reasons["broken"] and "no bigint" in reasons["noname"]
    entries = feed.committed(spark, path)
    assert [e["number"] for e in entries] == [0, 1] and len({e["query"] for e in entries}) == 1
    training = feed.read_split(spark, path, "training")
    assert training.columns == ["product_id", "description_ids", "n_tokens", "img_array"]
    assert tables.shapes_of(training) == SHAPES
    assert not {r[0] for r in training.select("product_id").collect()} & set(keys(spark, tmp_path, "validation"))
    # The unmatched image's tensor is whole.
    waiting = feed.read_split(spark, path, feed.UNMATCHED).select(tensors.npy_decode(F.col("img_array"))).first()[0]
    assert len(waiting) == 12 and np.isfinite(waiting).all()


def test_a_batch_that_comes_again_is_not_added_twice(spark, texts, tmp_path, monkeypatch):
    folder, path = tmp_path / "in", str(tmp_path / "set")
    pictures(folder, range(20))
    real = feed._commit

    def dies(*args):
        raise RuntimeError("executor and driver lost")

    # Written, but neither in the manifest nor noted by Spark.
    monkeypatch.setattr(feed, "_commit", dies)
    with pytest.raises(Exception, match="lost"):
        run(spark, folder, texts, tmp_path)
    assert feed.committed(spark, path) == []
    with pytest.raises(ValueError, match="no batch"):
        feed.read_split(spark, path, "training")

    # In the manifest, but not noted by Spark: the same batch comes a third time.
    def commits_and_dies(*args):
        real(*args)
        raise RuntimeError("driver lost")

    monkeypatch.setattr(feed, "_commit", commits_and_dies)
    with pytest.raises(Exception, match="lost"):
        run(spark, folder, texts, tmp_path)
    assert keys(spark, tmp_path, *FILES) == list(range(20))
    monkeypatch.setattr(feed, "_commit", real)
    pictures(folder, range(20, 25))
    run(spark, folder, texts, tmp_path)
    assert keys(spark, tmp_path, *FILES) == list(range(25))
    assert [e["number"] for e in feed.committed(spark, path)] == [0, 1]


def test_batches_of_two_queries_do_not_hide_each_other(spark, texts, tmp_path):
    for n in (1, 2):
        pictures(tmp_path / f"in{n}", range(10 * n, 10 * n + 5))
        run(spark, tmp_path / f"in{n}", texts, tmp_path, f"log{n}")
    assert keys(spark, tmp_path, *FILES) == [10, 11, 12, 13, 14, 20, 21, 22, 23, 24]
    assert len({e["query"] for e in feed.committed(spark, str(tmp_path / "set"))}) == 2


def test_a_batch_of_rejects_only_and_a_hot_product(spark, texts, tmp_path):
    shape = "product_id string, img_array binary, error string"
    bad = written(spark.createDataFrame([("1", None, "ValueError: x"), (None, b"1", None)], shape), "bad")
    path = str(tmp_path / "set")
    assert feed.add_batch(bad, texts, path, "q", 0, FILES)
    assert not feed.add_batch(bad, texts, path, "q", 0, FILES)
    assert keys(spark, tmp_path, *FILES) == []
    assert sorted(map(str, (r.product_id for r in feed.read_split(spark, path, feed.REJECTED).collect()))) == ["1", "None"]
    hot = written(spark.range(600).selectExpr("'5' AS product_id", "CAST('z' AS BINARY) AS img_array", "CAST(NULL AS STRING) AS error"), "hot")
    assert feed.add_batch(hot, texts, path, "q", 1, FILES)
    assert keys(spark, tmp_path, *FILES) == [5] * 600


def test_a_stream_lists_and_reads_many_files_per_task(spark, tmp_path, monkeypatch):
    """Inside a run listing takes a few tasks per core and a small picture costs little; the session's settings come back."""
    from swatchbook import cluster

    names = (cluster.LISTING_TASKS, cluster.OPEN_COST)
    usual = [spark.conf.get(n) for n in names]
    for i in range(90):
        (tmp_path / "in" / f"d{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"d{i % 3}" / f"{i}.jpg").write_bytes(bytes(12))
    seen = []

    def noted(batch, *rest):
        seen.append(([batch.sparkSession.conf.get(n) for n in names], batch.count()))

    monkeypatch.setattr(feed, "add_batch", noted)
    stream = images.image_tensors(images.stream_files(spark, str(tmp_path / "in")), images.raw_bytes((3, 2, 2)), (3, 2, 2))
    feed.feed_training_set(stream, None, str(tmp_path / "out"), str(tmp_path / "log"), {"training": 1})
    most = cluster.LISTED_BY * spark.sparkContext.defaultParallelism
    assert [(int(conf[0]) <= most, int(conf[1]) <= cluster.OPEN_BYTES, n) for conf, n in seen] == [(True, True, 90)]
    assert [spark.conf.get(n) for n in names] == usual
