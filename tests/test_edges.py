"""Legal inputs that the test tables do not hold."""

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField

from swatchbook.cluster import scratch_path, written
from swatchbook.operators import evaluation, inference, rejects, similarity, training_set
from swatchbook.plans import jobs
from swatchbook.sources import tables
from swatchbook.streaming import images


def test_pairs_of_large_keys_and_unusable_ones(spark):
    texts = spark.createDataFrame([(3_000_000_000, "a"), (1, "b"), (None, "c")], "product_id bigint, t string")
    sides = written(spark.createDataFrame([("3000000000", 1), ("1", 2), ("x", 3), ("x", 4)], "product_id string, i int"), "sides")
    assert sorted(map(tuple, training_set.pair(texts, sides).collect())) == [(1, "b", 2), (3_000_000_000, "a", 1)]
    assert sorted(map(str, map(tuple, training_set.unusable_keys(texts, sides).collect()))) == ["('image', 'x', 2)", "('text', None, 1)"]


@pytest.mark.parametrize("label", ["test", None])
def test_a_split_label_without_files_is_an_error(spark, label):
    df = spark.createDataFrame([(1, "training"), (2, "validation"), (3, label)], "id int, dataset string")
    path = scratch_path(spark, "set")
    with pytest.raises(ValueError, match="split labels"):
        tables.write_training_set(df, path, {"training": 1, "validation": 1})
    if label:
        folders = tables.write_training_set(df, path)
        assert sorted(folders) == ["test", "training", "validation"]
        assert sum(spark.read.parquet(p).count() for p in folders.values()) == 3
    else:
        with pytest.raises(Exception, match="no split label"):
            tables.write_training_set(df, path, 2)


def test_a_missing_package_fails_the_stream_and_keeps_the_files(spark, tmp_path):
    folder, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.jpg").write_bytes(bytes(12))

    def missing(content):
        import no_such_package

        return no_such_package.decode(content)

    def run(decode):
        stream = images.image_tensors(images.stream_files(spark, str(folder)), decode, (3, 2, 2))
        images.append_new(stream, out, log)

    with pytest.raises(Exception, match="no_such_package"):
        run(missing)
    run(images.raw_bytes((3, 2, 2)))
    assert images.read_tensors(spark, out).count() == 3


def test_blocks_are_bounded_by_their_results(spark):
    df = spark.range(400).coalesce(1).select("id", F.lit(b"x" * 100).alias("c"))

    def grow(block: pd.DataFrame) -> pd.Series:
        assert len(block) <= 11
        return block["c"].map(lambda c: bytes(c) * 100)

    out = rejects.map_with_rejects(df, grow, StructField("v", BinaryType()), ["id"], block_bytes=100_000)
    assert out.filter("error IS NULL AND octet_length(v) = 10000").count() == 400


def test_only_declared_errors_are_rejects(spark):
    def fail(block: pd.DataFrame) -> pd.Series:
        raise MemoryError("full") if sys.maxsize else None

    out = rejects.map_with_rejects(spark.range(2), fail, StructField("v", DoubleType()), ["id"])
    with pytest.raises(Exception, match="full"):
        out.collect()


BATCH = "batch_id bigint, pos int, img array<double>, txt array<double>"


@pytest.mark.parametrize(
    ("positions", "reason"), [([0, 2], "missing"), ([0, 0, 1], "twice"), ([0, 3], "outside"), ([0, -1], "outside"), ([0, None], "null vector")]
)
def test_positions_must_be_whole(spark, positions, reason):
    df = spark.createDataFrame([(0, p, [1.0, 0.0], [0.0, 1.0]) for p in positions], BATCH)
    for fn in (similarity.inbatch_logits, similarity.inbatch_predictions):
        with pytest.raises(Exception, match=reason):
            fn(df, 3).collect()


def test_null_vectors_in_a_batch_are_an_error(spark):
    df = spark.createDataFrame([(0, 0, [1.0], [1.0]), (0, 1, [1.0], None)], BATCH)
    with pytest.raises(Exception, match="null vector"):
        similarity.inbatch_predictions(df, 3).collect()


def test_one_pass_predictions_equal_those_from_logits(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(b, p, rng.normal(size=4).tolist(), rng.normal(size=4).tolist()) for b in range(3) for p in range(7 - b)]
    df = similarity.l2_normalize(similarity.l2_normalize(spark.createDataFrame(rows, BATCH), "img"), "txt")
    monkeypatch.setattr(similarity, "LOGIT_CELLS", 10)
    want = similarity.batch_predictions(similarity.inbatch_logits(df, 7)).orderBy("batch_id", "pos").collect()
    got = similarity.inbatch_predictions(df, 7).orderBy("batch_id", "pos").collect()
    assert [tuple(r)[:4] for r in got] == [tuple(r)[:4] for r in want]
    assert np.allclose([r["loss"] for r in got], [r["loss"] for r in want])


def test_nearest_leaves_out_null_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (None, [1.0, 1.0])], "id bigint, vec array<double>")
    got = similarity.nearest(df.withColumnRenamed("id", "query_id"), df, 1).collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(1, 1), (3, 3)]


def test_parity_counts_null_vectors_apart(spark):
    left = spark.createDataFrame([(1, [1.0]), (2, None), (3, [1.0]), (5, None)], "id int, vec array<double>")
    right = spark.createDataFrame([(1, [1.5]), (2, [1.0]), (4, [1.0])], "id int, vec array<double>")
    r = similarity.embedding_parity(left, right).first()
    assert (r["n_compared"], r["n_left_only"], r["n_right_only"], r["n_null_vectors"], r["max_abs_diff"]) == (1, 2, 1, 1, 0.5)


def test_projection_of_odd_vectors_is_null(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "id int, v array<double>")
    got = {r["id"]: r["p"] for r in inference.project(df, "v", np.array([[2.0], [1.0]]), "p").collect()}
    assert got == {1: [4.0], 2: None, 3: None}


def test_history_without_a_run_is_kept(spark):
    rows = [(None, 1, 0.5), (None, 2, 0.4), ("a", 1, 0.1), (None, 3, 0.6)]
    history = spark.createDataFrame(rows, "run string, epoch int, metric double")
    got = evaluation.running_best(history, block=2).collect()
    assert sorted((str(r["run"]), r["epoch"], r["is_best"]) for r in got) == [("None", 1, True), ("None", 2, False), ("None", 3, True), ("a", 1, True)]


def test_streamed_tensors_become_a_training_set(spark, tmp_path):
    """Files through the stream, paired with texts, split and written: the way a user goes."""
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(40):
        (folder / f"{n}.jpg").write_bytes(bytes([n] * 12) if n != 7 else b"bad")
    stream = images.image_tensors(images.stream_files(spark, str(folder)), images.raw_bytes((3, 2, 2)), (3, 2, 2))
    images.append_new(stream, str(tmp_path / "tensors"), str(tmp_path / "log"))
    texts = spark.range(50).select(F.col("id").alias("product_id"), F.array(F.col("id").cast("int")).alias("description_ids"))
    folders = jobs.build_training_set(texts, images.read_tensors(spark, str(tmp_path / "tensors")), str(tmp_path / "set"))
    keys = sorted(r[0] for p in folders.values() for r in spark.read.parquet(p).select("product_id").collect())
    assert keys == [n for n in range(40) if n != 7]
