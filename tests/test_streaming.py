import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from swatchbook.functions import tensors, vectors
from swatchbook.operators import inference, rejects
from swatchbook.sources import files
from swatchbook.streaming import images

SHAPE = (3, 2, 2)


def picture(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def test_new_files_only(spark, tmp_path):
    folder, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    picture(folder, "a/b/12.jpg", bytes(range(12)))
    picture(folder, "njpgx.jpg", bytes(12))
    picture(folder, "broken.jpg", b"123")
    picture(folder, "ignored.png", bytes(12))

    def run():
        stream = images.image_tensors(images.stream_files(spark, str(folder)), images.raw_bytes(SHAPE), SHAPE)
        images.append_new(stream, out, log)
        return images.read_tensors(spark, out)

    assert {r["product_id"] for r in run().collect()} == {"12", "njpgx"}
    assert run().count() == 2
    picture(folder, "z/13.jpg", bytes(12))
    table = run()
    assert table.count() == 3
    bad = images.read_rejects(spark, out).collect()
    assert [(r["product_id"], "ValueError" in r["error"]) for r in bad] == [("broken", True)]
    assert all(0 <= r["shard"] < 10 for r in table.collect())
    got = table.filter("product_id = '12'").select(tensors.npy_decode(F.col("img_array"))).first()[0]
    pixels = np.arange(12).reshape(SHAPE) / 255
    want = (pixels - np.reshape(vectors.CHANNEL_MEAN, (3, 1, 1))) / np.reshape(vectors.CHANNEL_STD, (3, 1, 1))
    assert np.allclose(got, want.ravel(), atol=1e-6)


def test_rejects_keep_the_good_rows_of_a_block(spark):
    df = spark.createDataFrame([(i, str(i) if i % 7 else "x") for i in range(50)], "i int, t string").repartition(2)

    def number(rows: pd.DataFrame) -> pd.Series:
        return rows["t"].astype(float)

    out = rejects.map_with_rejects(df, number, StructField("v", DoubleType()), ["i"])
    good = {r["i"]: r["v"] for r in rejects.accepted(out).collect()}
    bad = rejects.rejected(out, "v").collect()
    assert good == {i: float(i) for i in range(50) if i % 7}
    assert sorted(r["i"] for r in bad) == [i for i in range(50) if i % 7 == 0]
    assert all("could not convert" in r["error"] for r in bad)


def test_one_bad_row_in_ten_thousand_costs_few_calls(spark, tmp_path):
    """Calls are counted in a file; slices grow to 10,000 rows, then one holds the bad row."""
    calls, bad = str(tmp_path / "calls"), 29_000
    df = spark.range(30_000).coalesce(1).selectExpr("id AS i")

    def run(at):
        def doubled(rows: pd.DataFrame) -> pd.Series:
            with open(calls, "a") as f:
                f.write(f"{len(rows)}\n")
            if (rows["i"] == at).any():
                raise ValueError(f"row {at} is bad")
            return rows["i"] * 2.0

        open(calls, "w").close()
        out = rejects.map_with_rejects(df, doubled, StructField("v", DoubleType()), ["i"])
        rows = out.collect()
        return rows, sum(1 for _ in open(calls))

    _, usual = run(-1)
    rows, with_bad = run(bad)
    assert with_bad - usual < 30
    assert [(r.i, r.error) for r in rows if r.error] == [(bad, f"ValueError: row {bad} is bad")]
    assert all(r.v == 2 * r.i for r in rows if r.i != bad)


def test_many_bad_rows_and_other_failures(spark):
    df = spark.range(500).coalesce(1).selectExpr("id AS i")

    def odd(rows: pd.DataFrame) -> pd.Series:
        if (rows["i"] % 3 == 0).any():
            raise KeyError(int(rows["i"].iloc[0]))
        return rows["i"].astype(float)

    rows = rejects.map_with_rejects(df, odd, StructField("v", DoubleType()), ["i"]).collect()
    assert {r.i: r.error for r in rows if r.error} == {i: f"KeyError: {i}" for i in range(0, 500, 3)}
    short = rejects.map_with_rejects(df, lambda rows: rows["i"].iloc[1:], StructField("v", DoubleType()), ["i"])
    with pytest.raises(Exception, match="values for"):
        short.collect()


def test_a_model_that_refuses_rows(spark):
    rows = [(n, [float(n), 1.0] if n % 5 else ([1.0] if n % 2 else None)) for n in range(40)]
    df = spark.createDataFrame(rows, "i int, x array<double>")

    def load():
        def predict(batch):
            if (batch[:, 0] == 13).any():
                raise ValueError("thirteen")
            return batch * 2

        return predict

    out = {r.i: r for r in inference.embed_with_rejects(df, load, "x", 2, "v", ["i"]).collect()}
    assert len(out) == 40
    for n in range(40):
        if n % 5 == 0:
            assert out[n].error == ("ValueError: 1 values, not 2" if n % 2 else "ValueError: no input")
        elif n == 13:
            assert out[n].error == "ValueError: thirteen"
        else:
            assert (out[n].v, out[n].error) == ([2.0 * n, 2.0], None)


def test_write_files(spark, tmp_path):
    df = spark.createDataFrame([("a/1.jpg", b"x"), ("a/2.jpg", b"yy"), ("3.jpg", b"")], "n string, c binary")
    assert files.write_files(df, str(tmp_path / "f"), "n", "c") == 3
    assert (tmp_path / "f" / "a" / "2.jpg").read_bytes() == b"yy"
