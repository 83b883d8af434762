import numpy as np
import pytest
from pyspark.sql import functions as F

from swatchbook.functions import tensors, vectors
from swatchbook.operators import evaluation, inference, similarity
from swatchbook.plans import jobs


def table(spark, matrix, key="id", start=0):
    rows = [(start + i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} bigint, vec array<float>").repartition(3)


def brute(queries, corpus, k):
    q, c = (np.float32(m).astype(np.float64) for m in (queries, corpus))
    q, c = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (q, c))
    s = np.round(q @ c.T, similarity.SCORE_DECIMALS)
    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(i, r + 1): int(j) for i, row in enumerate(best) for r, j in enumerate(row)}


def found(df):
    return {(r["query_id"], r["rank"]): r["id"] for r in df.collect()}


@pytest.mark.parametrize(("cells", "tile", "k"), [(1, 4096, 1), (8, 16, 3), (32, 7, 10), (None, 50, 2), (None, 4096, 2)])
def test_nearest_on_noise(spark, cells, tile, k):
    rng = np.random.default_rng(1)
    queries, corpus = rng.normal(size=(60, 12)), rng.normal(size=(300, 12))
    out = similarity.nearest(table(spark, queries, "query_id"), table(spark, corpus), k, cells=cells, tile=tile, block=tile)
    assert found(out) == brute(queries, corpus, k)


def clustered(rng, n, centres, spread):
    return centres[rng.integers(len(centres), size=n)] + spread * rng.normal(size=(n, centres.shape[1]))


def test_nearest_on_clusters_opens_few_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    queries, corpus = clustered(rng, 80, centres, 0.02), clustered(rng, 600, centres, 0.02)
    scored = []
    plain = similarity._tile_scores

    def counting(queries, *rest):
        scored.append(queries.count())
        return plain(queries, *rest)

    monkeypatch.setattr(similarity, "_tile_scores", counting)
    out = similarity.nearest(table(spark, queries, "query_id"), table(spark, corpus), 3, cells=24)
    assert found(out) == brute(queries, corpus, 3)
    assert scored[0] == 80
    assert scored[1] < 80 * 23 / 3


@pytest.mark.parametrize(("cells", "k"), [(30, 3), (100, 1)])
def test_nearest_with_two_levels(spark, monkeypatch, cells, k):
    """Noise, clusters, copies and zero vectors with pivots in two levels and small blocks of them."""
    monkeypatch.setattr(similarity, "ONE_LEVEL", 4)
    monkeypatch.setattr(similarity, "LEVEL_ROWS", 40)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(9, 10))
    corpus = np.vstack([clustered(rng, 250, centres, 0.1), rng.normal(size=(60, 10)), np.zeros((2, 10))])
    corpus[::5] = corpus[0]
    queries = np.vstack([clustered(rng, 30, centres, 0.1), rng.normal(size=(10, 10)), np.zeros((1, 10))])
    out = similarity.nearest(table(spark, queries, "query_id"), table(spark, corpus), k, cells=cells, tile=16, block=16)
    assert found(out) == brute(queries, corpus, k)


@pytest.mark.parametrize(("one_level", "most"), [(256, 0.16), (4, 0.12)])
def test_share_of_scored_pairs(spark, monkeypatch, one_level, most):
    """Clustered vectors open few cells; of noise nearly all pairs are scored, and never one twice."""
    monkeypatch.setattr(similarity, "ONE_LEVEL", one_level)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 32))
    for make, low, high in ((lambda n: clustered(rng, n, centres, 0.02), 0, most), (lambda n: rng.normal(size=(n, 32)), 0.5, 1)):
        corpus, queries = make(2000), make(50)
        got = similarity.search(table(spark, queries, "query_id"), table(spark, corpus), 5, cells=64)
        assert found(got.best) == brute(queries, corpus, 5)
        share = similarity.scored_share(got, 50, 2000)
        assert low <= share <= high, share
        print("share of scored pairs", one_level, round(share, 3))


def test_rows_per_query_are_never_broadcast(spark, monkeypatch):
    """Floors and opened cells are as many as the queries; however small their files are, they travel by shuffles."""
    rng = np.random.default_rng(10)
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    plain, plain_open, plain_write = similarity._tile_scores, similarity._Tree.open, similarity.written
    monkeypatch.setattr(similarity, "_tile_scores", lambda queries, *rest: (noted(queries), plain(queries, *rest))[1])
    monkeypatch.setattr(similarity._Tree, "open", lambda tree, queries, cells: (noted(queries), plain_open(tree, queries, cells))[1])
    monkeypatch.setattr(similarity, "written", lambda df, label: (label == "round" and noted(df), plain_write(df, label))[1])
    queries, corpus = rng.normal(size=(40, 8)), rng.normal(size=(200, 8))
    out = similarity.nearest(table(spark, queries, "query_id"), table(spark, corpus), 3, cells=16)
    assert found(out) == brute(queries, corpus, 3)
    # Home cells, floors, and at least one round with its floors.
    assert len(plans) >= 4
    assert all("Broadcast" not in plan for plan in plans)
    assert sum("SortMergeJoin" in plan for plan in plans) >= 3


def test_nearest_with_a_third_of_copies(spark):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(300, 8))
    corpus[::3] = corpus[0]
    queries = np.vstack([corpus[:1], rng.normal(size=(20, 8)), np.zeros((1, 8))])
    out = similarity.nearest(table(spark, queries, "query_id"), table(spark, corpus), 5, cells=8, tile=20, block=20)
    assert found(out) == brute(queries, corpus, 5)


def test_nearest_with_fewer_rows_than_k(spark):
    rng = np.random.default_rng(4)
    queries, corpus = rng.normal(size=(5, 4)), rng.normal(size=(3, 4))
    out = similarity.nearest(table(spark, queries, "query_id"), table(spark, corpus), 10)
    assert found(out) == brute(queries, corpus, 10)


def test_nearest_of_nothing(spark):
    some, none = table(spark, np.ones((3, 4))), table(spark, np.ones((3, 4))).filter("id < 0")
    assert similarity.nearest(some.withColumnRenamed("id", "query_id"), none, 2).count() == 0
    assert similarity.nearest(none.withColumnRenamed("id", "query_id"), some, 2).count() == 0


def pairs(spark, images, texts, batch):
    rows = [
        (i // batch, i % batch, [float(x) for x in u], [float(x) for x in v])
        for i, (u, v) in enumerate(zip(images, texts, strict=True))
    ]
    df = spark.createDataFrame(rows, "batch_id bigint, pos int, img array<double>, txt array<double>").repartition(3)
    return similarity.l2_normalize(similarity.l2_normalize(df, "img"), "txt")


def numpy_report(images, texts, batch):
    """The evaluation record, written out with loops."""
    losses, labels, preds = [], [], {"img": [], "text": []}
    for start in range(0, len(images), batch):
        u, v = (m[start : start + batch] / np.linalg.norm(m[start : start + batch], axis=1, keepdims=True) for m in (images, texts))
        logits = u @ v.T / 0.07
        n = len(u)

        def ce(m, n=n):
            shifted = m - m.max(axis=1, keepdims=True)
            return np.log(np.exp(shifted).sum(axis=1)) - shifted[np.arange(n), np.arange(n)]

        losses.append(np.mean(0.5 * ce(logits) + 0.5 * ce(logits.T)))
        labels += list(range(n))
        preds["img"] += list(logits.argmax(axis=1))
        preds["text"] += list(logits.T.argmax(axis=1))
    report = {"eval_loss": np.mean(losses)}
    labels = np.array(labels)
    for d, p in preds.items():
        p = np.array(p)
        per = []
        for c in sorted(set(labels) | set(p)):
            tp, guessed, actual = ((p == c) & (labels == c)).sum(), (p == c).sum(), (labels == c).sum()
            prec = tp / guessed if guessed else 0.0
            rec = tp / actual if actual else 0.0
            per.append((prec, rec, 2 * prec * rec / (prec + rec) if prec + rec else 0.0))
        prec, rec, f = np.mean(per, axis=0)
        report |= {f"eval_acc_{d}": (p == labels).mean(), f"eval_prec_{d}": prec, f"eval_rec_{d}": rec, f"eval_f_score_{d}": f}
    return report


@pytest.mark.parametrize(("n", "batch"), [(40, 8), (43, 8), (5, 1)])
def test_evaluation_record(spark, n, batch):
    rng = np.random.default_rng(5)
    images = rng.normal(size=(n, 6))
    texts = images + 0.8 * rng.normal(size=(n, 6))
    report = jobs.evaluate(pairs(spark, images, texts, batch), batch).collect()
    assert len(report) == 1
    want = numpy_report(images, texts, batch)
    assert report[0].asDict().keys() == want.keys()
    assert report[0].asDict() == pytest.approx(want, abs=1e-9)


def test_loss_of_single_rows_is_zero_and_steps_are_limited(spark):
    rng = np.random.default_rng(6)
    images, texts = rng.normal(size=(2, 40, 6))
    rows = similarity.batch_predictions(similarity.inbatch_logits(pairs(spark, images, texts, 1), 1))
    assert all(abs(r["loss"]) < 1e-12 for r in rows.collect())
    report = jobs.evaluate(pairs(spark, images, texts, 8), 8, max_batches=2).first().asDict()
    assert report == pytest.approx(numpy_report(images[:16], texts[:16], 8), abs=1e-9)


@pytest.mark.parametrize(("n", "batch", "tile"), [(40, 40, 6), (83, 40, 6), (21, 9, 3), (7, 7, 1)])
def test_batches_in_tiles(spark, n, batch, tile):
    """A batch in seven tiles, short last tiles and short last batches: the same predictions and loss as in one row."""
    rng = np.random.default_rng(8)
    images = rng.normal(size=(n, 6))
    texts = images + 0.8 * rng.normal(size=(n, 6))
    df = pairs(spark, images, texts, batch)
    key = lambda r: (r.batch_id, r.pos)
    whole = sorted(similarity.inbatch_predictions(df, batch).collect(), key=key)
    tiled = sorted(similarity.inbatch_predictions(df, batch, most=tile).collect(), key=key)
    assert [(*key(r), r.pred_img, r.pred_txt) for r in tiled] == [(*key(r), r.pred_img, r.pred_txt) for r in whole]
    assert [r.loss for r in tiled] == pytest.approx([r.loss for r in whole], abs=1e-9)
    report = jobs.evaluate(df, batch, most=tile).first().asDict()
    assert report == pytest.approx(numpy_report(images, texts, batch), abs=1e-9)


def test_tiles_with_large_logits_and_ties(spark):
    """Logits of thousands do not overflow, and among equal ones the first position wins across tiles."""
    same = np.ones((12, 4)) * 100
    df = spark.createDataFrame([(0, i, u.tolist(), u.tolist()) for i, u in enumerate(same)], "batch_id bigint, pos int, img array<double>, txt array<double>")
    rows = similarity.inbatch_predictions(df, 12, most=5).collect()
    assert {(r.pred_img, r.pred_txt) for r in rows} == {(0, 0)}
    assert all(r.loss == pytest.approx(np.log(12)) for r in rows)


@pytest.mark.parametrize(
    ("change", "reason"),
    [("pos + 1", "missing in batch"), ("CASE WHEN pos = 3 THEN 2 ELSE pos END", "given twice"), ("pos + 20", "outside the batch")],
)
def test_positions_are_checked_in_tiles(spark, change, reason):
    rng = np.random.default_rng(9)
    df = pairs(spark, *rng.normal(size=(2, 8, 3)), 8).withColumn("pos", F.expr(change))
    with pytest.raises(Exception, match=reason):
        similarity.inbatch_predictions(df, 16, most=3).collect()


def test_a_position_outside_the_batch_is_an_error(spark):
    rng = np.random.default_rng(7)
    images, texts = rng.normal(size=(2, 4, 3))
    with pytest.raises(Exception, match="position outside the batch"):
        similarity.inbatch_logits(pairs(spark, images, texts, 4), 3).collect()


def test_ties_take_the_first_position(spark):
    df = spark.createDataFrame([([1.0, 5.0, 2.0, 5.0],)], "x array<double>")
    assert df.select(vectors.argmax(F.col("x"))).first()[0] == 1


def test_large_logits_do_not_overflow(spark):
    df = spark.createDataFrame([([1000.0, 0.0],)], "x array<double>")
    assert df.select(vectors.cross_entropy(F.col("x"), F.lit(1))).first()[0] == pytest.approx(1000.0)


def test_a_class_never_predicted_counts_as_zero(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 1)], "batch_id bigint, pos int, pred_img int, pred_txt int")
    rows = {r["direction"]: r for r in evaluation.macro_scores(evaluation.confusion(df)).collect()}
    assert rows["img"]["precision"] == pytest.approx(0.25)
    assert rows["img"]["recall"] == pytest.approx(0.5)
    assert rows["img"]["f_score"] == pytest.approx(1 / 3)
    assert rows["text"]["f_score"] == pytest.approx(1.0)


def test_parity_sees_differences_that_cancel(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [1.0])], "id bigint, vec array<float>")
    b = spark.createDataFrame([(1, [1.5, 1.5]), (2, [0.0, 0.0]), (4, [1.0])], "id bigint, vec array<float>")
    assert similarity.embedding_parity(a, b).first().asDict() == {
        "n_compared": 2,
        "n_left_only": 1,
        "n_right_only": 1,
        "n_size_differs": 0, "n_null_vectors": 0,
        "max_abs_diff": 0.5,
    }
    assert similarity.embedding_parity(a, a).first()["max_abs_diff"] == 0.0


def test_running_best(spark):
    rows = [("a", e, m) for e, m in enumerate([0.0, 0.3, 0.3, 0.2, 0.5, 0.1, 0.6, 0.6])] + [("b", 0, -1.0), ("b", 1, 0.1)]
    df = spark.createDataFrame(rows, "run string, epoch int, metric double")
    for block in (2, 3, 100):
        out = {(r["run"], r["epoch"]) for r in evaluation.running_best(df, block=block).collect() if r["is_best"]}
        assert out == {("a", 1), ("a", 4), ("a", 6), ("b", 1)}
    assert {r["epoch"] for r in evaluation.running_best(df, every=3).collect()} == {0, 3, 6}


def test_tensor_cells(spark):
    values = np.arange(24, dtype=np.float32)
    df = spark.createDataFrame([(1, [float(v) for v in values]), (2, None)], "i int, v array<float>")
    cells = df.select("i", tensors.npy_encode(F.col("v"), (2, 3, 4)).alias("c"))
    import io

    raw = cells.filter("i = 1").first()["c"]
    assert (np.load(io.BytesIO(raw)) == values.reshape(2, 3, 4)).all()
    buffer = io.BytesIO()
    np.save(buffer, values.reshape(2, 3, 4))
    assert buffer.getvalue() == bytes(raw)
    back = {r["i"]: r for r in cells.select("i", tensors.npy_decode(F.col("c")).alias("v"), tensors.npy_shape(F.col("c")).alias("s")).collect()}
    assert back[1]["v"] == list(values) and back[1]["s"] == [2, 3, 4]
    assert back[2]["v"] is None
    with pytest.raises(Exception, match="do not fill shape"):
        df.select(tensors.npy_encode(F.col("v"), (5, 5))).collect()


def test_standardised_channels(spark):
    pixels = np.arange(12, dtype=np.float64)
    df = spark.createDataFrame([([float(p) for p in pixels],)], "t array<float>")
    got = df.select(vectors.standardize_channels(F.col("t"), 4, scale=255.0)).first()[0]
    want = (pixels.reshape(3, 4) / 255 - np.array(vectors.CHANNEL_MEAN)[:, None]) / np.array(vectors.CHANNEL_STD)[:, None]
    assert np.allclose(got, want.ravel())


def test_models(spark):
    rng = np.random.default_rng(8)
    m, w = rng.normal(size=(20, 6)), rng.normal(size=(6, 3))
    df = table(spark, m)
    projected = {r["id"]: r["out"] for r in inference.project(df, "vec", w, "out").collect()}

    def make_predict():
        return lambda batch: batch @ w

    embedded = {r["id"]: r["out"] for r in inference.embed_table(df, make_predict, "vec", 6, "out", batch_size=4).collect()}
    for i in range(20):
        assert np.allclose(projected[i], np.float32(m[i]) @ w)
        assert np.allclose(embedded[i], m[i] @ w, atol=1e-4)


def test_blocks_hold_many_tiles(spark):
    """A vector is copied once per block of the other side, not once per 2,048 rows."""
    df = spark.range(10).select("id", F.array_repeat(F.lit(0.5), 64).alias("vec"))
    assert similarity.block_rows(df) >= 16 * similarity.TILE_ROWS
