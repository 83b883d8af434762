"""Exact search and the metric range join against brute force."""

import math

import numpy as np
import pytest

from swatchbook.llm import metric_join, topk
from swatchbook.llm.components import components

SHAPE = "vec_id bigint, embedding array<float>, label int, _id int, _v string, n_links int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 5) for r in rows], SHAPE)


def clustered(seed, n, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = [(int(i), (centres[rng.integers(5)] + rng.normal(size=dims) * 0.25).tolist(), int(rng.integers(2))) for i in rng.permutation(n)]
    rows += [(n + i, rows[i % 7][1], rows[i % 7][2]) for i in range(25)]
    return rows


AWKWARD = [
    (9001, None, 1),
    (9002, [], 1),
    (9003, [0.0] * 6, 1),
    (9004, [None, 1.0, 0.0, 0.0, 0.0, 0.0], 1),
    (9005, [float("nan")] * 6, 1),
    (9006, [float("inf")] + [0.0] * 5, 1),
    (9007, [1e-30, 0.0, 0.0, 0.0, 0.0, 0.0], 1),
    (9008, [1e30, 0.0, 0.0, 0.0, 0.0, 0.0], 1),
    (9009, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], None),
]


def brute_links(rows, cosine):
    ok = {}
    for i, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        u = np.array(v, dtype=np.float32).astype(np.float64)
        u /= np.abs(u).max()
        ok[i] = (label, u / np.sqrt(u @ u))
    links = {i: {j for j in ok if j != i and ok[j][0] == ok[i][0] and ok[i][1] @ ok[j][1] >= cosine} for i in ok}
    component = {i: i for i, _, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, near in links.items():
            low = min([component[i], *[component[j] for j in near]])
            if low < component[i]:
                component[i], changed = low, True
    return {i: (len(links.get(i, ())), component[i], component[i] == i) for i, _, _ in rows}


@pytest.mark.parametrize("blocks", [(4096, 2048), (40, 16)])
def test_near_vectors(spark, monkeypatch, blocks):
    monkeypatch.setattr(metric_join, "CELL_ROWS", blocks[0])
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", blocks[1])
    rows = clustered(1, 260) + AWKWARD
    got = {r[0]: tuple(r)[1:] for r in metric_join.near_vectors(table(spark, rows), 0.93).collect()}
    assert got == brute_links(rows, 0.93)


def test_near_vectors_without_vectors(spark):
    got = metric_join.near_vectors(table(spark, AWKWARD[:3])).collect()
    assert [tuple(r) for r in sorted(got)] == [(9001, 0, 9001, True), (9002, 0, 9002, True), (9003, 0, 9003, True)]
    assert metric_join.near_vectors(table(spark, [])).collect() == []


def brute_top(rows, k):
    ok = {i: [math.floor(64 * np.float32(x).astype(float)) for x in v] for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ok[q], ok[d], strict=False)), d) for d in ok if d != q)[:k]
            out += [(q, n + 1, d, -s) for n, (s, d) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4096, 64, 256), (32, 4, 3)])
def test_top_k(spark, monkeypatch, sizes):
    for name, value in zip(("SHARD_ROWS", "BLOCK_ROWS", "TILE_QUERIES"), sizes, strict=True):
        monkeypatch.setattr(topk, name, value)
    monkeypatch.setattr(topk, "CHUNK_SHARDS", 3)
    rows = clustered(2, 220) + [r for r in AWKWARD if r[0] not in (9007, 9008)]
    from pyspark.sql import functions as F

    vectors = table(spark, rows).select("vec_id", topk.quantised(F.col("embedding"), 64).alias("vector"), "_id")
    got = topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 20)


def test_top_k_large_numbers_and_nothing(spark):
    vectors = spark.createDataFrame([(0, [3 * 10**9, 1]), (1, [10**9, 5]), (2, [10**9, 4])], "vec_id bigint, vector array<bigint>")
    got = topk.top_k(vectors, vectors.filter("vec_id = 0"), k=5).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 3 * 10**18 + 5), (0, 2, 2, 3 * 10**18 + 4)]
    assert topk.top_k(vectors.limit(0), vectors, k=5).collect() == []


def test_top_k_refuses_what_does_not_fit(spark):
    from pyspark.sql import functions as F

    big = spark.createDataFrame([(0, [3 * 10**9, 0]), (1, [4 * 10**9, 5])], "vec_id bigint, vector array<bigint>")
    with pytest.raises(Exception, match="exceeds 64 bits"):
        topk.top_k(big, big.filter("vec_id = 0"), k=1).collect()
    with pytest.raises(Exception, match="too large for 64 bits"):
        table(spark, [AWKWARD[7]]).select(topk.quantised(F.col("embedding"), 64)).collect()
    # Bounds beyond 64 bits do not turn around.
    assert topk._bounds(np.array([[2**62, 1]]), np.array([[3, 0], [-3, 0]]), np.array([[3, 0], [-3, 0]])).tolist() == [[2**63 - 1, 1 - 2**63]]


def test_pivots_of_a_label_concern_that_label_only(spark, monkeypatch):
    """Ten labels of 60 vectors and 50 of one each: a copy per vector where a label is one cell, few where it is not."""
    rng = np.random.default_rng(4)
    rows = [(n, rng.normal(size=16).tolist(), n % 10) for n in range(600)] + [(5000 + n, rng.normal(size=16).tolist(), 100 + n) for n in range(50)]
    copies = {}
    real = metric_join.written
    for cell in (4096, 12):
        monkeypatch.setattr(metric_join, "CELL_ROWS", cell)
        monkeypatch.setattr(metric_join, "written", lambda df, name, c=cell: _counted(real(df, name), name, c, copies))
        got = {r[0]: tuple(r)[1:] for r in metric_join.near_vectors(table(spark, rows), 0.93).collect()}
        assert got == brute_links(rows, 0.93)
    # Pivots over all labels would give each vector about 25 copies for 54 cells of noise; here a label has five.
    assert copies[4096] == 650 and 650 < copies[12] < 4 * 650


def _counted(df, name, cell, copies):
    if name == "cells":
        copies[cell] = df.count()
    return df


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(n, n + 1) for n in range(100, 130)] + [(200, n) for n in range(201, 240)]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: root[n] for n in linked}
