"""Near-duplicate vectors by an exact range join around pivots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swatchbook.cluster import written
from swatchbook.llm.components import components

# Cells of a label are made around one sampled vector per so many, at most
# MAX_PIVOTS in all; the choice changes the work, never the links.
CELL_ROWS = 4096
MAX_PIVOTS = 1024
# Rows on either side of one task's comparison.
BLOCK_ROWS = 2048
# Slack for rounding in the bounds; links themselves are tested exactly.
SLACK = 1e-6


def _unit(arrays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one."""
    rows = [np.asarray(a, dtype=np.float64) for a in arrays]
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for n, row in enumerate(rows):
        out[n, : len(row)] = row
    # Scaled first, so that neither huge nor tiny components leave the range.
    top = np.abs(out).max(axis=1, initial=0)
    good = np.isfinite(out).all(axis=1) & (top > 0)
    out[good] /= top[good, None]
    out[good] /= np.sqrt((out[good] ** 2).sum(axis=1))[:, None]
    return out, good


def _dealing(pivots: dict, reach: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows for the home cell and for lower-numbered cells of their label that lie within ``reach``.

    ``pivots`` has the pivots of each label; a label without any is one cell.
    A vector y of cell j can only be near a vector x of cell i if y is near the
    plane between the two pivots, as x lies on the other side of it; by the
    triangle inequality that distance is (|y pi|^2 - |y pj|^2) / (2 |pi pj|).
    """

    def cells_of(units: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(row, cell, home, far)`` of every copy of the rows."""
        width = max(units.shape[1], own.shape[1])
        units, own = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (units, own))
        gaps = np.sqrt(np.maximum(2 - 2 * own @ own.T, 0))
        square = 2 - 2 * units @ own.T
        home = square.argmin(axis=1)
        nearest = square[np.arange(len(home)), home][:, None]
        near = square - nearest <= 2 * (reach + SLACK) * gaps[home] + SLACK
        near &= np.arange(len(own))[None, :] <= home[:, None]
        near[np.arange(len(home)), home] = True
        row, cell = np.nonzero(near)
        return row, cell, cell == home[row], np.sqrt(np.maximum(square[row, cell], 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, _ = _unit(batch.column(2).to_numpy(zero_copy_only=False))
            labels = batch.column(1).dictionary_encode()
            names, number = labels.dictionary.to_pylist(), labels.indices.to_numpy(zero_copy_only=False)
            bare = np.flatnonzero(~np.isin(number, [n for n, name in enumerate(names) if name in pivots]))
            parts = [(bare, np.zeros(len(bare), np.int64), np.ones(len(bare), bool), np.zeros(len(bare)))]
            for n, name in enumerate(names):
                if name in pivots:
                    rows = np.flatnonzero(number == n)
                    row, *rest = cells_of(units[rows], pivots[name])
                    parts.append((rows[row], *rest))
            row, cell, home, far = (np.concatenate(x) for x in zip(*parts, strict=True))
            data = [u.tobytes() for u in units]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row)),
                    pa.array(cell, type=pa.int32()),
                    pa.array(home),
                    pa.array(far, type=pa.float64()),
                    batch.column(3).take(pa.array(row)),
                    pa.array([data[r] for r in row], type=pa.binary()),
                ],
                names=["_id", "_label", "_cell", "_home", "_far", "_copies", "_u"],
            )

    return run


def _pivots(distinct: DataFrame, total: int) -> dict:
    """Sampled unit vectors of every label that fills two cells or more, one per cell; ``MAX_PIVOTS`` in all at most."""
    cell = max(CELL_ROWS, -(-total // MAX_PIVOTS))
    sizes = distinct.groupBy("_label").agg(F.count("*").alias("_n")).filter(F.col("_n") >= 2 * cell)
    # One row per label of two cells, so half as many as pivots at most.
    wanted = F.broadcast(sizes.withColumn("_wanted", F.expr(f"_n div {cell}")))
    # A few times as many as are wanted, by hash, and of these the first.
    drawn = distinct.join(wanted, "_label").filter(F.pmod(F.xxhash64("_id"), F.col("_n")) < 4 * F.col("_wanted"))
    order = Window.partitionBy("_label").orderBy(F.xxhash64("_id", F.lit(1)), "_id")
    sample = drawn.withColumn("_rank", F.row_number().over(order)).filter("_rank <= _wanted").select("_label", "_v").toPandas()
    return {label: _unit(rows["_v"].to_numpy())[0] for label, rows in sample.groupby("_label")}


def _linked(left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    return left @ right.T >= cosine


def connected_here(near: np.ndarray) -> np.ndarray:
    """For each node of a symmetric link matrix the first node it is connected with."""
    root = np.arange(len(near))
    while True:
        low = np.where(near, root[None, :], len(near)).min(axis=1, initial=len(near))
        low = np.minimum(root, low)
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def _comparing(cosine: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between two blocks of a cell: each row's links, and who it is connected with here."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_id", kind="stable").reset_index(drop=True)
        ids, copies = group["_id"].to_numpy(), group["_copies"].to_numpy()
        width = max(map(len, group["_u"])) // 8
        units = np.stack([np.pad(np.frombuffer(u), (0, width - len(u) // 8)) for u in group["_u"]])
        block, home = group["_block"].to_numpy(), group["_home"].to_numpy()
        first, second = int(group["_a"].iloc[0]), int(group["_b"].iloc[0])
        near = _linked(units, units, cosine)
        if first == second:
            near &= home[:, None] & home[None, :]
        else:
            # One side is the home block, the other a later block or a tile of visitors.
            left = home & (block == first)
            near &= left[:, None] ^ left[None, :]
        np.fill_diagonal(near, False)
        links = near @ copies
        some = links > 0
        return pd.DataFrame({"_id": ids[some], "_links": links[some], "_root": ids[connected_here(near)[some]]})

    return run


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, one row per row of ``vectors``.

    Rows of one label (not null) whose cosine, in double precision, is at least
    ``cosine`` are linked; ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` whether it is the
    row's own. A vector that is null, empty, zero or holds null or non-finite
    components, and a row without a label, links with nothing; a null id links
    with nothing and has a null component and is kept. Components that a
    shorter vector lacks are zeros. An empty table gives an empty one, rows
    that repeat an id share one component and each count their own links, and other columns are not read.

    Equal vectors of a label are compared once, as one row with its number of
    copies. Vectors go to the cell of the nearest pivot of their label and, by the triangle
    inequality, to each lower cell that a neighbour of theirs can lie in, so
    a pair meets in exactly one cell. A large cell is cut into blocks, and
    every pair of blocks is a task of its own with at most two blocks of rows.
    A task returns one row per linked vector, never its pairs.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_v")
    )
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    usable = (
        F.col("_id").isNotNull()
        & F.col("_label").isNotNull()
        & F.coalesce(F.forall("_v", number), F.lit(False))
        & F.coalesce(F.exists("_v", lambda x: x != 0), F.lit(False))
    )
    used = rows.filter(usable)
    distinct = written(
        used.groupBy("_label", "_v").agg(F.min("_id").alias("_id"), F.count("*").alias("_copies")).select(
            "_id", "_label", "_v", "_copies"
        ),
        "distinct",
    )
    total = distinct.count()
    if not total:
        return rows.select(
            F.col("_id").alias(id_col),
            F.lit(0).cast("bigint").alias("n_links"),
            F.col("_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    pivots = _pivots(distinct, total)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    kind = vectors.schema[label_col].dataType.simpleString()
    dealt = written(
        distinct.mapInArrow(
            _dealing(pivots, reach),
            f"_id bigint, _label {kind}, _cell int, _home boolean, _far double, _copies bigint, _u binary",
        ),
        "cells",
    )
    # One row per label and pivot: how many are at home there and how far they lie.
    cells = dealt.groupBy("_label", "_cell").agg(
        F.count_if("_home").alias("_n"),
        F.count_if(~F.col("_home")).alias("_visits"),
        F.max(F.when(F.col("_home"), F.col("_far"))).alias("_radius"),
    )
    cells = cells.filter("_n > 0").select(
        "_label",
        "_cell",
        "_radius",
        F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_blocks"),
        F.ceil(F.col("_visits") / BLOCK_ROWS).cast("int").alias("_tiles"),
    )
    inside = dealt.join(cells, ["_label", "_cell"]).filter(F.col("_home") | (F.col("_far") <= F.col("_radius") + reach + SLACK))
    # Home rows have the blocks 0 .. _blocks - 1, visitors the tiles behind them.
    block = F.when(F.col("_home"), F.pmod(F.xxhash64("_id"), "_blocks")).otherwise(
        F.col("_blocks") + F.pmod(F.xxhash64("_id"), F.greatest("_tiles", F.lit(1)))
    )
    inside = inside.withColumn("_block", block.cast("int"))
    meets = F.when(
        F.col("_home"), F.sequence(F.lit(0), F.col("_blocks") + F.col("_tiles") - 1)
    ).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    tasks = inside.withColumn("_other", F.explode(meets)).select(
        "_label",
        "_cell",
        F.least("_block", "_other").alias("_a"),
        F.greatest("_block", "_other").alias("_b"),
        "_id",
        "_copies",
        "_u",
        "_block",
        "_home",
    )
    found = written(
        tasks.groupBy("_label", "_cell", "_a", "_b").applyInPandas(
            _comparing(cosine), "_id bigint, _links bigint, _root bigint"
        ),
        "links",
    )
    degrees = found.groupBy("_id").agg(F.sum("_links").alias("_links"))
    classes = components(found.select("_id", "_root"))
    known = (
        distinct.select("_label", "_v", F.col("_id").alias("_rep"), "_copies")
        .join(degrees.withColumnRenamed("_id", "_rep"), "_rep", "left")
        .join(classes.select(F.col("node").alias("_rep"), "component"), "_rep", "left")
        .select(
            "_label",
            "_v",
            (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"),
            F.coalesce("component", "_rep").alias("_component"),
        )
    )
    # Every row finds its vector's result; the copies of one vector are the side that can be split.
    result = rows.withColumn("_used", F.coalesce(usable, F.lit(False)))
    joined = result.join(
        known, F.col("_used") & (result["_label"] == known["_label"]) & (result["_v"] == known["_v"]), "left"
    )
    component = F.coalesce("_component", "_id")
    return joined.select(
        F.col("_id").alias(id_col),
        F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"),
    )
