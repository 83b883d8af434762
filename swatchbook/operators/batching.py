"""Batches, epochs, shards of files and groups of work."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from swatchbook.cluster import global_row_index, written


# Round functions work in the field of this prime; both halves of a place are below it.
PRIME = (1 << 31) - 1
ROUNDS = 6
# Widths tried for the grid of an order: the more, the fewer surplus places.
WIDTHS = 2048


class Order(NamedTuple):
    """A keyed order of ``rows`` places: a Feistel network on a grid of ``width`` times ``height`` places.

    A place that falls outside the rows is moved on, ``steps`` times at most.
    """

    rows: int
    width: int
    height: int
    keys: tuple[int, ...]
    steps: int

    def place(self, at: np.ndarray) -> np.ndarray:
        """Where the places ``at`` go within the grid."""
        left, right = at // self.height, at % self.height
        for n in range(ROUNDS):
            a, b = self.keys[2 * n : 2 * n + 2]
            if n % 2:
                right = (right + _scatter(left, a, b)) % self.height
            else:
                left = (left + _scatter(right, a, b)) % self.width
        return left * self.height + right


def _scatter(x, a, b):
    """A cubic over the prime field; of numbers, arrays or columns below the prime."""
    return (x + a) % PRIME * ((x + a) % PRIME) % PRIME * ((x + b) % PRIME) % PRIME


def _grid(rows: int) -> tuple[int, int]:
    """Width and height of the grid with the fewest surplus places among those that are nearly square."""
    root = math.isqrt(max(rows - 1, 0)) + 1
    widths = range(root, root + min(WIDTHS, root // 4 + 2))
    return min(((w, max(1, -(-rows // w))) for w in widths), key=lambda g: (g[0] * g[1] - rows, g[0]))


def order_of(rows: int, seed: int, epoch: int) -> Order:
    """The order of one epoch. Keys come from seed and epoch by the round function itself."""
    width, height = _grid(rows)
    start = _scatter(seed % PRIME, 314159265, 271828182)
    keys: list[int] = []
    for n in range(ROUNDS):
        a = _scatter((start + epoch * ROUNDS + n) % PRIME, 161803398, 141421356)
        keys += [a, _scatter(a, 577215664, 693147180)]
    order = Order(rows, width, height, tuple(keys), 0)
    # Surplus places are followed until they are among the rows; a cycle of surplus places is never entered.
    outside, steps = np.arange(rows, width * height, dtype=np.int64), 0
    moved = outside
    while len(moved) and steps < len(outside):
        steps += 1
        moved = order.place(moved)
        moved = moved[moved >= rows]
    return order._replace(steps=steps)


def _moved(df: DataFrame, order: Order, at: str, out: str) -> DataFrame:
    """Add ``out``, where ``at`` goes within the grid by the row's ``_keys``. One projection a round, in the JVM."""
    height = F.lit(order.height).cast("bigint")
    df = df.withColumns({"_left": F.call_function("div", F.col(at), height), "_right": F.col(at) % height})
    for n in range(ROUNDS):
        half, other, size = ("_right", "_left", order.height) if n % 2 else ("_left", "_right", order.width)
        drawn = _scatter(F.col(other), F.get("_keys", F.lit(2 * n)), F.get("_keys", F.lit(2 * n + 1)))
        df = df.withColumn(half, (F.col(half) + drawn) % size)
    return df.withColumn(out, F.col("_left") * height + F.col("_right")).drop("_left", "_right")


def assign_batches(
    df: DataFrame,
    key: str,
    batch_size: int,
    shuffle: bool = True,
    seed: int = 0,
    epochs: int = 1,
    first_epoch: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``epoch``, ``batch_id`` and ``pos``: where each row stands in the batches.

    Rows are numbered in key order, once for any number of epochs. An epoch's
    order is that one, or a permutation of the row numbers drawn from seed and
    epoch (:class:`Order`), computed row by row: nothing is sorted or written
    for it. Epochs follow each other without a gap, so only the very last
    batch may be short; ``pos`` is also the target of a row within its batch.
    For endless training call again with the next ``first_epoch``. Pass only
    the columns the batches need: numbering sorts and writes them.
    """
    numbered = global_row_index(df, [F.col(key)], partitions, "_index")
    # The count comes from the footers of the numbered files.
    total = numbered.count() if shuffle or epochs > 1 else 0
    orders = [order_of(total, seed, first_epoch + n) for n in range(epochs)] if shuffle else []
    listed = [
        F.struct(F.lit(first_epoch + n).alias("epoch"), F.lit([*o.keys] if o else [0]).cast("array<bigint>").alias("keys"))
        for n, o in enumerate(orders or [None] * epochs)
    ]
    placed = numbered.withColumn("_e", F.explode(F.array(*listed))).withColumns(
        {"_epoch": F.col("_e.epoch"), "_keys": F.col("_e.keys"), "_at": F.col("_index")}
    )
    if shuffle:
        placed = _moved(placed, orders[0], "_at", "_at")
        for _ in range(max(o.steps for o in orders)):
            placed = _moved(placed, orders[0], "_at", "_next")
            placed = placed.withColumn("_at", F.when(F.col("_at") < total, F.col("_at")).otherwise(F.col("_next")))
    placed = placed.withColumn("_at", F.col("_at") + (F.col("_epoch") - first_epoch).cast("bigint") * F.lit(total).cast("bigint"))
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col("_epoch").cast("int").alias("epoch"),
        F.expr(f"_at div {batch_size}").alias("batch_id"),
        (F.col("_at") % batch_size).cast("int").alias("pos"),
    )


def single_batch(df: DataFrame, key: str, batch_size: int) -> DataFrame:
    """The first batch in key order, with ``pos``; the table is never sorted as a whole."""
    first = df.orderBy(key).limit(batch_size)
    # At most batch_size rows reach this window.
    return first.withColumn("pos", F.row_number().over(Window.orderBy(key)) - 1)


def file_batches(table: DataFrame, batch_size: int, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """Consecutive slices of at most ``batch_size`` rows within each file.

    ``table`` must be a plain parquet read. A row's place in its file comes from
    the scan, so nothing is shuffled and a file of any size is fine. With
    ``shuffle``, the slices of a file are to be taken by ascending ``slice_order``.
    """
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    located = table.select(
        "*",
        file.alias("file"),
        F.floor(row / batch_size).alias("slice_id"),
        (row % batch_size).cast("int").alias("pos"),
    )
    drawn = F.xxhash64("file", "slice_id", F.lit(seed)) if shuffle else F.col("slice_id")
    return located.withColumn("slice_order", drawn)


def file_shards(table: DataFrame, workers: int) -> DataFrame:
    """``(file, n_rows, worker)``: the files of a parquet read, dealt out in name order."""
    counts = table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"))
    files = written(counts, "file-counts")
    indexed = global_row_index(files, [F.col("file")], name="_index")
    return indexed.select("file", "n_rows", (F.col("_index") % workers).cast("int").alias("worker"))


def shard_count(df: DataFrame, rows_per_shard: int) -> int:
    """Number of shards that keeps a shard near ``rows_per_shard`` rows, however many rows there are."""
    return max(1, math.ceil(df.count() / rows_per_shard))


def map_by_shard(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: StructType | str,
    key: str,
    shards: int,
) -> DataFrame:
    """Apply a user's pandas function to groups of rows formed by ``pmod(key, shards)``.

    ``key`` must be a unique integer, so that the shards stay even. Take
    ``shards`` from :func:`shard_count`: a fixed number would let groups grow
    with the data.
    """
    sharded = df.withColumn("shard", F.pmod(F.col(key), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(fn, schema)


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """Apply a user's pandas function to blocks of rows, in place and without a shuffle."""

    def blocks(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(blocks, schema)
