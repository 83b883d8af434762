"""Similarity of image and text embeddings: inside batches and over a whole corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from swatchbook.cluster import row_bytes, sized_join, skew_join, small_side, written
from swatchbook.functions.vectors import LOGIT_SCALE, argmax, cross_entropy, unit

# Scores are compared at this many decimals, so that copies of a vector tie
# wherever they are computed, and the tie goes to the smallest id.
SCORE_DECIMALS = 9
TILE_ROWS = 2048
# Vectors of one block, and scores that a task holds at once.
BLOCK_BYTES, STRIP_CELLS = 32 << 20, 4 << 20
# Pairs of a batch that travel as one row; larger batches go in tiles of this many.
ROW_BATCH = 4096
# Logits a task holds before it hands them on.
LOGIT_CELLS = 1 << 20
# More cells than this are found in two levels.
ONE_LEVEL = 256
# Second-level cells of one first-level cell at most, and rows that are compared with their pivots at once.
SECOND, LEVEL_ROWS = 4096, 1 << 16
# Cells opened in the first round, and the factor from round to round.
GROWTH = 8
# Slack for rounding in the pruning bounds, in radians and in score.
ANGLE_SLACK = 1e-6


def l2_normalize(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Divide a vector by its length."""
    return df.withColumn(out or column, unit(F.col(column)))


def _packed(pairs: DataFrame, batch_size: int) -> DataFrame:
    """One row per batch. Its positions must be 0, 1, 2, ... and its vectors complete, else the job ends with the reason."""
    inside = F.col("pos").between(0, batch_size - 1) & F.col("img").isNotNull() & F.col("txt").isNotNull()
    checked = F.when(inside, F.col("pos")).otherwise(
        F.raise_error(
            F.concat_ws(" ", F.lit("position outside the batch, or null vector:"), F.col("batch_id").cast("string"), F.col("pos").cast("string"))
        )
    )
    # Each position once: a batch holds batch_size rows at most, and positions
    # that repeat are found before they are gathered.
    counted = pairs.groupBy("batch_id", checked.cast("int").alias("pos")).agg(
        F.count("*").alias("n"), F.first("img").alias("img"), F.first("txt").alias("txt")
    )
    once = F.when(F.col("n") == 1, F.col("pos")).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("position given twice in batch"), F.col("batch_id").cast("string")))
    )
    gathered = counted.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct(once.alias("pos"), "img", "txt"))).alias("rows")
    )
    dense = F.element_at("rows.pos", F.lit(-1)) == F.size("rows") - 1
    return gathered.select(
        "batch_id",
        F.when(dense, F.col("rows.pos"))
        .otherwise(F.raise_error(F.concat_ws(" ", F.lit("position missing in batch"), F.col("batch_id").cast("string"))))
        .alias("pos"),
        F.flatten("rows.img").alias("img"),
        F.flatten("rows.txt").alias("txt"),
    )


def _tiles(pairs: DataFrame, batch_size: int, tile: int) -> DataFrame:
    """``(batch_id, pos, img, txt, tiles)``: checked pairs, and how many tiles their batch has; no batch is gathered."""
    inside = F.col("pos").between(0, batch_size - 1) & F.col("img").isNotNull() & F.col("txt").isNotNull()
    place = F.concat_ws(" ", F.col("batch_id").cast("string"), F.col("pos").cast("string"))
    checked = F.when(inside, F.col("pos")).otherwise(F.raise_error(F.concat(F.lit("position outside the batch, or null vector: "), place)))
    stored = written(pairs.select("batch_id", checked.cast("int").alias("pos"), "img", "txt"), "pairs")
    each = stored.groupBy("batch_id", "pos").agg(F.count("*").alias("n"))
    sizes = each.groupBy("batch_id").agg(F.count("*").alias("places"), F.max("n").alias("most"), F.max("pos").alias("last"))
    named = F.col("batch_id").cast("string")
    tiles = (
        F.when(F.col("most") > 1, F.raise_error(F.concat(F.lit("position given twice in batch "), named)))
        .when(F.col("last") + 1 != F.col("places"), F.raise_error(F.concat(F.lit("position missing in batch "), named)))
        .otherwise(F.expr(f"last div {tile} + 1"))
    )
    return sized_join(stored, sizes.select("batch_id", tiles.cast("int").alias("tiles")), "batch_id", "inner", "batch-tiles")


def _tiled_predictions(pairs: DataFrame, batch_size: int, scale: float, alpha: float, tile: int) -> DataFrame:
    """:func:`inbatch_predictions` of batches of any size: one task scores one tile of images against one of texts.

    Of every such block the rows' and the columns' best logit, its place and
    the sum of exponentials relative to it leave the task, and are merged per
    pair and side by a grouped aggregate over the tiles.
    """
    placed = _tiles(pairs, batch_size, tile).withColumn("own", F.expr(f"pos div {tile}").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    images = placed.select("batch_id", F.col("own").alias("i"), other.alias("t"), "pos", F.col("img").alias("vec"))
    # Aliases, as both sides come from one table.
    same = [F.col(c).alias(c) for c in ("batch_id", "pos")]
    texts = placed.select(*same, other.alias("i"), F.col("own").alias("t"), F.col("txt").alias("vec"))
    kind = pairs.schema["batch_id"].dataType.simpleString()
    factor = float(np.exp(scale))

    def side(name: int, batch_id, pos: np.ndarray, others: np.ndarray, logits: np.ndarray, own: np.ndarray) -> pd.DataFrame:
        top = logits.max(axis=1)
        return pd.DataFrame(
            {
                "batch_id": [batch_id] * len(pos),
                "pos": pos,
                "side": name,
                "top": top,
                "best": others[logits.argmax(axis=1)],
                "total": np.exp(logits - top[:, None]).sum(axis=1),
                "own": own,
            }
        )

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        # Ascending positions: ties take the first.
        a, b = a.sort_values("pos"), b.sort_values("pos")
        rows, columns = a["pos"].to_numpy(), b["pos"].to_numpy()
        logits = factor * (np.stack(a["vec"].to_numpy()).astype(np.float64) @ np.stack(b["vec"].to_numpy()).astype(np.float64).T)
        same = a["i"].iloc[0] == a["t"].iloc[0]
        own = np.diag(logits) if same else np.full(max(logits.shape), np.nan)
        batch_id = a["batch_id"].iloc[0]
        return pd.concat(
            [
                side(0, batch_id, rows, columns, logits, own[: len(rows)]),
                side(1, batch_id, columns, rows, logits.T, own[: len(columns)]),
            ]
        )

    blocks = images.groupBy("batch_id", "i", "t").cogroup(texts.groupBy("batch_id", "i", "t"))
    shape = f"batch_id {kind}, pos int, side int, top double, best int, total double, own double"
    parts = blocks.applyInPandas(score, shape)
    # One entry per tile of the batch.
    merged = parts.groupBy("batch_id", "pos", "side").agg(
        F.max("top").alias("top"),
        F.max(F.struct("top", (-F.col("best")).alias("first"))).alias("best"),
        F.max(F.nanvl("own", F.lit(None).cast("double"))).alias("own"),
        F.collect_list(F.struct("top", "total")).alias("parts"),
    )
    total = F.aggregate("parts", F.lit(0.0), lambda x, p: x + p["total"] * F.exp(p["top"] - F.col("top")))
    loss = F.col("top") + F.log(total) - F.col("own")
    found = merged.select("batch_id", "pos", "side", (-F.col("best.first")).cast("int").alias("pred"), loss.alias("loss"))
    return found.groupBy("batch_id", "pos").agg(
        F.max(F.when(F.col("side") == 0, F.col("pred"))).alias("pred_img"),
        F.max(F.when(F.col("side") == 1, F.col("pred"))).alias("pred_txt"),
        F.sum(F.when(F.col("side") == 0, alpha * F.col("loss")).otherwise((1 - alpha) * F.col("loss"))).alias("loss"),
    )


def inbatch_predictions(
    pairs: DataFrame, batch_size: int, scale: float = LOGIT_SCALE, alpha: float = 0.5, most: int = ROW_BATCH
) -> DataFrame:
    """:func:`batch_predictions` of :func:`inbatch_logits` in one pass: the logits never leave the task.

    Batches of up to ``most`` pairs travel as one row each, larger ones in
    tiles of that many pairs a side, with the same result: predictions take the
    first best position, up to rounding of equal logits.
    """
    if batch_size > most:
        return _tiled_predictions(pairs, batch_size, scale, alpha, most)
    packed = _packed(pairs, batch_size)
    factor = float(np.exp(scale))
    kind = packed.schema["batch_id"].dataType.simpleString()

    def sides(a: np.ndarray, b: np.ndarray, first: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        logits = factor * (a[first : first + step] @ b.T)
        top = logits.max(axis=1)
        own = logits[np.arange(len(logits)), first + np.arange(len(logits))]
        return logits.argmax(axis=1), top + np.log(np.exp(logits - top[:, None]).sum(axis=1)) - own

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in batches:
            for batch_id, pos, img, txt in block.itertuples(index=False):
                u = np.asarray(img, dtype=np.float64).reshape(len(pos), -1)
                v = np.asarray(txt, dtype=np.float64).reshape(len(pos), -1)
                step = max(1, LOGIT_CELLS // len(pos))
                for i in range(0, len(pos), step):
                    (images, loss_img), (texts, loss_txt) = sides(u, v, i, step), sides(v, u, i, step)
                    yield pd.DataFrame(
                        {
                            "batch_id": [batch_id] * len(images),
                            "pos": pos[i : i + step],
                            "pred_img": images,
                            "pred_txt": texts,
                            "loss": alpha * loss_img + (1 - alpha) * loss_txt,
                        }
                    )

    return packed.mapInPandas(score, f"batch_id {kind}, pos int, pred_img int, pred_txt int, loss double")


def inbatch_logits(pairs: DataFrame, batch_size: int, scale: float = LOGIT_SCALE) -> DataFrame:
    """``(batch_id, pos, img_logits, txt_logits)``: one row per pair, no row per combination.

    ``pairs`` has ``batch_id``, ``pos``, ``img`` and ``txt`` (unit vectors). A
    batch travels as one row of at most ``batch_size`` vectors per side.
    Positions that are missing, given twice or outside the batch, and null
    vectors, are errors; this bounds that row. Entry j of
    ``img_logits`` scores this image against text j, entry j of ``txt_logits``
    this text against image j.
    """
    packed = _packed(pairs, batch_size)
    factor = float(np.exp(scale))
    schema = StructType(
        [
            packed.schema["batch_id"],
            StructField("pos", packed.schema["pos"].dataType.elementType),
            StructField("img_logits", ArrayType(DoubleType())),
            StructField("txt_logits", ArrayType(DoubleType())),
        ]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, cells = [], 0

        def taken():
            return pd.DataFrame(rows, columns=schema.names)

        for block in batches:
            for batch_id, pos, img, txt in block.itertuples(index=False):
                u = np.asarray(img, dtype=np.float64).reshape(len(pos), -1)
                v = np.asarray(txt, dtype=np.float64).reshape(len(pos), -1)
                # A few rows of a large batch at a time: never the whole matrix.
                step = max(1, LOGIT_CELLS // len(pos))
                for i in range(0, len(pos), step):
                    images, texts = factor * (u[i : i + step] @ v.T), factor * (v[i : i + step] @ u.T)
                    rows += zip([batch_id] * len(images), pos[i : i + step], images, texts, strict=True)
                    cells += images.size
                    if cells >= LOGIT_CELLS:
                        yield taken()
                        rows, cells = [], 0
        if rows:
            yield taken()

    return packed.mapInPandas(score, schema)


def batch_predictions(logits: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``(batch_id, pos, pred_img, pred_txt, loss)`` from a row of logits each.

    The prediction is the first best position. The loss weighs the image-side
    cross-entropy by ``alpha`` and the text-side one by ``1 - alpha``.
    """
    loss = alpha * cross_entropy(F.col("img_logits"), F.col("pos")) + (1 - alpha) * cross_entropy(
        F.col("txt_logits"), F.col("pos")
    )
    return logits.select(
        "batch_id",
        "pos",
        argmax(F.col("img_logits")).alias("pred_img"),
        argmax(F.col("txt_logits")).alias("pred_txt"),
        loss.alias("loss"),
    )


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    """Rows of unit length in double precision; a zero vector stays zero."""
    rows = np.stack(vectors).astype(np.float64)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best scores per row; among ties the first columns."""
    if k == 1:
        return scores.argmax(axis=1)[:, None]
    if scores.shape[1] <= 4 * k:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    near = np.sort(np.argpartition(-scores, k - 1, axis=1)[:, :k], axis=1)
    values = np.take_along_axis(scores, near, axis=1)
    best = np.take_along_axis(near, np.argsort(-values, axis=1, kind="stable"), axis=1)
    # More columns than k reach the k-th score: only a full sort knows the first ones.
    tied = (scores >= values.min(axis=1)[:, None]).sum(axis=1) > k
    best[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :k]
    return best


def _pivots(corpus: DataFrame, cells: int) -> np.ndarray:
    """At most ``cells`` vectors of the corpus, drawn by hash of the id."""
    drawn = corpus.orderBy(F.xxhash64("id"), "id").limit(cells).select("vec")
    return np.unique(_unit([np.asarray(r[0]) for r in drawn.collect()]), axis=0)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


class _Tree:
    """Pivots in one level, or in two with the square root of the number of cells in the first.

    The first level is held by every worker. Pivots of the second level belong
    to one of the first; they travel only to blocks of that one's rows, so the
    number of cells may grow with the corpus. A cell is known by
    ``top * SECOND + sub``; sub 0 is the first pivot itself.
    """

    def __init__(self, base: DataFrame, rows: int, cells: int):
        self.spark = base.sparkSession
        self.two = cells > ONE_LEVEL
        first = math.isqrt(cells - 1) + 1 if self.two else cells
        self.first = _pivots(base, first)
        self.shared = self.spark.sparkContext.broadcast(self.first)
        self.second = None
        if self.two:
            # About as many rows as there are cells, in the cells of the first level that they fall into.
            share = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rows)) < cells
            drawn = self._first_level(base.filter(share))
            order = Window.partitionBy("top").orderBy(F.xxhash64("id"), "id")
            # Spark applies the rank limit before the shuffle as well.
            ranked = drawn.withColumn("sub", F.row_number().over(order)).filter(F.col("sub") < SECOND)
            self.second = written(ranked.select("top", "sub", F.col("vec").alias("pivot")), "second-pivots")

    def _first_level(self, df: DataFrame) -> DataFrame:
        """Add ``top``, the nearest pivot of the first level, and the angle ``far`` to it."""
        shared = self.shared

        @F.pandas_udf("struct<top:int,far:double>")
        def locate(vectors: pd.Series) -> pd.DataFrame:
            angles = _angles(_unit(vectors.to_numpy()), shared.value)
            nearest = angles.argmin(axis=1)
            return pd.DataFrame({"top": nearest.astype(np.int32), "far": angles[np.arange(len(nearest)), nearest]})

        return df.withColumn("_at", locate("vec")).select("*", "_at.top", "_at.far").drop("_at")

    def blocked(self, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """``df`` with a block of its ``top``, and the second level's pivots once for every such block."""
        counts = df.groupBy("top").agg(F.ceil(F.count("*") / LEVEL_ROWS).alias("blocks"))
        # One row per pivot of the first level, which every worker holds anyway.
        counts = F.broadcast(written(counts, "first-level"))
        rows = df.join(counts, "top").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks"))).drop("blocks")
        every = self.second.join(counts, "top").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        return rows, every.drop("blocks")

    def place(self, df: DataFrame, key: str, label: str) -> DataFrame:
        """``(key, vec, cell, near, top, far)``: the cell of each row and the angles to the pivots of both levels."""
        first = self._first_level(df)
        if not self.two:
            cell = (F.col("top") * SECOND).cast("bigint")
            return written(first.select(key, "vec", cell.alias("cell"), F.col("far").alias("near"), "top", "far"), label)
        rows, pivots = self.blocked(written(first, f"{label}-first"), key)
        shape = f"{key} bigint, vec {df.schema['vec'].dataType.simpleString()}, cell bigint, near double, top int, far double"

        def locate(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
            if rows.empty:
                return pd.DataFrame({c: [] for c in (key, "vec", "cell", "near", "top", "far")})
            vectors, far = _unit(rows["vec"].to_numpy()), rows["far"].to_numpy()
            cell, near = np.zeros(len(rows), dtype=np.int64), far.copy()
            if len(pivots):
                angles = _angles(vectors, _unit(pivots["pivot"].to_numpy()))
                best = angles.argmin(axis=1)
                closest = angles[np.arange(len(best)), best]
                closer = closest < far
                cell, near = np.where(closer, pivots["sub"].to_numpy()[best], 0), np.where(closer, closest, far)
            return rows.assign(cell=rows["top"].to_numpy().astype(np.int64) * SECOND + cell, near=near)[[key, "vec", "cell", "near", "top", "far"]]

        return written(rows.groupBy("top", "block").cogroup(pivots.groupBy("top", "block")).applyInPandas(locate, shape), label)

    def open(self, queries: DataFrame, cells: DataFrame) -> DataFrame:
        """``(query_id, cell, bound)``: cells other than a query's own whose best possible score ``bound`` reaches its floor.

        Members of a cell lie between ``near_lo`` and ``near_hi`` from its
        pivot and between ``far_lo`` and ``far_hi`` from that of the first
        level; either range bounds the angle to the query from below.
        """
        tops = cells.groupBy("top").agg(F.min("far_lo").alias("lo"), F.max("far_hi").alias("hi")).collect()
        names = np.array([r["top"] for r in tops], dtype=np.int32)
        shared = self.spark.sparkContext.broadcast(
            (self.first[names], names, np.array([r["lo"] for r in tops]), np.array([r["hi"] for r in tops]))
        )

        @F.pandas_udf("array<struct<top:int,bound:double,angle:double>>")
        def open_tops(vectors: pd.Series, floor: pd.Series) -> pd.Series:
            pivots, names, lo, hi = shared.value
            angles = _angles(_unit(vectors.to_numpy()), pivots)
            bound = _best_possible(angles, lo, hi)
            reach = bound >= floor.fillna(-2.0).to_numpy()[:, None]
            return pd.Series(
                [list(zip(names[r].tolist(), b[r].tolist(), a[r].tolist(), strict=True)) for r, b, a in zip(reach, bound, angles, strict=True)]
            )

        reached = queries.select("query_id", "vec", F.col("cell").alias("own"), "floor", F.explode(open_tops("vec", "floor")).alias("t")).select("*", "t.*").drop("t")
        if not self.two:
            return reached.select("query_id", (F.col("top") * SECOND).cast("bigint").alias("cell"), "bound", "own").filter("cell <> own").drop("own")
        rows, _ = self.blocked(written(reached, "open-first"), "query_id")
        # The cells that hold rows, with their pivots; sub 0 has none of its own.
        pivots = self.second.withColumn("cell", (F.col("top") * SECOND + F.col("sub")).cast("bigint")).select("cell", "pivot")
        listed = written(cells.join(pivots, "cell", "left"), "cells")
        every = written(rows.select("top", "block").distinct(), "open-blocks").join(listed, "top")

        def bounds(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if rows.empty or own.empty:
                return pd.DataFrame({"query_id": [], "cell": [], "bound": []}).astype({"query_id": "int64", "cell": "int64", "bound": "float64"})
            far = rows["angle"].to_numpy()[:, None]
            bound = _best_possible(far, own["far_lo"].to_numpy(), own["far_hi"].to_numpy())
            named = own["pivot"].notna().to_numpy()
            near = np.repeat(far, len(own), axis=1)
            if named.any():
                near[:, named] = _angles(_unit(rows["vec"].to_numpy()), _unit(own["pivot"][named].to_numpy()))
            bound = np.minimum(bound, _best_possible(near, own["near_lo"].to_numpy(), own["near_hi"].to_numpy()))
            reach = bound >= rows["floor"].fillna(-2.0).to_numpy()[:, None]
            reach &= own["cell"].to_numpy()[None, :] != rows["own"].to_numpy()[:, None]
            at, cell = np.nonzero(reach)
            return pd.DataFrame({"query_id": rows["query_id"].to_numpy()[at], "cell": own["cell"].to_numpy()[cell], "bound": bound[at, cell]})

        return rows.groupBy("top", "block").cogroup(every.groupBy("top", "block")).applyInPandas(bounds, "query_id bigint, cell bigint, bound double")


def _best_possible(angles: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest cosine that a member between ``lo`` and ``hi`` from a pivot can have with what is ``angles`` from it."""
    gap = np.maximum(0.0, np.maximum(angles - hi, lo - angles) - ANGLE_SLACK)
    return np.cos(np.minimum(gap, np.pi)) + ANGLE_SLACK


def block_rows(vectors: DataFrame) -> int:
    """Rows of one block, so that it holds about ``BLOCK_BYTES``; at least those of a tile."""
    return max(TILE_ROWS, BLOCK_BYTES // row_bytes(vectors.select("vec")))


def _tile_scores(queries: DataFrame, corpus: DataFrame, cells: DataFrame | None, k: int, tile: int) -> DataFrame:
    """k best corpus rows per query within the cells listed in its ``cell`` rows.

    ``cells`` has the number of rows ``n`` of every cell; without it all is
    one cell. Both sides of a cell are cut into blocks of about ``tile`` rows,
    and one task scores one block against one block, some queries at a time: a
    cell that holds a third of the corpus, or that every query asks for, is
    many tasks of bounded size. A row is copied once per block of the other
    side, and only k rows per query leave a pair of blocks.
    """
    if cells is None:
        counts = [max(1, -(-df.count() // tile)) for df in (corpus, queries)]
        queries, corpus = (df.withColumns({"cbs": F.lit(counts[0]), "qbs": F.lit(counts[1])}) for df in (queries, corpus))
    else:
        asked = queries.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("qbs"))
        sizes = cells.select("cell", F.ceil(F.col("n") / tile).alias("cbs")).join(asked, "cell")
        sizes, small = small_side(sizes, "cell-blocks")
        # Cells that nobody asks for drop out.
        queries, corpus = (
            df.join(F.broadcast(sizes), "cell") if small else skew_join(df, sizes, "cell") for df in (queries, corpus)
        )

    def block_of(column: str, blocks: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(blocks)).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))

    left = (
        queries.withColumn("qb", block_of("query_id", "qbs"))
        .withColumn("cb", every("cbs"))
        .select("cell", "cb", "qb", "query_id", "vec")
    )
    right = (
        corpus.withColumn("cb", block_of("id", "cbs"))
        .withColumn("qb", every("qbs"))
        .select("cell", "cb", "qb", "id", "vec")
    )

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype(
                {"query_id": "int64", "id": "int64", "score": "float64"}
            )
        # Ascending ids: ties take the smallest.
        c = c.sort_values("id")
        ids = c["id"].to_numpy()
        asking, base = _unit(q["vec"].to_numpy()), _unit(c["vec"].to_numpy()).T
        found, values = [], []
        strip = max(1, STRIP_CELLS // len(ids))
        for at in range(0, len(asking), strip):
            scores = np.round(asking[at : at + strip] @ base, SCORE_DECIMALS)
            best = _best(scores, k)
            found.append(ids[best])
            values.append(np.take_along_axis(scores, best, axis=1))
        found = np.concatenate(found)
        return pd.DataFrame(
            {
                "query_id": np.repeat(q["query_id"].to_numpy(), found.shape[1]),
                "id": found.ravel(),
                "score": np.concatenate(values).ravel(),
            }
        )

    tiles = left.groupBy("cell", "cb", "qb").cogroup(right.groupBy("cell", "cb", "qb"))
    return tiles.applyInPandas(score, "query_id bigint, id bigint, score double")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    # Spark applies the rank limit before this shuffle as well, so a task sends
    # at most k rows per query.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Search(NamedTuple):
    """Results of a search, and which cells were scored for which queries."""

    best: DataFrame
    opened: list[DataFrame]
    cells: DataFrame | None


def nearest(queries: DataFrame, corpus: DataFrame, k: int, *columns: str, **options) -> DataFrame:
    """``(query_id, id, score, rank)``: the exact k best corpus rows of every query by cosine; see :func:`search`."""
    return search(queries, corpus, k, *columns, **options).best


def search(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_key: str = "query_id",
    query_vec: str = "vec",
    corpus_key: str = "id",
    corpus_vec: str = "vec",
    cells: int | None = None,
    tile: int = TILE_ROWS,
    block: int | None = None,
) -> Search:
    """The exact k best corpus rows of every query by cosine, cell by cell, best cells first.

    Keys must be unique integers; vectors may be copies. Rows without a key or
    a vector take no part. The corpus is divided into about ``cells`` cells
    around its own vectors (by default one per ``tile`` rows, however many
    those are), from ``ONE_LEVEL`` cells on in two levels. A query is first
    scored in its home cell; its k-th score there is a floor. By the triangle
    inequality on angles a cell whose members lie between ``lo`` and ``hi``
    from a pivot holds nothing better than
    cos(max(0, angle - hi, lo - angle)). Cells that reach the floor are opened
    in rounds, those with the best bound first and ``GROWTH`` times as many
    in each round; the floor rises after each, so what a later round would
    have opened is often out of reach by then. Cells are skipped only when this
    proves them useless; with unclustered vectors all of them are scored.
    Within a cell blocks of ``block`` rows are scored against each other, by
    default some megabytes. Tables with rows per query are joined by shuffles
    only: their files are small for what they hold, as ids and cells repeat,
    so that Spark would take them for small and send them through the driver.
    """
    asked = queries.select(F.col(query_key).cast("bigint").alias("query_id"), F.col(query_vec).alias("vec")).dropna()
    base = corpus.select(F.col(corpus_key).cast("bigint").alias("id"), F.col(corpus_vec).alias("vec")).dropna()
    rows = base.count()
    block = block or block_rows(base)
    if rows == 0:
        nothing = queries.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
        return Search(nothing, [], None)
    cells = cells or -(-rows // tile)
    if cells == 1:
        one = F.lit(0).cast("bigint").alias("cell")
        return Search(_ranked(_tile_scores(asked.select("*", one), base.select("*", one), None, k, block), k), [], None)
    tree = _Tree(base, rows, cells)
    placed = tree.place(base, "id", "corpus-cells")
    found = placed.groupBy("cell").agg(
        F.first("top").alias("top"),
        F.count("*").alias("n"),
        F.min("near").alias("near_lo"),
        F.max("near").alias("near_hi"),
        F.min("far").alias("far_lo"),
        F.max("far").alias("far_hi"),
    )
    known = written(found, "cells")
    homed = tree.place(asked, "query_id", "query-cells").select("query_id", "vec", "cell")
    members = placed.select("id", "vec", "cell")
    opened = [homed.select("query_id", "cell")]
    best = written(_ranked(_tile_scores(homed, members, known, k, block), k), "best")

    def with_floor(df: DataFrame) -> DataFrame:
        floors = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        return df.join(floors.hint("merge"), "query_id", "left")

    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
    reached = tree.open(with_floor(homed), known).withColumn("place", F.row_number().over(order))
    reached = written(reached, "open-cells")
    last = reached.agg(F.max("place")).first()[0] or 0
    done, upto = 0, GROWTH
    while done < last:
        part = with_floor(reached.filter((F.col("place") > done) & (F.col("place") <= upto)))
        part = written(part.filter(F.col("bound") >= F.coalesce("floor", F.lit(-2.0))).select("query_id", "cell"), "round")
        # Bounds only fall from here on.
        if part.isEmpty():
            break
        opened.append(part)
        asking = part.join(homed.select("query_id", "vec").hint("merge"), "query_id")
        scores = _tile_scores(asking, members, known, k, block)
        best = written(_ranked(best.drop("rank").unionByName(scores), k), "best")
        done, upto = upto, GROWTH * upto
    return Search(best, opened, known)


def scored_share(found: Search, queries: int, rows: int) -> float:
    """Share of all pairs of ``queries`` queries and ``rows`` corpus rows that were scored."""
    if found.cells is None or not queries * rows:
        return 1.0
    pairs = [df.join(found.cells.select("cell", "n"), "cell").agg(F.sum("n")).first()[0] or 0 for df in found.opened]
    return sum(pairs) / (queries * rows)


def embedding_parity(left: DataFrame, right: DataFrame, key: str = "id", vec: str = "vec") -> DataFrame:
    """One row: ids on either side only, compared ids, and the largest absolute difference.

    Looks at every element's absolute difference, so differences cannot cancel.
    """
    a = left.select(F.col(key).alias("_k"), F.col(vec).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(F.col(key).alias("_k"), F.col(vec).alias("_b"), F.lit(True).alias("_in_b"))
    gaps = F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same_size = F.size("_a") == F.size("_b")
    return a.join(b, "_k", "full").agg(
        F.count_if(both).alias("n_compared"),
        F.count_if(F.col("_in_b").isNull()).alias("n_left_only"),
        F.count_if(F.col("_in_a").isNull()).alias("n_right_only"),
        F.count_if(F.col("_in_a") & F.col("_in_b") & ~both).alias("n_null_vectors"),
        F.count_if(both & ~same_size).alias("n_size_differs"),
        F.max(F.when(both & same_size, F.array_max(gaps))).alias("max_abs_diff"),
    )
