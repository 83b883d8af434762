"""Exact k highest inner products by block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swatchbook.cluster import written

# Rows of one forward index, rows of one block in it, queries scored together.
SHARD_ROWS = 4096
BLOCK_ROWS = 64
TILE_QUERIES = 256
# Shards whose maxima travel in one row.
CHUNK_SHARDS = 1024
# Rows are dealt to shards by the nearest of this many rows at most, so that
# the rows of a shard resemble each other. Any choice gives the same result.
MAX_PIVOTS = 1024


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as bigint; null unless all components are finite numbers.

    A finite component whose result exceeds 64 bits ends the job with the reason.
    """
    whole = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return F.when(whole, F.transform(vector, lambda x: _whole(F.lit(float(scale)) * x.cast("double"))))


def _whole(x: Column) -> Column:
    return F.when(F.abs(x) < 2.0**63, F.floor(x)).otherwise(F.raise_error(F.lit("component too large for 64 bits")))


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    """The rows as one array; a missing component is a zero."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for n, row in enumerate(rows):
        out[n, : len(row)] = row
    return out


def _widen(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))) if matrix.shape[1] < width else matrix


MOST = (1 << 63) - 1


def _largest(left: np.ndarray, right: np.ndarray) -> float:
    """No inner product of the rows is further from zero."""
    most = [max(float(m.max(initial=0)), -float(m.min(initial=0))) for m in (left, right)]
    return most[0] * most[1] * max(1, left.shape[1])


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right.T`` in whole numbers; by floating point where that is exact, by large integers where 64 bits may not do."""
    top = _largest(left, right)
    if top < 2.0**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T if top < 2.0**62 else left.astype(object) @ right.T.astype(object)


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The inner products; one beyond 64 bits is refused."""
    found = _products(left, right)
    if found.dtype == object and found.size and max(found.max(), -found.min()) > MOST:
        raise OverflowError("components too large: an inner product exceeds 64 bits")
    return found.astype(np.int64)


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The summed term maxima: no row between ``low`` and ``high`` scores more with a query, as far as 64 bits go."""
    found = _products(np.maximum(queries, 0), high) + _products(np.minimum(queries, 0), low)
    return np.clip(found, -MOST, MOST).astype(np.int64) if found.dtype == object else found


def _assigning(pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (pivots.astype(np.float64) ** 2).sum(axis=1)
        for batch in batches:
            rows = batch.column(1).to_numpy(zero_copy_only=False)
            width = max(pivots.shape[1], max(map(len, rows), default=0))
            matrix = _matrix(list(rows), width).astype(np.float64)
            near = (norms - 2 * (matrix @ _widen(pivots, width).astype(np.float64).T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near, type=pa.int32())], names=["_id", "_v", "_pivot"]
            )

    return run


def _pack(group: pd.DataFrame) -> tuple[bytes, bytes, int]:
    """Ids, components and width of a group of rows."""
    width = max(map(len, group["_v"]), default=0)
    return group["_id"].to_numpy(np.int64).tobytes(), _matrix(list(group["_v"]), width).tobytes(), width


def _index(group: pd.DataFrame) -> pd.DataFrame:
    """The forward index of a shard, rows by id, and its term maxima and minima."""
    group = group.sort_values("_id", kind="stable")
    ids, data, width = _pack(group)
    matrix = np.frombuffer(data, np.int64).reshape(len(group), width)
    return pd.DataFrame(
        {
            "_shard": [int(group["_shard"].iloc[0])],
            "_ids": [ids],
            "_data": [data],
            "_width": [width],
            "_high": [matrix.max(axis=0).tobytes()],
            "_low": [matrix.min(axis=0).tobytes()],
        }
    )


def _tiles(group: pd.DataFrame) -> pd.DataFrame:
    ids, data, width = _pack(group)
    floors = group["_floor"].to_numpy(np.int64).tobytes()
    keys = {c: [group[c].iloc[0]] for c in group.columns if c in ("_shard", "_tile")}
    return pd.DataFrame(keys | {"_qids": [ids], "_qdata": [data], "_qwidth": [width], "_floors": [floors]})


def _table(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, np.int64)
    return numbers, np.frombuffer(data, np.int64).reshape(len(numbers), width)


def _summaries(group: pd.DataFrame) -> pd.DataFrame:
    width = int(group["_width"].max())
    wide = [
        np.stack([np.pad(np.frombuffer(x, np.int64), (0, width - len(x) // 8)) for x in group[c]]) for c in ("_high", "_low")
    ]
    return pd.DataFrame(
        {
            "_chunk": [int(group["_chunk"].iloc[0])],
            "_shards": [group["_shard"].to_numpy(np.int64).tobytes()],
            "_highs": [wide[0].tobytes()],
            "_lows": [wide[1].tobytes()],
            "_swidth": [width],
        }
    )


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for frame in frames:
        yield from frame.to_dict("records")


def _routing(first: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For each query the shard of the highest bound, or all shards whose bound reaches its floor."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _joined(frames):
            ids, queries = _table(row["_qids"], row["_qdata"], row["_qwidth"])
            shards = np.frombuffer(row["_shards"], np.int64)
            high, low = (
                np.frombuffer(row[c], np.int64).reshape(len(shards), row["_swidth"]) for c in ("_highs", "_lows")
            )
            width = max(queries.shape[1], high.shape[1])
            bounds = _bounds(_widen(queries, width), _widen(high, width), _widen(low, width))
            if first:
                q, s = np.arange(len(ids)), bounds.argmax(axis=1)
            else:
                q, s = np.nonzero(bounds >= np.frombuffer(row["_floors"], np.int64)[:, None])
            yield pd.DataFrame({"_id": ids[q], "_shard": shards[s], "_bound": bounds[q, s]})

    return run


def _scan(queries: np.ndarray, qids: np.ndarray, floors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """``(query place, row place, score)`` of each query's k best rows of a shard that reach its floor.

    The blocks of a query are scored in the order of their bounds, more of
    them at a time, until the next bound is below its floor or its k-th score.
    Scores that tie with the k-th stay in, as a smaller id may decide.
    """
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = _widen(queries, width), _widen(rows, width)
    starts = np.arange(0, len(rows), BLOCK_ROWS)
    high, low = np.maximum.reduceat(rows, starts, axis=0), np.minimum.reduceat(rows, starts, axis=0)
    bounds = _bounds(queries, high, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    exact = _largest(queries, rows) < 2.0**53
    typed = rows.astype(np.float64) if exact else rows
    for n, query in enumerate(queries.astype(typed.dtype)):
        ranked, places, scores = bounds[n, order[n]], [], []
        floor, at, step = int(floors[n]), 0, 4
        best = np.empty(0, np.int64)
        while at < len(ranked) and ranked[at] >= floor:
            blocks = order[n, at : at + step][ranked[at : at + step] >= floor]
            place = (blocks[:, None] * BLOCK_ROWS + np.arange(BLOCK_ROWS)).ravel()
            place = place[place < len(rows)]
            place = place[ids[place] != qids[n]]
            score = (typed[place] @ query).astype(np.int64) if exact else _scores(typed[place], query[None, :])[:, 0]
            places.append(place)
            scores.append(score)
            best = np.concatenate([best, score])
            if len(best) >= k:
                best = np.partition(best, len(best) - k)[-k:]
                floor = max(floor, int(best.min()))
            at, step = at + step, step * 2
        if places:
            place, score = np.concatenate(places), np.concatenate(scores)
            place, score = place[score >= floor], score[score >= floor]
            top = np.lexsort((ids[place], -score))[:k]
            yield n, place[top], score[top]


def _scoring(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _joined(frames):
            qids, queries = _table(row["_qids"], row["_qdata"], row["_qwidth"])
            ids, rows = _table(row["_ids"], row["_data"], row["_width"])
            floors = np.frombuffer(row["_floors"], np.int64)
            out = list(_scan(queries, qids, floors, ids, rows, k))
            if out:
                yield pd.DataFrame(
                    {
                        "_q": np.repeat([qids[n] for n, _, _ in out], [len(p) for _, p, _ in out]),
                        "_d": np.concatenate([ids[p] for _, p, _ in out]),
                        "_s": np.concatenate([s for _, _, s in out]),
                    }
                )

    return run


_NO_FLOOR = -(2**63)
_TILE = "_qids binary, _qdata binary, _qwidth int, _floors binary"


def _score(routed: DataFrame, index: DataFrame, k: int, tiles: int) -> DataFrame:
    """Scores of queries with their shards; ``routed`` has _id, _v, _floor, _shard."""
    tiled = (
        routed.withColumn("_tile", F.pmod(F.xxhash64("_id"), F.lit(tiles)))
        .groupBy("_shard", "_tile")
        .applyInPandas(_tiles, f"_shard bigint, _tile bigint, {_TILE}")
    )
    return tiled.join(index, "_shard").mapInPandas(_scoring(k), "_q bigint, _d bigint, _s bigint")


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_q").orderBy(F.desc("_s"), "_d")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "vector",
) -> DataFrame:
    """``(query_id, rank, id_col, score)``: each query's ``k`` highest integer inner products.

    Both tables hold a bigint id and an array of bigint. Ties go to the smaller
    id; a query is not compared with rows of its own id; fewer than ``k`` rows
    give fewer. Rows with a null id or vector take no part, a null component
    is not allowed, a component that a shorter vector lacks counts as zero.
    Rows that repeat an id are candidates each; a repeated query is asked once.
    Other columns are not read, empty tables give an empty result. An inner
    product beyond 64 bits ends the job with the reason.

    The rows are dealt to shards of similar rows, each with a forward index in
    blocks. A query first looks at the shard of its highest bound; the k-th
    score there is the floor that any other shard must reach to be looked at.
    Within a shard blocks go by their bounds. Queries travel in tiles and
    shards in one row of some megabytes, so no task holds more than one of
    each, and no key gathers more rows than a shard has.
    """
    spark = rows.sparkSession
    kept = [
        df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).filter("_id IS NOT NULL AND _v IS NOT NULL")
        for df in (rows, queries)
    ]
    base, asked = written(kept[0], "vectors"), written(kept[1].dropDuplicates(["_id"]), "queries")
    shape = "query_id bigint, rank int, " + f"{id_col} bigint, score bigint"
    total, wanted = base.count(), asked.count()
    if not total or not wanted:
        return spark.createDataFrame([], shape)
    tiles = -(-wanted // TILE_QUERIES)

    shards = -(-total // SHARD_ROWS)
    sample = base.orderBy(F.xxhash64("_id"), "_id").limit(min(MAX_PIVOTS, shards)).toPandas()
    pivots = _matrix(list(sample["_v"]), max(map(len, sample["_v"])))
    near = written(base.mapInArrow(_assigning(pivots), "_id bigint, _v array<bigint>, _pivot int"), "assigned")
    # At most MAX_PIVOTS rows: each pivot's rows are cut into shards of about SHARD_ROWS.
    cuts = near.groupBy("_pivot").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("_cuts"))
    dealt = near.join(F.broadcast(cuts), "_pivot").select(
        (
            F.col("_pivot").cast("bigint") * F.lit(1 << 32)
            + F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.col("_cuts"))
        ).alias("_shard"),
        "_id",
        "_v",
    )
    index = written(
        dealt.groupBy("_shard").applyInPandas(
            _index, "_shard bigint, _ids binary, _data binary, _width int, _high binary, _low binary"
        ),
        "index",
    )
    chunks = max(1, -(-index.count() // CHUNK_SHARDS))
    summary = written(
        index.select(F.pmod(F.xxhash64("_shard"), F.lit(chunks)).alias("_chunk"), "_shard", "_width", "_high", "_low")
        .groupBy("_chunk")
        .applyInPandas(_summaries, "_chunk bigint, _shards binary, _highs binary, _lows binary, _swidth int"),
        "summary",
    )

    def routes(floors: DataFrame, first: bool) -> DataFrame:
        tiled = (
            floors.withColumn("_tile", F.pmod(F.xxhash64("_id"), F.lit(tiles)))
            .groupBy("_tile")
            .applyInPandas(_tiles, f"_tile bigint, {_TILE}")
        )
        # Every tile of the stated queries meets every chunk of summaries.
        every = tiled.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))
        return every.join(summary, "_chunk").mapInPandas(_routing(first), "_id bigint, _shard bigint, _bound bigint")

    open_floor = asked.withColumn("_floor", F.lit(_NO_FLOOR))
    seeds = written(
        routes(open_floor, True).groupBy("_id").agg(F.max_by("_shard", F.struct("_bound", "_shard")).alias("_shard")), "seeds"
    )
    found = written(_best(_score(open_floor.join(seeds, "_id"), index, k, tiles), k).drop("rank"), "seed-scores")
    floors = found.groupBy(F.col("_q").alias("_id")).agg(
        F.when(F.count("*") >= k, F.min("_s")).otherwise(F.lit(_NO_FLOOR)).alias("_floor")
    )
    floored = asked.join(floors, "_id", "left").withColumn("_floor", F.coalesce("_floor", F.lit(_NO_FLOOR)))
    floored = written(floored, "floors")
    others = routes(floored, False).join(seeds, ["_id", "_shard"], "left_anti").select("_id", "_shard")
    rest = _score(others.join(floored, "_id"), index, k, tiles)
    return _best(found.union(rest), k).select(
        F.col("_q").alias("query_id"), "rank", F.col("_d").alias(id_col), F.col("_s").alias("score")
    )
