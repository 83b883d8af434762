"""Row transforms that may fail: good rows and rejects with the reason."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


# What bad data makes a decoder raise; anything else is the environment's fault and fails the task.
DATA_ERRORS = (ValueError, TypeError, KeyError, IndexError, EOFError, struct.error)
# A block of results is handed on when its values hold this much.
BLOCK_BYTES = 32 << 20


def map_with_rejects(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.Series],
    column: StructField,
    carry: list[str],
    errors: tuple[type[Exception], ...] = DATA_ERRORS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``column`` computed by ``fn``, and ``error`` for rows on which it fails.

    ``fn`` maps a block of rows to one value each. Rows go in slices; a slice
    that fails with one of ``errors`` is halved, and so on, until the rows at
    fault are alone: one of n rows costs about 2 log2(n) more calls, and the
    others keep their values. Any other exception, such as a
    missing package or a lack of memory, fails the task. Slices grow and
    shrink with the size of the results, so that a block stays near
    ``block_bytes`` however much larger than its input a result is. Works on
    batch and on streaming tables. Only ``carry`` is kept of the input columns.
    """
    schema = StructType([df.schema[c] for c in carry] + [column, StructField("error", StringType())])

    def values_of(block: pd.DataFrame) -> tuple[list, list]:
        """Values and reasons of a block; one that fails is halved until the rows at fault are alone."""
        try:
            found = list(fn(block))
            if len(found) != len(block):
                raise RuntimeError(f"{len(found)} values for {len(block)} rows")
            return found, [None] * len(block)
        except errors as failure:  # a row's own failure is its result
            if len(block) == 1:
                return [None], [f"{type(failure).__name__}: {failure}"]
        half = len(block) // 2
        (first, why), (second, why_too) = values_of(block.iloc[:half]), values_of(block.iloc[half:])
        return first + second, why + why_too

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = 1
        for batch in batches:
            at = 0
            while at < len(batch):
                block = batch.iloc[at : at + step]
                at += len(block)
                values, reasons = values_of(block)
                out = block[carry].copy()
                out[column.name] = pd.Series(values, index=out.index, dtype=object)
                out["error"] = pd.Series(reasons, index=out.index, dtype=object)
                yield out
                width = max(1, max((getattr(v, "nbytes", None) or (len(v) if hasattr(v, "__len__") else 8)) for v in values))
                step = int(min(max(1, block_bytes // width), 2 * step, 10_000))

    return df.mapInPandas(blocks, schema)


def accepted(mapped: DataFrame) -> DataFrame:
    return mapped.filter(F.col("error").isNull()).drop("error")


def rejected(mapped: DataFrame, column: str) -> DataFrame:
    return mapped.filter(F.col("error").isNotNull()).drop(column)
