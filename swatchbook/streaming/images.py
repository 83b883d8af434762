"""Image files as an incremental, checkpointed stream of tensors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from swatchbook.cluster import many_files
from swatchbook.functions.tensors import npy_header
from swatchbook.functions.vectors import CHANNEL_MEAN, CHANNEL_STD
from swatchbook.operators.rejects import map_with_rejects
from swatchbook.operators.training_set import IMAGE_SHARDS, hash_shard, key_from_path

# Fixed values.
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
IMAGE_GLOB = "*.jpg"
IMAGE_SIZE = (336, 336)


def stream_files(
    spark: SparkSession, folder: str, glob: str = IMAGE_GLOB, max_files_per_batch: int | None = None
) -> DataFrame:
    """New files below ``folder`` since the last checkpoint, with their bytes."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
    )
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    return reader.load(folder)


def raw_bytes(shape: Sequence[int]) -> Callable[[bytes], np.ndarray]:
    """Decoder of uncompressed channel-first bytes, scaled to [0, 1]."""

    def decode(content: bytes) -> np.ndarray:
        return np.frombuffer(content, dtype=np.uint8).reshape(shape) / 255.0

    return decode


def image_tensors(
    files: DataFrame,
    decode: Callable[[bytes], np.ndarray],
    shape: Sequence[int] = (3, *IMAGE_SIZE),
    shards: int = IMAGE_SHARDS,
) -> DataFrame:
    """``(shard, product_id, img_array, error, rejected)``: standardised tensors as NPY bytes.

    ``decode`` is the user's. A file on which it raises a data error, or that
    has another shape, is kept as a reject with its reason and without a tensor.
    """
    header = npy_header(shape, "float32")
    mean = np.asarray(CHANNEL_MEAN).reshape(-1, 1, 1)
    std = np.asarray(CHANNEL_STD).reshape(-1, 1, 1)

    def cell(content: bytes) -> bytes:
        pixels = decode(content)
        if pixels.shape != tuple(shape):
            raise ValueError(f"shape {pixels.shape} is not {tuple(shape)}")
        return header + ((pixels - mean) / std).astype(np.float32).tobytes()

    def tensors(block: pd.DataFrame) -> pd.Series:
        return block["content"].map(cell)

    rows = files.select("path", "content", hash_shard(F.col("path"), shards).alias("shard"))
    mapped = map_with_rejects(rows, tensors, StructField("img_array", BinaryType()), ["path", "shard"])
    return mapped.select(
        "shard",
        key_from_path(F.col("path")).alias("product_id"),
        "img_array",
        "error",
        F.col("error").isNotNull().cast("int").alias("rejected"),
    )


def append_new(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: Sequence[str] = ("rejected", "shard"),
    compression: str = "uncompressed",
    fmt: str = "parquet",
) -> None:
    """Append everything new to the table at ``path`` and stop.

    The checkpoint path is the caller's and stays the same from run to run, so
    no file is ever taken twice. Rejects share the table in a partition of
    their own: one sink, one pass over the files, written exactly once.
    """
    with many_files(stream.sparkSession):
        (
            stream.writeStream.format(fmt)
            .option("checkpointLocation", checkpoint)
            .option("compression", compression)
            .partitionBy(*partition_by)
            .outputMode("append")
            .trigger(availableNow=True)
            .start(path)
            .awaitTermination()
        )


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, product_id, img_array)`` of the accepted images."""
    return spark.read.parquet(path).filter("rejected = 0").select("shard", "product_id", "img_array")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("rejected = 1").select("shard", "product_id", "error")
