"""Pairing text with images, and the training / validation split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchbook.cluster import skew_join

# Fixed values.
SPLIT_BUCKETS = 16
TRAINING_BUCKETS = 14
TRAINING, VALIDATION = "training", "validation"
IMAGE_SHARDS = 10


def key_from_path(path: Column, extension: str = "jpg") -> Column:
    """Last element of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), rf"\.{extension}$", "")


def hash_shard(path: Column, shards: int = IMAGE_SHARDS) -> Column:
    """Shard 0 .. shards-1 from Spark's hash of the path."""
    return F.abs(F.hash(path) % shards).cast("int")


def pair(texts: DataFrame, images: DataFrame, key: str = "product_id", key_type: str = "bigint", **skew) -> DataFrame:
    """Inner join of texts and images on a key of one pinned type.

    A key that is not of that type (say, a file name without a number) matches
    nothing; :func:`unusable_keys` counts such rows. Either side may hold any
    number of rows per key; a key that holds a large part of a side is spread
    over many tasks.
    """
    left = images.withColumn(key, F.col(key).try_cast(key_type)).filter(F.col(key).isNotNull())
    right = texts.withColumn(key, F.col(key).try_cast(key_type)).filter(F.col(key).isNotNull())
    others = [c for c in texts.columns if c != key] + [c for c in images.columns if c != key]
    return skew_join(left, right, key, "inner", **skew).select(key, *others)


def unusable_keys(
    texts: DataFrame, images: DataFrame, key: str = "product_id", key_type: str = "bigint"
) -> DataFrame:
    """``(side, key, n)``: the keys that :func:`pair` cannot use, null or not of its type, and their rows."""
    sides = []
    for name, df in (("text", texts), ("image", images)):
        bad = df.filter(F.col(key).try_cast(key_type).isNull())
        sides.append(bad.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "key", "n"))
    return sides[0].union(sides[1])


def split_by_bucket(bucket: Column, training: int = TRAINING_BUCKETS) -> Column:
    return F.when(bucket < training, F.lit(TRAINING)).otherwise(F.lit(VALIDATION))


def split_by_hash(
    key: Column, key_type: str = "int", buckets: int = SPLIT_BUCKETS, training: int = TRAINING_BUCKETS
) -> Column:
    """Split label from Spark's hash of the key.

    The key's type is pinned, as it decides the hash; a key that does not fit
    it is hashed as it is. The hash is widened before ``abs``, which would
    overflow on the smallest int.
    """
    pinned = key.try_cast(key_type)
    hashed = F.when(pinned.isNull() & key.isNotNull(), F.hash(key)).otherwise(F.hash(pinned))
    return split_by_bucket(F.abs(hashed.cast("bigint")) % buckets, training)


def split_by_key(key: Column, buckets: int = SPLIT_BUCKETS, training: int = TRAINING_BUCKETS) -> Column:
    """Split label from the key itself, for integer keys without structure."""
    return split_by_bucket(F.pmod(key, F.lit(buckets)), training)
