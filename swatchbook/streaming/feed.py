"""A training set that grows with a stream of image tensors, every batch of it once."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from swatchbook.cluster import many_files, scratch, skew_join, written
from swatchbook.operators.training_set import split_by_hash
from swatchbook.sources.tables import file_system, hadoop_path, write_training_set

# Beside the splits: images whose product has no text yet, and files that gave no tensor or no key.
UNMATCHED, REJECTED = "unmatched", "rejected"
MANIFEST = "_manifest"


def _names(spark: SparkSession, path: str) -> list[str]:
    """Batches of the manifest in the order of their names."""
    fs, folder = file_system(spark, path), hadoop_path(spark, f"{path}/{MANIFEST}")
    if not fs.exists(folder):
        return []
    found = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(name.removesuffix(".json") for name in found if name.endswith(".json"))


def committed(spark: SparkSession, path: str) -> list[dict]:
    """What the manifest says of each committed batch: its name, query, number and splits."""
    names = _names(spark, path)
    if not names:
        return []
    rows = spark.read.text([f"{path}/{MANIFEST}/{name}.json" for name in names], wholetext=True).collect()
    return sorted((json.loads(r[0]) for r in rows), key=lambda e: (e["query"], e["number"]))


def _commit(spark: SparkSession, path: str, entry: dict) -> None:
    """The entry appears whole or not at all: it is written under another name first."""
    fs = file_system(spark, path)
    target = hadoop_path(spark, f"{path}/{MANIFEST}/{entry['batch']}.json")
    draft = hadoop_path(spark, f"{path}/{MANIFEST}/{entry['batch']}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(entry).encode()))
    finally:
        out.close()
    if not fs.rename(draft, target):
        raise OSError(f"cannot commit batch {entry['batch']}")


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a query keeps over all runs from its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def add_batch(
    tensors: DataFrame,
    texts: DataFrame,
    path: str,
    query: str,
    number: int,
    files: Mapping[str, int],
    shapes: Mapping[str, Sequence[int]] | None = None,
    key_type: str = "bigint",
) -> bool:
    """Add one batch of :func:`images.image_tensors` to the set at ``path``; says whether it was new.

    A batch has a folder of its own, named by query and number, and counts
    from the moment the manifest names it. Running it again replaces a folder
    that was left half-way, and does nothing once it is in the manifest.
    """
    spark = tensors.sparkSession
    name = f"{query}-{number:09d}"
    fs = file_system(spark, path)
    if fs.exists(hadoop_path(spark, f"{path}/{MANIFEST}/{name}.json")):
        return False
    with scratch(spark):
        # Decoded once; what follows reads the tensors from there.
        stored = written(tensors.select("product_id", "img_array", "error"), "tensors")
        key = F.col("product_id").try_cast(key_type)
        usable = F.col("error").isNull() & key.isNotNull()
        images = stored.filter(usable).select(key.alias("product_id"), "img_array", F.monotonically_increasing_id().alias("_image_row"))
        known = texts.withColumn("_text_row", F.monotonically_increasing_id()).withColumn("product_id", key).filter("product_id IS NOT NULL")
        paired = skew_join(images, known, "product_id", "left")
        label = F.when(F.col("_text_row").isNull(), F.lit(UNMATCHED)).otherwise(split_by_hash(F.col("product_id")))
        columns = ["product_id", *[c for c in texts.columns if c != "product_id"], "img_array"]
        labelled = paired.select(*columns, label.alias("dataset"), "_text_row", "_image_row")
        folder = f"{path}/batch={name}"
        write_training_set(labelled, folder, {**files, UNMATCHED: 1}, "dataset", shapes, deal_by=("_text_row", "_image_row"))
        why = F.coalesce("error", F.concat(F.lit(f"key is no {key_type}: "), F.coalesce("product_id", F.lit("null"))))
        stored.filter(~usable).select("product_id", why.alias("error")).write.mode("overwrite").parquet(f"{folder}/{REJECTED}")
    _commit(spark, path, {"batch": name, "query": query, "number": number, "splits": sorted(files)})
    return True


def feed_training_set(
    stream: DataFrame,
    texts: DataFrame,
    path: str,
    checkpoint: str,
    files: Mapping[str, int],
    shapes: Mapping[str, Sequence[int]] | None = None,
    key_type: str = "bigint",
) -> None:
    """Join everything new in a stream of image tensors with ``texts``, add it to the training set, and stop.

    ``stream`` is that of :func:`images.image_tensors`; ``texts`` is a table
    with ``product_id``, read anew for every batch. ``files`` gives the number
    of files of each split for one batch. The checkpoint stays the same from
    run to run. If a run dies after a batch was written and before Spark has
    noted it, the batch comes again with the same number and is not added
    twice; another checkpoint is another query, whose files count as new.
    Read the set with :func:`read_split`, which sees committed batches only.
    Nothing is dropped: images without a text are in ``UNMATCHED`` with their
    tensors, files without a tensor or an integer name in ``REJECTED`` with
    the reason.
    """

    def add(batch: DataFrame, number: int) -> None:
        add_batch(batch, texts, path, _query_id(batch.sparkSession, checkpoint), number, files, shapes, key_type)

    with many_files(stream.sparkSession):
        (
            stream.writeStream.foreachBatch(add)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )


def read_split(spark: SparkSession, path: str, split: str, schema: StructType | None = None) -> DataFrame:
    """One split of all committed batches, or ``UNMATCHED`` or ``REJECTED``. Without any batch ``schema`` is needed."""
    folders = [f"{path}/batch={name}/{split}" for name in _names(spark, path)]
    if not folders:
        if schema is None:
            raise ValueError(f"no batch has been committed to {path}")
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(*folders)
