"""Table reads and writes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchbook.cluster import row_bytes, scratch, scratch_path

# Fixed value.
ROW_GROUP_MB = 500
FILE_BYTES = 1 << 30


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, fmt: str = "parquet"
) -> DataFrame:
    """A stored table, of which only ``columns`` are read. ``fmt`` may name any installed source."""
    table = spark.read.format(fmt).load(path)
    return table.select(*columns) if columns else table


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    fmt: str = "parquet",
    compression: str | None = None,
    partition_by: Sequence[str] = (),
    row_group_mb: int | None = None,
) -> None:
    """Write a table; compression and row-group size hold for this write only."""
    writer = df.write.format(fmt).mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    if row_group_mb:
        writer = writer.option("parquet.block.size", row_group_mb << 20)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def with_shapes(df: DataFrame, shapes: Mapping[str, Sequence[int]]) -> DataFrame:
    """Record tensor shapes in the column metadata, which parquet keeps."""
    for column, shape in shapes.items():
        df = df.withMetadata(column, {"shape": list(shape)})
    return df


def shapes_of(df: DataFrame) -> dict[str, list[int]]:
    return {f.name: f.metadata["shape"] for f in df.schema.fields if "shape" in f.metadata}


def dealt_to_files(
    df: DataFrame, files: Mapping[str, int], label: str = "dataset", deal_by: Sequence[str] = ()
) -> DataFrame:
    """Rows in one partition per file to be written; ``_split``, the place of a row's label in ``files``, replaces it.

    A row's file follows from a hash of ``deal_by`` (default: the whole row),
    so a task that runs again deals alike; take columns that tell the rows of
    a frequent key apart. A null label, or one that ``files`` does not name,
    ends the job with the reason.
    """
    total = sum(files.values())
    unknown = F.raise_error(F.concat(F.lit("split labels without a number of files: "), F.coalesce(label, F.lit("null"))))
    drawn = F.xxhash64(*(deal_by or df.columns))
    first, file, split = 0, unknown, unknown
    for place, (name, count) in enumerate(files.items()):
        file = F.when(F.col(label) == name, F.pmod(drawn, F.lit(count)) + first).otherwise(file)
        split = F.when(F.col(label) == name, F.lit(place)).otherwise(split)
        first += count
    return df.repartitionById(total, file.cast("int")).withColumn("_split", split.cast("int")).drop(label, *deal_by)


def write_training_set(
    df: DataFrame,
    path: str,
    files: int | Mapping[str, int] | None = None,
    label: str = "dataset",
    shapes: Mapping[str, Sequence[int]] | None = None,
    compression: str = "gzip",
    row_group_mb: int = ROW_GROUP_MB,
    deal_by: Sequence[str] = (),
) -> dict[str, str]:
    """Write one folder per split label and return the folders.

    ``files`` per label: rows are dealt to the files of their label in one
    shuffle (:func:`dealt_to_files`) and written in one pass, beside the old
    folders, which are replaced at the end; a label without rows gets an empty
    table. A single number: all splits leave in one pass, each with that many
    files. Without a number the labelled rows are staged by label and measured,
    and every split gets files of about ``FILE_BYTES`` before compression.
    No file depends on how often a key occurs if ``deal_by`` (columns that are
    not written) or else the rows differ. A null label, or one that
    ``files`` does not name, is an error, and nothing is changed then.
    """
    spark = df.sparkSession
    if isinstance(files, int):
        shaped = with_shapes(df.drop(*deal_by), shapes or {})
        checked = shaped.withColumn(label, F.coalesce(F.col(label), F.raise_error(F.lit("a row has no split label"))))
        write_table(checked.repartition(files), path, "overwrite", "parquet", compression, [label], row_group_mb)
        return {"*": path}
    if files is not None:
        return _write_splits(df, path, files, label, shapes or {}, compression, row_group_mb, deal_by)
    with scratch(spark):
        stage = scratch_path(spark, "labelled")
        df = df.drop(*deal_by)
        write_table(df, stage, partition_by=[label])
        staged = spark.read.schema(df.schema).parquet(stage)
        # One row per label.
        found = [r[0] for r in staged.select(label).distinct().collect()]
        if None in found:
            raise ValueError("split labels without a number of files: null")
        folders = {}
        for name in sorted(found):
            split = staged.filter(F.col(label) == name).drop(label)
            count = max(1, -(-split.count() * row_bytes(split) // FILE_BYTES))
            folders[name] = f"{path}/{name}"
            write_table(
                with_shapes(split, shapes or {}).repartition(count),
                folders[name],
                "overwrite",
                "parquet",
                compression,
                (),
                row_group_mb,
            )
    return folders


def _write_splits(
    df: DataFrame,
    path: str,
    files: Mapping[str, int],
    label: str,
    shapes: Mapping[str, Sequence[int]],
    compression: str,
    row_group_mb: int,
    deal_by: Sequence[str],
) -> dict[str, str]:
    spark = df.sparkSession
    # The underscore hides the folder from readers of ``path``.
    new = f"{path}/_new-{uuid.uuid4().hex}"
    fs = file_system(spark, path)
    try:
        try:
            dealt = with_shapes(dealt_to_files(df, files, label, deal_by), shapes)
            write_table(dealt, new, "errorifexists", "parquet", compression, ["_split"], row_group_mb)
        except Exception as failure:
            if "split labels without" in str(failure):
                raise ValueError(re.search(r"split labels without a number of files: [^\n'\"]*", str(failure))[0]) from failure
            raise
        folders = {name: f"{path}/{name}" for name in files}
        for place, folder in enumerate(folders.values()):
            written_to = hadoop_path(spark, f"{new}/_split={place}")
            if not fs.exists(written_to):
                write_table(dealt.drop("_split").limit(0), f"{new}/_split={place}", compression=compression)
            fs.delete(hadoop_path(spark, folder), True)
            if not fs.rename(written_to, hadoop_path(spark, folder)):
                raise OSError(f"cannot move the new files to {folder}")
        return folders
    finally:
        fs.delete(hadoop_path(spark, new), True)


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
