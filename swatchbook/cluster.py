"""Shared scratch space, lineage cuts, size checks and skew handling.

Everything here is about running on many executors: where intermediate tables
go, when a side may be broadcast, and how a hot key is spread over tasks.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType
from pyspark.sql.window import Window

# A side of a join is broadcast only when it holds at most this much.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

# Shuffled pieces are meant to be about this large. A key is hot when its rows
# make up more than one piece, and more than MIN_HOT_ROWS rows.
PIECE_BYTES = 128 << 20
MIN_HOT_ROWS = 100
# Rows looked at to learn how wide a row is.
WIDTH_ROWS = 1_000

# Bytes of one Arrow batch between the JVM and a Python worker.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

# Tasks that list the files of a micro-batch: this many per core, where Spark would take one per file up to 10,000.
LISTING_TASKS, LISTED_BY = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 2
# Opening a file counts as this many bytes of it; by Spark's 4 MB a task would read 32 pictures at most.
OPEN_COST, OPEN_BYTES = "spark.sql.files.openCostInBytes", 256 << 10

# Tables of fewer input splits are dealt out over the cores ahead of costly work.
SPREAD_SPLITS = 64
# Files whose row counts are added up in one task.
OFFSET_GROUP = 1_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by the session."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="swatchbook-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder, or below the folder of the :func:`scratch` around it."""
    return f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside are removed at the end.

    Results must be written inside, as they may read those tables.
    """
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(folder)
    try:
        yield folder
    finally:
        _SCRATCH.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint, but stays columnar, so later passes
    still read only the columns they need. Survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Streams started inside list and read many small files per task; a lower setting of the session stays."""
    confs = {LISTING_TASKS: LISTED_BY * spark.sparkContext.defaultParallelism, OPEN_COST: OPEN_BYTES}
    usual = {name: spark.conf.get(name) for name in confs}
    try:
        for name, most in confs.items():
            # A size may carry a unit, and then is the session's own.
            if usual[name].removesuffix("b").removesuffix("B").isdigit():
                spark.conf.set(name, min(int(usual[name].rstrip("bB")), most))
        yield
    finally:
        for name, value in usual.items():
            spark.conf.set(name, value)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files of a stored table."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return int(files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])


def row_bytes(df: DataFrame) -> int:
    """About how wide a row is, from its first rows."""
    widths = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            widths.append(F.coalesce(F.octet_length(column), F.lit(0)))
        elif isinstance(field.dataType, ArrayType):
            widths.append(F.greatest(F.size(column), F.lit(0)) * 8)
    fixed = 8 * len(df.columns)
    if not widths:
        return fixed
    mean = df.limit(WIDTH_ROWS).agg(F.avg(sum(widths, F.lit(0)))).first()[0]
    return fixed + int(mean or 0)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of few input splits out over all cores, ahead of costly work per row.

    A table of one file or row group is otherwise one task. From
    ``SPREAD_SPLITS`` splits on a table is never shuffled, however many cores
    there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, SPREAD_SPLITS) else df


def small_side(df: DataFrame, label: str, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Materialise ``df``, whose columns must cast to string; the flag says whether it may be broadcast."""
    table = written(df, label)
    width = F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in df.columns]))
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return table, rows <= max_rows and size <= BROADCAST_BYTES


def hot_keys(df: DataFrame, key: str, piece_rows: int) -> DataFrame:
    """``(key, _salts)`` of keys with more than ``piece_rows`` rows, and how many such pieces they make up.

    Counting combines on the map side and reads the key column only, once.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") > piece_rows).select(key, F.ceil(F.col("_n") / piece_rows).alias("_salts"))


def _salted(df: DataFrame, key: str, own: DataFrame | None, other: DataFrame | None, names: tuple[str, str]) -> DataFrame:
    """Rows with a salt of their own side, repeated for every salt of the other side."""
    mine, theirs = names
    zero = F.lit(0).cast("bigint")
    salt = zero
    if own is not None:
        df = df.join(own, key, "left")
        # Null keys match nothing, but must not all travel to the same task.
        salts = F.when(F.col(key).isNull(), F.lit(1 << 20)).otherwise(F.coalesce("_salts", F.lit(1)))
        # The running id is hashed: rows of a key may come at regular intervals.
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), salts)
    df = df.withColumn(mine, salt).drop("_salts")
    if other is None:
        return df.withColumn(theirs, zero)
    df = df.join(other, key, "left")
    return df.withColumn(theirs, F.explode(F.sequence(zero, F.coalesce("_salts", F.lit(1).cast("bigint")) - 1))).drop(
        "_salts"
    )


def skew_join(
    many: DataFrame,
    one: DataFrame,
    key: str,
    how: str = "inner",
    piece_rows: int | None = None,
) -> DataFrame:
    """Equi-join in which a hot key is spread over as many tasks as its rows fill.

    Rows of the other side are repeated per salt, for hot keys only. ``how``
    may be inner, left, left_semi or left_anti, with ``many`` on the left. An
    inner join splits the hot keys of both sides, so a key that is hot on
    either or on both is never in one task; of the right side of a semi or
    anti join only the distinct keys travel. Both sides should be table reads
    plus row-wise steps, so that the running id behind the salt is the same
    when a lost task is computed again. ``piece_rows`` is taken from the width
    of the rows.
    """

    def hot(df: DataFrame, label: str) -> DataFrame | None:
        rows = piece_rows or max(MIN_HOT_ROWS, PIECE_BYTES // row_bytes(df))
        # Fewer rows than pieces in the table; broadcast only if that is small as well.
        table, small = small_side(hot_keys(df, key, rows), label)
        if table.isEmpty():
            return None
        return F.broadcast(table) if small else table

    if how in ("left_semi", "left_anti"):
        one = one.select(key).distinct()
    left = hot(many, "hot-left")
    right = hot(one, "hot-right") if how == "inner" else None
    if left is None and right is None and how in ("inner", "left_semi"):
        return many.join(one, key, how)
    if left is None:
        left = many.sparkSession.createDataFrame([], many.select(key).schema.add("_salts", "long"))
    names = ("_salt", "_other")
    salted = _salted(many, key, left, right, names)
    return salted.join(_salted(one, key, right, left, names[::-1]), [key, *names], how).drop(*names)


def sized_join(many: DataFrame, one: DataFrame, key: str, how: str, label: str) -> DataFrame:
    """Broadcast ``one`` if a count shows it is small, else the skew-safe shuffle join.

    For the latter ``many`` is written first, as it may itself come from a
    shuffle, whose row order would change when a lost task is computed again.
    """
    table, small = small_side(one, label)
    if small:
        return many.join(F.broadcast(table), key, how)
    return skew_join(written(many, "many"), table, key, how)


def global_row_index(
    df: DataFrame, order: Sequence[Column], partitions: int | None = None, name: str = "row_index"
) -> DataFrame:
    """Number all rows 0, 1, 2, ... in ``order`` without a single-task window.

    The rows are range-partitioned, sorted and written. A row's number is then
    its position inside its file plus the row counts of the files before it.
    A running id breaks ties, so copies with equal keys still spread over
    tasks. ``df`` should be a table read plus row-wise steps (see
    :func:`skew_join`).
    """
    spark = df.sparkSession
    if partitions is None:
        # An estimate of the plan may be far off; the written rows are measured.
        source = scratch_path(spark, "unsorted")
        df.write.parquet(source)
        df = spark.read.schema(df.schema).parquet(source)
        smallest = int(spark.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(smallest, -(-stored_bytes(spark, source) // PIECE_BYTES))
    path = scratch_path(spark, "row-index")
    tagged = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order)]).withColumn(
        "_tie", F.monotonically_increasing_id()
    )
    keys = [F.col(f"_o{i}") for i in range(len(order))] + [F.col("_tie")]
    (
        tagged.repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys)
        .drop("_tie", *[f"_o{i}" for i in range(len(order))])
        .write.parquet(path)
    )
    table = spark.read.schema(df.schema).parquet(path)
    # A file's place: the number of its task, and of the file within it.
    place = F.regexp_extract("_metadata.file_name", r"^part-(\d+)-", 1).cast("bigint") * F.lit(1 << 20) + F.coalesce(
        F.regexp_extract("_metadata.file_name", r"-c(\d+)\.", 1).try_cast("bigint"), F.lit(0)
    )
    located = table.select("*", place.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # Offsets in two levels: within groups of files, and of the groups.
    counts = located.groupBy("_file").agg(F.count("*").alias("_n")).withColumn(
        "_half", F.floor(F.col("_file") / F.lit(OFFSET_GROUP << 20))
    )
    before = Window.orderBy("_half").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_half").agg(F.sum("_n").alias("_total")).select(
        "_half", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_half").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(groups, "_half").select(
        "_file", (F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_offset")
    )
    offsets, small = small_side(offsets, "offsets")
    return (
        located.join(F.broadcast(offsets) if small else offsets, "_file")
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .select(*[F.col(f"`{c}`") for c in df.columns], name)
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor.

    The archive is a file of the driver's, which Spark sends to the executors.
    Arrow batches are kept to a few megabytes unless the session says
    otherwise: two workers and the JVM hold several of them per core.
    """
    if not spark.sparkContext.getConf().contains(ARROW_BYTES):
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)
    if getattr(ship, "done", None) == spark.sparkContext.applicationId:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="package-"), os.path.basename(package))
    spark.sparkContext.addPyFile(
        shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
    )
    ship.done = spark.sparkContext.applicationId
