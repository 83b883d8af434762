"""Byte-pair merge lists and the vocabulary built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
START_TOKEN = "<|startoftext|>"
END_TOKEN = "<|endoftext|>"
WORD_END = "</w>"
VOCABULARY_SIZE = 49_408
MAX_MERGES = VOCABULARY_SIZE - 2 * 256 - 2

SHOWN_BYTES = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]


def byte_symbols() -> list[tuple[int, str]]:
    """(byte, printable symbol) of all 256 bytes, in vocabulary order.

    Printable bytes stand for themselves; the others get the characters from
    code 256 on, so that no symbol is a space or a control character.
    """
    hidden = sorted(set(range(256)) - set(SHOWN_BYTES))
    return [(b, chr(b)) for b in SHOWN_BYTES] + [(b, chr(256 + i)) for i, b in enumerate(hidden)]


def read_merge_list(spark: SparkSession, path: str, limit: int = MAX_MERGES) -> DataFrame:
    """(rank, left, right) of a merge-list file, plain or gz.

    The first line is a header. The line number is the rank, so the file is
    read as one value; lines beyond ``limit`` are not part of the list, which
    keeps it below 49,408 rows.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")))
    pair = F.split(F.trim(F.regexp_replace("col", r"\s+", " ")), " ")
    return (
        lines.filter((F.col("pos") >= 1) & (F.col("pos") <= limit) & (F.trim("col") != ""))
        .select((F.col("pos") - 1).alias("rank"), pair[0].alias("left"), pair[1].alias("right"))
    )


def vocabulary(merges: DataFrame) -> DataFrame:
    """(id, token): bytes, bytes at a word's end, merges, start and end token."""
    spark = merges.sparkSession
    symbols = spark.createDataFrame(
        [(i, s) for i, (_, s) in enumerate(byte_symbols())], "id int, token string"
    )
    merged = merges.select((F.col("rank") + 512).cast("int").alias("id"), F.concat("left", "right").alias("token"))
    specials = merges.agg(F.coalesce(F.max("rank") + 1, F.lit(0)).alias("n")).select(
        F.inline(
            F.array(
                F.struct((F.col("n") + 512).cast("int").alias("id"), F.lit(START_TOKEN).alias("token")),
                F.struct((F.col("n") + 513).cast("int").alias("id"), F.lit(END_TOKEN).alias("token")),
            )
        )
    )
    ends = symbols.select((F.col("id") + 256).alias("id"), F.concat("token", F.lit(WORD_END)).alias("token"))
    return symbols.unionByName(ends).unionByName(merged).unionByName(specials)


def collect_merges(merges: DataFrame) -> list[tuple[int, str, str]]:
    """The list on the driver, by rank; its source limits it to 48,894 rows."""
    return sorted(tuple(r) for r in merges.select("rank", "left", "right").collect())


def token_ids(merge_rows: list[tuple[int, str, str]]) -> list[tuple[int, str]]:
    """The rows of :func:`vocabulary` for a collected merge list."""
    symbols = [s for _, s in byte_symbols()]
    tokens = list(enumerate([*symbols, *[s + WORD_END for s in symbols]]))
    tokens += [(rank + 512, left + right) for rank, left, right in merge_rows]
    end = merge_rows[-1][0] + 513 if merge_rows else 512
    return [*tokens, (end, START_TOKEN), (end + 1, END_TOKEN)]
