"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchbook.cluster import ship, written
from swatchbook.llm import language, minhash, mixing, packing, secret_scan
from swatchbook.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with ``_key``: the id and a hash of the row, equal only for repeated rows."""
    rest = [c for c in COLUMNS if c != "doc_id"]
    # The hash passes over nulls, so it is told where they are.
    row = F.xxhash64(*rest, *[F.col(c).isNull() for c in rest])
    return docs.select(*COLUMNS).withColumn("_key", F.struct(F.col("doc_id").alias("id"), row.alias("hash")))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejected documents go, the others carry the language found.

    Rows that repeat an id are judged each by its own text; a null id, source
    or language is no reason to go, a text without letters is.
    """
    ship(spark)
    keyed = _keyed(docs)
    found = language.identify_documents(keyed, id_col="_key").filter("NOT rejected").select("_key", "language")
    kept = keyed.join(found.dropDuplicates(["_key"]), keyed["_key"].eqNullSafe(found["_key"]))
    return kept.select(*[F.col("language").alias("lang") if c == "lang" else c for c in COLUMNS])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of near copies the document with the smallest id stays.

    An id that several rows share stays if one of its rows does; rows with a null id stay.
    """
    ship(spark)
    found = minhash.near_documents(docs).filter("doc_id IS NOT NULL")
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("_kept")).filter("NOT _kept").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every document stays, secrets in its text are replaced by a mark."""
    rest = [c for c in COLUMNS if c not in ("text", "n_chars")]
    carried = docs.select(F.struct(*rest).alias("_rest"), "text", "source")
    scanned = secret_scan.scan_secrets(carried, id_col="_rest")
    return scanned.select("_rest.*", "text", F.length("text").cast("bigint").alias("n_chars")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: every document as often as the mix takes it.

    Identical rows become one that is repeated as often as the mix takes them together.
    """
    keyed = _keyed(docs)
    taken = mixing.mix(keyed, id_col="_key").groupBy("_key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    taken = written(taken.filter("_copies > 0"), "taken")
    found = keyed.join(taken.withColumnRenamed("_key", "_own"), F.col("_key").eqNullSafe(F.col("_own")))
    # As a rule few rows are repeated; the others are not shuffled for it.
    once = found.filter("_rows = 1").union(found.filter("_rows > 1").dropDuplicates(["_key"]))
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the mix into sequences of 2048 tokens, one row per piece."""
    ship(spark)
    return packing.pack(docs, vocabulary(), length=2048, end_id=0)


STAGES = [
    ("language_id", identified),
    ("minhash_near_dedup", distinct),
    ("secret_scan", redacted),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

# Likelihoods, a trained forest and an iterative mix are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
