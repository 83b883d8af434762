"""Language identification by Bayesian fusion of text, declared language, address and host."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchbook.cluster import global_row_index, sized_join, written
from swatchbook.llm import workers

# Hashed letter trigrams.
BUCKETS = 1 << 14
# Neighbouring trigrams are not independent: a text counts as so many of them at most.
EFFECTIVE = 200
# Bytes of the trigram probabilities that the driver and a worker hold at a time; further languages follow in blocks.
MODEL_BYTES = 64 << 20
# Rows that a host's own counts are smoothed with from its domain, and a domain's from all.
HOST_WEIGHT, DOMAIN_WEIGHT, SMOOTHING = 20.0, 50.0, 1.0

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def trigrams(text: str) -> np.ndarray:
    """The hashed letter trigrams of a text in lower case; anything but letters separates words."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.int64)
    clean = np.where(_LETTERS[data], data, 32).astype(np.uint32)
    padded = np.concatenate([[32], clean, [32]]).astype(np.uint32)
    code = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    code = code[padded[1:-1] != 32]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int64)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each declared language, summed up over a batch."""
    workers.enter("language")
    for batch in batches:
        for declared in batch.column(0).unique().to_pylist():
            total = np.zeros(BUCKETS, dtype=np.int64)
            for text in batch.column(1).filter(pc.equal(batch.column(0), declared)).to_pylist():
                total += np.bincount(trigrams(text), minlength=BUCKETS)
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([declared] * len(found), type=pa.string()),
                    pa.array(found, type=pa.int32()),
                    pa.array(total[found], type=pa.int64()),
                ],
                names=["_language", "_bucket", "_n"],
            )


class Model(NamedTuple):
    """Trigram counts ``(_language, _bucket, _n)``, and the languages as ``(_language, _at)``, from 0 in their order."""

    counts: DataFrame
    places: DataFrame
    size: int

    def block(self, low: int, high: int) -> np.ndarray:
        """The logarithms of the trigram probabilities of the languages from ``low`` to below ``high``."""
        wanted = self.places.filter((F.col("_at") >= low) & (F.col("_at") < high))
        rows = self.counts.join(F.broadcast(wanted), "_language").select((F.col("_at") - low).alias("_at"), "_bucket", "_n").toArrow()
        table = np.zeros((high - low, BUCKETS))
        table[rows["_at"].to_numpy(), rows["_bucket"].to_numpy()] = rows["_n"].to_numpy()
        return np.log(table + 0.5) - np.log((table + 0.5).sum(axis=1, keepdims=True))


def learn(rows: DataFrame) -> Model:
    """Trigram counts of every language that a row with letters declares; ``rows`` has declared and text."""
    used = rows.filter("declared IS NOT NULL AND text IS NOT NULL").select("declared", "text")
    counts = used.mapInArrow(_counting, "_language string, _bucket int, _n bigint")
    counts = written(counts.groupBy("_language", "_bucket").agg(F.sum("_n").alias("_n")), "trigrams")
    places = written(global_row_index(counts.select("_language").distinct(), [F.col("_language")], name="_at"), "languages")
    return Model(counts, places, places.count())


def _reading(logs: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tempered log-likelihoods of each text under every language, its trigrams, and its mean under the best."""
    by_trigram = np.ascontiguousarray(logs.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("language")
        for batch in batches:
            scores, sizes, means = [], [], []
            for text in batch.column(1).to_pylist():
                found = trigrams(text or "")
                total = np.bincount(found, minlength=BUCKETS) @ by_trigram if len(found) > 256 else by_trigram[found].sum(axis=0)
                scores.append(total * (min(len(found), EFFECTIVE) / max(len(found), 1)))
                sizes.append(len(found))
                means.append(float(total.max() / len(found)) if len(found) else 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in (0, 2, 3, 4, 5)),
                    pa.array(scores, type=pa.list_(pa.float64())),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(means, type=pa.float64()),
                ],
                names=["_id", "_declared", "_suffix", "_host", "_domain", "_text", "_size", "_mean"],
            )

    return run


def _counted(read: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """For each combination of keys its rows ``_n``, and by the block's languages that their texts alone point to."""
    counts = read.filter("_first IS NOT NULL").groupBy(*keys, "_first").agg(F.count("*").alias("_rows"))
    inside = F.when((F.col("_first") >= low) & (F.col("_first") < high), F.struct(F.col("_first") - low, "_rows"))
    return counts.groupBy(*keys).agg(F.sum("_rows").alias("_n"), F.map_from_entries(F.collect_list(inside)).alias("_by"))


def _overall(read: DataFrame, low: int, high: int) -> list[int]:
    """Rows whose texts alone point to each language of the block."""
    found = read.filter((F.col("_first") >= low) & (F.col("_first") < high)).groupBy("_first").count().collect()
    counts = {r["_first"]: r["count"] for r in found}
    return [counts.get(k, 0) for k in range(low, high)]


def _at(by: str, k: Column) -> Column:
    return F.coalesce(F.try_element_at(by, k.cast("bigint")), F.lit(0))


def _evidence(read: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """For each value of a column the log-probabilities of it under each language of the block, smoothed.

    Counted by grouped aggregation over the languages that the texts alone point to.
    """
    known = read.filter(f"{column} IS NOT NULL AND _first IS NOT NULL")
    counts = _counted(known, [column], low, high)
    values = known.select(column).distinct().count()
    base = F.array(*[F.lit(t + SMOOTHING * (values + 1)) for t in _overall(known, low, high)])
    logs = F.transform(base, lambda total, k: F.log((_at("_by", k) + SMOOTHING) / total))
    return counts.select(F.col(column).alias(f"{column}_key"), logs.alias(f"{column}_logs"))


def _priors(read: DataFrame, low: int, high: int, n: int) -> DataFrame:
    """Log priors of each host for the block's languages: its rows, smoothed by its domain's, and those by all rows'."""
    hosts = _counted(read, ["_host", "_domain"], low, high)
    domains = _counted(read, ["_domain"], low, high).select(
        F.col("_domain").alias("_d"), F.col("_n").alias("_dn"), F.col("_by").alias("_dby")
    )
    joined = hosts.join(domains, F.col("_domain").eqNullSafe(F.col("_d")))
    rows = read.filter("_first IS NOT NULL").count()
    overall = F.array(*[F.lit((t + SMOOTHING) / (rows + SMOOTHING * n)) for t in _overall(read, low, high)])

    def prior(share: Column, k: Column) -> Column:
        domain = (_at("_dby", k) + DOMAIN_WEIGHT * share) / (F.col("_dn") + DOMAIN_WEIGHT)
        return F.log((_at("_by", k) + HOST_WEIGHT * domain) / (F.col("_n") + HOST_WEIGHT))

    return joined.select(
        F.col("_host").alias("_host_key"), F.col("_domain").alias("_domain_key"), F.transform(overall, prior).alias("_host_logs")
    )


def _fused(scored: DataFrame, read: DataFrame, low: int, high: int, n: int) -> DataFrame:
    """``scored`` with its best language ``_at`` of the block, that one's logit, and the sum of all by it."""
    joined = scored
    for column in ("_declared", "_suffix"):
        table = _evidence(read, column, low, high)
        joined = joined.join(table, F.col(column) == F.col(f"{column}_key"), "left")
    joined = joined.join(
        _priors(read, low, high, n),
        F.col("_host").eqNullSafe(F.col("_host_key")) & F.col("_domain").eqNullSafe(F.col("_domain_key")),
        "left",
    )
    nothing = F.array_repeat(F.lit(0.0), high - low)
    logits = F.col("_text")
    for column in ("_declared_logs", "_suffix_logs", "_host_logs"):
        logits = F.zip_with(logits, F.coalesce(column, nothing), lambda a, b: a + b)
    return (
        joined.withColumn("_logits", logits)
        .withColumn("_top", F.array_max("_logits"))
        .withColumn("_at", F.array_position("_logits", F.col("_top")) - 1 + low)
        .withColumn("_total", F.aggregate("_logits", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("_top"))))
    )


def _in_blocks(parts: DataFrame, model: Model, blocks: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """What :func:`_fused` gives, and the readings, when the languages fill more than one block.

    The texts are read twice per block and only the best of a block is kept,
    so no row, worker or driver holds the numbers of more than one block.
    """
    base = written(parts.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    rows = base.withColumn("_id", F.col("_row")).drop("_row")
    heads, fused = [], []
    for low, high in blocks:
        top = F.array_max("_text")
        head = _scored(rows, model, low, high).select(
            "_id", "_size", F.struct(top.alias("score"), (1 - low - F.array_position("_text", top)).alias("at"), "_mean").alias("_head")
        )
        heads.append(written(head, "heads"))
    best = reduce(DataFrame.union, heads).groupBy("_id").agg(F.max("_size").alias("_size"), F.max("_head").alias("_head"))
    read = rows.select("_id", F.col("declared").alias("_declared"), "_suffix", "_host", "_domain").join(best, "_id")
    first = F.when(F.col("_size") > 0, -F.col("_head.at"))
    read = written(read.withColumn("_first", first).withColumn("_mean", F.col("_head._mean")).drop("_head"), "readings")
    for low, high in blocks:
        part = _fused(_scored(rows, model, low, high), read, low, high, model.size)
        fused.append(written(part.select("_id", F.struct("_top", (-F.col("_at")).alias("at"), "_total").alias("_part")), "fused"))
    whole = reduce(DataFrame.union, fused).groupBy("_id").agg(F.collect_list("_part").alias("_parts"), F.max("_part").alias("_max"))
    total = F.aggregate(
        "_parts", F.lit(0.0), lambda t, x: t + x["_total"] * F.exp(x["_top"] - F.col("_max._top"))
    )
    ids = base.select(F.col("_id").alias("_own"), F.col("_row").alias("_id"))
    out = whole.select("_id", (-F.col("_max.at")).alias("_at"), total.alias("_total")).join(read, "_id").join(ids, "_id")
    return out.withColumn("_id", F.col("_own")), read


def _scored(rows: DataFrame, model: Model, low: int, high: int) -> DataFrame:
    kind = rows.schema["_id"].dataType.simpleString()
    shape = (
        f"_id {kind}, _declared string, _suffix string, _host string, _domain string, "
        "_text array<double>, _size bigint, _mean double"
    )
    columns = rows.select("_id", "text", "declared", "_suffix", "_host", "_domain")
    return columns.mapInArrow(_reading(model.block(low, high)), shape)


def identify(
    rows: DataFrame,
    id_col: str,
    text: Column,
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    domain: Column | None = None,
    min_posterior: float = 0.5,
    max_deviation: float = 8.0,
) -> DataFrame:
    """``(id_col, language, posterior, n_trigrams, rejected)``, one row per row of ``rows``.

    The posterior of a language is the product of the host's prior, the
    probabilities of the declared language and of the address suffix under
    it, and the likelihood of the text's letter trigrams, which counts as that of
    at most ``EFFECTIVE`` trigrams. Trigram probabilities are learnt from all
    rows that declare a language, for every language that a row with letters
    declares; those are read in blocks of ``MODEL_BYTES``. How far a declaration, a suffix or a host
    can be trusted is counted from what the texts alone point to.

    A row is rejected without letters in its text, with a posterior below
    ``min_posterior``, or if its text is more than ``max_deviation`` standard
    deviations less likely per trigram than its language's texts of its
    length. A null or empty text gives a null language, a null or unknown
    declaration, suffix or host gives no evidence. Null ids and repeated rows
    are rows of their own; with no language declared anywhere all rows are
    rejected; an empty table gives an empty one; other columns are not read.
    Ties go to the language that sorts first.
    """
    none = F.lit(None).cast("string")
    parts = rows.select(
        F.col(id_col).alias("_id"),
        text.alias("text"),
        (declared if declared is not None else none).alias("declared"),
        (suffix if suffix is not None else none).alias("_suffix"),
        (host if host is not None else none).alias("_host"),
        (domain if domain is not None else none).alias("_domain"),
    )
    model = learn(parts)
    n = model.size
    if not n:
        return parts.select(
            F.col("_id").alias(id_col),
            none.alias("language"),
            F.lit(0.0).alias("posterior"),
            F.lit(0).cast("bigint").alias("n_trigrams"),
            F.lit(True).alias("rejected"),
        )
    each = max(1, MODEL_BYTES // (BUCKETS * 8))
    blocks = [(low, min(n, low + each)) for low in range(0, n, each)]
    if len(blocks) == 1:
        best = F.array_position("_text", F.array_max("_text")) - 1
        read = written(_scored(parts, model, 0, n).withColumn("_first", F.when(F.col("_size") > 0, best)), "readings")
        fused = _fused(read, read, 0, n, n)
    else:
        fused, read = _in_blocks(parts, model, blocks)
    fused = fused.withColumn("_posterior", 1 / F.col("_total"))
    # How likely texts are per trigram in each language: the spread shrinks with the length.
    usual = (
        read.filter("_size > 0")
        .groupBy(F.col("_first").alias("_at"))
        .agg(F.avg("_mean").alias("_usual"), F.stddev_pop(F.col("_mean") * F.sqrt(F.least("_size", F.lit(EFFECTIVE)))).alias("_spread"))
    )
    told = model.places.join(usual, "_at", "left")
    rated = sized_join(fused.select("_id", "_at", "_size", "_mean", "_posterior"), told, "_at", "left", "usual")
    odd = (F.col("_usual") - F.col("_mean")) * F.sqrt(F.least("_size", F.lit(EFFECTIVE))) > max_deviation * F.col("_spread")
    empty = F.col("_size") == 0
    return rated.select(
        F.col("_id").alias(id_col),
        F.when(~empty, F.col("_language")).alias("language"),
        F.when(empty, 0.0).otherwise(F.col("_posterior")).alias("posterior"),
        F.col("_size").alias("n_trigrams"),
        (empty | (F.col("_posterior") < min_posterior) | F.coalesce(odd & (F.col("_spread") > 0), F.lit(False))).alias("rejected"),
    )


# The public parts of web pages and addresses that the evidence comes from.
MARKUP = r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})"
HOST = r"^[a-z]+://([^/:?#]+)"
SUFFIX = r"^[a-z]+://[^/]+/([a-z]{2})(?:/|$)"


def identify_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """:func:`identify` for web pages: text outside tags, the markup's language, the address and its host."""
    html, url = F.col(html_col), F.lower(F.col(url_col))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    blank = lambda c: F.when(c != "", c)
    host = blank(F.regexp_extract(url, HOST, 1))
    top = blank(F.regexp_extract(host, r"\.([a-z]{2})$", 1))
    return identify(
        pages,
        id_col,
        text,
        declared=blank(F.lower(F.regexp_extract(html, MARKUP, 1))),
        suffix=F.coalesce(top, blank(F.regexp_extract(url, SUFFIX, 1))),
        host=host,
        domain=F.substring_index(host, ".", -2),
    )


def identify_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """:func:`identify` for documents: the declared language, the source as host, its letters as domain."""
    source = F.col(source_col)
    return identify(
        docs, id_col, F.col(text_col), declared=F.col(lang_col), host=source, domain=F.regexp_replace(source, "[0-9]+$", "")
    )
