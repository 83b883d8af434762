"""How filters of documents interact: survivors of every subset of them, in every order.

Each document becomes a word with one bit per subset of the filters, set if
the document passes all filters of that subset. The bits of all words of a part
and label are counted by place with carry-save adders, and every figure of the
report is a difference of such counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchbook.cluster import skew_join, spread, written
from swatchbook.llm import workers

# Subsets of five filters fill a word of 32 bits.
MOST_FILTERS = 5

# The filters of the registered query; E is the one about other documents.
LETTERS = "ABCDE"
# First bytes of characters in UTF-8.
_LEADING = bytes(b for b in range(256) if not 128 <= b < 192)
_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"


def text_failures(text: bytes) -> int:
    """Failed filters of a text by itself, as bits 0 to 3.

    A: under 50 words; B: distinct words under 65 % of the words; C: A-Z make
    up over 5 % of the characters; D: holds one of ``#$%&*|``. An empty text
    fails A only.
    """
    # The white space that bytes.split() knows is just that of the words' definition.
    words = text.split()
    n = len(words)
    # Bytes that continue a character are not counted.
    characters = len(text) - len(text.translate(None, _LEADING)) if not text.isascii() else len(text)
    upper = len(text) - len(text.translate(None, _UPPER))
    marked = len(text.translate(None, _MARKS)) < len(text)
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * upper > 5 * characters) << 2 | marked << 3


def _judging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    workers.enter("filter audit")
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([text_failures(t) for t in texts], type=pa.int32()),
                pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], type=pa.binary()),
            ],
            names=["_id", "_part", "_fails", "_text"],
        )


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(_id, _part, _fails)``: the filters that each row fails, as bits in the order of ``LETTERS``.

    E: the text is that of a row with a smaller id. Texts are told apart by a hash of
    128 bits. Only these, ids and parts are shuffled, never texts. The smallest id of
    each text is found with partial sums, and a text that many rows share
    is split by salts when it is looked up. A null text is empty, a null part
    is the empty string. A null id is smaller than none and larger than none.
    """
    texts = spread(
        docs.select(
            F.col(id_col).alias("_id"),
            F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"),
            F.coalesce(F.col(text_col), F.lit("")).alias("_body"),
        )
    )
    kind = texts.schema["_id"].dataType.simpleString()
    rows = written(texts.mapInArrow(_judging, f"_id {kind}, _part string, _fails int, _text binary"), "judged")
    # A text of one id only has no smaller one.
    first = rows.groupBy("_text").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    shared = written(first.filter("_first < _last").select("_text", "_first"), "shared-texts")
    found = skew_join(rows, shared, "_text", "left")
    copy = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False)).cast("int")
    return found.select("_id", "_part", F.col("_fails").bitwiseOR(copy * (1 << 4)).alias("_fails"))


def survival_words(filters: int) -> np.ndarray:
    """For each set of failed filters the word whose bit s says that no filter of subset s is failed."""
    subsets = np.arange(1 << filters)
    return np.array([np.bitwise_or.reduce(np.where(subsets & fails == 0, 1 << subsets, 0)) for fails in subsets], dtype=np.uint32)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit ``words`` have each of the 32 bits set.

    Three words of one weight become one of that weight, their sum without
    carry, and one of twice the weight, the carry. At most two words of each
    weight are left, whose bits are counted singly.
    """
    total = np.zeros(32, dtype=np.int64)
    weight, level = 1, words.astype(np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            either = a ^ b
            carries.append((a & b) | (either & c))
            level = np.concatenate([either ^ c, level[3 * third :]])
        total += weight * ((level[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).sum(axis=0, dtype=np.int64)
        weight, level = 2 * weight, np.concatenate(carries) if carries else level[:0]
    return total


def _adding(filters: int, labels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    word_of, width = survival_words(filters), 1 << filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("filter audit")
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            number = parts.indices.to_numpy(zero_copy_only=False)
            words = word_of[batch.column(1).to_numpy(zero_copy_only=False)]
            order = np.argsort(number, kind="stable")
            words, number = words[order], number[order]
            marks = [batch.column(2 + k).to_numpy(zero_copy_only=False)[order] for k in range(labels)]
            starts = np.flatnonzero(np.diff(number, prepend=-1))
            stops = np.append(starts[1:], len(number))
            counts = np.empty((len(starts), 1 + labels, width), dtype=np.int64)
            for n, (start, stop) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
                own = words[start:stop]
                counts[n, 0] = positional_popcount(own)[:width]
                for k, mark in enumerate(marks):
                    counts[n, 1 + k] = positional_popcount(own[mark[start:stop]])[:width]
            flat = pa.array(counts.ravel())
            offsets = pa.array(np.arange(0, len(flat) + 1, (1 + labels) * width), type=pa.int32())
            yield pa.RecordBatch.from_arrays(
                [parts.dictionary.take(pa.array(number[starts])), pa.ListArray.from_arrays(offsets, flat)], names=["_part", "_counts"]
            )

    return run


def subset_survivors(rows: DataFrame, filters: int, labels: Sequence[str] = ()) -> DataFrame:
    """``(part, survivors)``: for all rows and for those of each label the survivors of each subset.

    ``rows`` has ``_part``, ``_fails`` (bits, below 2 ** ``filters``) and a
    boolean column per label. ``survivors`` has an array per subset: entry 0
    counts all rows, entry 1 + k those of label k; subset s is at place s. A task hands on one
    row per part and Arrow batch; the rest is a grouped sum.
    """
    if not 1 <= filters <= MOST_FILTERS:
        raise ValueError(f"subsets of {filters} filters do not fit a word of 32 bits")
    width, sets = 1 << filters, 1 + len(labels)
    marks = [F.coalesce(F.col(c), F.lit(False)).alias(f"_l{n}") for n, c in enumerate(labels)]
    counted = rows.select("_part", "_fails", *marks).mapInArrow(_adding(filters, len(labels)), "_part string, _counts array<bigint>")
    sums = counted.groupBy("_part").agg(*[F.sum(F.col("_counts")[n]).alias(f"_s{n}") for n in range(sets * width)])
    by_subset = [F.array(*[F.col(f"_s{k * width + s}") for k in range(sets)]) for s in range(width)]
    return sums.select(F.col("_part").alias("part"), F.array(*by_subset).alias("survivors"))


def report(survivors: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of all filters and step: what that step's filter does there.

    ``survivors`` as made by :func:`subset_survivors` with the labels good and
    toxic. ``filter_order`` names the filters by letter, ``step`` counts from 1.
    """
    n = len(letters)
    whole = (1 << n) - 1

    def alive(subset: Column, label: int = 0) -> Column:
        return F.get(F.get("survivors", subset), F.lit(label))

    def shapley(k: int) -> Column:
        """Removals by filter k summed over all orders: as often as the filters before it can be arranged."""
        others = [s for s in range(1 << n) if not s >> k & 1]
        ways = [factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in others]
        terms = [w * (alive(F.lit(s)) - alive(F.lit(s | 1 << k))) for s, w in zip(others, ways, strict=True)]
        return sum(terms[1:], terms[0])

    # One row per part gets the list of all orders and steps.
    steps, places = [], {c: k for k, c in enumerate(letters)}
    for order in map("".join, permutations(letters)):
        before = 0
        for step, c in enumerate(order, 1):
            steps.append(f"named_struct('filter_order', '{order}', 'step', {step}, 'k', {places[c]}, 'before', {before})")
            before |= 1 << places[c]
    listed = F.expr(f"array({', '.join(steps)})")
    each = survivors.withColumn("_shapley", F.array(*[shapley(k) for k in range(n)]))
    each = each.select("part", "survivors", "_shapley", F.explode(listed).alias("_at")).select("*", "_at.*")
    own = F.expr("shiftleft(1, k)")
    before, after = F.col("before"), F.col("before").bitwiseOR(own)
    removed = alive(before) - alive(after)
    return each.select(
        "part",
        "filter_order",
        "step",
        alive(after).alias("kept"),
        removed.alias("removed"),
        (alive(F.lit(0)) - alive(own) - removed).alias("redundant"),
        (alive(F.lit(whole) - own) - alive(F.lit(whole))).alias("unique_fails"),
        (alive(before, 1) - alive(after, 1)).alias("good_lost"),
        (alive(before, 2) - alive(after, 2)).alias("toxic_lost"),
        F.get("_shapley", F.col("k")).alias("shapley"),
    )


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    The five filters of :func:`judged`, applied in all 120 orders, counted per
    value of ``part_col`` (null: empty string). ``labels`` has ``id_col``,
    ``quality`` and ``toxic``; a document is good (toxic) if any of its rows
    there has quality (toxic) 1, and neither without one. A repeated id's rows
    are documents of their own, all with that id's labels; null ids have no
    label. An empty table gives an empty one, other columns are not read.
    """
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic")
    )
    rows = written(judged(docs, id_col, text_col, part_col), "failures")
    # A repeated id is split by salts, as a text is.
    marked = skew_join(rows, written(marks, "marks"), "_id", "left")
    return report(subset_survivors(marked, len(LETTERS), ["_good", "_toxic"]))
