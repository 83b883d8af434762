"""Best-two-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swatchbook.cluster import written
from swatchbook.llm import workers
from swatchbook.llm.token_counts import portions
from swatchbook.sources.merges import byte_symbols

# Pieces packed together. Each group leaves one sequence open at most.
GROUP_PIECES = 4096


# The pre-token pattern of the byte-level vocabularies, as a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Runs of white space that the fast encoder's pattern may not get through.
LONG_WHITE = re.compile(r"\s{10000}")


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, as the tokenizers library gives them.

    Where tokens are numbered in the order of their merges, tiktoken gives the
    same ids several times as fast. Texts with an added token's string or with
    a very long run of white space are left to the library, as are all texts
    of a vocabulary that is numbered otherwise.
    """

    def __init__(self, path: str):
        # Spark runs one worker per core; threads of the library would only compete.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte_of = {c: b for b, c in byte_symbols()}
        vocab = {t: n for t, n in spec["model"]["vocab"].items() if t not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        self.fast = None
        # A merge later in the list must have the higher number, and every token but the bytes its one merge.
        if made == sorted(set(made)) and vocab.keys() - byte_of.keys() == {a + b for a, b in merges}:
            ranks = {bytes(byte_of[c] for c in t): n for t, n in vocab.items()}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special) or LONG_WHITE.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


workers.forgets(encoder.cache_clear)


def _cutting(path: str, length: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("packing")
        ids_of = encoder(path)
        for batch in batches:
            at = 0
            texts = batch.column(1).to_pylist()
            for portion in portions(texts):
                rows, pieces, starts, lengths, sums = [], [], [], [], []
                for text in portion:
                    ids = ids_of.encode(text) + end
                    total = len(ids) // 4
                    start, stop, piece = 0, total % length or length, 0
                    while start < total:
                        rows.append(at)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(stop - start)
                        sums.append(zlib.crc32(memoryview(ids)[4 * start : 4 * stop]))
                        start, stop, piece = stop, stop + length, piece + 1
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, type=pa.int64())),
                        pa.array(pieces, type=pa.int32()),
                        pa.array(starts, type=pa.int64()),
                        pa.array(lengths, type=pa.int64()),
                        pa.array(sums, type=pa.int64()),
                    ],
                    names=["_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each item, all between 1 and ``capacity`` long.

    A bin takes the longest item that is left, then again and again the
    longest that fits. If a gap stays, its smallest item makes way for the two
    items that fill the expanded gap best, when they fill it better.
    """
    count = np.bincount(lengths, minlength=capacity + 1)
    items = np.argsort(lengths, kind="stable")
    last = np.cumsum(count)  # items[last[x] - 1] is the next item of length x
    # floor[x]: the longest length left that is at most x, 0 if none.
    sizes = np.arange(capacity + 1)
    floor = np.maximum.accumulate(np.where(count > 0, sizes, 0))

    def take(x: int) -> None:
        count[x] -= 1
        if not count[x]:
            up = int(np.searchsorted(floor, x, side="right"))
            floor[x:up] = floor[x - 1]

    def put_back(x: int) -> None:
        count[x] += 1
        part = floor[x:]
        np.maximum(part, x, out=part)

    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    number = 0
    while floor[capacity]:
        content, gap = [], capacity
        while x := int(floor[gap]):
            content.append(x)
            take(x)
            gap -= x
        if gap and len(content) > 1:
            smallest = content[-1]
            room = gap + smallest
            a = sizes[1:room][count[1:room] > 0]
            b = floor[room - a]
            # Two of one length need two items of it.
            alone = (a == b) & (count[a] < 2)
            b = np.where(alone, floor[np.maximum(a - 1, 0)], b)
            filled = np.where(b > 0, a + b, 0)
            if len(filled) and filled.max() > smallest:
                best = int(filled.argmax())
                content[-1:] = [int(a[best]), int(b[best])]
                take(content[-1])
                take(content[-2])
                put_back(smallest)
        offset = 0
        for x in content:
            last[x] -= 1
            bins[items[last[x]]], offsets[items[last[x]]] = number, offset
            offset += x
        number += 1
    return bins, offsets


def _packing(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_id", "piece", "ids_crc32"], kind="stable")
        bins, offsets = two_fit(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(group["_group"].to_numpy() << 32) + bins, offset=offsets).drop(
            columns="_group"
        )

    return run


def pack(
    docs: DataFrame,
    path: str,
    length: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    A document is its token ids followed by ``end_id``. Only documents longer
    than ``length`` are cut; all their pieces but the first are full. Pieces
    are packed in groups of about ``GROUP_PIECES`` that are dealt by a running
    row number, so no key makes a group large, and only lengths and checksums
    are shuffled. A null text is empty and becomes a piece with ``end_id``
    alone. Repeated rows are packed as often as they occur, null ids are kept,
    an empty table gives an empty one, other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = texts.schema["_id"].dataType.simpleString()
    shape = f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = written(texts.mapInArrow(_cutting(path, length, end_id), shape), "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    # The table is written, so the running id is the same if a task runs again.
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("bigint"))
    packed = dealt.groupBy("_group").applyInPandas(_packing(length), f"{shape}, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("_id", id_col)
