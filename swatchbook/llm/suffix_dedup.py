"""Removal of repeated byte strings by external induced suffix sorting of shards."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swatchbook.cluster import small_side, written
from swatchbook.llm.induced_sort import CAP, suffix_order

# Bytes of the hashed grams that choose the shard of a string.
GRAM = 32
# Bytes looked at together; their places fit the low bits of a key.
PLACES = 1 << 16
# Text that is sorted together if it is of several keys.
SORTED_BYTES = 2 << 20


def _numbers(length: int) -> int:
    """Start and number of windows travel as start * this + number; a run has at most ``length`` windows."""
    return max(1 << 10, 1 << length.bit_length())


def _hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at every place, by doubling."""
    h, n = data.astype(np.uint64) + np.uint64(1), 1
    factor = 0x9E3779B97F4A7C15
    while n < GRAM:
        h = h[:-n] * np.uint64(factor) + h[n:]
        factor = (factor * 0xD1B54A32D192ED03 + 2 * n) % 2**64 | 1
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, from minima that run through blocks both ways."""
    n = len(h) - width + 1
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(h)] = h
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, key, start and number of the runs of windows of ``length`` bytes with one smallest gram.

    The key of a window is the hash of the smallest of its grams, the first
    one among equals, so equal windows have equal keys. Windows that share
    the very same gram are one run, of fewer windows than ``length``.
    """
    joined = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
    width = length - GRAM + 1
    found = []
    # Pieces overlap, so that every window is in exactly one.
    for at in range(0, max(0, len(joined) - length + 1), PLACES - length):
        data = joined[at : at + PLACES - 1]
        h = (_hashes(data) & np.uint64(2**64 - PLACES)) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
        low = _sliding_minima(h, width)
        low = low[: PLACES - length]
        place = at + np.arange(len(low))
        text = np.searchsorted(ends, place, side="right")
        inside = place + length <= ends[np.minimum(text, len(ends) - 1)]
        fresh = np.append(True, (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1]))
        first = np.flatnonzero(fresh)
        number = np.diff(np.append(first, len(low)))
        keep = inside[first]
        first, number = first[keep], number[keep]
        owner = text[first]
        begin = place[first] - (ends[owner] - np.fromiter((len(texts[k]) for k in owner), np.int64, len(owner)))
        found.append((owner, low[first] >> np.uint64(16), begin, number))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))


def _running(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per run: key, id, print, and start and number as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, key, start, number = runs(part.column(2).to_pylist(), length)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner)),
                        part.column(1).take(pa.array(owner)),
                        pa.array(key.astype(np.int64)),
                        pa.array(start * _numbers(length) + number),
                    ],
                    names=["_id", "_print", "_x", "_at"],
                )

    return run


_STRING = "_x bigint, _id bigint, _start bigint, _n bigint, _bytes binary"


def _cutting(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The strings of the runs; of equal ones in a batch the first one, the others without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(2)))
            ids, texts, keys, places, prints, wanted = (batch.column(n).to_pylist() for n in range(6))
            best: dict[bytes, tuple[int, int, int, int]] = {}
            out: list[tuple[int, int, int, int, bytes | None]] = []
            for doc, text, xs, ats, own, other_print in zip(ids, texts, keys, places, prints, wanted, strict=True):
                for x, at in zip(xs, ats, strict=True) if own == other_print else ():
                    start, n = divmod(at, _numbers(length))
                    string, row = text[start : start + n + length - 1], (x, doc, start, n)
                    other = best.get(string)
                    if other is None or (doc, start) < other[1:3]:
                        best[string], row = row, other
                    if row is not None and row[1:3] != best[string][1:3]:
                        out.append((*row, None))
            out += [(*row, string) for string, row in best.items()]
            for at in range(0, len(out), 20_000):
                columns = zip(*out[at : at + 20_000], strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=kind) for c, kind in zip(columns, kinds, strict=True)],
                    names=["_x", "_id", "_start", "_n", "_bytes"],
                )

    return run


def repeated(strings: list[bytes], numbers: np.ndarray, length: int) -> np.ndarray:
    """Which places of the joined strings start a window that also starts earlier.

    The k-th string has ``numbers[k]`` windows. Strings come in the order of
    their places in the corpus. The suffixes of all strings are sorted; a
    suffix whose common prefix with its neighbour reaches ``length`` starts
    with the same window, and of each such group the first place stays.
    """
    joined = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    text = joined.astype(np.int32) + 3
    sizes = np.array([len(s) + 1 for s in strings])
    offsets = np.cumsum(sizes) - sizes
    text[offsets + sizes - 1] = 2  # ends of strings; no window contains one
    text = np.append(text, 1)
    starts = np.zeros(len(text), dtype=bool)
    starts[np.repeat(offsets, numbers) + _counted(numbers)] = True
    gone = np.zeros(len(text), dtype=bool)
    waiting: list[np.ndarray] = []

    def close() -> None:
        places = np.concatenate(waiting)
        gone[places] = True
        gone[places.min()] = False
        waiting.clear()

    for positions, common in suffix_order(text, depth=length // 2 + 1, cap=max(CAP, length)):
        fresh = np.flatnonzero(common < length)
        cuts = np.concatenate([fresh, [len(positions)]])
        if not len(fresh) or fresh[0]:
            head = positions[: cuts[0]]
            head = head[starts[head]]
            if len(head):
                waiting.append(head)
        if len(fresh):
            if waiting:
                close()
            # Groups inside this part: more than one entry, all but the first place go.
            body, group = positions[fresh[0] :], np.cumsum(common[fresh[0] :] < length) - 1
            used = starts[body]
            body, group = body[used], group[used]
            tail = group == len(fresh) - 1
            if tail.any():
                waiting.append(body[tail])
            body, group = body[~tail], group[~tail]
            if len(body):
                first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                low = np.repeat(np.minimum.reduceat(body, first), np.diff(np.append(first, len(body))))
                gone[body[body != low]] = True
    if waiting:
        close()
    return gone[:-1]


def _counted(numbers: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the numbers."""
    return np.arange(numbers.sum()) - np.repeat(np.cumsum(numbers) - numbers, numbers)


def _sorting(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Removed spans ``(id, from, to)`` of a shard, whose rows come sorted by key."""

    def spans(rows: list[tuple[int, int, int, int, bytes | None]]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[int, int, int]] = {}
        keys: dict[bytes, int] = {}
        out: list[tuple[int, int, int]] = []
        for x, doc, start, n, string in rows:
            row = (doc, start, n)
            if string is not None:
                keys[string] = x
            if string is not None:
                other = best.get(string)
                if other is None or row < other:
                    best[string], row = row, other
                if row == best[string]:
                    continue
            if row is not None:
                out.append((row[0], row[1], row[1] + row[2] + length - 1))
        if best:
            # The windows of one run differ, so a key needs two strings for a repeat.
            several = Counter(keys.values())
            order = sorted((row, string) for string, row in best.items() if several[keys[string]] > 1)
            strings, numbers = [s for _, s in order], np.array([r[2] for r, _ in order])
            if order:
                gone = repeated(strings, numbers, length)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                first, stop = edge[::2], edge[1::2]
                sizes = np.array([len(s) + 1 for s in strings])
                offsets = np.cumsum(sizes) - sizes
                owner = np.searchsorted(offsets, first, side="right") - 1
                for k, a, b in zip(owner.tolist(), first.tolist(), stop.tolist(), strict=True):
                    doc, start, _ = order[k][0]
                    at = start - int(offsets[k])
                    out.append((doc, at + a, at + b - 1 + length))
        for at in range(0, len(out), 50_000):
            columns = zip(*out[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["_id", "_from", "_to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int, int, int, bytes | None]] = []
        size, last = 0, None
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in range(5))
            for x, doc, start, n, string in zip(*columns, strict=True):
                if size > SORTED_BYTES and x != last:
                    yield from spans(waiting)
                    waiting, size = [], 0
                waiting.append((x, doc, start, n, string))
                size, last = size + len(string or b""), x
        if waiting:
            yield from spans(waiting)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that spans cover together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _removing(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What is left of each text without its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, str]] = []
            for text, copy, spans in zip(*(batch.column(n).to_pylist() for n in (1, 2, 3)), strict=True):
                gone = [(0, len(text))] if copy and len(text) >= length else merged([(s["a"], s["b"]) for s in spans or []])
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                rows.append((len(text), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, type=kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return run


def repeated_spans(rows: DataFrame, texts: DataFrame, length: int = 100) -> tuple[DataFrame, DataFrame]:
    """The bytes to remove: ``(_id, _from, _to)`` spans, and ``(_id, _print, _copy)`` of each id's text.

    See :func:`remove_repeats`. ``rows`` has _id, _text and _print, ``texts``
    the same rows by id. ``_copy`` marks ids whose text is that of a smaller id.
    """
    pairs = written(rows.select("_id", "_print").distinct(), "prints")
    prints = pairs.groupBy("_id").agg(F.min("_print").alias("_print"))
    firsts = prints.groupBy("_print").agg(F.min("_id").alias("_first"))
    known = written(
        prints.join(firsts, "_print").select("_id", "_print", (F.col("_id") != F.col("_first")).alias("_copy")), "texts"
    )
    # Copies, and further texts of one id, take no part; as a rule these are few.
    out = pairs.join(known.filter("NOT _copy"), ["_id", "_print"], "left_anti")
    out, small = small_side(out.select("_id", "_print.*"), "left-out")
    out = out.select("_id", F.struct("a", "b", "c").alias("_print"))
    kind = rows.schema["_print"].dataType.simpleString()
    found = rows.select("_id", "_print", "_text").mapInArrow(
        _running(length), f"_id bigint, _print {kind}, _x bigint, _at bigint"
    )
    windows = found.join(F.broadcast(out) if small else out, ["_id", "_print"], "left_anti").select("_x", "_id", "_at")
    # Only strings whose key comes up twice can repeat; hot keys are counted before the shuffle.
    twice = windows.groupBy("_x").agg(F.count("*").alias("_n")).filter("_n > 1").select("_x")
    wanted = windows.join(twice, "_x").groupBy("_id").agg(
        F.collect_list("_x").alias("_x"), F.collect_list("_at").alias("_at")
    )
    wanted = wanted.join(known.withColumnRenamed("_print", "_p").drop("_copy"), "_id")
    # All texts, though the ones without keys give nothing: so the exchange is the very one of the last step.
    cut = (
        texts.join(wanted, "_id", "left")
        .select("_id", "_text", "_x", "_at", "_print", "_p")
        .mapInArrow(_cutting(length), _STRING)
    )
    spans = cut.repartition("_x").sortWithinPartitions("_x").mapInArrow(
        _sorting(length), "_id bigint, _from bigint, _to bigint"
    )
    return spans, known


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("bigint").alias("_id"),
        text.cast("binary").alias("_text"),
        F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"), F.octet_length(text).alias("c")).alias(
            "_print"
        ),
    )


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, kept_sha256)``, one row per row of ``docs``.

    Removed is each byte covered by a string of ``length`` bytes that also
    starts earlier, in a document of smaller id or earlier in its own;
    overlaps count, and all is judged on the input. A null or empty text has
    0 bytes and nothing removed. A row with a null id takes no part. Rows that
    repeat id and text are one document; of different texts of one id the one
    with the smallest hash takes part, the others stay whole. An empty table
    gives an empty one, other columns are not read. A ``length`` below the
    ``GRAM`` bytes of a gram, or above half of ``PLACES``, is refused.

    A window's shard is chosen by the smallest hash of its grams, so equal
    windows meet; neighbours with one key travel as one string. Keys that come
    up once are left out, equal strings and equal texts are compared once.
    Each shard sorts the suffixes of its strings (see :mod:`induced_sort`).
    """
    if not GRAM <= length <= PLACES // 2:
        raise ValueError(f"length must be from {GRAM} to {PLACES // 2}")
    every = _rows(docs, id_col, text_col)
    rows = every.filter("_id IS NOT NULL")
    texts = rows.repartition("_id")
    spans, known = repeated_spans(rows, texts, length)
    by_id = spans.groupBy("_id").agg(F.collect_list(F.struct(F.col("_from").alias("a"), F.col("_to").alias("b"))).alias("_spans"))
    told = known.join(by_id, "_id", "left").select("_id", F.col("_print").alias("_p"), "_copy", "_spans")
    mine = F.coalesce(F.col("_print") == F.col("_p"), F.lit(False))
    joined = texts.join(told, "_id", "left").select(
        "_id",
        "_text",
        (mine & F.coalesce("_copy", F.lit(False))).alias("_copy"),
        F.when(mine, F.col("_spans")).alias("_spans"),
    )
    # Rows without an id take no part, and no join.
    no_spans = F.lit(None).cast(joined.schema["_spans"].dataType)
    rest = every.filter("_id IS NULL").select("_id", "_text", F.lit(False).alias("_copy"), no_spans.alias("_spans"))
    out = joined.union(rest).mapInArrow(
        _removing(length), "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
    return out.withColumnRenamed("_id", id_col)
