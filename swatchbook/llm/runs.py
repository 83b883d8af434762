"""Periodic runs of words by string synchronising sets.

At scale t (a power of two) a position is in the set when the smallest hash of
the t-word windows starting at it and at the t positions behind it belongs to
the first or to the last of them. Whether a position is chosen depends on its
2t words alone, so what repeats is chosen alike. Windows that are themselves
periodic (period at most t / 4) take no part in the minimum: all their runs
have been found at smaller scales by then. In any run of smallest period q,
t <= q < 2t, that holds four periods, one of the first t positions is chosen,
and the next place with the same 2t words is chosen too, q words later. So
neighbours of equal context at a distance of t .. 2t - 1 propose every such
period, and few others. Periods below ``SMALLEST_SCALE`` are found by comparing
each word with the one q places before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swatchbook.cluster import spread
from swatchbook.llm import workers

SMALLEST_SCALE = 4
# What the proof above needs, in periods.
PERIODS = 4
# Words whose hashes are held at once.
PORTION_WORDS = 1 << 19
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

Reorder = Callable[[object, int], "np.ndarray | None"]


def _scatter(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _levels(codes: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of all windows of 1, 2, 4, ... words, up to ``most`` words."""
    levels, width = [_scatter(codes.astype(np.uint64))], 1
    while 2 * width <= most:
        below = levels[-1]
        levels.append(_scatter(below[:-width] * np.uint64(0x9E3779B97F4A7C15) + (below[width:] ^ (below[width:] >> np.uint64(29)))))
        width *= 2
    return levels


def _extend(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(start, length)`` of the longest stretches around ``at`` in which words ``period`` apart are equal."""
    words = len(levels[0])
    right, left = np.zeros_like(at), np.zeros_like(at)
    # Windows of one width may match again and again only at the widest level.
    for level in [levels[-1], *levels[::-1]]:
        width = words - len(level) + 1
        here = at + right
        fits = here + period + width <= words
        same = fits & (level[np.where(fits, here, 0)] == level[np.where(fits, here + period, 0)])
        right += width * same
        here = at - left - width
        fits = here >= 0
        same = fits & (level[np.where(fits, here, 0)] == level[np.where(fits, here + period, 0)])
        left += width * same
    return at - left, left + right + period


def _directly(codes: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """``(start, length)`` of all runs of a small smallest period with ``PERIODS`` periods."""
    equal = np.zeros(len(codes) + 2, dtype=np.int8)
    if len(codes) > period:
        equal[1 : len(codes) - period + 1] = codes[:-period] == codes[period:]
    edges = np.diff(equal)
    start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    enough = stop - start >= (PERIODS - 1) * period
    start, stop = start[enough], stop[enough]
    if period > 1:
        # 2 and 3 are prime: only a run of one word over and over has a smaller period.
        one = codes[start] == codes[start + 1]
        for n in range(1, period):
            one &= codes[start + n] == codes[start]
        start, stop = start[~one], stop[~one]
    return start, stop - start + period


def _chosen(ids: np.ndarray, scale: int) -> np.ndarray:
    """The positions of the synchronising set, from the hashes of the windows of ``scale`` words."""
    least, width = ids, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], ids[scale:])
    return np.flatnonzero(((ids[:-scale] == least) | (ids[scale:] == least)) & (least != NEVER))


def _confirmed(codes: np.ndarray, start: int, length: int, period: int) -> tuple[int, int]:
    """The stretch itself; if two hashes collided, the one around its first words that is really periodic."""
    stop = start + length
    whole = np.array_equal(codes[start : stop - period], codes[start + period : stop])
    if whole and (start == 0 or codes[start - 1] != codes[start - 1 + period]) and (stop == len(codes) or codes[stop] != codes[stop - period]):
        return start, length
    equal = codes[:-period] == codes[period:]
    if not equal[start]:
        return start, 0
    breaks = np.flatnonzero(~equal)
    after = int(np.searchsorted(breaks, start))
    first = int(breaks[after - 1]) + 1 if after else 0
    last = int(breaks[after]) if after < len(breaks) else len(equal)
    return first, last - first + period


def periodic_runs(codes: np.ndarray, longest: int) -> np.ndarray:
    """``(start, length, period)`` rows of all runs of at least ``PERIODS`` periods.

    ``codes`` are the words of any number of texts as numbers, each text
    followed by a number that occurs once; no text has more than ``longest``
    words. A run is a stretch with the smallest period given that no
    neighbouring word extends. Rows are sorted by start, then period.
    """
    found: list[np.ndarray] = []
    for period in range(1, min(SMALLEST_SCALE, longest // PERIODS + 1)):
        start, length = _directly(codes, period)
        found.append(np.column_stack([start, length, np.full(len(start), period)]))
    scale = SMALLEST_SCALE
    levels = _levels(codes, max(longest, 2 * scale)) if PERIODS * scale <= longest else []
    while PERIODS * scale <= longest:
        k = scale.bit_length() - 1
        ids = levels[k].copy()
        known = np.concatenate(found)
        periodic = known[(PERIODS * known[:, 2] <= scale) & (known[:, 1] >= scale)]
        if len(periodic):
            # Starts of the windows that lie inside a run of a small period.
            step = np.zeros(len(ids) + 1, dtype=np.int64)
            np.add.at(step, periodic[:, 0], 1)
            np.add.at(step, periodic[:, 0] + periodic[:, 1] - scale + 1, -1)
            ids[np.cumsum(step[:-1]) > 0] = NEVER
        at = _chosen(ids, scale)
        context = levels[k + 1]
        at = at[at < len(context)]
        order = np.argsort(context[at], kind="stable")
        at, same = at[order], context[at[order]]
        apart = np.diff(at)
        pair = np.flatnonzero((same[1:] == same[:-1]) & (apart >= scale) & (apart < 2 * scale))
        if len(pair):
            period = apart[pair]
            start, length = _extend(levels, at[pair], period)
            enough = length >= PERIODS * period
            rows = np.unique(np.column_stack([start, length, period])[enough], axis=0)
            checked = [(*_confirmed(codes, *map(int, row)), int(row[2])) for row in rows]
            checked = [row for row in checked if row[1] >= PERIODS * row[2]]
            if checked:
                found.append(np.unique(np.array(checked, dtype=np.int64), axis=0))
        scale *= 2
    rows = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def text_runs(texts: list[np.ndarray], distinct: int, min_length: int = 6, exponent: int = PERIODS) -> list[np.ndarray]:
    """The runs of each text, given as its words' numbers below ``distinct``.

    Texts of similar length are searched together, so that a long one does not
    put the short ones through its scales.
    """
    result = [np.empty((0, 3), dtype=np.int64)] * len(texts)
    classes: dict[int, list[int]] = {}
    for n, text in enumerate(texts):
        if len(text) >= max(min_length, exponent):
            classes.setdefault(len(text).bit_length(), []).append(n)
    for members in classes.values():
        portions: list[list[int]] = [[]]
        held = 0
        for n in members:
            if held + len(texts[n]) > PORTION_WORDS and portions[-1]:
                portions.append([])
                held = 0
            portions[-1].append(n)
            held += len(texts[n]) + 1
        for portion in portions:
            sizes = np.array([len(texts[n]) + 1 for n in portion])
            ends = np.cumsum(sizes)
            codes = np.empty(ends[-1], dtype=np.int64)
            for n, end in zip(portion, ends, strict=True):
                codes[end - len(texts[n]) - 1 : end - 1] = texts[n]
            codes[ends - 1] = distinct + np.arange(len(portion))
            rows = periodic_runs(codes, int(sizes.max()) - 1)
            rows = rows[rows[:, 1] >= np.maximum(min_length, exponent * rows[:, 2])]
            owner = np.searchsorted(ends, rows[:, 0], side="right")
            for k in np.unique(owner):
                own = rows[owner == k].copy()
                own[:, 0] -= ends[k] - sizes[k]
                result[portion[k]] = own
    return result


def without_repeats(size: int, runs: np.ndarray) -> np.ndarray | None:
    """The places of the words to keep: all but those that a run holds after its first period; null if all stay."""
    if not len(runs):
        return None
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(step[:-1]) == 0)


def _searching(min_length: int, exponent: int, reorder: Reorder | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("runs")
        for batch in batches:
            ids = batch.column(0).to_pylist() if reorder else None
            # The white space that bytes.split() knows is just that of the words' definition.
            words = [text.split() for text in batch.column(1).cast(pa.binary()).to_pylist()]
            numbers = count()
            number: dict[bytes, int] = {}
            for text in words:
                for word in set(text).difference(number):
                    number[word] = next(numbers)
            texts = [np.fromiter(map(number.__getitem__, text), dtype=np.int64, count=len(text)) for text in words]
            for n in range(len(texts)) if reorder else ():
                places = reorder(ids[n], len(texts[n]))
                if places is not None:
                    texts[n] = texts[n][places]
                    words[n] = [words[n][i] for i in places.tolist()]
            found = text_runs(texts, len(number), min_length, exponent)
            kept = [without_repeats(len(text), runs) for text, runs in zip(texts, found, strict=True)]
            collapsed = [b" ".join(w if k is None else [w[i] for i in k.tolist()]) for w, k in zip(words, kept, strict=True)]
            offsets = np.cumsum([0, *map(len, found)])
            rows = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
            lists = pa.StructArray.from_arrays([pa.array(rows[:, n]) for n in range(3)], fields=list(shape))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(text) for text in texts], type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), lists),
                    pa.array(collapsed, type=pa.binary()).cast(pa.string()),
                ],
                names=["_id", "n_words", "runs", "collapsed"],
            )

    return run


def word_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 6,
    exponent: int = PERIODS,
    reorder: Reorder | None = None,
) -> DataFrame:
    """``(id_col, n_words, runs, collapsed)``, one row per row of ``docs``.

    Words are what stands between ASCII white space. ``runs`` lists every
    stretch of words with smallest period ``period`` that is at least
    ``min_length`` words and ``exponent`` periods long (four at least) and that
    no neighbouring word extends, by start, then period; starts count words
    from 0. ``collapsed`` are the words, joined by one blank, without those
    that a run holds after its first period. ``reorder`` may name other words
    of a text to read: given id and number of words, the places to read in
    order, or nothing.

    A null or blank text has no words, no runs and an empty ``collapsed``; ids
    may be null or repeat, repeated rows stay, an empty table gives an empty
    one, other columns are not read. Texts are taken whole. The job is one map
    over the rows: no shuffle, and a task holds one Arrow batch or one text
    with about 200 bytes a word.
    """
    if exponent < PERIODS:
        raise ValueError(f"runs of fewer than {PERIODS} periods are not all found")
    texts = spread(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")))
    kind = texts.schema["_id"].dataType.simpleString()
    shape = f"_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return texts.mapInArrow(_searching(min_length, exponent, reorder), shape).withColumnRenamed("_id", id_col)


def longest_run(runs: str = "runs"):
    """The run of greatest length; ties go to the smallest start, then period."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    best = F.array_min(ranked)
    return F.struct(best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period"))
