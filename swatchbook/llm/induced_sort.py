"""Suffix sorting with common prefixes by induction through disk-backed bucket queues."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

# Entries of all queues of one pass that are held in memory; what is beyond goes to a file.
HELD = 1 << 22
# Common prefixes are counted up to this length unless a longer one is asked for.
CAP = 128


class BucketQueue:
    """A monotone priority queue: entries come out by symbol, and by arrival within a symbol.

    Entries are (position, common prefix with the entry before). Induction
    pushes to a symbol in the order of the suffixes, so arrival is their rank.
    Beyond ``held`` entries the queue moves what it holds to an unnamed file.
    """

    def __init__(self, symbols: int, held: int = HELD, kind: type = np.uint8):
        self.kind = np.dtype(kind)
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.held, self.limit, self.file = 0, held, None

    def push(self, symbol: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.parts[symbol].append((positions, common))
        self.held += len(positions)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for parts in self.parts:
            for n, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(part[0].astype(np.int64).tobytes())
                    self.file.write(part[1].astype(self.kind).tobytes())
                    parts[n] = (at, len(part[0]))
        self.held = 0

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The parts of a symbol in order; parts that are pushed to it meanwhile follow."""
        while self.parts[symbol]:
            parts, self.parts[symbol] = self.parts[symbol], []
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for first, second in parts:
                if isinstance(first, np.ndarray):
                    self.held -= len(first)
                    waiting.append((first, second))
                else:
                    self.file.seek(first)
                    positions = np.frombuffer(self.file.read(8 * second), np.int64)
                    waiting.append((positions, np.frombuffer(self.file.read(self.kind.itemsize * second), self.kind)))
                size += len(waiting[-1][0])
                if size >= self.limit:
                    yield _joined(waiting)
                    waiting, size = [], 0
            if waiting:
                yield _joined(waiting)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Parts that follow each other as one."""
    if len(parts) == 1:
        return parts[0]
    return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima of ``values[first .. last]`` (both included) for many ranges, by a sparse table."""
    out = np.empty(len(first), dtype=values.dtype)
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1  # floor of the binary logarithm
    table, k = values, 0
    while True:
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[first[here]], table[last[here] + 1 - (1 << k)])
        k += 1
        if k > (level.max() if len(level) else 0):
            return out
        half = 1 << (k - 1)
        table = np.minimum(table[:-half], table[half:])


def _prefix(text: np.ndarray, a: int, b: int, cap: int) -> int:
    """Length of the common prefix of two suffixes, up to ``cap``."""
    n = min(cap, len(text) - max(a, b))
    different = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(different[0]) if len(different) else n


class _Inducer:
    """One direction of induction: reads suffixes in order and pushes the ones before them."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queue: BucketQueue, symbols: int, cap: int):
        self.text, self.wanted, self.queue, self.cap = text, wanted, queue, cap
        # Smallest common prefix among what was read since the last push to a symbol; 0: nothing pushed yet.
        self.since = np.zeros(symbols, dtype=queue.kind)

    def read(self, positions: np.ndarray, common: np.ndarray) -> None:
        """``common[k]``: common prefix of the k-th suffix with the one read before it."""
        if not len(positions):
            return
        k = np.flatnonzero((positions > 0) & self.wanted[positions - 1])
        before = positions[k] - 1
        symbol = self.text[before]
        order = np.argsort(symbol, kind="stable")
        k, before, symbol = k[order], before[order], symbol[order]
        fresh = np.ones(len(k), dtype=bool)
        fresh[1:] = symbol[1:] != symbol[:-1]
        start = np.zeros(len(k), dtype=np.int64)
        start[1:] = k[:-1] + 1
        start[fresh] = 0
        low = _range_minima(common, start, k) if len(k) else np.empty(0, dtype=self.queue.kind)
        heads = np.flatnonzero(fresh)
        low[heads] = np.minimum(low[heads], self.since[symbol[heads]])
        pushed = np.minimum(low.astype(np.int64) + 1, self.cap).astype(self.queue.kind)
        # The first entry of a symbol has nothing before it.
        pushed[heads[self.since[symbol[heads]] == 0]] = np.minimum(pushed[heads[self.since[symbol[heads]] == 0]], 1)
        self.since = np.minimum(self.since, common.min())
        tails = np.append(heads[1:], len(k)) - 1 if len(k) else heads
        rest = np.minimum.accumulate(common[::-1])[::-1]
        for head, tail in zip(heads.tolist(), tails.tolist(), strict=True):
            at = int(k[tail]) + 1
            self.since[symbol[head]] = rest[at] if at < len(common) else self.cap
            self.queue.push(int(symbol[head]), before[head : tail + 1], pushed[head : tail + 1])


def _sorted_stars(text: np.ndarray, rising: np.ndarray, stars: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes at ``stars``, as far as their first ``depth`` substrings tell.

    Substrings between two stars get names by sorting their symbols from the
    left; the string of names is sorted by names of twice as many substrings,
    until all differ or ``depth`` are covered; each is two symbols at least.
    """
    n = len(text)
    ends = np.append(stars[1:], n - 1)
    length = ends - stars + 1
    # Names: ranks refined by six symbols at a time, while the substring lasts; a
    # falling suffix is smaller than a rising one of the same symbol.
    typed = 2 * text.astype(np.int32) + rising + 1
    name = np.zeros(len(stars), dtype=np.int64)
    at, open_ones = 0, np.arange(len(stars))
    while len(open_ones):
        word = np.zeros(len(open_ones), dtype=np.uint64)
        for j in range(6):
            place = stars[open_ones] + at + j
            inside = at + j < length[open_ones]
            word = word * np.uint64(1024) + np.where(inside, typed[np.minimum(place, n - 1)], 0).astype(np.uint64)
        keys = np.zeros(len(stars), dtype=np.uint64)
        keys[open_ones] = word
        name = _ranks(name, keys)
        at += 6
        open_ones = open_ones[length[open_ones] > at]
    step = 1
    while step < depth and name.max(initial=0) + 1 < len(name):
        follower = np.zeros(len(name), dtype=np.uint64)
        follower[:-step] = name[step:].astype(np.uint64) + np.uint64(1)
        name = _ranks(name, follower)
        step *= 2
    return np.argsort(name, kind="stable")


def _dense(values: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct values."""
    order = np.argsort(values)
    ordered = values[order]
    step = np.zeros(len(values), dtype=np.int64)
    step[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.cumsum(step)
    return out


def _ranks(name: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Dense ranks by (name, key); there are fewer than 2^31 names."""
    if key.max(initial=0) >= 1 << 31:
        key = _dense(key)
    return _dense((name << 32) | key.astype(np.int64))


def _star_prefixes(text: np.ndarray, stars: np.ndarray, cap: int, kind: type) -> np.ndarray:
    """Common prefix of each suffix with the one before it, up to ``cap``; 0 for the first."""
    out = np.zeros(len(stars), dtype=kind)
    here = np.arange(1, len(stars))
    # Five symbols of ten bits as one number, which a double holds exactly.
    padded = np.append(text.astype(np.int64) + 1, np.zeros(cap + 10, dtype=np.int64))
    five = np.zeros(len(padded) - 5, dtype=np.int64)
    for j in range(5):
        five = (five << 10) | padded[j : j + len(five)]
    at = 0
    while len(here) and at < cap:
        differ = five[stars[here] + at] ^ five[stars[here - 1] + at]
        ended = differ != 0
        bits = np.frexp(differ[ended].astype(np.float64))[1] - 1
        out[here[ended]] = np.minimum(at + 4 - bits // 10, cap)
        here = here[~ended]
        at += 5
    out[here] = cap
    return out


def suffix_order(
    text: np.ndarray, depth: int, held: int = HELD, cap: int = CAP
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes in falling order, in parts, with their common prefix with the one before.

    ``text`` holds symbols from 1 up; its last symbol must be its smallest.
    Suffixes are ordered by their first ``2 * depth`` symbols at least, and common
    prefixes counted up to ``cap``. First the suffixes smaller than both
    neighbours are sorted; they induce the falling ones, reading all symbols
    upwards, and these induce the rising ones, reading downwards. Both passes
    push through a queue that keeps to ``held`` entries of memory.
    """
    n, symbols = len(text), int(text.max()) + 1
    kind = np.uint8 if cap < 256 else np.int32
    rising = np.zeros(n, dtype=bool)
    # A run of one symbol rises or falls with what follows it.
    change = np.flatnonzero(text[1:] != text[:-1])
    run_of = np.searchsorted(change, np.arange(n - 1))
    up = np.append(text[change + 1] > text[change], False)
    rising[:-1] = up[run_of] if len(change) else False
    rising[-1] = True
    if len(change):
        rising[change[-1] + 1 : -1] = False
    stars = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    order = stars[_sorted_stars(text, rising, stars, depth)]
    common = _star_prefixes(text, order, cap, kind)

    bounds = np.searchsorted(text[order], np.arange(symbols + 1))
    queue, fallen = BucketQueue(symbols, held, kind), BucketQueue(symbols, held, kind)
    inducer = _Inducer(text, ~rising, queue, symbols, cap)
    last = -1
    for c in range(symbols):
        for positions, prefix in queue.pop(c):
            if last >= 0 and text[last] != c:
                prefix = prefix.copy()
                prefix[0] = 0
            fallen.push(c, positions, prefix)
            inducer.read(positions, prefix)
            last = int(positions[-1])
        here = slice(bounds[c], bounds[c + 1])
        if bounds[c] < bounds[c + 1]:
            prefix = common[here].copy()
            prefix[0] = 0 if last < 0 else _prefix(text, last, int(order[bounds[c]]), cap)
            inducer.read(order[here], prefix)
            last = int(order[bounds[c + 1] - 1])
    queue.close()

    queue = BucketQueue(symbols, held, kind)
    inducer = _Inducer(text, rising, queue, symbols, cap)
    last = -1
    for c in range(symbols - 1, -1, -1):
        for positions, prefix in queue.pop(c):
            prefix = prefix.copy()
            if last < 0 or text[last] != c:
                prefix[0] = 0
            yield positions, prefix
            inducer.read(positions, prefix)
            last = int(positions[-1])
        for positions, prefix in reversed(list(fallen.pop(c))):
            # Read downwards, a suffix's prefix is the one that the next higher had with it.
            turned = np.empty(len(prefix), dtype=kind)
            turned[1:] = prefix[:0:-1]
            turned[0] = 0 if last < 0 else _prefix(text, last, int(positions[-1]), cap)
            yield positions[::-1], turned
            inducer.read(positions[::-1], turned)
            last = int(positions[0])
    # Nothing stands behind the last symbol, so nothing has induced it.
    yield np.array([n - 1]), np.zeros(1, dtype=kind)
    queue.close()
    fallen.close()
