"""Token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swatchbook.llm import pretokens, workers
from swatchbook.sources.merges import byte_symbols

# Texts whose pieces are held at once.
BATCH_CHARS = 4 << 20
# Strings of more bytes are not rewritten for every rank.
LONG = 512


def _every_second(overlaps: np.ndarray) -> np.ndarray:
    """Which occurrences count: in a run of overlapping ones the first, the third and so on.

    ``overlaps`` says of each occurrence but the last whether the next one begins inside it.
    """
    place = np.arange(len(overlaps) + 1)
    first = np.r_[True, ~overlaps]
    return (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0


class RankMerger:
    """Byte-pair merging of many byte strings at once.

    All symbols lie in one flat array. Each round looks up the rank of every
    neighbouring pair, finds the lowest one of each string, and replaces all
    its occurrences in that string, from the left where they overlap. Strings
    without a pair to merge leave the arrays. Long strings are linked instead,
    and the places of every rank kept, so that a rank costs only what it merges.

    A merge must rank above those that make its two parts, as in every trained
    list; another order is refused, for there all occurrences of a pair cannot
    be merged at once.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        symbols = dict(byte_symbols())
        self.base = np.array([vocab[symbols[b]] for b in range(256)], dtype=np.int64)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        code = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank = code[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        maker = np.full(self.width, -1, dtype=np.int64)
        np.maximum.at(maker, self.made, np.arange(len(pairs)))
        if (np.maximum(maker[code // self.width], maker[code % self.width]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path}: a merge ranks below one that makes its parts")
        # A bitmap of the hashed pairs spares most of the searches for pairs that are no merge.
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self._slot(code)] = True

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        none = len(self.made)
        code = left * self.width + right
        out = np.full(len(code), none, dtype=np.int64)
        some = np.flatnonzero(self.bits[self._slot(code)])
        at = np.minimum(np.searchsorted(self.code, code[some]), none - 1)
        found = self.code[at] == code[some]
        out[some[found]] = self.rank[at[found]]
        return out

    def counts(self, strings: list[bytes]) -> np.ndarray:
        """Symbols that are left of each string; an empty one has none."""
        result = np.zeros(len(strings), dtype=np.int64)
        lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        result[lengths == 1] = 1
        long = np.flatnonzero(lengths > LONG)
        if len(long):
            result[long] = self._linked([strings[i] for i in long], lengths[long])
        ids = np.flatnonzero((lengths > 1) & (lengths <= LONG))
        if not len(ids):
            return result
        symbols = self.base[np.frombuffer(b"".join(strings[i] for i in ids), dtype=np.uint8)]
        lengths = lengths[ids]
        none = len(self.made)
        while len(ids):
            starts = np.cumsum(lengths) - lengths
            ranks = np.full(len(symbols), none, dtype=np.int64)
            ranks[:-1] = self._ranks(symbols[:-1], symbols[1:])
            ranks[starts[1:] - 1] = none  # no pair across two strings
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == none
            if done.any():
                result[ids[done]] = lengths[done]
                kept = np.repeat(~done, lengths)
                symbols, ranks = symbols[kept], ranks[kept]
                ids, lengths, lowest = ids[~done], lengths[~done], lowest[~done]
                if not len(ids):
                    break
            merge = ranks == np.repeat(lowest, lengths)
            at = np.flatnonzero(merge)
            at = at[_every_second(np.diff(at) == 1)]
            symbols[at] = self.made[ranks[at]]
            kept = np.ones(len(symbols), dtype=bool)
            kept[at + 1] = False
            symbols = symbols[kept]
            lengths = np.add.reduceat(kept.astype(np.int64), np.cumsum(lengths) - lengths)
        return result

    def _linked(self, strings: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """The counts of long strings, rank by rank in all of them at once."""
        symbols = self.base[np.frombuffer(b"".join(strings), dtype=np.uint8)]
        ends = np.cumsum(lengths)
        after = np.arange(1, len(symbols) + 1)
        before = after - 2
        after[ends - 1] = before[ends - lengths] = -1
        none = len(self.made)
        ranks = np.full(len(symbols), none, dtype=np.int64)
        places: dict[int, list[np.ndarray]] = defaultdict(list)
        ready: list[int] = []

        def rank(at: np.ndarray) -> None:
            """Look up the pairs that begin at ``at`` and keep their places by rank."""
            ranks[at] = none
            paired = at[after[at] >= 0]
            found = self._ranks(symbols[paired], symbols[after[paired]])
            ranks[paired] = found
            mergeable = found < none
            paired, found = paired[mergeable], found[mergeable]
            order = np.argsort(found, kind="stable")
            paired, found = paired[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for group, value in zip(np.split(paired, cuts), found[np.r_[0, cuts]].tolist() if len(found) else (), strict=False):
                if value not in places:
                    heapq.heappush(ready, value)
                places[value].append(group)

        rank(np.arange(len(symbols)))
        gone = np.zeros(len(symbols), dtype=bool)
        while ready:
            value = heapq.heappop(ready)
            parts = places.pop(value)
            at = parts[0] if len(parts) == 1 else np.sort(np.concatenate(parts))
            at = at[ranks[at] == value]  # the others have changed since
            if not len(at):
                continue
            at = at[_every_second(after[at[:-1]] == at[1:])]
            right = after[at]
            symbols[at] = self.made[value]
            gone[right] = True
            ranks[right] = none
            behind = after[right]
            after[at] = behind
            inside = behind >= 0
            before[behind[inside]] = at[inside]
            previous = before[at]
            rank(np.unique(np.concatenate([at, previous[previous >= 0]])))
        return np.add.reduceat((~gone).astype(np.int64), ends - lengths)


class TokenCounter:
    """Counts the tokens of texts; remembers the pieces that it has met."""

    def __init__(self, path: str):
        import regex

        self.merger = RankMerger(path)
        self.split = regex.compile(pretokens.PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, self.merger.special))) if self.merger.special else None
        self.memory: dict[str, int] = {}

    def _encode(self, pieces: list[str]) -> list[int]:
        owner, words = [], []
        for n, piece in enumerate(pieces):
            found = self.split.findall(piece)
            words += found
            owner += [n] * len(found)
        distinct = {w: n for n, w in enumerate(dict.fromkeys(words))}
        counted = self.merger.counts([w.encode("utf-8", "surrogatepass") for w in distinct])
        each = counted[np.fromiter((distinct[w] for w in words), dtype=np.int64, count=len(words))]
        return np.bincount(np.array(owner, dtype=np.int64), weights=each, minlength=len(pieces)).astype(int).tolist()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the tokenizers library counts them by default."""
        keys, extra = [], []
        for text in texts:
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                keys.append([k for part in parts for k in pretokens.cut(part)])
                extra.append(len(parts) - 1)
            else:
                keys.append(pretokens.cut(text))
                extra.append(0)
        pretokens.remember(self.memory, keys, self._encode)
        get = self.memory.__getitem__
        return [sum(map(get, k)) + e for k, e in zip(keys, extra, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One counter per worker and vocabulary."""
    return TokenCounter(path)


workers.forgets(counter.cache_clear)


def portions(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[list[str]]:
    """The texts in portions of about ``limit`` characters; a longer text is alone."""
    portion, size = [], 0
    for text in texts:
        if portion and size + len(text) > limit:
            yield portion
            portion, size = [], 0
        portion.append(text)
        size += len(text)
    if portion:
        yield portion


def _counting(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("token counts")
        tokens = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [n for portion in portions(texts) for n in tokens.count(portion)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, type=pa.int64())], names=["_id", "_bytes", "_tokens"]
            )

    return run


def count_tokens(
    docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    ``path`` is a byte-level BPE file of the tokenizers library that every
    executor can open. Counts equal that library's without added begin or end
    tokens; strings of special tokens inside a text count as that token. A
    null text counts as empty: 0 bytes, 0 tokens. A word of megabytes takes
    seconds, as the work of a merge is that of its occurrences. Repeated rows stay, null ids
    stay, an empty table gives an empty one, other columns are not read.
    The job is one map over the rows: no shuffle, and memory is bounded by an
    Arrow batch and the remembered pieces.
    """
    texts = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    ).withColumn("_bytes", F.octet_length("_text").cast("bigint"))
    kind = texts.schema["_id"].dataType.simpleString()
    counted = texts.mapInArrow(_counting(path), f"_id {kind}, _bytes bigint, _tokens bigint")
    return counted.select(
        F.col("_id").alias(id_col),
        F.col("_bytes").alias("n_bytes"),
        F.col("_tokens").alias("n_tokens"),
        (F.col("_tokens") > limit).alias("over_limit"),
    )
