"""Byte-pair encoding of a text table.

Cleaning, splitting, framing and decoding are column expressions. Only the
merging of words is Python: it runs on the distinct words of an Arrow batch,
all of them at once in numpy, and remembers words per worker, so encoding a
corpus is one map-only stage that shuffles nothing, however often a word occurs.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchbook.cluster import spread
from swatchbook.functions.text import (
    CONTEXT_LENGTH,
    clean_text,
    frame_ids,
    framed_size,
    loses_end,
    pretokenize,
)
from swatchbook.sources.merges import (
    END_TOKEN,
    START_TOKEN,
    VOCABULARY_SIZE,
    WORD_END,
    byte_symbols,
    collect_merges,
    token_ids,
    vocabulary,
)

REMEMBERED_WORDS = 200_000
# Words whose merges are looked for at once.
MERGED_WORDS = 1 << 14
SHORT_WORD = 64
NO_RANK = 1 << 30


def merge_symbols(symbols: list[str], rank_of: dict[tuple[str, str], int]) -> list[str]:
    """Join neighbouring symbols until no neighbouring pair is in the list.

    Each round takes the best-ranked pair and joins all its places from left to
    right. Short words keep a plain list of ranks; long ones a heap of places.
    """
    if len(symbols) > SHORT_WORD:
        return _merge_long(symbols, rank_of)
    parts = list(symbols)
    ranks = [rank_of.get(pair, NO_RANK) for pair in zip(parts, parts[1:], strict=False)]
    while ranks:
        best = min(ranks)
        if best == NO_RANK:
            break
        i = ranks.index(best)
        while True:
            parts[i] += parts[i + 1]
            del parts[i + 1], ranks[i]
            if i > 0:
                ranks[i - 1] = rank_of.get((parts[i - 1], parts[i]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of.get((parts[i], parts[i + 1]), NO_RANK)
            if best not in ranks[i + 1 :]:
                break
            i = ranks.index(best, i + 1)
    return parts


def _merge_long(symbols: list[str], rank_of: dict[tuple[str, str], int]) -> list[str]:
    """The same in O(n log n): places of pairs wait in a heap, neighbours are linked."""
    n = len(symbols)
    parts: list[str | None] = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    waiting = [
        (rank_of[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in rank_of
    ]
    heapq.heapify(waiting)
    while waiting:
        best = waiting[0][0]
        places = []
        while waiting and waiting[0][0] == best:
            places.append(heapq.heappop(waiting)[1])
        joined = []
        for i in places:
            j = after[i]
            if parts[i] is None or j >= n or rank_of.get((parts[i], parts[j])) != best:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            joined.append(i)
        for i in joined:
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (parts[left], parts[right]) in rank_of:
                    heapq.heappush(waiting, (rank_of[parts[left], parts[right]], left))
    return [p for p in parts if p is not None]


class WordEncoder:
    """Ids of one word. Holds a merge list by rank and its vocabulary, at most 49,408 entries each."""

    def __init__(self, merges: list[tuple[int, str, str]]):
        self.rank_of = {(left, right): rank for rank, left, right in merges}
        self.id_of = {token: i for i, token in token_ids(merges)}
        self.symbol_of = dict(byte_symbols())
        self.known: dict[str, list[int]] = {}
        self._number_symbols()

    def _number_symbols(self) -> None:
        """The merge list as arrays over numbered symbols: sorted pairs with their rank and what they make."""
        plain = [self.symbol_of[b] for b in range(256)]
        made = [s for left, right in self.rank_of for s in (left, right, left + right)]
        numbers = {s: i for i, s in enumerate(dict.fromkeys([*plain, *[s + WORD_END for s in plain], *made]))}
        self.n_symbols = len(numbers)
        # Parts that no text leads to have no id.
        self.id_of_number = np.array([self.id_of.get(s, -1) for s in numbers], dtype=np.int32)
        rows = sorted(
            (numbers[left] * self.n_symbols + numbers[right], rank, numbers[left + right])
            for (left, right), rank in self.rank_of.items()
        )
        self.pairs, self.ranks, self.makes = np.array(rows or [(-1, NO_RANK, 0)], dtype=np.int64).T.copy()

    @property
    def start_id(self) -> int:
        return self.id_of[START_TOKEN]

    @property
    def end_id(self) -> int:
        return self.id_of[END_TOKEN]

    def word_symbols(self, word: str) -> list[str]:
        if word in (START_TOKEN, END_TOKEN):
            return [word]
        symbols = [self.symbol_of[b] for b in word.encode("utf-8")]
        symbols[-1] += WORD_END
        return merge_symbols(symbols, self.rank_of)

    def word_ids(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            found = [self.id_of[s] for s in self.word_symbols(word)]
            if len(word) <= SHORT_WORD:
                if len(self.known) >= REMEMBERED_WORDS:
                    self.known = {}
                self.known[word] = found
        return found


    def ids_of_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words; those not yet known are merged together, some thousands at a time."""
        fresh = [w for w in words if 0 < len(w) <= SHORT_WORD and w not in self.known and w not in (START_TOKEN, END_TOKEN)]
        found: dict[str, list[int]] = {}
        for at in range(0, len(fresh), MERGED_WORDS):
            some = fresh[at : at + MERGED_WORDS]
            found.update(zip(some, self._merged(some), strict=True))
        ids = [found[w] if w in found else self.word_ids(w) for w in words]
        if len(self.known) + len(found) > REMEMBERED_WORDS:
            self.known = {}
        self.known.update(itertools.islice(found.items(), REMEMBERED_WORDS))
        return ids

    def _merged(self, words: list[str]) -> list[list[int]]:
        """:func:`merge_symbols` for many words, a round of all of them at once."""
        coded = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        symbols = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.int64)
        # The last symbol of a word carries its end.
        symbols[np.cumsum(lengths) - 1] += 256
        word = np.repeat(np.arange(len(words)), lengths)
        done = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            pair = symbols[:-1] * self.n_symbols + symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            listed = (self.pairs[at] == pair) & (word[1:] == word[:-1])
            rank = np.append(np.where(listed, self.ranks[at], NO_RANK), NO_RANK)
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            going = best < NO_RANK
            done.append((word[~going], symbols[~going]))
            places = np.flatnonzero((rank == best) & going)
            # Places side by side overlap (a a a): from left to right every second one is joined.
            order = np.arange(len(places))
            first = np.maximum.accumulate(np.where(np.diff(places, prepend=-2) == 1, 0, order))
            places = places[(order - first) % 2 == 0]
            symbols[places] = self.makes[at[places]]
            going[places + 1] = False
            symbols, word = symbols[going], word[going]
        word, symbols = (np.concatenate(parts) for parts in zip(*done, strict=True))
        ids = self.id_of_number[symbols[np.argsort(word, kind="stable")]].tolist()
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def word_encoder(merges: DataFrame) -> WordEncoder:
    return WordEncoder(collect_merges(merges))


def _ids_of_lists(encoder: WordEncoder, words: pa.ListArray) -> pa.ListArray:
    """Ids of each list of words, with one look-up per distinct word of the batch."""
    starts = words.offsets.to_numpy()
    coded = words.flatten().dictionary_encode()
    per_word = encoder.ids_of_words(coded.dictionary.to_pylist())
    sizes = np.fromiter((len(p) for p in per_word), dtype=np.int64, count=len(per_word))
    flat = np.fromiter(itertools.chain.from_iterable(per_word), dtype=np.int32, count=int(sizes.sum()))
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    which = coded.indices.to_numpy()
    lengths = sizes[which]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    # Position of every id in `flat`: the first place of its word plus its place in the word.
    inside = np.arange(ends[-1], dtype=np.int64) - np.repeat(ends[:-1], lengths)
    ids = flat[np.repeat(firsts[:-1][which], lengths) + inside]
    offsets = ends[starts - starts[0]]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def encode_words(df: DataFrame, encoder: WordEncoder, words: str, out: str = "ids") -> DataFrame:
    """Replace the array column ``words``, free of nulls, by the array column ``out`` of ids."""
    shared = df.sparkSession.sparkContext.broadcast(encoder)
    kept = [c for c in df.columns if c != words]
    schema = df.select(*kept, F.array().cast("array<int>").alias(out)).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column(batch.schema.get_field_index(words))
            ids = _ids_of_lists(shared.value, lists)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept] + [ids], names=[*kept, out]
            )

    return df.mapInArrow(encode, schema)


def words_of(text: Column, repair: Callable[[Column], Column] | None = None) -> Column:
    """Words of a raw text; a null text has no words."""
    return F.coalesce(pretokenize(clean_text(text, repair)), F.array().cast("array<string>"))


def chunk_counts(df: DataFrame, text: str, repair: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(chunk, n)``: how often what stands between two spaces occurs in the cleaned texts, counted per Arrow batch.

    A cleaned text has no white space but spaces, and no word spans one: the
    words of all chunks, each ``n`` times, are the words of all texts. A chunk
    has a row for every batch that it occurs in, so sums over it are due.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = pc.list_flatten(pc.split_pattern(batch.column(0), " "))
            found = chunks.value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["chunk", "n"])

    return df.select(clean_text(F.col(text), repair).alias("text")).mapInArrow(count, "chunk string, n bigint")


def encode_texts(
    df: DataFrame,
    merges: DataFrame,
    text: str,
    repair: Callable[[Column], Column] | None = None,
    encoder: WordEncoder | None = None,
) -> DataFrame:
    """Replace the column ``text`` by ``ids``: all ids of the whole text, unframed."""
    words = spread(df).withColumn(text, words_of(F.col(text), repair))
    return encode_words(words, encoder or word_encoder(merges), text)


def tokenize_table(
    df: DataFrame,
    merges: DataFrame,
    key: str,
    text: str,
    length: int = CONTEXT_LENGTH,
    repair: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``(key, description_ids, n_tokens, truncated)`` of a text table."""
    encoder = word_encoder(merges)
    coded = encode_texts(df.select(key, text), merges, text, repair, encoder)
    return coded.select(
        key,
        frame_ids(F.col("ids"), encoder.start_id, encoder.end_id, length).alias("description_ids"),
        framed_size(F.col("ids")).alias("n_tokens"),
        loses_end(F.col("ids"), length).alias("truncated"),
    )


def word_table(df: DataFrame, merges: DataFrame, text: str) -> DataFrame:
    """``(word, n_texts, ids)``: every distinct word of the corpus, encoded once.

    Words are made distinct per text and then counted with a map-side combine,
    so a word that occurs in every text costs one row per map task. Symbols
    meet their ids in a join with the vocabulary, which is broadcast as it has
    at most 49,408 rows. A word's group is its own list of symbols.
    """
    # explode_outer: a plain explode adds a filter that would split every text twice.
    words = (
        spread(df.select(text))
        .select(F.explode_outer(F.array_distinct(words_of(F.col(text)))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n_texts"))
        .filter(F.col("word").isNotNull())
    )
    shared = df.sparkSession.sparkContext.broadcast(word_encoder(merges))

    def spell(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            yield block.assign(symbols=block["word"].map(shared.value.word_symbols))

    spelled = words.mapInPandas(spell, "word string, n_texts bigint, symbols array<string>")
    # Two merges may make the same symbol; the later id stands.
    ids = vocabulary(merges).groupBy("token").agg(F.max("id").alias("id"))
    return (
        spelled.select("word", "n_texts", F.posexplode("symbols").alias("pos", "token"))
        .join(F.broadcast(ids), "token")
        .groupBy("word", "n_texts")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("places"))
        .select("word", "n_texts", F.col("places.id").alias("ids"))
    )


def decode_ids(df: DataFrame, merges: DataFrame, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of the id list ``ids``; a word's end is written as a space.

    The vocabulary (at most 49,408 rows) is broadcast, so decoding is map-only.
    Bytes that are not UTF-8 become the replacement character.
    """
    byte_of = {s: b for b, s in byte_symbols()}
    table: list[bytes] = [b""] * VOCABULARY_SIZE
    for i, token in token_ids(collect_merges(merges)):
        table[i] = bytes(byte_of[c] for c in token)
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        piece = shared.value

        def text(row):
            return b"".join([piece[i] for i in row]).decode("utf-8", errors="replace").replace(WORD_END, " ")

        return rows.map(text, na_action="ignore")

    return df.withColumn(out, decode(F.col(ids)))
