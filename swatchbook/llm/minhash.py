"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swatchbook.cluster import written
from swatchbook.llm import workers
from swatchbook.llm.components import components
from swatchbook.llm.metric_join import connected_here

WORDS = 5
# Two collections of HALVES half keys, each of WIDTH minima. A table key is a
# pair of one half key from either collection: HALVES^2 tables from
# 2 * HALVES * WIDTH minima. Documents with a similarity of 0.75 share no
# table with a probability of 2 * (1 - 0.75^2)^12 = 0.0001, at 0.85 with 1e-6.
HALVES, WIDTH = 12, 2
MINIMA = 2 * HALVES * WIDTH
# Shingles hashed at once, and rows of one task's comparison.
PART, BLOCK_ROWS = 4096, 1024
# Rounds in which every document asks one neighbour, before all the rest is compared.
STAR_ROUNDS = 2
# Documents that share half of their shingles with one leader are a family; from
# this size on its members are compared block by block, not pair by pair.
FAMILY_ROWS, FAMILY_BLOCK = 16, 512
# Rows that a worker turns into Python objects at once.
SLICE_ROWS = 256

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers without visible structure (public finaliser constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed((np.arange(MINIMA, dtype=np.uint64) + np.uint64(1)) * _ODD)
_MULTIPLIERS = _mixed(_SEEDS) | np.uint64(1)
_PLACES = _mixed((np.arange(WORDS, dtype=np.uint64) + np.uint64(77)) * _ODD) | np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a text; A-Z in lower case, words between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(words) < WORDS:
        # Another number of words gives another start, so short sequences differ from full shingles.
        places = _PLACES[: len(words)]
        return _mixed(_mixed(np.array([(hashed * places).sum()], dtype=np.uint64)) + np.uint64(len(words)))
    n = len(words) - WORDS + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        total += hashed[k : k + n] * _PLACES[k]
    return np.unique(_mixed(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a non-empty set."""
    best = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), PART):
        part = shingles[at : at + PART]
        for k in range(MINIMA):
            low = (((part ^ _SEEDS[k]) * _MULTIPLIERS[k]) ^ ((part ^ _SEEDS[k]) >> np.uint64(29))) * _ODD
            best[k] = min(best[k], low.min())
    return best


def half_keys(lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The half keys of the two collections; the place in the collection is part of the key."""
    grouped = _mixed(lowest).reshape(2, HALVES, WIDTH)
    key = np.arange(2 * HALVES, dtype=np.uint64).reshape(2, HALVES) * _ODD
    for k in range(WIDTH):
        key = _mixed(key + grouped[:, :, k])
    return key[0].view(np.int64), key[1].view(np.int64)


def set_print(shingles: np.ndarray) -> bytes:
    """A 128-bit name of a set: documents with equal sets are one node."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows a few at a time, so that a worker never holds a whole batch of texts or sets twice."""
    workers.enter("minhash")
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _signing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        sizes, nodes, keys, signs = [], [], [], []
        for text in batch.column(1).to_pylist():
            shingles = shingle_set(text)
            sizes.append(len(shingles))
            if len(shingles):
                lowest = minima(shingles)
                nodes.append(set_print(shingles))
                keys.append(half_keys(lowest))
                signs.append((lowest >> np.uint64(20)).astype(np.uint16).tobytes())
            else:
                nodes.append(None)
                keys.append((None, None))
                signs.append(None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, type=pa.int64()),
                pa.array(nodes, type=pa.binary()),
                pa.array([a for a, _ in keys], type=pa.list_(pa.int64())),
                pa.array([b for _, b in keys], type=pa.list_(pa.int64())),
                pa.array(signs, type=pa.binary()),
            ],
            names=["_id", "_n", "_node", "_a", "_b", "_sign"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        found = [shingle_set(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([set_print(s) for s in found], type=pa.binary()),
                pa.array([s.tobytes() for s in found], type=pa.binary()),
            ],
            names=["_node", "_set"],
        )


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common, len(both) - common


def _confirming(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found = [
                overlap(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            linked = pa.array([100 * common >= percent * union for common, union in found], type=pa.bool_())
            near = pa.array([2 * common >= union for common, union in found], type=pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), linked, near], names=["a", "b", "_linked", "_near"]
            )

    return run


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with whether their full sets are linked, and whether they share half of their union."""
    left = sets.select(F.col("_node").alias("a"), F.col("_set").alias("_sa"))
    right = sets.select(F.col("_node").alias("b"), F.col("_set").alias("_sb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "_sa", "_sb")
    return written(
        joined.mapInArrow(_confirming(percent), "a binary, b binary, _linked boolean, _near boolean"), "compared"
    )


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the left sets shares with each of the right ones."""
    number = np.concatenate([*left, *right])
    distinct, code, times = np.unique(number, return_inverse=True, return_counts=True)
    # Only shingles that occur twice matter, some columns of them at a time.
    place = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    held = times[code] > 1
    owner, column = owner[held], place[code[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, int((times > 1).sum()), PART):
        at = slice(*np.searchsorted(column, [first, first + PART]))
        part = np.zeros((len(left) + len(right), PART), dtype=np.float32)
        part[owner[at], column[at] - first] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out


def _within(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between two blocks of a family: every linked node and the first one it is connected with."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first, second = int(group["_lo"].iloc[0]), int(group["_hi"].iloc[0])
        left = group[group["_block"] == first].sort_values("_node")
        right = group[group["_block"] == second].sort_values("_node")
        sets = [[np.frombuffer(s, np.uint64) for s in side["_set"]] for side in (left, right)]
        common = _common(*sets)
        sizes = [np.array([len(s) for s in side], dtype=np.float64) for side in sets]
        linked = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
        near = linked
        if first != second:
            none = [np.zeros((n, n), dtype=bool) for n in linked.shape]
            near = np.block([[none[0], linked], [linked.T, none[1]]])
        nodes = np.concatenate([left["_node"], right["_node"]]) if first != second else left["_node"].to_numpy()
        np.fill_diagonal(near, False)
        some = near.any(axis=1)
        return pd.DataFrame({"a": nodes[some], "b": nodes[connected_here(near)[some]]}, dtype=object)

    return run


def _family_links(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the nodes of each family, which are compared block by block on their full sets."""
    sizes = families.groupBy("_family").agg(F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("_blocks"))
    members = (
        families.join(sizes, "_family")
        .join(sets, "_node")
        .withColumn("_block", F.pmod(F.xxhash64("_node"), "_blocks").cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            "_family",
            F.least("_block", "_other").alias("_lo"),
            F.greatest("_block", "_other").alias("_hi"),
            "_node",
            "_block",
            "_set",
        )
    )
    return members.groupBy("_family", "_lo", "_hi").applyInPandas(_within(percent), "a binary, b binary")


def _likely(same: np.ndarray, percent: int) -> np.ndarray:
    """Whether so many equal minima are possible at the similarity asked for.

    The bound lies four standard deviations below the expected number, so a
    link is lost here with a probability of about 5e-5.
    """
    p = percent / 100
    return same >= MINIMA * p - 4 * (MINIMA * p * (1 - p)) ** 0.5


def _pairs_of(
    keys: np.ndarray,
    sides: np.ndarray,
    classes: np.ndarray,
    signs: np.ndarray,
    tables: np.ndarray,
    sizes: np.ndarray,
    shared: np.ndarray,
    families: Sequence[np.ndarray],
    percent: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs to confirm among rows sorted by key.

    A pair is given only for the first table that its minima agree on, so it
    comes up once, however many buckets it shares. Two sets have at most as
    many shingles in common as either shares with anyone. Members of one
    family have been compared already.
    """
    last = np.searchsorted(keys, keys, side="right") - np.arange(len(keys))  # rows left in the bucket
    here, d = np.flatnonzero(last > 1), 1
    while len(here):
        a, b = here, here + d
        fit = (classes[a] != classes[b]) & ((sides[a] != sides[b]) | (sides[a] == 2))
        for family in families:
            fit &= family[a] != family[b]
        a, b = a[fit], b[fit]
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            common = np.minimum(shared[x], shared[y])
            able = 100 * common >= percent * (sizes[x] + sizes[y] - common)
            x, y = x[able], y[able]
            same = signs[x] == signs[y]
            halves = same.reshape(len(x), 2, HALVES, WIDTH).all(axis=3)
            first = halves[:, 0].argmax(axis=1) * HALVES + halves[:, 1].argmax(axis=1)
            keep = (first == tables[x]) & _likely(same.sum(axis=1), percent)
            yield x[keep], y[keep]
        d += 1
        here = here[last[here] > d]


def _crossing(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of one bucket that are not connected yet and whose minima agree enough.

    The rows come sorted by key; a bucket that goes on in the next batch waits for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("minhash")
        waiting: list[pa.RecordBatch] = []
        for batch in _ended(batches):
            if batch is not None:
                if waiting and batch.num_rows and batch.column(0)[batch.num_rows - 1] == waiting[0].column(0)[0]:
                    waiting.append(batch)
                    continue
                waiting.append(batch)
            if not waiting:
                continue
            rows = pa.Table.from_batches(waiting).combine_chunks()
            keys = rows.column(0).to_numpy()
            cut = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
            waiting = [] if batch is None else rows.slice(cut).to_batches()
            rows, keys = rows.slice(0, cut), keys[:cut]
            if cut < 2:
                continue
            nodes = rows.column(1).to_numpy(zero_copy_only=False)
            classes, _ = pd.factorize(rows.column(2).to_numpy(zero_copy_only=False))
            signs = np.frombuffer(b"".join(rows.column(3).to_pylist()), dtype=np.uint16).reshape(cut, MINIMA)
            sides, tables, sizes, shared, *families = (c.to_numpy() for c in rows.columns[4:])
            for x, y in _pairs_of(keys, sides, classes, signs, tables, sizes, shared, families, percent):
                if len(x):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[x], type=pa.binary()), pa.array(nodes[y], type=pa.binary())], names=["a", "b"]
                    )

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


def _shared(nodes: DataFrame, half: str) -> DataFrame:
    """The half keys that at least two nodes hold, with their places, by node; nodes without one fall away."""
    keys = nodes.select("_node", F.posexplode(half).alias("_place", "_key"))
    twice = keys.groupBy("_key").agg(F.count("*").alias("_size")).filter("_size > 1")
    return keys.join(twice.select("_key"), "_key").groupBy("_node").agg(
        F.collect_list(F.struct("_place", "_key")).alias(half)
    )


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes after linking nodes; ``classes`` has _node and _class."""
    of_a = classes.select(F.col("_node").alias("a"), F.col("_class").alias("ca"))
    of_b = classes.select(F.col("_node").alias("b"), F.col("_class").alias("cb"))
    linked = links.join(of_a, "a").join(of_b, "b").select("ca", "cb")
    up = components(linked).select(F.col("node").alias("_class"), F.col("component").alias("_up"))
    joined = classes.join(up, "_class", "left")
    return written(joined.select("_node", F.coalesce("_up", "_class").alias("_class")), "classes")


def _star(buckets: DataFrame, turn: int) -> DataFrame:
    """For each unsettled node one other to ask: the leader of one of its buckets.

    ``buckets`` has _key, _node and _class. Leaders are the nodes that meet
    the most others, as an original meets more of its copies than a copy does;
    in later turns chance has a say as well.
    """
    sizes = buckets.groupBy("_key").agg(F.count("*").alias("_size"))
    met = buckets.join(sizes, "_key").groupBy("_node").agg(F.sum("_size").alias("_met"))
    chance = F.pmod(F.xxhash64("_node", F.lit(turn)), F.lit(1 << turn))
    ranked = met.select("_node", F.struct(chance.alias("x"), F.col("_met").alias("y"), F.xxhash64("_node").alias("z")).alias("_rank"))
    rows = buckets.join(ranked, "_node")
    leaders = rows.groupBy("_key").agg(F.max_by(F.struct("_node", "_class", "_rank"), "_rank").alias("_lead"))
    asked = rows.select("_key", "_node", "_class").join(leaders, "_key").filter("_class <> _lead._class")
    one = asked.groupBy("_node").agg(F.max_by("_lead._node", "_lead._rank").alias("_other"))
    return one.select(F.col("_node").alias("a"), F.col("_other").alias("b"))


def _partners(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(_node, _shared)``: how many shingles of a node others in the buckets have, where that is enough for a link."""
    shape = "_node binary, _x array<bigint>"
    open_sets = sets.join(buckets.select("_node").distinct(), "_node", "left_semi")
    held = open_sets.mapInArrow(_listed, shape).select("_node", F.explode("_x").alias("_x"))
    held = written(held, "shingles")
    common = held.groupBy("_x").agg(F.count("*").alias("_size")).filter("_size > 1").select("_x")
    counted = held.join(common, "_x").groupBy("_node").agg(F.count("*").alias("_shared"))
    size = F.octet_length("_set") / 8
    return counted.join(open_sets.select("_node", size.alias("_n")), "_node").filter(
        F.col("_shared") * 100 >= F.col("_n") * percent
    ).select("_node", "_shared")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        found = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, type=pa.list_(pa.int64()))], names=["_node", "_x"]
        )


def near_documents(
    docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)``, one row per row of ``docs``.

    A document's set is its distinct shingles of five words; the whole
    sequence if it has fewer words; empty without words or text, and then it
    is linked with nothing. Documents are linked when their sets share at
    least ``percent`` hundredths of their union, which is counted on the full
    sets (of 64-bit shingles). ``component_id`` is the smallest id reachable.
    A row with a null id is linked with nothing, has a null component and is
    kept. Rows that repeat an id are judged by their own texts. Texts are read
    whole, other columns are not read, an empty table gives an empty one.

    Documents with equal sets are one node. Candidates come from table keys
    that combine a half key of either collection, made only from half keys
    that another node holds too. A bucket is never expanded into its pairs at
    once: in the first rounds every node asks the leader of one bucket, and
    what they link becomes one class; then nodes of one bucket that are in
    different classes are compared in blocks, and pairs whose minima agree
    enough are confirmed. Pairs inside a class need no comparison, as they
    change no class.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    )
    shape = "_id bigint, _n bigint, _node binary, _a array<bigint>, _b array<bigint>, _sign binary"
    signed = written(rows.mapInArrow(_signing, shape), "signatures")
    nodes = written(
        signed.filter("_node IS NOT NULL AND _id IS NOT NULL")
        .groupBy("_node")
        .agg(F.min("_id").alias("_id"), *[F.first(c).alias(c) for c in ("_n", "_a", "_b", "_sign")]),
        "nodes",
    )

    live = _shared(nodes, "_a").join(_shared(nodes, "_b"), "_node")
    halves = live.select("_node", "_b", F.explode("_a").alias("_ka")).select("_node", "_ka", F.explode("_b").alias("_kb"))
    table = F.col("_ka._place") * HALVES + F.col("_kb._place")
    keyed = written(
        halves.select("_node", F.xxhash64("_ka._key", "_kb._key").alias("_key"), table.alias("_table")), "table-keys"
    )
    shared = keyed.groupBy("_key").agg(F.count("*").alias("_size")).filter("_size > 1").select("_key")
    buckets = written(keyed.join(shared, "_key").select("_key", "_node", "_table"), "buckets")

    candidates = written(buckets.select("_node").distinct(), "candidates")
    classes = candidates.select("_node", F.col("_node").alias("_class"))
    # The texts of one row per candidate, read again.
    wanted = nodes.join(candidates, "_node").select("_id")
    texts = rows.join(wanted.distinct(), "_id").select("_text")
    sets = written(
        texts.mapInArrow(_sets, "_node binary, _set binary").join(candidates, "_node", "left_semi").dropDuplicates(["_node"]),
        "sets",
    )

    unsettled = buckets.join(classes, "_node")
    families = []
    for turn in range(STAR_ROUNDS):
        pairs = written(_star(unsettled, turn), "star")
        if pairs.isEmpty():
            break
        asked = compared(pairs, sets, percent)
        near = asked.filter("_near")
        large = near.groupBy("b").agg(F.count("*").alias("_size")).filter(F.col("_size") >= FAMILY_ROWS).select("b")
        followers = near.join(large, "b").select(F.col("a").alias("_node"), F.col("b").alias("_family"))
        family = written(
            followers.union(large.select("b", F.col("b").alias("_family"))).dropDuplicates(["_node"]), "families"
        )
        families.append(family)
        links = asked.filter("_linked").select("a", "b").union(_family_links(family, sets, percent))
        classes = _merged(classes, links)
        # Buckets whose nodes are all in one class are settled.
        now = unsettled.drop("_class").join(classes, "_node")
        settled = now.groupBy("_key").agg(F.min("_class").alias("_lo"), F.max("_class").alias("_hi"))
        still = settled.filter("_lo <> _hi").select("_key")
        unsettled = written(now.join(still, "_key").select("_key", "_node", "_table", "_class"), "unsettled")

    # A document whose shingles are mostly its own has no link; the others meet in what is left of the buckets.
    partners = _partners(unsettled, sets, percent)
    unsettled = unsettled.join(partners, "_node")
    for turn in range(STAR_ROUNDS):
        name = f"_family{turn}"
        if turn < len(families):
            unsettled = unsettled.join(families[turn].select("_node", F.xxhash64("_family").alias(name)), "_node", "left")
        else:
            unsettled = unsettled.withColumn(name, F.lit(None).cast("bigint"))
        # Without a family a node is one of its own.
        unsettled = unsettled.withColumn(name, F.coalesce(name, F.xxhash64("_node")))
    unsettled = written(unsettled, "partners")

    # Rows of a large bucket are dealt to blocks, and each pair of blocks is a bucket of its own.
    sizes = unsettled.groupBy("_key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks"))
    members = (
        unsettled.join(sizes, "_key")
        .join(nodes.select("_node", "_n", "_sign"), "_node")
        .withColumn("_block", F.pmod(F.xxhash64("_node"), "_blocks").cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            F.xxhash64("_key", F.least("_block", "_other"), F.greatest("_block", "_other")).alias("_key"),
            "_node",
            "_class",
            "_sign",
            # Within a block all meet, between two blocks only rows of different ones.
            F.when(F.col("_block") == F.col("_other"), 2)
            .otherwise((F.col("_block") > F.col("_other")).cast("int"))
            .cast("int")
            .alias("_side"),
            F.col("_table").cast("int").alias("_table"),
            "_n",
            "_shared",
            *[f"_family{turn}" for turn in range(STAR_ROUNDS)],
        )
    )
    crossing = members.repartition("_key").sortWithinPartitions("_key").mapInArrow(
        _crossing(percent), "a binary, b binary"
    )
    pairs = written(crossing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "pairs")
    if not pairs.isEmpty():
        classes = _merged(classes, compared(pairs, sets, percent).filter("_linked").select("a", "b"))

    # A class is known by a node; its component is the smallest id of its documents.
    of_node = written(
        nodes.select("_node", "_id").join(classes, "_node", "left").select(
            "_node", F.coalesce("_class", "_node").alias("_class"), "_id"
        ),
        "node-classes",
    )
    lowest = of_node.groupBy("_class").agg(F.min("_id").alias("_component"))
    by_node = of_node.join(lowest, "_class").select("_node", "_component")
    joined = signed.select("_id", "_n", "_node").join(by_node, "_node", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id"))
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_shingles"),
        component.cast("bigint").alias("component_id"),
        F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"),
    )
