"""Licence scans by ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swatchbook.cluster import spread
from swatchbook.llm import license_rules, workers
from swatchbook.llm.license_rules import SURENESS, Rule

DETECTION = "struct<rule:string,label:string,priority:int,start:bigint,words:bigint,base:boolean,suppressed:boolean>"

# A-Z to a-z; every other ASCII character that is no letter or digit sets words apart.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, in lower case."""
    return text.translate(_FOLD).split()


class Scanner:
    """Tries the rules whose keywords a text holds, and resolves what overlaps."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        # A leading blank is the literal that the search looks for first.
        self.compiled = [re.compile(f" (?:{r.pattern})(?= )".encode()) for r in self.rules]
        self.needed = [[frozenset(w.encode() for w in group) for group in r.keywords] for r in self.rules]
        often = Counter(w for groups in self.needed for group in groups for w in group)
        # A rule waits at the words of the group that the fewest rules share; those without keywords are always tried.
        self.always = [n for n, groups in enumerate(self.needed) if not groups]
        self.waiting: dict[bytes, list[int]] = {}
        for n, groups in enumerate(self.needed):
            if groups:
                for w in min(groups, key=lambda g: (max(often[w] for w in g), sorted(g))):
                    self.waiting.setdefault(w, []).append(n)

    def gated(self, words: set[bytes]) -> list[int]:
        """Numbers of the rules that a text with these words can match."""
        near = {n for w in self.waiting.keys() & words for n in self.waiting[w]}
        return sorted(self.always + [n for n in near if not any(g.isdisjoint(words) for g in self.needed[n])])

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """``(start, stop, rule)`` of all matches, in words; matches of one rule do not overlap each other."""
        tried = self.gated(set(words))
        if not tried:
            return []
        line, blanks = b" %s " % b" ".join(words), None
        found = []
        for n in tried:
            for match in self.compiled[n].finditer(line):
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
                # The match begins at the blank before its first word and ends before one.
                first, last = np.searchsorted(blanks, (match.start(), match.end())).tolist()
                found.append((first, last, n))
        return found

    def scan(self, words: list[bytes]) -> list[tuple[int, int, int, bool]]:
        """``(start, stop, rule, suppressed)`` in order of place, then rule.

        First a detection inside another of the same or a better priority is
        suppressed (of two at one place, the later rule's). Of those left that
        still share words, the better priority stays, then the longer, the
        earlier, the earlier rule.
        """
        found = sorted(self.places(words), key=lambda d: (d[0], -d[1], d[2]))
        reach = [0] * len(SURENESS)
        left, gone = [], set()
        for at, (start, stop, n) in enumerate(found):
            priority = self.rules[n].priority
            if max(reach[: priority + 1]) >= stop:
                gone.add(at)
            else:
                left.append(at)
            reach[priority] = max(reach[priority], stop)
        taken: list[tuple[int, int]] = []
        for at in sorted(left, key=lambda a: (self.rules[found[a][2]].priority, found[a][0] - found[a][1], found[a][0], found[a][2])):
            start, stop, _ = found[at]
            after = bisect_left(taken, (start, stop))
            if (after and taken[after - 1][1] > start) or (after < len(taken) and taken[after][0] < stop):
                gone.add(at)
            else:
                insort(taken, (start, stop))
        return [(*d, at in gone) for at, d in enumerate(found)]


def _scanning(rules: Sequence[Rule]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("licences")
        scanner = Scanner(rules)
        names = pa.array([r.name for r in scanner.rules])
        labels = pa.array([r.label for r in scanner.rules])
        priority = np.array([r.priority for r in scanner.rules], dtype=np.int32)
        base = np.array([r.base for r in scanner.rules], dtype=bool)
        for batch in batches:
            sizes, offsets, rows = [], [0], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                rows += scanner.scan(words)
                offsets.append(len(rows))
            table = np.array(rows, dtype=np.int64).reshape(-1, 4)
            number = pa.array(table[:, 2])
            fields = {
                "rule": names.take(number),
                "label": labels.take(number),
                "priority": pa.array(priority[table[:, 2]]),
                "start": pa.array(table[:, 0]),
                "words": pa.array(table[:, 1] - table[:, 0]),
                "base": pa.array(base[table[:, 2]]),
                "suppressed": pa.array(table[:, 3].astype(bool)),
            }
            found = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, type=pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), found)],
                names=["_id", "n_words", "detections"],
            )

    return run


def scan_licenses(
    docs: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, n_words, detections)``, one row per row of ``docs``.

    Texts are lower-cased (A-Z) and cut into words of letters, digits and
    characters beyond ASCII. ``detections`` holds every match of every rule
    with its place in words, by place and then rule, and whether another one
    suppresses it (:meth:`Scanner.scan`). Rules default to
    :func:`license_rules.rules`.

    A null or empty text has no words and no detections. Ids may be null or
    repeat, repeated rows stay, an empty table gives an empty one, other
    columns are not read. Texts are read whole. The job is one map over the
    rows without a shuffle; a task holds one Arrow batch.
    """
    texts = spread(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")))
    kind = texts.schema["_id"].dataType.simpleString()
    run = _scanning(license_rules.rules() if rules is None else rules)
    return texts.mapInArrow(run, f"_id {kind}, n_words bigint, detections array<{DETECTION}>").withColumnRenamed("_id", id_col)


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` are about all
    detections of base rules; ``labels`` adds those of the other rules that
    nothing suppresses. ``score`` is the chance that at least one label is
    right when labels are right independently, each as sure as its best detection.
    """
    at_base = F.filter("detections", lambda d: d["base"])
    seen = F.filter("detections", lambda d: d["base"] | ~d["suppressed"])
    sure = F.array(*[F.lit(x) for x in SURENESS])
    named = scanned.select(
        id_col, "n_words", at_base.alias("_base"), F.array_sort(F.array_distinct(F.transform(seen, lambda d: d["label"]))).alias("_labels"), seen.alias("_seen")
    )

    def best(label):
        """The best priority of a label's detections."""
        return F.array_min(F.transform(F.filter("_seen", lambda d: d["label"] == label), lambda d: d["priority"]))

    doubt = F.aggregate("_labels", F.lit(1.0), lambda x, label: x * (F.lit(1.0) - F.get(sure, best(label))))
    return named.select(
        id_col,
        "n_words",
        F.size("_base").cast("bigint").alias("n_base"),
        F.array_min("_base.start").alias("first_word"),
        F.array_max("_base.start").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_base.label")), ",").alias("base_labels"),
        F.array_join("_labels", ",").alias("labels"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - doubt)).alias("score"),
    )
