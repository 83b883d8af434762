"""Secret scans: a random forest removes false positives; column expressions throughout."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swatchbook.cluster import written

# A candidate is a block of key text, a value that its context names, an issuer's format whatever
# it holds, a long token with a digit, or a very long one.
BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
# The password of an address; cheap looks back go first.
URL_PASSWORD = r"(?<=:)(?<=://[^\s:/@]{0,128}:)[^\s/\"'<>]+(?=@)"
_NAME = r"(?i:token|secret|passw|api|key|auth|bearer|credential)[A-Za-z_]{0,32}[\"']?\s{0,8}[=:]\s{0,8}"
NAMED_VALUE = (
    rf"(?<=[=:\s\"'])(?<=[=:]\s{{0,8}}[\"']?)(?:(?<={_NAME}\")[^\"\r\n]++(?<!\s)(?=\")"
    rf"|(?<={_NAME}')[^'\r\n]++(?<!\s)(?=')"
    rf"|(?<={_NAME})[^\s\"'`,;<>(){{}}\[\]]++)"
)
ISSUER = (
    r"(?=[Agxs])(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9+/_-])|gh[pousr]_[A-Za-z0-9]{36,}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"
)
TOKEN = r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}|[A-Za-z0-9+/_-]{24,})={0,2}"
CANDIDATE = f"{BLOCK}|{URL_PASSWORD}|{NAMED_VALUE}|{ISSUER}|{TOKEN}"
NEIGHBOURHOOD = 48
MARK = "[secret]"

# Words next to a value that say what it is.
NAMED = r"(?i)(token|secret|passw|api|key|auth|bearer|credential)[A-Za-z_]*[\"']?\s*(?:[=:]|is)?\s*[\"']?$"
ASSIGNED = r"[=:]\s*[\"']?$"
URL_USER = r"://[^\s:/@]*:$"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]"
TEST_PATH = r"(?i)test|example|sample|fixture|mock|docs?/"
ISSUED = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_live_[A-Za-z0-9]{16,}$"
UUID = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"

FEATURES = (
    "length",
    "transitions",
    "digits",
    "capitals",
    "variety",
    "coverage",
    "hexadecimal",
    "slashes",
    "path",
    "named",
    "assigned",
    "quoted",
    "placeholder",
)

# Labelled findings of each kind that the forest is fitted on at most, and words in the dictionary.
SAMPLE_ROWS = 10_000
DICTIONARY_WORDS = 300
TREES, DEPTH, SEED = 25, 6, 11


class Split(NamedTuple):
    """A node of a tree: the feature's number, the threshold, and what is below on either side."""

    feature: int
    threshold: float
    low: Split | float
    high: Split | float


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> list[str]:
    """The ``words`` words of three to ten letters that occur most often in all texts; ties by the word."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"\b[a-z]{3,10}\b"), F.lit(0))).alias("w"))
    top = found.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(words)
    return [row.w for row in top.collect()]


def _share(text: Column, kept: str, length: Column) -> Column:
    return F.length(F.regexp_replace(text, kept, "")) / length


def _in_address(before: Column, after: Column) -> Column:
    return before.rlike(URL_USER) & after.startswith("@")


def features(value: Column, before: Column, after: Column, path: Column, words: Sequence[str]) -> list[Column]:
    """The numbers that the forest sees, in the order of ``FEATURES``."""
    length = F.length(value).cast("double")
    shape = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"
    )
    longest_first = sorted(words, key=lambda w: (-len(w), w))
    known = "|".join(re.escape(w) for w in longest_first) or r"\A\z"
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    near = F.concat(before, value, after)
    values = {
        "length": length,
        "transitions": (F.length(shape) - 1) / length,
        "digits": _share(value, "[^0-9]", length),
        "capitals": _share(value, "[^A-Z]", length),
        "variety": F.size(F.array_distinct(F.split(value, ""))) / length,
        "coverage": 1 - _share(F.lower(value), known, length),
        "hexadecimal": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "slashes": _share(value, "[^/]", length),
        "path": flag(F.coalesce(path, F.lit("")).rlike(TEST_PATH)),
        "named": flag(before.rlike(NAMED) | _in_address(before, after)),
        "assigned": flag(before.rlike(ASSIGNED)),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "placeholder": flag(near.rlike(PLACEHOLDER)),
    }
    return [values[name].cast("double") for name in FEATURES]


def label(value: Column, before: Column, after: Column) -> Column:
    """1 for what is a secret by its issuer's format or its assignment, 0 for what cannot be one, else null.

    Stands in for the labelled findings of a reviewer, which the tables lack.
    """
    near = F.concat(before, value, after)
    return (
        F.when(near.rlike(PLACEHOLDER) | value.rlike(UUID), 0)
        .when(value.rlike(BLOCK) | value.rlike(ISSUED), 1)
        # Short values next to a name are as often versions and counts: the forest decides.
        .when(before.rlike(NAMED) & before.rlike(ASSIGNED) & value.rlike("[0-9]") & (F.length(value) >= 8), 1)
        .when(_in_address(before, after) & value.rlike("[0-9]"), 1)
        .when(value.rlike("^[0-9+/_-]*$") | ~value.rlike("[0-9]"), 0)
        .cast("int")
    )


def _values(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def _found(values: Column, pieces: Column) -> Column:
    """Candidates of a text in order, each with the text next to it."""
    return F.transform(
        F.arrays_zip(values.alias("v"), F.slice(pieces, F.lit(1), F.size(values)).alias("b"), F.slice(pieces, F.lit(2), F.size(values)).alias("a")),
        lambda z: F.struct(
            z["v"].alias("value"),
            F.substring(z["b"], F.greatest(F.length(z["b"]) - NEIGHBOURHOOD + 1, F.lit(1)), F.lit(NEIGHBOURHOOD)).alias("before"),
            F.substring(z["a"], F.lit(1), F.lit(NEIGHBOURHOOD)).alias("after"),
        ),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``(doc_id, path, value, before, after)``, one row per candidate of every text."""
    text = F.col(text_col)
    some = docs.filter(text.rlike(CANDIDATE)).select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), text.alias("_text"))
    # Named columns: what is used several times is searched for once.
    cut = some.withColumn("_values", _values(F.col("_text"))).withColumn("_pieces", F.split("_text", CANDIDATE, -1))
    found = cut.select("doc_id", "path", F.explode(_found(F.col("_values"), F.col("_pieces"))).alias("c"))
    return found.select("doc_id", "path", "c.value", "c.before", "c.after")


def labelled_findings(docs: DataFrame, rows: int = SAMPLE_ROWS, **columns: str) -> DataFrame:
    """``(path, value, before, after, label)``: up to ``rows`` distinct findings of each label, by hash."""
    named = candidates(docs, **columns).select("path", "value", "before", "after", label(F.col("value"), F.col("before"), F.col("after")).alias("label"))
    # Written, so that the texts are searched once for both kinds.
    named = written(named.filter("label IS NOT NULL"), "labelled")
    order = F.xxhash64("value", "before", "after", "path")
    # Of a value's contexts the first in this order, whichever task meets it first.
    context = F.struct(order.alias("o"), "before", "after", "path")
    kinds = [
        named.filter(F.col("label") == k).groupBy("value").agg(F.min(context).alias("c")).orderBy("c.o", "value").limit(rows)
        for k in (0, 1)
    ]
    return kinds[0].withColumn("label", F.lit(0)).union(kinds[1].withColumn("label", F.lit(1))).select(
        "c.path", "value", "c.before", "c.after", "label"
    )


def _tree(lines: list[str]) -> Split | float:
    """A tree out of the model's printed form."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines)
    lines.pop(0)
    return Split(int(feature), float(threshold), low, _tree(lines))


def train(findings: DataFrame, words: Sequence[str], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Split | float]:
    """The trees of a random forest fitted on labelled findings; none unless both labels occur.

    ``findings`` has path, value, before, after and label (0 or 1). It is
    bounded, as its rows are sorted into one partition: the same findings give
    the same forest, however they were dealt.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    numbers = features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), words)
    table = findings.select(F.col("label").cast("double").alias("label"), *[c.alias(n) for c, n in zip(numbers, FEATURES, strict=True)])
    # One partition in a fixed order, as the trees' samples are drawn by partition and place.
    table = written(table.orderBy(*FEATURES, "label").coalesce(1), "findings").coalesce(1)
    if table.select("label").distinct().count() < 2:
        return []
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(vectors)
    return [_tree(tree.toDebugString.strip().split("\n")[1:]) for tree in model.trees]


def _vote(tree: Split | float, numbers: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(numbers[tree.feature] <= tree.threshold, _vote(tree.low, numbers)).otherwise(_vote(tree.high, numbers))


def score(forest: Sequence[Split | float], numbers: Column) -> Column:
    """The share of trees that vote for a secret; ``numbers`` is an array in the order of ``FEATURES``."""
    votes = [_vote(tree, numbers) for tree in forest]
    total = votes[0]
    for vote in votes[1:]:
        total = total + vote
    return total / len(votes)


def scan(
    docs: DataFrame,
    forest: Sequence[Split | float],
    words: Sequence[str],
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
) -> DataFrame:
    """``(id_col, text_col, n_candidates, n_secrets, top_score)``, one row per row of ``docs``.

    Candidates that at least ``threshold`` of the trees take for a secret are
    replaced by a mark, the others are false positives and stay. Without a
    forest (no labelled findings of both kinds) the labels themselves decide,
    and what has none is kept as a finding. A null text stays null and an
    empty one empty, both without candidates and with a null score; null ids,
    repeated rows and ties need no special treatment, as each row is mapped
    by itself; an empty table gives an empty one and other columns are not
    read. One map without a shuffle.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(path_col).cast("string").alias("_path"))
    some = F.col("_text").rlike(CANDIDATE)
    cut = rows.withColumn("_values", F.when(some, _values(F.col("_text")))).withColumn(
        "_pieces", F.when(F.col("_values").isNotNull(), F.split("_text", CANDIDATE, -1))
    )
    found = cut.withColumn("_c", _found(F.col("_values"), F.col("_pieces")))
    numbered = found.withColumn(
        "_c",
        F.transform(
            "_c",
            lambda c: F.struct(
                c["value"].alias("value"),
                F.array(*features(c["value"], c["before"], c["after"], F.col("_path"), words)).alias("x"),
                label(c["value"], c["before"], c["after"]).alias("label"),
            ),
        ),
    )
    rated = numbered.withColumn(
        "_c",
        F.transform(
            "_c",
            lambda c: F.struct(
                c["value"].alias("value"),
                (score(forest, c["x"]) if forest else F.coalesce(c["label"], F.lit(1)).cast("double")).alias("score"),
            ),
        ),
    )
    pieces = F.col("_pieces")
    rebuilt = F.array_join(
        F.concat(
            F.transform(
                F.arrays_zip(F.slice(pieces, F.lit(1), F.size("_c")).alias("piece"), F.col("_c").alias("c")),
                lambda z: F.concat(z["piece"], F.when(z["c"]["score"] >= threshold, MARK).otherwise(z["c"]["value"])),
            ),
            F.slice(pieces, F.size("_c") + 1, F.lit(1)),
        ),
        "",
    )
    scores = F.transform("_c", lambda c: c["score"])
    return rated.select(
        F.col("_id").alias(id_col),
        F.when(F.exists(scores, lambda s: s >= threshold), rebuilt).otherwise(F.col("_text")).alias(text_col),
        F.coalesce(F.size("_c"), F.lit(0)).alias("n_candidates"),
        F.coalesce(F.size(F.filter(scores, lambda s: s >= threshold)), F.lit(0)).alias("n_secrets"),
        F.array_max(scores).alias("top_score"),
    )


def scan_secrets(docs: DataFrame, threshold: float = 0.5, **columns: str) -> DataFrame:
    """:func:`scan` with a dictionary and a forest that come from ``docs`` itself."""
    text = {k: v for k, v in columns.items() if k == "text_col"}
    words = dictionary(docs, **text)
    forest = train(labelled_findings(docs, **columns), words)
    return scan(docs, forest, words, threshold, **columns)
