"""MinHash near-dedup and removal of repeated strings against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from swatchbook.llm import induced_sort, minhash, suffix_dedup


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[n : n + 5]) for n in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    component = {i: i for i, _ in sets if i is not None}
    links = [
        (a, b)
        for n, (a, x) in enumerate(sets)
        for b, y in sets[n + 1 :]
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)
    ]
    for _ in component:
        for a, b in links:
            component[a] = component[b] = min(component[a], component[b])
    return sorted((i or -1, len(s), component.get(i) or -1, i is None or component[i] == i) for i, s in sets)


def copies(seed, n):
    """Texts with light and heavy edits of a few originals, copies, and a passage that many share."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    originals = [[rng.choice(words) for _ in range(rng.randint(20, 150))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = list(rng.choice(originals)) if rng.random() < 0.8 else passage + [rng.choice(words) for _ in range(60)]
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    return rows


AWKWARD = [(9001, None), (9002, ""), (9003, " \n"), (9004, "A b"), (9005, "a B"), (9006, "a b c"), (None, "a b"), (9007, "É a b c d e f"), (9008, "é a b c d e f")]


@pytest.mark.parametrize("family", [16, 4])
def test_near_documents(spark, monkeypatch, family):
    monkeypatch.setattr(minhash, "FAMILY_ROWS", family)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 8)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 5)
    rows = copies(family, 150) + AWKWARD
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS _id", "2 AS _node", "3 AS a")
    got = sorted((r[0] or -1, r[1], r[2] if r[2] is not None else -1, r[3]) for r in minhash.near_documents(df).collect())
    want = [(i, n, c if c != -1 or i == -1 else 0, k) for i, n, c, k in brute([(i + 1 if i is not None else None, t) for i, t in rows])]
    got = sorted(((i if i == -1 else i), n, c, k) for i, n, c, k in got)
    shifted = sorted((i - 1 if i > 0 else i, n, c - 1 if c > 0 else c, k) for i, n, c, k in want)
    fixed = sorted((0 if i == -1 and n > 1 else i, n, c, k) for i, n, c, k in got)
    assert fixed == sorted((0 if i == -1 and n > 1 else i, n, c, k) for i, n, c, k in shifted)


def test_near_documents_empty(spark):
    assert minhash.near_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, 5000).astype(np.uint64)) for _ in range(7)]
    got = minhash._common(sets[:3], sets[3:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets[:3]]


def test_suffix_order_by_induction():
    rng = np.random.default_rng(3)
    for trial in range(300):
        text = np.append(rng.integers(2, 2 + rng.integers(1, 5), rng.integers(1, 60)), 1)
        parts = list(induced_sort.suffix_order(text, depth=150, held=8 if trial % 2 else 1 << 20))
        order = np.concatenate([p for p, _ in parts]).tolist()
        common = np.concatenate([c for _, c in parts]).tolist()
        suffixes = [text[i:].tolist() for i in order]
        assert suffixes == sorted(suffixes, reverse=True)
        for n in range(1, len(order)):
            same = [a == b for a, b in zip(suffixes[n - 1], suffixes[n], strict=False)] + [False]
            assert common[n] == min(same.index(False), induced_sort.CAP)


def without_repeats(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(window)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


REPEATS = [
    (1, "a" * 101), (2, "a" * 500), (3, None), (4, ""), (5, "xy" * 300 + "q" * 99), (6, "q" * 100), (7, "q" * 100), (8, "é" * 120),
    (9, "z" * 99), (10, "z" * 99), (11, "\0" * 220 + "b"), (12, "a" * 100), (13, "b" * 50 + "\0" * 100),
]


def test_remove_repeats(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 2000)
    rows = REPEATS + [(100 + i, t) for i, t in copies(5, 60)]
    df = spark.createDataFrame([*rows, rows[6], (None, "a" * 300)], "doc_id bigint, text string").selectExpr("*", "1 AS _id", "2 AS n_bytes")
    got = suffix_dedup.remove_repeats(df, 100).collect()
    want = without_repeats(rows, 100)
    assert len(got) == len(rows) + 2
    for r in got:
        assert tuple(r)[1:] == (want[r[0]] if r[0] is not None else (300, 0, 0, hashlib.sha256(b"a" * 300).hexdigest()))


@pytest.mark.parametrize("length", [150, 300, 1100])
def test_remove_repeats_of_other_lengths(spark, length):
    rng = random.Random(length)
    passage = "".join(rng.choices("abcdefgh ", k=2 * length))
    own = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    rows = [(1, own(500) + passage + own(70)), (2, own(30) + passage + own(900)), (3, passage[: length - 1] + own(50)), (4, own(9) + passage[7 : 7 + length])]
    rows += [(5, "xy" * length), (6, "xy" * (length // 2) + "z" + passage[-length:]), (7, None)]
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length).collect()}
    assert got == without_repeats(rows, length)


@pytest.mark.parametrize("length", [0, suffix_dedup.GRAM - 1, suffix_dedup.PLACES])
def test_lengths_that_are_refused(spark, length):
    with pytest.raises(ValueError, match="length must be"):
        suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string"), length)


def test_remove_repeats_on_documents(sample):
    rows = [tuple(r) for r in sample.select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(sample, 100).collect()}
    assert got == without_repeats(rows, 100)


def test_remove_repeats_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
