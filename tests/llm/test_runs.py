"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from swatchbook.llm import queries, runs


def plain_runs(words, min_length=6, exponent=4):
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(min_length, exponent * q):
                part = words[i : i + size]
                if all(part[p:] != part[:-p] for p in range(1, q)):
                    found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def text_of(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.choice([0, 3, 6, 10, 30, 80, 200, 400]))]
    for _ in range(rng.randint(0, 2)):
        if words:
            a = rng.randrange(len(words))
            b, p = rng.randrange(a, len(words) + 1), 1 + rng.randrange((len(words) - a) // 3 + 1)
            words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
    return words


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_the_plain_search(seed):
    rng = random.Random(seed)
    texts = [text_of(rng) for _ in range(800)]
    found = runs.text_runs([np.array(t, dtype=np.int64) for t in texts], 50)
    for text, rows in zip(texts, found, strict=True):
        assert [tuple(r) for r in rows.tolist()] == plain_runs(text)


@pytest.mark.parametrize(
    "words",
    [
        ([0] * 7 + [1]) * 40,
        (([0] * 7 + [1]) * 5 + [2]) * 9 + [0, 0, 0] * 20,
        (([0, 1] * 6 + [2]) * 6 + [3]) * 5,
        list(range(100)) * 5,
        [0] * 5,
        [0] * 6,
        [0, 1] * 4,
        [0, 1, 2] * 3 + [0, 1],
    ],
)
def test_runs_within_runs(words):
    (rows,) = runs.text_runs([np.array(words, dtype=np.int64)], 100)
    assert [tuple(r) for r in rows.tolist()] == plain_runs(words)


def test_colliding_hashes_change_nothing(monkeypatch):
    """With hashes of a few bits only, confirmed runs are still real ones."""
    monkeypatch.setattr(runs, "_scatter", lambda x: (x * np.uint64(2654435761)) % np.uint64(61))
    rng = random.Random(5)
    for text in (text_of(rng) for _ in range(300)):
        (rows,) = runs.text_runs([np.array(text, dtype=np.int64)], 50)
        assert set(map(tuple, rows.tolist())) <= set(plain_runs(text))


def test_higher_exponents_only():
    with pytest.raises(ValueError, match="periods"):
        runs.word_runs(None, exponent=3)
    words = [0, 1, 2, 3] * 5 + [9] + [4, 5] * 9
    (rows,) = runs.text_runs([np.array(words, dtype=np.int64)], 10, exponent=6)
    assert rows.tolist() == [[21, 18, 2]]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id,
        len(found),
        *best,
        1000 * best[1] // best[2] if found else None,
        digest("".join(f"{s},{size},{q}\n" for s, size, q in found)),
        digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def table(spark, folder, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS runs", "2 AS start", "'x' AS collapsed", "3 AS _id")
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_query_equals_the_plain_version(spark, tmp_path):
    rng = random.Random(8)
    rows = [(n, rng.choice([" ", "\n", "  \t", "\x0b\x0c"]).join(f"w{w}" for w in text_of(rng))) for n in range(400)]
    # Both ids are of the tenth that is folded.
    folded = [n for n in range(400) if zlib.crc32(str(n).encode()) % 10 == 0]
    assert len(folded) > 20
    rows += [(None, None), (None, "a b " * 9), (7, ""), (7, " \t\n "), (8, "x\xa0y x\xa0y x\xa0y x\xa0y x\xa0y x\xa0y"), (9, "é ß " * 8)]
    rows += [(1000, "tick tock " * 3000), (1001, " ".join(f"v{n % 1500}" for n in range(7000)))] * 2
    got = queries.op11_synchronising_runs(spark, table(spark, tmp_path, rows))
    assert [f.simpleString() for f in got.schema.fields] == [
        "doc_id:bigint", "n_runs:bigint", "start:bigint", "length:bigint", "period:bigint", "exponent_milli:bigint", "runs_sha256:string", "collapsed_sha256:string",
    ]
    small = [r for r in rows if (r[0] or 0) < 1000]
    assert sorted(map(repr, (tuple(r) for r in got.collect() if (r.doc_id or 0) < 1000))) == sorted(repr(expected(*r)) for r in small)
    long = {r.doc_id: r for r in got.filter("doc_id >= 1000").collect()}
    assert got.filter("doc_id >= 1000").count() == 4
    if 1000 not in folded and 1001 not in folded:
        assert (long[1000].length, long[1000].period, long[1001].length, long[1001].period) == (6000, 2, 7000, 1500)


def test_empty_table(spark, tmp_path):
    assert queries.op11_synchronising_runs(spark, table(spark, tmp_path, [])).collect() == []
