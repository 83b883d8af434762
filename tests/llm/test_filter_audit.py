"""Filter audit against its SQL and a plain count."""

import random

import numpy as np
import pytest

import compare
from swatchbook.llm import filter_audit, queries


def test_popcount():
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 3, 4, 7, 63, 64, 1000, 4099):
        words = rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)
        want = [(int((words >> np.uint32(b) & np.uint32(1)).sum())) for b in range(32)]
        assert filter_audit.positional_popcount(words).tolist() == want


def test_words_are_truth_tables():
    for filters in (1, 3, 5):
        for fails, word in enumerate(filter_audit.survival_words(filters).tolist()):
            assert [bool(word >> s & 1) for s in range(1 << filters)] == [not s & fails for s in range(1 << filters)]


@pytest.mark.parametrize(
    "text, fails",
    [
        ("", "A"),
        (" ".join(f"w{n}" for n in range(50)), ""),
        (" ".join(f"w{n}" for n in range(49)), "A"),
        (" ".join(f"w{n % 65}" for n in range(100)), ""),
        (" ".join(f"w{n % 64}" for n in range(100)), "B"),
        (" ".join(["AAAAA"] + [f"é{n:02d}" for n in range(25)]), "A" + ("C" if 5 > 0.05 * 105 else "")),
        ("A" + "é" * 19, "A"),
        ("A" + "é" * 18, "AC"),
        ("50 % of it", "AD"),
        ("x|y", "AD"),
    ],
)
def test_failures_of_a_text(text, fails):
    assert filter_audit.text_failures(text.encode()) == sum(1 << "ABCD".index(c) for c in fails)


def stored(spark, folder, docs, labels):
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    df.selectExpr("*", "1 AS part", "2 AS step", "3 AS _fails", "4 AS _id").write.parquet(f"{folder}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    marks.selectExpr("*", "1 AS _good", "'x' AS source").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def sql_of(folder):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return compare.sql_rows(con, queries.ORACLE["op13_truth_table_audit"])


def test_query_equals_its_sql(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "Beta", "x%", "yy", "GAMMA", f"w{n}", f"v{k}"]) for k in range(rng.choice([3, 49, 60]))) for n in range(60)]
    docs = [(n, rng.choice(texts), rng.choice(["a", "b", "", None])) for n in range(400)]
    docs += [(5, texts[0], "a"), (5, texts[0], "a"), (6, None, None), (3, "", "b"), (None, "", "a"), (None, texts[1], "a"), (900, "word " * 30000, "long")]
    # A text that a third of all rows share.
    docs += [(n, texts[2], "a") for n in range(1000, 1200)]
    labels = [(n, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for n in range(0, 1100, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (77777, 1, 1)]
    folder = stored(spark, tmp_path, docs, labels)
    got = compare.spark_rows(queries.op13_truth_table_audit(spark, folder))
    assert got == sql_of(folder)
    assert len(got[1]) == 4 * 600


def test_hot_parts_and_many_parts(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id AS string) END AS _part", "cast(id % 32 AS int) AS _fails", "id % 5 = 0 AS good")
    found = {r.part: r.survivors for r in filter_audit.subset_survivors(rows, 5, ["good"]).collect()}
    assert len(found) == 2001
    ids = range(0, 3000, 3)
    for s in range(32):
        assert found["hot"][s] == [sum(not i % 32 & s for i in ids), sum(not i % 32 & s and i % 5 == 0 for i in ids)]
    with pytest.raises(ValueError, match="word of 32"):
        filter_audit.subset_survivors(rows, 6)


def test_empty_tables(spark, tmp_path):
    folder = stored(spark, tmp_path, [], [])
    assert queries.op13_truth_table_audit(spark, folder).collect() == []


def test_no_labels(spark, tmp_path):
    folder = stored(spark, tmp_path, [(1, "a b", None)], [])
    assert compare.spark_rows(queries.op13_truth_table_audit(spark, folder)) == sql_of(folder)
