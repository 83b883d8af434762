import pytest

from swatchbook.cluster import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def docs(spark):
    """A few documents with every awkward case; the extra columns clash with names used inside."""
    long = " ".join(f"word{n % 97}" for n in range(6000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (5, long, "en", "b"),
        (6, "  \t\n ", None, "b"),
        (7, "one two", "de", None),
        (7, "one two", "de", None),
        (None, "der die das und nicht mit einer", "de", "c"),
        (9, "Straße über Äpfel <|endoftext|> ok", "de", "c"),
    ]
    shape = "doc_id bigint, text string, lang string, source string"
    df = spark.createDataFrame(rows, shape)
    return df.selectExpr("*", "length(text) AS n_chars", "1 AS _id", "'x' AS _text", "2 AS n_tokens", "3 AS size", "4 AS _key")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
