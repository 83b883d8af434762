import gzip
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swatchbook.functions import text
from swatchbook.operators import tokenizer
from swatchbook.sources import merges


def brute_force(symbols, rank_of):
    while True:
        ranked = [rank_of.get(p, 10**9) for p in zip(symbols, symbols[1:], strict=False)]
        if not ranked or min(ranked) == 10**9:
            return symbols
        best, out, i = min(ranked), [], 0
        while i < len(symbols):
            if i < len(ranked) and ranked[i] == best:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out


pieces = st.text(alphabet="ab", min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(pieces, pieces), unique=True, max_size=25), st.text(alphabet="ab", min_size=1, max_size=30))
def test_merging_equals_brute_force(pairs, word):
    rank_of = {p: i for i, p in enumerate(pairs)}
    want = brute_force(list(word), rank_of)
    assert tokenizer.merge_symbols(list(word), rank_of) == want
    assert tokenizer._merge_long(list(word), rank_of) == want


words_of_letters = st.lists(st.text(alphabet="abé'", min_size=1, max_size=30), unique=True, max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(pieces, pieces, st.booleans()), unique_by=lambda p: p[:2], max_size=25), words_of_letters)
def test_merging_many_words_equals_one_by_one(pairs, words):
    encoder = tokenizer.WordEncoder([(i, a, b + "</w>" * end) for i, (a, b, end) in enumerate(pairs)])
    want = [[encoder.id_of[s] for s in encoder.word_symbols(w)] for w in words]
    assert encoder.ids_of_words(words) == want
    assert encoder.ids_of_words(words) == want


def test_many_words_are_merged_together(monkeypatch):
    """No loop over a single word's symbols, and slices, special, long and forgotten words change nothing."""
    encoder = tokenizer.WordEncoder([(0, "a", "a"), (1, "aa", "a</w>"), (2, "aa", "aa")])
    words = ["a" * n for n in range(1, 65)] + ["b", "<|endoftext|>", "x" * 65]
    want = [[encoder.id_of[s] for s in encoder.word_symbols(w)] for w in words]
    alone = []
    plain = tokenizer.merge_symbols
    monkeypatch.setattr(tokenizer, "MERGED_WORDS", 7)
    monkeypatch.setattr(tokenizer, "REMEMBERED_WORDS", 30)
    monkeypatch.setattr(tokenizer, "merge_symbols", lambda symbols, ranks: (alone.append(symbols), plain(symbols, ranks))[1])
    assert encoder.ids_of_words(words) == want
    assert encoder.ids_of_words(words[20:]) == want[20:]
    assert len(encoder.known) <= 30
    # Only the word beyond SHORT_WORD, in both calls.
    assert [len(s) for s in alone] == [65, 65]


def test_a_very_long_word_is_quick():
    rank_of = {("a", "a"): 0, ("aa", "aa"): 1, ("aaaa", "aaaa"): 2}
    parts = tokenizer.merge_symbols(["a"] * 200_003, rank_of)
    assert "".join(parts) == "a" * 200_003
    assert parts.count("a" * 8) == 25_000


@pytest.fixture
def merge_file(tmp_path):
    lines = ["#version: 0.2", "t h", "th e</w>", "i n", "in g</w>", "Ã ©</w>", "a b", "x y", ""]
    path = tmp_path / "merges.txt.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    return str(path)


def test_merge_list(spark, merge_file):
    rows = merges.read_merge_list(spark, merge_file).orderBy("rank").collect()
    assert [tuple(r) for r in rows][:3] == [(0, "t", "h"), (1, "th", "e</w>"), (2, "i", "n")]
    assert len(rows) == 7
    assert merges.read_merge_list(spark, merge_file, limit=2).count() == 2
    assert merges.MAX_MERGES == 48894


def test_vocabulary(spark, merge_file):
    table = dict(tuple(r) for r in merges.vocabulary(merges.read_merge_list(spark, merge_file)).collect())
    assert len(table) == 512 + 7 + 2
    assert (table[0], table[256], table[512], table[513]) == ("!", "!</w>", "th", "the</w>")
    assert (table[519], table[520]) == ("<|startoftext|>", "<|endoftext|>")
    assert len({table[i] for i in range(256)}) == 256
    assert table == dict(merges.token_ids(merges.collect_merges(merges.read_merge_list(spark, merge_file))))


TEXTS = ["The thing", "théé 42", "", "ab" * 100, None, "<|endoftext|> xy", "日本 \U0001f600"]


def test_texts_and_back(spark, merge_file):
    pairs = merges.read_merge_list(spark, merge_file)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").repartition(3)
    coded = tokenizer.decode_ids(tokenizer.encode_texts(df, pairs, "t"), pairs)
    rows = {r["i"]: r for r in coded.collect()}
    assert rows[0]["ids"][0] == 513
    assert [rows[i]["text"] for i in range(7)] == [
        "the thing ",
        "théé 4 2 ",
        "",
        "ab" * 100 + " ",
        "",
        "<|endoftext|>xy ",
        "日本 \U0001f600 ",
    ]
    assert rows[5]["ids"][0] == 520


def test_invalid_bytes_become_the_replacement_character(spark, merge_file):
    pairs = merges.read_merge_list(spark, merge_file)
    symbols = [s for _, s in merges.byte_symbols()]
    df = spark.createDataFrame([(1, [symbols.index("Ã"), symbols.index("x")]), (2, None)], "i int, ids array<int>")
    assert {r["i"]: r["text"] for r in tokenizer.decode_ids(df, pairs).collect()} == {1: "�x", 2: None}


def test_token_table(spark, merge_file):
    pairs = merges.read_merge_list(spark, merge_file)
    df = spark.createDataFrame([(1, "the"), (2, "the " * 80)], "k bigint, t string")
    rows = {r["k"]: r for r in tokenizer.tokenize_table(df, pairs, "k", "t").collect()}
    assert rows[1]["description_ids"] == [519, 513, 520] + [0] * 74
    assert (rows[1]["n_tokens"], rows[1]["truncated"]) == (3, False)
    assert rows[2]["description_ids"] == [519] + [513] * 76
    assert (rows[2]["n_tokens"], rows[2]["truncated"]) == (82, True)


def test_words_of_chunks_are_the_words_of_the_texts(spark):
    texts = [*TEXTS, "  a  b\u00a0c\u2003a\u3000d ", "it's IT'S 'S a\u0345b x\x1cy", "&lt;|startoftext|&gt;a <|endof text|>", "The\u0085thing\u200bb"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    pieces = tokenizer.chunk_counts(df, "t").select(F.explode(text.pretokenize(F.col("chunk"))).alias("word"), "n")
    found = {r["word"]: r["n"] for r in pieces.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    words = [w for r in df.select(tokenizer.words_of(F.col("t"))).collect() for w in r[0]]
    assert found == Counter(words)
    assert len(found) > 20


def test_word_table_counts_each_word_once_per_text(spark, merge_file):
    pairs = merges.read_merge_list(spark, merge_file)
    df = spark.createDataFrame([("the the in",), ("the",)], "t string")
    rows = {r["word"]: (r["n_texts"], r["ids"]) for r in tokenizer.word_table(df, pairs, "t").collect()}
    assert rows["the"] == (2, [513])
    assert rows["in"][0] == 1


def test_words_forgotten_by_the_cache_are_encoded_again(monkeypatch):
    monkeypatch.setattr(tokenizer, "REMEMBERED_WORDS", 3)
    encoder = tokenizer.WordEncoder([])
    first = [encoder.word_ids(w) for w in ("a", "b", "c", "d", "a")]
    assert first[0] == first[4]
    assert len(encoder.known) <= 3
