"""Token counts and packing against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from swatchbook.llm import packing, pretokens, token_counts
from swatchbook.llm.queries import vocabulary

PIECES = ["a", "ab", "the", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "'s", "<|endoftext|>", "é", "日本", "1", "😀", "\r\n", "　", "aaaaa", "-"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 20))) for _ in range(3000)] + ["x" * 5000, "ab" * 3000]


def test_pieces_rebuild_the_text(texts):
    for text in texts:
        assert "".join(map(pretokens.literal, pretokens.cut(text))) == text


def test_counts_equal_the_library(library, texts):
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.TokenCounter(vocabulary()).count(texts) == expected


def test_counts_of_long_words(library):
    rng = random.Random(7)
    words = ["".join(rng.choices(letters, k=rng.randint(400, 1500))) for letters in ("ab", "aab", "abcdefgh", "é日x") for _ in range(40)]
    words += ["".join(rng.choices("ABCDEFabcdef0123456789", k=1 << 20)), "a" * 100_001, "the" * 30_000, "x", ""]
    expected = [len(e.ids) for e in library.encode_batch(words, add_special_tokens=False)]
    assert token_counts.TokenCounter(vocabulary()).count(words) == expected


def test_linked_strings_equal_the_ragged_ones(monkeypatch, texts):
    merger = token_counts.RankMerger(vocabulary())
    strings = [t.encode() for t in texts[:500]] + [b"a" * n for n in range(20)]
    ragged = merger.counts(strings).tolist()
    monkeypatch.setattr(token_counts, "LONG", 1)
    assert merger.counts(strings).tolist() == ragged


def test_merges_below_their_parts_are_refused(tmp_path):
    import json

    spec = json.loads(open(vocabulary()).read())
    spec["model"]["merges"].reverse()
    path = tmp_path / "reversed.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="ranks below"):
        token_counts.RankMerger(str(path))


def test_count_tokens_of_an_empty_table(docs):
    assert token_counts.count_tokens(docs.filter("false"), vocabulary(), limit=5).collect() == []


def test_ids_equal_the_library(library, texts):
    expected = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = packing.Encoder(vocabulary())
    assert encoder.fast is not None
    assert [encoder.encode(t) for t in texts] == expected


def test_ids_of_every_character(library):
    """Both engines put every code point into the same class."""
    encoder = packing.Encoder(vocabulary())
    characters = [chr(n) for n in range(0x110000) if not 0xD800 <= n < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}!{c}" for c in characters[n : n + 100]) for n in range(0, len(characters), 100)]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == np.array(found.ids, dtype="<u4").tobytes()


def test_ids_of_very_long_runs(library):
    encoder = packing.Encoder(vocabulary())
    for text in (" " * 300_000 + "a", "\n" * 50_000, "ab" * 200_000, "a b" * 200_000, "-" * 100_000, "x" + "\u3000" * 20_000):
        assert encoder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_ids_of_the_documents(library, sample):
    texts = [r.text or "" for r in sample.select("text").collect()]
    encoder = packing.Encoder(vocabulary())
    assert [encoder.encode(t) for t in texts] == [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_vocabularies_in_another_order_go_to_the_library(tmp_path):
    import json

    spec = json.loads(open(vocabulary()).read())
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    encoder = packing.Encoder(str(path))
    assert encoder.fast is None
    assert encoder.encode("the other") == np.array(Tokenizer.from_file(str(path)).encode("the other").ids, dtype="<u4").tobytes()


def test_memory_starts_anew(monkeypatch, library):
    monkeypatch.setattr(pretokens, "REMEMBERED", 3)
    counter = token_counts.TokenCounter(vocabulary())
    for text in ("one two three four five", "six seven", "one six"):
        assert counter.count([text]) == [len(library.encode(text).ids)]


def test_count_tokens(docs, library):
    rows = token_counts.count_tokens(docs, vocabulary(), limit=5).collect()
    assert len(rows) == 10
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    expected = sorted((i or -1, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == expected
    assert all(r.over_limit == (r.n_tokens > 5) for r in rows)


def least_bins(lengths, capacity):
    """The best of the bounds that tell apart items over capacity - k, over half a bin, and of at least k."""
    bounds = []
    for k in range(capacity // 2 + 1):
        alone = lengths[lengths > capacity - k]
        large = lengths[(lengths <= capacity - k) & (lengths > capacity / 2)]
        small = lengths[(lengths <= capacity / 2) & (lengths >= k)]
        room = len(large) * capacity - large.sum()
        bounds.append(len(alone) + len(large) + max(0, -((room - small.sum()) // capacity)))
    return max(bounds)


@pytest.mark.parametrize("seed", range(5))
def test_two_fit_fills_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 400)
    bins, offsets = packing.two_fit(lengths, 100)
    for number in range(bins.max() + 1):
        here = bins == number
        order = np.argsort(offsets[here])
        ends = np.cumsum(lengths[here][order])
        assert offsets[here][order].tolist() == [0, *ends[:-1].tolist()]
        assert ends[-1] <= 100
    # No packing is below this bound; sum / capacity is out of reach when half of the items exceed half a bin.
    assert bins.max() + 1 <= least_bins(lengths, 100) + 1


@pytest.mark.parametrize("seed", range(5))
def test_two_fit_fills_bins_with_small_items(seed):
    lengths = np.random.default_rng(seed).integers(1, 31, 400)
    bins, _ = packing.two_fit(lengths, 100)
    assert bins.max() + 1 <= -(-lengths.sum() // 100) + 1


def test_two_fit_replaces_the_smallest():
    # Greedy packing leaves 60 + 30 and a gap of 10; 22 + 18 fill it.
    bins, _ = packing.two_fit(np.array([60, 30, 22, 18]), 100)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_pack_is_whole(docs, library):
    length = 64
    rows = packing.pack(docs, vocabulary(), length=length, end_id=0).toPandas()
    for text, n_rows in (("one two", 2), ("", 2)):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (rows["ids_crc32"] == crc).sum() == n_rows
    long = rows[rows["doc_id"] == 5].sort_values("piece")
    assert (long["length"].iloc[1:] == length).all()
    assert long["start"].tolist() == [0, *np.cumsum(long["length"])[:-1].tolist()]
    for _, bin_ in rows.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_["offset"].tolist() == [0, *np.cumsum(bin_["length"])[:-1].tolist()]
        assert bin_["length"].sum() <= length
