import html
import html.entities

import pandas as pd
import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swatchbook.functions import text

# A fixed value.
PATTERN = regex.compile(
    r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", regex.IGNORECASE
)


def clean(t):
    t = html.unescape(html.unescape(t)).strip()
    return regex.sub(r"\s+", " ", t).strip().lower()


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    cleaned = text.clean_text(F.col("t"))
    rows = df.select("i", cleaned.alias("c"), text.pretokenize(cleaned).alias("w")).collect()
    for r in rows:
        want = clean(texts[r["i"]])
        assert r["c"] == want
        assert r["w"] == regex.findall(PATTERN, want)


def test_examples(spark):
    check(
        spark,
        [
            "Don't stop 12 ok!?",
            "  Tom &amp;amp; Jerry &lt;b&gt; ",
            "a b c　 d\t\n\r e",
            "\x1c\x1f x \x1d y \x1e",
            "\x85next\x85",
            "Straße ÉCOLE İstanbul ΣΑΣ",
            "1234 ½ ٣ Ⅷ",
            "it's we're I'll I'd I'M they've can't",
            "<|startoftext|>hi<|endoftext|>",
            "日本語 テキスト",
            "é \U0001f600\U0001f600!",
            "",
            " ",
            "&nbsp;&notit; &#x41;&#65 &bogus;",
        ],
    )


LETTERS = st.characters(max_codepoint=0x52F, blacklist_categories=("Cs", "Cn", "Co"))
ODD = st.sampled_from("\u00a0\u1680\u2003\u2028\u202f\u3000\u200b\ufeff日½Ⅷ٣\U0001f600&;")


@settings(max_examples=5, derandomize=True, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=LETTERS | ODD, max_size=40), min_size=20, max_size=60))
def test_same_as_the_regex_module(spark, texts):
    # Scripts are limited to those that every recent Unicode version knows.
    check(spark, texts)


def test_every_character_the_jvm_knows(spark):
    """Both engines put every code point that the JVM's tables hold into the same class."""
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = pd.DataFrame({"c": codes, "t": [f"a{chr(c)}b '{chr(c)}1" for c in codes]})
    df = spark.createDataFrame(rows).withColumn("known", F.substring("t", 2, 1).rlike(r"\p{IsAssigned}"))
    words = df.filter("known").select("t", text.pretokenize(F.col("t")).alias("w")).toPandas()
    assert len(words) > 250_000
    assert [t for t, w in zip(words["t"], words["w"], strict=True) if list(w) != regex.findall(PATTERN, t)] == []


@pytest.mark.parametrize("t", ["\u0345", "a\u0345b", "!\u0345!", "\u0345\u0345x", "α\u0345\u03b9 '\u0345s"])
def test_the_mark_with_a_letter_for_its_upper_case(spark, t):
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(text.pretokenize(F.col("t"))).first()[0] == regex.findall(PATTERN, t)


def unescaped(spark, texts):
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(texts)), "t": texts}))
    rows = df.select("i", text.unescape(F.col("t")).alias("u")).toPandas().sort_values("i")
    return rows["u"].tolist()


def twice(t):
    return html.unescape(html.unescape(t))


def test_references_by_name(spark):
    names = sorted(html.entities.html5)
    texts = [form.format(n) for n in names for form in ("&{}", "a&{}b", "&amp;{}", "&amp;amp;{} x", "&{0}&{0}")]
    texts += [f"&{n[:-1]}q;" for n in names] + [f"&{n[:-2]};" for n in names if len(n) > 3]
    assert unescaped(spark, texts) == [twice(t) for t in texts]


def test_references_by_number(spark):
    codes = [*range(0x3000), *range(0xD700, 0xE100), *range(0xFD00, 0x10100), *range(0x10000, 0x110100, 0xFF), *range(0x10FF00, 0x110010)]
    codes += [p << 16 | end for p in range(18) for end in (0xFFFD, 0xFFFE, 0xFFFF)]
    texts = [form.format(c) for c in codes for form in ("&#{};", "&#x{:x}", "x&#X00{:X};y", "&amp;#{};", "&#38;#{}")]
    texts += ["&#" + "9" * 4000 + ";", "&#x" + "f" * 5000, "&#" + "0" * 4000 + "65;", "&#;", "&#x;", "&#", "&", "&&#65&#66;", "&#6 5;", "&#x6g;"]
    assert unescaped(spark, texts) == [twice(t) for t in texts]


@settings(max_examples=5, derandomize=True, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["&", "#", "x", "amp", ";", "lt", "not", "in", "38", "\U0001f600", " ", "\f", "é", "copy", "$1", "\\", "a" * 33]), max_size=12).map("".join), min_size=200, max_size=300))
def test_references_in_any_order(spark, texts):
    assert unescaped(spark, texts) == [twice(t) for t in texts]


def test_cleaning_needs_no_python(spark, capsys):
    df = spark.range(3).select(text.clean_text(F.concat(F.lit("&lt;"), F.col("id").cast("string"))).alias("c"))
    df.explain("extended")
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert "Python" not in plan and "Pandas" not in plan
    assert "from_json" not in plan.lower()  # the table is a literal


def test_nulls(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(text.pretokenize(text.clean_text(F.col("t")))).first()[0] is None


@pytest.mark.parametrize("n", [0, 1, 74, 75, 76, 500])
def test_frames(spark, n):
    df = spark.createDataFrame([(list(range(100, 100 + n)),)], "ids array<int>")
    ids = F.col("ids")
    framed, size, lost, end = df.select(
        text.frame_ids(ids, 9000, 9001), text.framed_size(ids), text.loses_end(ids), text.end_position(text.frame_ids(ids, 9000, 9001))
    ).first()
    whole = [9000, *range(100, 100 + n), 9001]
    assert framed == (whole + [0] * 77)[:77]
    assert size == n + 2
    assert lost == (n > 75)
    assert end == (n + 1 if n <= 75 else 0)
