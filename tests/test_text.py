"""Cleaner, printed-array parser and category map (C4-C6)."""

import re

import pytest
from pyspark.sql import functions as F

from mediascore.sources.artifacts import load_category_maps
from mediascore.functions.text import clean_value, clean_values, parse_printed_array


def py_clean(v: str) -> str:
    """Test-only restatement of the cleaning contract in plain Python."""
    out = re.sub(r"[^\w]", "_", v.lower())
    return re.sub(r"_+", "_", out).strip("_")


CASES = [
    ("Sci-Fi & Fantasy", "sci_fi_fantasy"),
    ("__x__", "x"),
    ("!!!", ""),
    ("É é", "é_é"),
    ("ΣΣ Α", "σς_α"),
    ("İstanbul", "i_stanbul"),
    (" Action!", "action"),
    ("Film--Noir", "film_noir"),
    ("TV Movie", "tv_movie"),
    ("Comédie", "comédie"),
]


def test_cleaner_cases(spark):
    df = spark.createDataFrame([(a,) for a, _ in CASES], "v string")
    got = [r[0] for r in df.select(clean_value(F.col("v"))).collect()]
    assert got == [b for _, b in CASES]
    assert [py_clean(a) for a, _ in CASES] == got


def test_cleaner_matches_python_on_ascii_and_latin(spark):
    chars = [chr(c) for c in range(32, 0x250)]
    words = ["".join(chars[i:i + 7]) for i in range(0, len(chars), 7)]
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = [r[0] for r in df.select(clean_value(F.col("v"))).collect()]
    assert got == [py_clean(w) for w in words]


def test_clean_values_drops_null_and_empty(spark):
    df = spark.createDataFrame([(["Drama", None, "", "!!!"],), (None,), ([],)], "g array<string>")
    got = [r[0] for r in df.select(clean_values(F.col("g"))).collect()]
    assert got == [["drama", ""], None, []]


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("['genre_drama' 'genre_crime'\n 'genre_tv_movie']", ["genre_drama", "genre_crime", "genre_tv_movie"]),
        ('["a" "b"]', ["a", "b"]),
        ("['a', 'b']", ["a',", "b"]),
        ("['x' ... 'y']", ["x", "...", "y"]),
        ("[]", []),
    ],
)
def test_parse_printed_array(spark, text, tokens):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(parse_printed_array(F.col("s"))).first()[0] == tokens


def test_category_map_rules(spark):
    def maps(column, names):
        table = spark.createDataFrame([(column, names)], "original_column string, exploded_mapping array<string>")
        return load_category_maps(table).get(column, {})

    mixed = maps("genre", ["genre_drama", "g_war", "war", "genre_x"])
    assert list(mixed.items()) == [("drama", "genre_drama"), ("war", "g_war"), ("x", "genre_x")]
    # duplicate category: the last column wins, at the first one's place
    assert list(maps("genre", ["genre_a", "genre_b", "other_a"]).items()) == [("a", "other_a"), ("b", "genre_b")]
    assert maps("origin_country", ["origin_country_us"]) == {"us": "origin_country_us"}
    assert maps("genre", ["war", "drama"]) == {}


from hypothesis import given, settings, strategies as st  # noqa: E402

# Scripts whose letters, digits and case mappings agree between the JVM and
# Python (the cleaner's known differences are in newer Unicode additions).
ALPHABET = st.characters(
    min_codepoint=0x20, max_codepoint=0x52F,
    blacklist_categories=("Cs", "Cc", "Mn", "Me", "Mc"),
)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=8))
def test_cleaner_property(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = [r[0] for r in df.select(clean_value(F.col("v"))).collect()]
    assert got == [py_clean(w) for w in words]


def test_cleaner_on_every_code_point(spark):
    """All 1,112,063 characters that are no surrogates (but NUL's own row, too): none differs."""
    points = spark.range(0x110000).where("id < 55296 or id >= 57344")
    text = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    text = F.when(F.col("id") == 0xFEFF, F.lit("\ufeff")).otherwise(text)  # decode takes it for a byte order mark
    for around in ("", "A"):  # alone, and within a word
        rows = points.select("id", clean_value(F.concat(F.lit(around), text, F.lit(around))).alias("c")).toArrow()
        got = dict(zip(rows.column("id").to_pylist(), rows.column("c").to_pylist()))
        assert len(got) == 0x110000 - 2048
        wrong = [hex(i) for i, c in got.items() if c != py_clean(around + chr(i) + around)]
        assert not wrong, (len(wrong), wrong[:20])
