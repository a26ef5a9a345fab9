"""Fixture data derived from the driver's tables (part, lineitem).

``media_items`` gives one media record per part; ``media_raw`` renders them as
JSON lines with one deterministic defect per part; ``media_envelopes`` groups
them into batch requests.  The fixture model is a pure function of the fitted
feature list, so every query over these grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediascore.schema import FIELD_TYPES, FIELDS

# Fixed values of the fixture: 25 two-letter country codes (in order), the
# four languages, the genre per part type.
COUNTRY_CODES = "USGBFRDEESITJPKRCNINBRMXCAAUSENODKFINLBEPLATCHIEPT"
LANGUAGES = ["en", "fr", "de", "es"]
GENRE_BY_TYPE = {
    "PROMO": "Sci-Fi & Fantasy",
    "ECONOMY": "TV Movie",
    "SMALL": "Drama",
    "LARGE": " Action!",
    "MEDIUM": "Comédie",
}
GENRE_OTHER = "Film--Noir"
LONG_GENRE = "Epic Historical Adventure Musical Docudrama"  # 45 characters with padding

# Defect chosen by p_partkey % 101 (anything else: clean record).
DEFECTS = {
    0: "bad key", 1: "key plus newline", 2: "year 1800", 3: "budget -1",
    4: "tmdb_rating 8.7004", 5: "rt_score 101", 6: "country USA",
    7: "language eng", 8: "genre of 45 characters", 9: "null list element",
    10: "truncated JSON", 11: "year as text (valid)", 12: "year 1994.5",
    13: "extra unknown field (valid)",
    59: "a closing bracket and text after the record", 60: "a closing bracket and another record",
    55: "text after the record", 56: "year true (a boolean counts as 1)", 57: "a string instead of a record",
}
# Fields that are sent with another JSON value: defect -> (field, JSON text,
# the value it has as SQL, or None where its type is wrong, the type rule then
# broken).  With DEFECTS every rule is broken by some record.
OVERRIDES: dict[int, tuple[str, str, str | None, str | None]] = {
    14: ("revenue", "-5", "-5", None),
    15: ("runtime", "-1", "-1", None),
    16: ("tmdb_votes", "-2", "-2", None),
    17: ("imdb_votes", '"-3"', "-3", None),
    18: ("metascore", "101.0", "101", None),
    19: ("imdb_rating", "100.5", "100.5", None),
    20: ("imdb_rating", "9.25", "9.25", None),
    21: ("tmdb_rating", "10.5", "10.5", None),
    22: ("tmdb_rating", '"NaN"', None, "tmdb_rating:type"),
    23: ("imdb_rating", "true", None, "imdb_rating:type"),
    24: ("budget", '"many"', None, "budget:type"),
    25: ("revenue", "1.5", None, "revenue:type"),
    26: ("runtime", '"1h"', None, "runtime:type"),
    27: ("tmdb_votes", "[1]", None, "tmdb_votes:type"),
    28: ("rt_score", '"true"', None, "rt_score:type"),
    29: ("metascore", '{"x":1}', None, "metascore:type"),
    30: ("imdb_votes", '""', None, "imdb_votes:type"),
    31: ("production_status", '"%s"' % ("s" * 26), "'%s'" % ("s" * 26), None),
    32: ("tagline", '"%s"' % ("t" * 256), "'%s'" % ("t" * 256), None),
    33: ("origin_country", '["US",null]', "['US', NULL]", None),
    34: ("production_companies", "[null]", "[NULL]::VARCHAR[]", None),
    35: ("production_countries", '[null,"US"]', "[NULL, 'US']", None),
    36: ("production_countries", '["USA"]', "['USA']", None),
    37: ("spoken_languages", '["eng"]', "['eng']", None),
    38: ("spoken_languages", '["en",null]', "['en', NULL]", None),
    39: ("origin_country", '"US"', None, "origin_country:type"),
    40: ("production_companies", '{"a":1}', None, "production_companies:type"),
    41: ("production_countries", "5", None, "production_countries:type"),
    42: ("spoken_languages", "true", None, "spoken_languages:type"),
    43: ("genre", '"Drama"', None, "genre:type"),
    44: ("origin_country", "[1]", None, "origin_country:element_type"),
    45: ("production_companies", "[true]", None, "production_companies:element_type"),
    46: ("production_countries", '[["US"]]', None, "production_countries:element_type"),
    47: ("spoken_languages", '["en",{}]', None, "spoken_languages:element_type"),
    48: ("genre", '["a",1]', None, "genre:element_type"),
    49: ("imdb_id", "5", None, "imdb_id:type"),
    50: ("imdb_id", "null", "NULL", None),
    51: ("production_status", '["x"]', None, "production_status:type"),
    52: ("original_language", "1", None, "original_language:type"),
    53: ("tagline", '{"x":1}', None, "tagline:type"),
    54: ("overview", "true", None, "overview:type"),
    58: ("tmdb_rating", "8.70000000000000000001", "8.7000009", None),  # any value with too many places
    61: ("budget", '"1e2"', None, "budget:type"),
    62: ("revenue", '"-1_0"', "-10", None),
    63: ("budget", "-1e2", "-100", None),
    64: ("tmdb_votes", "-1.0E7", "-10000000", None),
    65: ("imdb_rating", '" 1_00.5 "', "100.5", None),
    66: ("runtime", '"1994."', None, "runtime:type"),
}
ITEMS_PER_REQUEST = 10
BARE_ARRAY_EVERY = 37  # request_id % 37 == 5 -> a bare top-level array
EMPTY_EVERY = 41  # request_id % 41 == 7 -> a request without items
JUNK_EVERY = 39  # request_id % 39 == 11 -> text after the envelope, begun by a closing bracket


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cc(k: Column) -> Column:
    return F.substr(F.lit(COUNTRY_CODES), (F.lit(1) + F.lit(2) * (k % 25)).cast("int"), F.lit(2))


def media_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed media record per part (aggregates of its line items)."""
    li = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.min(F.year("l_shipdate")).alias("y"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.floor("l_extendedprice").cast("bigint")).alias("rev"),
            F.sum(F.floor("l_quantity").cast("bigint")).alias("qty"),
        )
    )
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (k % 4 + 1).cast("int"))
    genre = F.coalesce(
        F.try_element_at(F.create_map(*[x for kv in GENRE_BY_TYPE.items() for x in map(F.lit, kv)]), F.col("p_type")),
        F.lit(GENRE_OTHER),
    )
    name_word = lambda i: F.split_part(F.col("p_name"), F.lit(" "), F.lit(i))
    rec = {
        "imdb_id": F.concat(F.lit("tt"), F.when(k < 10**6, F.lpad(k.cast("string"), 7, "0")).otherwise(k.cast("string"))),
        "release_year": F.when(k % 11 != 0, F.col("y")),
        "budget": F.when(k % 7 != 0, F.floor(F.col("p_retailprice") * 10000)),
        "revenue": F.when(k % 13 != 0, F.col("rev")),
        "runtime": F.col("p_size") * 4,
        "origin_country": F.array(_cc(k)),
        "production_companies": F.array(F.col("p_brand")),
        "production_countries": F.array(_cc(k), _cc(k + F.col("p_size"))),
        "production_status": F.when(k % 3 == 0, "Released").when(k % 3 == 1, "Post Production").otherwise("Rumored"),
        "original_language": F.when(k % 17 != 0, lang),
        "spoken_languages": F.when(k % 19 != 0, F.array(lang, F.lit("en"))),
        "genre": F.array(genre, name_word(1), name_word(2)),
        "tagline": F.col("p_name"),
        "overview": F.concat(F.col("p_name"), F.lit(" "), F.col("p_type")),
        "tmdb_rating": F.col("p_retailprice") / 100,
        "tmdb_votes": F.col("n") * 100,
        "rt_score": F.col("p_size") * 2,
        "metascore": 100 - F.col("p_size"),
        "imdb_rating": F.col("p_size") * F.lit(1.5).cast("decimal(2,1)"),
        "imdb_votes": F.col("qty"),
    }
    joined = p.join(li, p["p_partkey"] == li["l_partkey"], "left")
    return joined.select(
        k.alias("p_partkey"),
        *[rec[n].cast(FIELD_TYPES[n]).alias(n) for n in FIELDS],
    )


def media_items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 record fields only."""
    return media_items(spark, sf_dir).drop("p_partkey")


def media_raw(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """JSON lines (request_id, pos, value) with one defect per part.
    ``items`` may pass an already built ``media_items`` table."""
    m = items if items is not None else media_items(spark, sf_dir)
    d = F.col("p_partkey") % 101
    patched = {
        "imdb_id": F.when(d == 0, F.lit("invalid_id"))
        .when(d == 1, F.concat(F.col("imdb_id"), F.lit("\n")))
        .otherwise(F.col("imdb_id")),
        "release_year": F.when(d == 2, F.lit(1800)).otherwise(F.col("release_year")),
        "budget": F.when(d == 3, F.lit(-1).cast("bigint")).otherwise(F.col("budget")),
        "rt_score": F.when(d == 5, F.lit(101)).otherwise(F.col("rt_score")),
        "origin_country": F.when(d == 6, F.array(F.lit("USA"))).otherwise(F.col("origin_country")),
        "original_language": F.when(d == 7, F.lit("eng")).otherwise(F.col("original_language")),
        "genre": F.when(d == 8, F.array(F.element_at("genre", 1), F.rpad(F.lit(LONG_GENRE), 45, "x")))
        .when(d == 9, F.array(F.element_at("genre", 1), F.lit(None).cast("string")))
        .otherwise(F.col("genre")),
    }
    def left_out(n):
        """Null (so not written) where the field is sent with another value."""
        own = [k for k, o in OVERRIDES.items() if o[0] == n]
        return F.when(~d.isin(*own), patched.get(n, F.col(n))) if own else patched.get(n, F.col(n))

    # behind a generator: one expression with all defects is too large to compile
    m = m.select("p_partkey", F.inline(F.array(F.struct(F.to_json(F.struct(*[left_out(n).alias(n) for n in FIELDS])).alias("js")))))
    js = F.col("js")
    literal = F.create_map(*[F.lit(x) for k, (n, text, _, _) in OVERRIDES.items() for x in (k, f'"{n}":{text}}}')])
    js = F.when(d.isin(*OVERRIDES), F.concat(F.regexp_replace(js, r"\}$", ","), F.try_element_at(literal, d.cast("int")))).otherwise(js)
    js = (
        F.when(d == 4, F.regexp_replace(js, r'"tmdb_rating":[0-9.]+', '"tmdb_rating":8.7004'))
        .when(d == 10, F.substr(js, F.lit(1), (F.length(js) / 2).cast("int")))
        .when(d == 11, F.regexp_replace(js, r'"release_year":([0-9]+)', '"release_year":"$1"'))
        .when(d == 12, F.regexp_replace(js, r'"release_year":([0-9]+)', '"release_year":$1.5'))
        .when(d == 55, F.concat(js, F.lit(" trailing")))
        .when(d == 59, F.concat(js, F.lit("]junk")))
        .when(d == 60, F.concat(js, F.lit('] {"imdb_id":"x"}')))
        .when(d == 56, F.regexp_replace(js, r'"release_year":([0-9]+)', '"release_year":true'))
        .when(d == 57, F.lit('"record"'))
        .when(d == 13, F.regexp_replace(js, r"^\{", '{"title":"extra",'))
        .otherwise(js)
    )
    return m.select(
        (F.col("p_partkey") / ITEMS_PER_REQUEST).cast("bigint").alias("request_id"),
        (F.col("p_partkey") % ITEMS_PER_REQUEST).cast("int").alias("pos"),
        js.alias("value"),
    )


def media_envelopes(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None) -> DataFrame:
    """One batch request per ``request_id``: ``{"items":[...]}`` in ``pos``
    order (at most ITEMS_PER_REQUEST items by construction); every 37th
    request is sent as a bare array and every 39th with text after it, which are
    no valid envelopes, and every 41st without items, which is one."""
    raw = raw if raw is not None else media_raw(spark, sf_dir)
    grouped = raw.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("xs")
    )
    body = F.concat_ws(",", F.transform("xs", lambda x: x["value"]))
    text = F.when(
        F.col("request_id") % BARE_ARRAY_EVERY == 5, F.concat(F.lit("["), body, F.lit("]"))
    ).when(F.col("request_id") % EMPTY_EVERY == 7, F.lit('{"items":[]}')).otherwise(F.concat(F.lit('{"items":['), body, F.lit("]}")))
    junk = F.when(F.col("request_id") % JUNK_EVERY == 11, F.lit("]junk")).otherwise(F.lit(""))
    return grouped.select("request_id", F.concat(text, junk).alias("value"))


# -- fixture model --------------------------------------------------------------------
def fixture_nodes(
    spark: SparkSession, feature_names: list[str], n_trees: int, depth: int,
    categorical: list[str], tree_offset: int = 0,
) -> DataFrame:
    """Complete binary trees; children 2i+1 / 2i+2; for tree t (shifted by
    ``tree_offset``) and node i: feature F[(7t+3i) % |F|], threshold
    ((13t+5i) % 97)/97, leaf ((31t+17i) % 201 - 100)/1000, missing -> yes;
    categorical features split on category set [(t+i) % 3]."""
    per_tree = 2 ** (depth + 1) - 1
    first_leaf = 2 ** depth - 1
    nf = len(feature_names)
    feats = F.array(*[F.lit(f) for f in feature_names])
    ids = spark.range(n_trees * per_tree)
    tree = (F.col("id") / per_tree).cast("bigint")
    node = F.col("id") % per_tree
    t = tree + tree_offset
    feat = F.element_at(feats, ((7 * t + 3 * node) % nf + 1).cast("int"))
    is_leaf = node >= first_leaf
    is_cat = feat.isin(list(categorical))
    return ids.select(
        tree.cast("int").alias("tree_id"),
        node.cast("int").alias("node_id"),
        F.when(~is_leaf, feat).alias("feature"),
        F.when(is_leaf, "leaf").when(is_cat, "cat").otherwise("num").alias("kind"),
        F.when(~is_leaf & ~is_cat, ((13 * t + 5 * node) % 97) / 97).cast("float").alias("threshold"),
        F.when(~is_leaf & is_cat, F.array(((t + node) % 3).cast("int"))).alias("categories"),
        F.when(~is_leaf, 2 * node + 1).cast("int").alias("yes_id"),
        F.when(~is_leaf, 2 * node + 2).cast("int").alias("no_id"),
        F.when(~is_leaf, 2 * node + 1).cast("int").alias("missing_id"),
        F.when(is_leaf, ((31 * t + 17 * node) % 201 - 100) / 1000).cast("float").alias("leaf"),
    )
