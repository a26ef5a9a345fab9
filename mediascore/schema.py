"""Record schemas, field groups and the rule table (as data)."""

from __future__ import annotations

from pyspark.sql import types as T

# Typed media record: the 20 fields of the input contract.
MEDIA_SCHEMA = T.StructType(
    [
        T.StructField("imdb_id", T.StringType(), False),
        T.StructField("release_year", T.IntegerType()),
        T.StructField("budget", T.LongType()),
        T.StructField("revenue", T.LongType()),
        T.StructField("runtime", T.LongType()),
        T.StructField("origin_country", T.ArrayType(T.StringType())),
        T.StructField("production_companies", T.ArrayType(T.StringType())),
        T.StructField("production_countries", T.ArrayType(T.StringType())),
        T.StructField("production_status", T.StringType()),
        T.StructField("original_language", T.StringType()),
        T.StructField("spoken_languages", T.ArrayType(T.StringType())),
        T.StructField("genre", T.ArrayType(T.StringType())),
        T.StructField("tagline", T.StringType()),
        T.StructField("overview", T.StringType()),
        T.StructField("tmdb_rating", T.DecimalType(5, 3)),
        T.StructField("tmdb_votes", T.LongType()),
        T.StructField("rt_score", T.IntegerType()),
        T.StructField("metascore", T.IntegerType()),
        T.StructField("imdb_rating", T.DecimalType(4, 1)),
        T.StructField("imdb_votes", T.LongType()),
    ]
)
FIELDS = [f.name for f in MEDIA_SCHEMA.fields]
FIELD_TYPES = {f.name: f.dataType for f in MEDIA_SCHEMA.fields}

LIST_FIELDS = [n for n in FIELDS if isinstance(FIELD_TYPES[n], T.ArrayType)]
INT_FIELDS = [n for n in FIELDS if isinstance(FIELD_TYPES[n], (T.IntegerType, T.LongType))]
DECIMAL_FIELDS = [n for n in FIELDS if isinstance(FIELD_TYPES[n], T.DecimalType)]
STRING_FIELDS = [n for n in FIELDS if isinstance(FIELD_TYPES[n], T.StringType)]

CORRUPT_COL = "_corrupt_record"

# Names of the JSON type rules that a scanned record breaks (ARRAY<STRING>).
TYPES_COL = "_types"
TEXT_FIELDS = [f.name for f in MEDIA_SCHEMA.fields if isinstance(f.dataType, T.StringType)]

# Fixed values of the input contract.
CONTINUOUS_FIELDS = [
    "release_year", "budget", "revenue", "runtime",
    "tmdb_rating", "tmdb_votes", "rt_score", "metascore",
    "imdb_rating", "imdb_votes",
]
DROPPED_FIELDS = ["production_companies", "tagline", "overview"]
CATEGORICAL_FIELDS = ["production_status", "original_language"]
NORM_SUFFIX = "_norm"

# Validation rules, in report order: (rule name, field, kind, arguments).
RULES: list[tuple[str, str, str, tuple]] = [
    ("imdb_id:required", "imdb_id", "required", ()),
    ("imdb_id:type", "imdb_id", "json_type", ()),
    ("imdb_id:pattern", "imdb_id", "pattern", (r"\Att[0-9]{7,8}\z",)),
    ("release_year:type", "release_year", "int_type", ()),
    ("release_year:range", "release_year", "range", (1900, 2100)),
    ("budget:type", "budget", "int_type", ()),
    ("budget:range", "budget", "range", (0, None)),
    ("revenue:type", "revenue", "int_type", ()),
    ("revenue:range", "revenue", "range", (0, None)),
    ("runtime:type", "runtime", "int_type", ()),
    ("runtime:range", "runtime", "range", (0, None)),
    ("origin_country:type", "origin_country", "json_type", ()),
    ("origin_country:element_type", "origin_country", "json_type", ()),
    ("origin_country:null_element", "origin_country", "no_null_elements", ()),
    ("origin_country:element_length", "origin_country", "element_length_eq", (2,)),
    ("production_companies:type", "production_companies", "json_type", ()),
    ("production_companies:element_type", "production_companies", "json_type", ()),
    ("production_companies:null_element", "production_companies", "no_null_elements", ()),
    ("production_countries:type", "production_countries", "json_type", ()),
    ("production_countries:element_type", "production_countries", "json_type", ()),
    ("production_countries:null_element", "production_countries", "no_null_elements", ()),
    ("production_countries:element_length", "production_countries", "element_length_eq", (2,)),
    ("production_status:type", "production_status", "json_type", ()),
    ("production_status:max_length", "production_status", "max_length", (25,)),
    ("original_language:type", "original_language", "json_type", ()),
    ("original_language:max_length", "original_language", "max_length", (2,)),
    ("original_language:length", "original_language", "length_eq", (2,)),
    ("spoken_languages:type", "spoken_languages", "json_type", ()),
    ("spoken_languages:element_type", "spoken_languages", "json_type", ()),
    ("spoken_languages:null_element", "spoken_languages", "no_null_elements", ()),
    ("spoken_languages:element_length", "spoken_languages", "element_length_eq", (2,)),
    ("genre:type", "genre", "json_type", ()),
    ("genre:element_type", "genre", "json_type", ()),
    ("genre:null_element", "genre", "no_null_elements", ()),
    ("genre:element_length", "genre", "element_max_length", (20,)),
    ("tagline:type", "tagline", "json_type", ()),
    ("tagline:max_length", "tagline", "max_length", (255,)),
    ("overview:type", "overview", "json_type", ()),
    ("tmdb_rating:type", "tmdb_rating", "decimal_type", ()),
    ("tmdb_rating:range", "tmdb_rating", "range", (0, 10)),
    ("tmdb_rating:scale", "tmdb_rating", "scale", (3,)),
    ("tmdb_votes:type", "tmdb_votes", "int_type", ()),
    ("tmdb_votes:range", "tmdb_votes", "range", (0, None)),
    ("rt_score:type", "rt_score", "int_type", ()),
    ("rt_score:range", "rt_score", "range", (0, 100)),
    ("metascore:type", "metascore", "int_type", ()),
    ("metascore:range", "metascore", "range", (0, 100)),
    ("imdb_rating:type", "imdb_rating", "decimal_type", ()),
    ("imdb_rating:range", "imdb_rating", "range", (0, 100)),
    ("imdb_rating:scale", "imdb_rating", "scale", (1,)),
    ("imdb_votes:type", "imdb_votes", "int_type", ()),
    ("imdb_votes:range", "imdb_votes", "range", (0, None)),
]
RULE_NAMES = [r[0] for r in RULES]
MALFORMED_RULE = "record:malformed_json"
