"""Text helpers: the category value cleaner and the printed-array parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediascore.functions.letters import lower, non_word

# Fixed values of the cleaner: a "word" character is a letter, a number or
# the underscore; every other character becomes "_", runs of "_" collapse to
# one, and "_" is stripped from both ends.
UNDERSCORE_RUN = r"_+"
EDGE_UNDERSCORES = r"^_+|_+$"

# Fixed values of the printed-array parser: characters stripped from both ends
# of the whole string and of every token, and the whitespace set that splits
# tokens (the characters Python's str.split() treats as whitespace).
ARRAY_EDGE_CHARS = "[]'\""
TOKEN_EDGE_CHARS = "'\""
WHITESPACE_RUN = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def clean_value(c: Column) -> Column:
    """lower -> non-word chars to '_' -> collapse '_' runs -> strip '_'."""
    # most values are plain ASCII, which needs neither the whole class nor the mapping of newer letters
    plain = F.regexp_replace(F.lower(c), "[^0-9a-z_]", "_")
    out = F.when(F.octet_length(c) == F.length(c), plain).otherwise(F.regexp_replace(lower(c), non_word(), "_"))
    out = F.regexp_replace(out, UNDERSCORE_RUN, "_")
    return F.regexp_replace(out, EDGE_UNDERSCORES, "")


def clean_values(arr: Column) -> Column:
    """Clean every non-null, non-empty element of an ARRAY<STRING>.

    Null and '' elements are dropped first, so membership tests on the result
    never see a null (``array_contains`` is three-valued otherwise).  A null
    array stays null.
    """
    kept = F.filter(arr, lambda x: x.isNotNull() & (x != F.lit("")))
    return F.transform(kept, clean_value)


def parse_printed_array(s: Column) -> Column:
    """Parse a printed array such as ``"['genre_drama' 'genre_crime'\\n 'x']"``.

    Strip any of ``[ ] ' "`` from both ends, split on whitespace, strip quotes
    from every token and drop empty tokens.  Commas are not separators.
    """
    body = F.btrim(s, F.lit(ARRAY_EDGE_CHARS))
    tokens = F.split(body, WHITESPACE_RUN)
    stripped = F.transform(tokens, lambda t: F.btrim(t, F.lit(TOKEN_EDGE_CHARS)))
    return F.filter(stripped, lambda t: t != F.lit(""))
