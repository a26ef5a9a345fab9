"""Lax scalar typing for raw (text) JSON values.

Raw scalars are read as STRING (``from_json`` into INT would turn "1994" and
1994.0 into null, and into DECIMAL(5,3) would round 8.71234 silently).  Every
helper returns ``(value, type_ok)``: ``value`` is null when the text is null
or unparsable, ``type_ok`` is false only when text is present but unparsable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE_DECIMAL = T.DecimalType(38, 18)
_PLAIN_DECIMAL = r"^[+-]?[0-9]*\.?[0-9]*$"
_FRACTION_DIGITS = r"\.([0-9]*?)0*$"
#: Integers as text: white space around, single underscores between digits, a fraction of zeros.
INTEGER_TEXT = r"\A\p{IsWhite_Space}*([+-]?[0-9]+(?:_[0-9]+)*)(?:\.0+)?\p{IsWhite_Space}*\z"
#: Decimals as text, once underscores and the white space around are gone.
DECIMAL_TEXT = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_AROUND = r"\A[\p{IsWhite_Space}\x1c-\x1f]+|[\p{IsWhite_Space}\x1c-\x1f]+\z|_"


def lax_int(s: Column, target: T.DataType = T.LongType()) -> tuple[Column, Column]:
    """Integer from text: 1994, "1994", 1994.0, "1994.0", "1_994" (the scan
    gives JSON booleans as 1 and 0, and JSON numbers without an exponent).

    Rejects fractional values (1994.5), exponents in a text ("1e2"), empty text
    and non-numbers.
    """
    digits = F.regexp_extract(s, INTEGER_TEXT, 1)
    value = F.when(digits != "", F.replace(digits, F.lit("_"), F.lit("")).try_cast(T.LongType()).try_cast(target))
    return value, s.isNull() | value.isNotNull()


def _decimal_text(s: Column) -> Column:
    return F.regexp_replace(s, _AROUND, "")


def lax_decimal(s: Column) -> tuple[Column, Column]:
    """Decimal from a JSON number or numeric text, exponents and underscores
    allowed; NaN, inf and booleans are rejected."""
    text = _decimal_text(s)
    d = F.when(text.rlike(DECIMAL_TEXT), text.try_cast(WIDE_DECIMAL))
    return d, s.isNull() | d.isNotNull()


def decimal_scale_ok(s: Column, d: Column, places: int) -> Column:
    """At most ``places`` fractional digits, trailing zeros not counted.

    Checked on the parsed value and, for plain decimal text, on the text as
    well (parsing into DECIMAL(38,18) rounds digits beyond the 18th).
    """
    by_value = d == F.round(d, places)
    text = _decimal_text(s)
    frac = F.regexp_extract(text, _FRACTION_DIGITS, 1)
    by_text = F.when(text.rlike(_PLAIN_DECIMAL), F.length(frac) <= F.lit(places)).otherwise(F.lit(True))
    return by_value & by_text
