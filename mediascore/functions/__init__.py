"""Column -> Column helpers (all JVM-side built-in expressions)."""

from mediascore.functions.text import clean_value, clean_values, parse_printed_array  # noqa: F401
from mediascore.functions.typed import lax_decimal, lax_int  # noqa: F401
