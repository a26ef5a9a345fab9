r"""Which characters are word characters.

The cleaner's contract is Python's ``\w`` and ``str.lower``.  The JVM's
classes follow an older or newer Unicode, so what the two tell apart is looked
up once for a process: the JVM's regular expressions and Spark's lower are run
over all code points and compared with Python's, and the few that differ are
added to the class, or mapped, as intervals.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

JVM_WORD = r"\p{L}\p{N}_"


def intervals(characters: str) -> str:
    """A regular expression's ranges of the characters, in order."""
    points = sorted(map(ord, characters))
    out, first = [], 0
    for i, c in enumerate(points):
        if i + 1 == len(points) or points[i + 1] != c + 1:
            out.append(rf"\x{{{points[first]:X}}}-\x{{{c:X}}}")
            first = i + 1
    return "".join(out)


@lru_cache(maxsize=1)
def differences() -> tuple[str, str, str, str, str]:
    """(word characters that the JVM's class lacks, those it has too many,
    letters that Spark's lower leaves alone, their small forms, and letters
    for Spark's lower that are none here)."""
    spark = SparkSession.active()
    jvm = spark._jvm
    word = re.compile(r"\w")
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    own, other = "".join(p for p in points if word.match(p)), "".join(p for p in points if not word.match(p))
    without = lambda text, pattern: jvm.java.util.regex.Pattern.compile(pattern).matcher(text).replaceAll("")
    spark_lower = lambda text: spark.range(1).select(F.lower(F.lit("\n".join(text)))).first()[0].split("\n")
    lacks, extra = without(own, f"[{JVM_WORD}]"), without(other, f"[^{JVM_WORD}]")
    pairs = [(p, p.lower()) for p, low in zip(own, spark_lower(own)) if low == p != p.lower() and len(p.lower()) == 1]
    rest = other.replace("\n", "")
    unknown = "".join(p for p, low in zip(rest, spark_lower(rest)) if low != p.lower())
    return lacks, extra, "".join(a for a, _ in pairs), "".join(b for _, b in pairs), unknown


def non_word() -> str:
    """The regular expression of one character that is no word character."""
    lacks, extra, *_ = differences()
    pattern = f"[^{JVM_WORD}{intervals(lacks)}]"
    return f"{pattern}|[{intervals(extra)}]" if extra else pattern


def lower(c: Column) -> Column:
    _, _, large, small, unknown = differences()
    c = F.lower(F.translate(c, unknown, "_" * len(unknown)) if unknown else c)
    return F.translate(c, large, small) if large else c
