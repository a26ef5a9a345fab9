"""Codes of single-value categoricals by joins, for vocabularies too large to
send to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediascore.operators.trees import qcol
from mediascore.session import materialize

#: So many of a column's most frequent values are looked up once and broadcast with their codes.
HOT_VALUES = 1000


def with_codes(df: DataFrame, vocab: DataFrame, columns: list[str], hot: int = HOT_VALUES) -> DataFrame:
    """Adds ``__code_<c>`` (int, null for a null or unknown value) for each of
    ``columns``, from ``vocab`` (column, value, code; one row for a value).

    A value may be that of a third of all rows: the ``hot`` most frequent ones
    are counted (combined before the shuffle) and joined to the vocabulary
    first, a bounded table that is broadcast; only rows with another value are
    shuffled to the vocabulary.  Rows are neither lost nor doubled."""
    for c in columns:
        text = qcol(c).cast("string")
        known = vocab.where(F.col("column") == c).select(F.col("value").alias("__value"), F.col("code").cast("int").alias("__known"))
        most = df.where(text.isNotNull()).groupBy(text.alias("__often")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "__often").limit(hot)
        often = materialize(most.join(known, F.col("__often") == F.col("__value"), "left").select("__often", F.col("__known").alias("__code")), "codes")
        told = df.join(F.broadcast(often), text == F.col("__often"), "left")
        settled = F.col("__often").isNotNull() | text.isNull()
        here = told.where(settled).withColumn(f"__code_{c}", F.col("__code")).drop("__often", "__code")
        rest = told.where(~settled).drop("__often", "__code").join(known, text == F.col("__value"), "left")
        df = here.unionByName(rest.withColumn(f"__code_{c}", F.col("__known")).drop("__value", "__known"))
    return df
