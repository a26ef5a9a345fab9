"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers (once for each
    application), as Spark does with any Python file, so that they need no
    installed copy and keep module state between tasks."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="mediascore-ship-"), "mediascore_ship.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def bucket_of(modulus: int) -> Column:
    """The remainder of the crc32 of doc_id as text (null: 0), which tells training from held-out documents."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def text_slices(batch, most: int, column: str = "text"):
    """(first row, slice) of an Arrow batch's texts, about ``most`` bytes at a
    time; a longer text is its own slice."""
    text = batch.column(column)
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size, dtype=np.int64)
    k = 0
    while k < len(text):
        before = end[k - 1] if k else 0
        n = max(1, int(np.searchsorted(end, before + most, "right")) - k)
        yield k, text.slice(k, n)
        k += n


def text_parts(batch, most: int = 1 << 20, column: str = "text"):
    """(first row, texts) of an Arrow batch, about ``most`` bytes at a time; a
    longer text is its own part.  Only a part's texts are made Python strings."""
    for k, text in text_slices(batch, most, column):
        yield k, text.to_pylist()


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII string, bit by bit: a byte is xored in, then eight steps."""
    steps = f"flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split({text}, '')])"
    step = "case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end"
    return f"xor(list_reduce({steps}, lambda a, x: {step}, 4294967295::bigint), 4294967295)"
