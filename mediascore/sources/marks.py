"""Small texts in the shared folder that a stream's driver leaves for its
successor, each replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def read_mark(spark: SparkSession, path: str) -> str | None:
    """The text at ``path``, or None where there is none."""
    _, where, fs = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_mark(spark: SparkSession, path: str, text: str) -> None:
    """Write beside ``path`` and rename over it: a reader sees the old text or the new one."""
    hadoop, where, fs = _at(spark, path)
    beside = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    over = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(where), over)


def drop_mark(spark: SparkSession, path: str) -> None:
    _, where, fs = _at(spark, path)
    fs.delete(where, False)
