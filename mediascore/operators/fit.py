"""Artifact producers fitted by Spark jobs over the data.

All three are one scan with map-side partial aggregation; what reaches the
shuffle is one row per (column, distinct value) per task, so a hot value (even
a third of all rows) costs one row per task, not one row per record.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mediascore.functions.text import clean_values
from mediascore.operators.trees import qcol
from mediascore.session import materialize
from mediascore.schema import CATEGORICAL_FIELDS, CONTINUOUS_FIELDS
from mediascore.sources.marks import read_mark, write_mark

ENCODED_LIST_FIELDS = ["genre", "origin_country", "production_countries", "spoken_languages"]


def fit_normalization(df: DataFrame, fields=CONTINUOUS_FIELDS) -> DataFrame:
    """(feature, min, max) over the whole input, one aggregation pass.
    Fields with no non-null value are left out."""
    present = [f for f in fields if f in df.columns]
    aggs = []
    for i, f in enumerate(present):
        x = qcol(f).cast("double")
        aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"mn{i}").alias("min"), F.col(f"mx{i}").alias("max"))
        for i, f in enumerate(present)
    ])
    return wide.select(F.inline(rows)).where(F.col("min").isNotNull())


def fit_category_schema_long(df: DataFrame, columns=ENCODED_LIST_FIELDS) -> DataFrame:
    """(original_column, category, column_name) for every distinct cleaned,
    non-empty value of every list column."""
    present = [c for c in columns if c in df.columns]
    def tag(c: str):
        return lambda v: F.struct(F.lit(c).alias("original_column"), v.alias("category"))

    pairs = F.flatten(F.array(*[
        F.transform(F.coalesce(clean_values(qcol(c)), F.array().cast("array<string>")), tag(c))
        for c in present
    ]))
    return (
        df.select(F.inline(pairs))
        .where(F.col("category") != F.lit(""))
        .distinct()
        .withColumn("column_name", F.concat(F.col("original_column"), F.lit("_"), F.col("category")))
    )


def fit_category_schema(df: DataFrame, columns=ENCODED_LIST_FIELDS) -> DataFrame:
    """The artifact form: one row per list column with its sorted column names.
    The list is bounded by that column's distinct categories (after the
    distinct), never by the row count."""
    from mediascore.sources.artifacts import category_schema_from_long

    return category_schema_from_long(fit_category_schema_long(df, columns))


def fit_category_vocab(df: DataFrame, columns=CATEGORICAL_FIELDS) -> DataFrame:
    """(column, value, code): code = rank of the value in the sorted distinct
    vocabulary of its column, from 0."""
    present = [c for c in columns if c in df.columns]
    vals = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("value")) for c in present
    ]))).where(F.col("value").isNotNull()).distinct()
    return numbered(vals)


def numbered(values: DataFrame) -> DataFrame:
    """Adds ``code``, the rank from 0 of each distinct (column, value) within
    its column.  The values are range-partitioned and sorted, and a value's
    rank is its place in its partition plus the counts of the column's earlier
    partitions: no task sorts a whole column, only the counts (a row for each
    column and partition) meet."""
    placed = materialize(
        values.select("column", "value").repartitionByRange("column", "value").sortWithinPartitions("column", "value")
        .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()),
        "vocabulary",
    )
    parts = placed.groupBy("column", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("column", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(parts, ["column", "part"]).select("column", "value", (F.col("at") - F.col("first") + F.col("before")).cast("int").alias("code"))


def fit_artifacts(df: DataFrame, fields=CONTINUOUS_FIELDS, list_columns=ENCODED_LIST_FIELDS,
                  categorical=CATEGORICAL_FIELDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three artifacts from ONE scan and ONE aggregation.

    Every row is unpivoted into tagged facts -- (norm, field, null, x) for the
    continuous fields, (cat, column, cleaned value) per list element, (voc,
    column, value) for the categoricals -- and grouped by (kind, column,
    value) with min/max.  The result is as small as the artifacts (fields +
    distinct categories + distinct vocabulary values); it is written once to
    the shared folder and the three tables are read from it.
    """
    summary = materialize(_summary(df, fields, list_columns, categorical).groupBy("kind", "column", "value").agg(F.min("x").alias("min"), F.max("x").alias("max")), "fitted-artifacts")
    return _artifacts(summary)


def _summary(df: DataFrame, fields, list_columns, categorical, *keep: str) -> DataFrame:
    """The tagged facts (kind, column, value, x) of every row, beside the columns ``keep``."""
    nums = [f for f in fields if f in df.columns]
    lists = [c for c in list_columns if c in df.columns]
    cats = [c for c in categorical if c in df.columns]

    def fact(kind, column, value, x):
        return F.struct(F.lit(kind).alias("kind"), F.lit(column).alias("column"),
                        value.cast("string").alias("value"), x.cast("double").alias("x"))

    def tag(c):
        return lambda v: fact("cat", c, v, F.lit(None))

    empty = F.array().cast("array<string>")
    facts = F.flatten(F.array(
        F.array(*[fact("norm", f, F.lit(None), qcol(f)) for f in nums]) if nums else F.array().cast("array<struct<kind:string,column:string,value:string,x:double>>"),
        *[F.transform(F.coalesce(clean_values(qcol(c)), empty), tag(c)) for c in lists],
        F.array(*[fact("voc", c, qcol(c), F.lit(None)) for c in cats]) if cats else F.array().cast("array<struct<kind:string,column:string,value:string,x:double>>"),
    ))
    told = (F.col("kind") == "norm") | (F.col("value").isNotNull() & (F.col("value") != F.lit("")))
    return df.select(*keep, F.inline(facts)).where(told)


def _artifacts(summary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three artifacts of (kind, column, value, min, max)."""
    norm = summary.where((F.col("kind") == "norm") & F.col("min").isNotNull()).select(
        F.col("column").alias("feature"), "min", "max")
    schema_long = summary.where(F.col("kind") == "cat").select(
        F.col("column").alias("original_column"), F.col("value").alias("category"),
        F.concat(F.col("column"), F.lit("_"), F.col("value")).alias("column_name"))
    return norm, schema_long, numbered(summary.where(F.col("kind") == "voc"))


def _by_file(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """The records of parquet files (key: path) beside the key as ``file``.
    Files of the same schema are one scan, which tells each record's file, so
    the plan grows with the schemas and not with the files."""
    alike: dict[str, tuple[StructType, list[str]]] = {}
    for path in files.values():
        schema = spark.read.parquet(path).schema
        alike.setdefault(schema.json(), (schema, []))[1].append(path)
    told = None
    for schema, paths in alike.values():
        records = spark.read.schema(schema).parquet(*paths)
        one = records.select("*", records.metadataColumn("_metadata")["file_path"].alias("__path"))
        told = one if told is None else told.unionByName(one, allowMissingColumns=True)
    # paths as the scan spells them
    spelt = lambda f: spark._jvm.org.apache.hadoop.fs.Path(_status(spark, f).getPath().toString()).toUri().toString()
    keys = spark.createDataFrame([(spelt(f), k) for k, f in files.items()], "__of string, file string")
    key = F.coalesce("file", F.raise_error(F.concat(F.lit("not a new file: "), F.col("__path"))))
    return told.join(F.broadcast(keys), F.col("__path") == F.col("__of"), "left").withColumn("file", key).drop("__path", "__of")


def _status(spark: SparkSession, f: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)


def fit_incremental(spark: SparkSession, files: list[str], state: str, read=None, fields=CONTINUOUS_FIELDS,
                    list_columns=ENCODED_LIST_FIELDS, categorical=CATEGORICAL_FIELDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The artifacts of the records in ``files``, of which only those are read
    that ``state``, a folder, does not know from an earlier fit.

    The state holds for each file (path, length and change time) the smallest
    and largest number of every field and the distinct values of every column,
    which merge with those of any other files and can be taken away again.  A
    fit writes the new files' part and then the index of what counts, which is
    replaced as a whole: a fit that is lost half-way leaves the state as it
    was.  ``read`` turns a list of paths into records and is called for each
    file; without it they are parquet files, and many are read at once.  The
    driver holds the index, some hundred bytes for each file."""
    marked = read_mark(spark, f"{state}/index")
    known: dict[str, str] = json.loads(marked) if marked else {}
    now: dict[str, str] = {}  # file key -> path
    for f in files:
        status = _status(spark, f)
        now[hashlib.sha256(f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}".encode()).hexdigest()[:32]] = f
    new = [k for k in now if k not in known]
    if new:
        part = uuid.uuid4().hex
        told = _by_file(spark, {k: now[k] for k in new}) if read is None else None
        for k in new if read else ():
            one = read([now[k]]).select("*", F.lit(k).alias("file"))
            told = one if told is None else told.unionByName(one, allowMissingColumns=True)
        # a file's summary is far smaller than the file
        rows = _summary(told, fields, list_columns, categorical, "file")
        rows.groupBy("file", "kind", "column", "value").agg(F.min("x").alias("min"), F.max("x").alias("max")).write.parquet(f"{state}/part={part}")
        known |= dict.fromkeys(new, part)
    known = {k: part for k, part in known.items() if k in now}
    write_mark(spark, f"{state}/index", json.dumps(known))
    parts = sorted(set(known.values()))
    schema = "file string, kind string, column string, value string, min double, max double"
    states = spark.read.schema(schema).parquet(*[f"{state}/part={p}" for p in parts]) if parts else spark.createDataFrame([], schema)
    counted = spark.createDataFrame([(k,) for k in known], "file string")
    merged = states.join(F.broadcast(counted), "file").groupBy("kind", "column", "value").agg(F.min("min").alias("min"), F.max("max").alias("max"))
    return _artifacts(materialize(merged, "fitted-artifacts"))
