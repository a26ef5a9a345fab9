"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass 1 scatters the rows into buckets by a seeded hash of the row's number and
id, so that every row, also one of many equal ones, falls into each bucket
with equal chance and a bucket holds about ``bucket_bytes``.  Pass 2 gathers
one bucket at a time, permutes it (Spark's shuffle function is a Fisher-Yates
shuffle) and writes it.  The buckets in order are the shuffled table; shard k
of n is its k-th part, so shards differ by one row at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def row_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def write_buckets(docs: DataFrame, path: str, seed: int, bucket_bytes: int = 8 << 20) -> None:
    """Both passes.  Writes rows (bucket int, pos int, row struct of all
    columns of ``docs``, whatever their names) as parquet under ``path``; pos
    runs from 0 within a bucket.  Nulls and repeated rows are rows like any
    other; an empty table writes no rows.  A text is never split, so a bucket
    exceeds bucket_bytes by the spread of the hash and its longest texts."""
    total = docs.agg(F.sum(row_size(F.col("text")))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("row_no"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("row_no"), F.col("row.doc_id")), F.lit(buckets)).cast("int")
    dealt = packed.select(bucket.alias("bucket"), "row_no", "row").repartition(int(buckets), "bucket")
    gathered = dealt.groupBy("bucket").agg(F.collect_list(F.struct("row_no", "row")).alias("rows"))
    permuted = gathered.select("bucket", F.shuffle(F.array_sort("rows"), F.lit(seed)).alias("rows"))
    permuted.select("bucket", F.posexplode("rows").alias("pos", "item")).select("bucket", "pos", "item.row").write.parquet(path)


def manifest(spark: SparkSession, path: str, n_shards: int) -> DataFrame:
    """One row for each bucket: bucket, n, before (rows of all buckets before
    it) and total.  Which buckets a shard spans follows from it.  Only counts
    by bucket meet in one task."""
    counts = spark.read.parquet(path).groupBy("bucket").agg(F.count("*").alias("n"))
    ordered = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("bucket", "n", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))


def place(rows: DataFrame, buckets: DataFrame, n_shards: int) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0) to rows with bucket and pos."""
    at = F.col("before") + F.col("pos")
    base, more = F.floor(F.col("total") / n_shards), F.col("total") % n_shards
    big = more * (base + 1)  # rows in the shards that hold one more
    placed = rows.join(buckets, "bucket").withColumn("_at", at).withColumn("_base", base).withColumn("_big", big).withColumn("_more", more)
    first = F.expr("_at < _big")
    return (
        placed.withColumn("shard", F.when(first, F.expr("_at div (_base + 1)")).otherwise(F.expr("_more + (_at - _big) div _base")).cast("int"))
        .withColumn("slot", F.when(first, F.expr("_at % (_base + 1)")).otherwise(F.expr("(_at - _big) % _base")).cast("long"))
        .drop("_at", "_base", "_big", "_more", "n", "before", "total")
    )


def read_shard(spark: SparkSession, path: str, n_shards: int, shard: int) -> DataFrame:
    """The rows of one shard in slot order: slot and the documents' columns."""
    rows = place(spark.read.parquet(path), manifest(spark, path, n_shards), n_shards)
    return rows.where(F.col("shard") == shard).orderBy("slot").select("slot", "row.*")
