"""A registry fixture: model ``m1`` with versions in several stages.

Version v's trees are the fixture model shifted by v (``tree_offset``), over
artifacts fitted from the data; version 11 is a broken upload (no nodes) used
to show that a refresh keeps the last good model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "m1"
# Fixed values of the fixture: (version, stage) rows.
GOOD_VERSIONS = [("1", "None"), ("2", "Staging"), ("9", "Production"), ("10", "Production")]
BROKEN_VERSION = ("11", "Production")

VERSIONS_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("stage", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("creation_timestamp", T.LongType()), T.StructField("last_updated_timestamp", T.LongType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])
RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
])


def registry_versions(spark: SparkSession, include_broken: bool = False) -> DataFrame:
    rows = GOOD_VERSIONS + ([BROKEN_VERSION] if include_broken else [])
    data = [
        (MODEL, v, s, f"run-{v}", "READY", f"fixture version {v}", 1_700_000_000_000 + int(v) * 1000,
         1_700_000_000_000 + int(v) * 2000, {"stage": s, "tree_offset": v})
        for v, s in rows
    ]
    return spark.createDataFrame(data, VERSIONS_SCHEMA)


def registry_runs(spark: SparkSession, n_trees: int, depth: int) -> DataFrame:
    rows = GOOD_VERSIONS + [BROKEN_VERSION]
    data = [
        (f"run-{v}", {"n_trees": float(n_trees), "depth": float(depth)}, {"tree_offset": v})
        for v, _ in rows
    ]
    return spark.createDataFrame(data, RUNS_SCHEMA)


def supplier_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry that grows with the data: suppliers as model versions, those
    of a nation being one model's; account balances give the stage."""
    s = spark.read.parquet(f"{sf_dir.rstrip('/')}/supplier.parquet")
    version = F.col("s_suppkey").cast("string")
    stage = F.when(F.col("s_acctbal") > 8000, "Production").when(F.col("s_acctbal") > 4000, "Staging").when(F.col("s_acctbal") > 0, "None").otherwise("Archived")
    return s.select(
        F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("model_name"), version.alias("version"), stage.alias("stage"),
        F.concat(F.lit("run-"), (F.col("s_suppkey") % 50).cast("string")).alias("run_id"), F.lit("READY").alias("status"), F.col("s_name").alias("description"),
        F.col("s_suppkey").alias("creation_timestamp"), (F.col("s_suppkey") * 2).alias("last_updated_timestamp"), F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("tags"),
    )


def event_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Metric and parameter rows of runs as a store holds them: every event is
    a value of a metric (its type) of its user's run, every order's priority a
    parameter of its customer's run."""
    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    run = lambda c: F.concat(F.lit("run-"), (F.col(c) % 50).cast("string"))
    metrics = e.select(run("user_id").alias("run_id"), F.col("event_type").alias("key"), "value", (F.col("event_id") % 97).alias("step"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"))
    o = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    params = o.select(run("o_custkey").alias("run_id"), F.concat(F.lit("priority-"), F.col("o_orderstatus")).alias("key"), F.col("o_orderpriority").alias("value"))
    return metrics, params
