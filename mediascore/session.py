"""SparkSession helpers.

Nothing here overrides a cluster's settings: values are only filled in when the
session leaves them unset (tests, local runs).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Settings the scoring path relies on, applied only when the session leaves
# them unset.  The feature projection is one wide expression list; HotSpot does
# not JIT methods over 8000 bytes of bytecode, so whole-stage codegen must
# fall back to split per-operator code above that size instead of running a
# huge interpreted method.
RECOMMENDED = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # of a key that a JSON record repeats, the last value counts
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune_session(spark: SparkSession) -> SparkSession:
    for k, v in RECOMMENDED.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "mediascore") -> SparkSession:
    """A local session for tests and benches (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return tune_session(spark)


_LOCAL_FOLDERS: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder the cluster names in ``spark.checkpoint.dir``.

    The setting is only read.  Where it is unset, a single-machine session
    (master ``local``, as in tests) gets one private folder for its lifetime;
    on a cluster, where a machine-local folder would be invisible to the other
    machines, an unset key is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _LOCAL_FOLDERS.get(sc.applicationId)
        if path is None:
            path = _LOCAL_FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="mediascore-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def checkpoint_path(spark: SparkSession, *parts: str) -> str:
    """A sub-path of the shared checkpoint folder (for stream checkpoints and
    written intermediate tables)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, *parts) if "://" not in base else "/".join([base.rstrip("/"), *parts])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the session's JVM ends."""
    path = checkpoint_path(spark, "tables", f"{name}-{uuid.uuid4().hex}")
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df, name: str):
    """Write ``df`` once as parquet under the shared folder and return it read
    back: later jobs reuse it instead of recomputing it, and a lost executor
    re-reads the table instead of replaying the lineage.  The table goes when
    the session's JVM ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
