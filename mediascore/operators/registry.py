"""Model registry as tables: version resolution, pinning, metadata, summary.

``versions(model_name, version, stage, run_id, status, description,
creation_timestamp, last_updated_timestamp, tags MAP)`` and
``runs(run_id, metrics MAP<STRING,DOUBLE>, params MAP<STRING,STRING>)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediascore.bundle import ArtifactError

# Fixed stage precedence for "latest": Production, then Staging, then None.
STAGES = ["Production", "Staging", "None"]


def stage_rank(stage: Column) -> Column:
    r = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(STAGES))):
        r = F.when(stage == F.lit(s), F.lit(i)).otherwise(r)
    return F.when(stage.isNull(), F.lit(STAGES.index("None"))).otherwise(r)


def latest_model_version(versions: DataFrame) -> DataFrame:
    """Per model: the version in the best stage, highest version number first
    (numbers compare as numbers: 10 beats 9).  One aggregate, map-side
    combined; versions in other stages are ignored."""
    rank = stage_rank(F.col("stage"))
    order = F.struct(rank.alias("r"), (-F.col("version").cast("bigint")).alias("v"))
    return (
        versions.where(rank.isNotNull())
        .groupBy("model_name")
        .agg(F.min_by(F.struct(*versions.columns), order).alias("_v"))
        .select("_v.*")
    )


def pinned_version(versions: DataFrame, model_name: str, version: str | None) -> DataFrame:
    """``None`` or 'latest' -> the latest version; otherwise exactly that one."""
    mine = versions.where(F.col("model_name") == F.lit(model_name))
    if version is None or version == "latest":
        return latest_model_version(mine)
    return mine.where(F.col("version") == F.lit(str(version)))


def resolve_version(versions: DataFrame, model_name: str, version: str | None = None) -> str:
    """Driver-side resolution (one row): the version string to load."""
    rows = pinned_version(versions, model_name, version).select("version").limit(2).collect()
    if not rows:
        raise ArtifactError(f"no version {version or 'latest'} of model {model_name!r}")
    return rows[0]["version"]


def folded_runs(metrics: DataFrame, params: DataFrame) -> DataFrame:
    """(run_id, metrics MAP, params MAP) from a store's rows: ``metrics``
    (run_id, key, value, step, timestamp), of which each key's last value by
    step, then timestamp, counts (the greatest of equal ones), and ``params``
    (run_id, key, value), one for each key.  Both are combined before the
    shuffle: a run with most of the rows costs a row for each key and task."""
    last = metrics.where(F.col("key").isNotNull()).groupBy("run_id", "key").agg(F.max_by("value", F.struct("step", "timestamp", "value")).alias("value"))
    m = last.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metrics"))
    one = params.where(F.col("key").isNotNull()).groupBy("run_id", "key").agg(F.max("value").alias("value"))
    p = one.groupBy(F.col("run_id").alias("p_run")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("params"))
    both = m.join(p, F.col("run_id").eqNullSafe(F.col("p_run")), "full_outer")
    empty = lambda kind: F.map_from_entries(F.array().cast(f"array<struct<key:string,value:{kind}>>"))
    return both.select(F.coalesce("run_id", "p_run").alias("run_id"), F.coalesce("metrics", empty("double")).alias("metrics"), F.coalesce("params", empty("string")).alias("params"))


def model_metadata(versions: DataFrame, runs: DataFrame, model_name: str, version: str | None = None) -> DataFrame:
    """Version row joined to its run: stamps, status, description, tags,
    run metrics and params.  The run side is one row per run; it is
    broadcast only behind AQE's runtime size check (no hint)."""
    return with_runs(pinned_version(versions, model_name, version), runs)


def with_runs(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Version rows with their run's metrics and params (null where no run is known)."""
    return versions.join(runs, on="run_id", how="left").select(
        "model_name", "version", "run_id", "stage", "status", "description",
        "creation_timestamp", "last_updated_timestamp", "tags",
        F.col("metrics").alias("run_metrics"), F.col("params").alias("run_params"),
    )


def artifact_summary(normalization: DataFrame, schema_rows: DataFrame, feature_names: DataFrame, nodes: DataFrame,
                     version: str, run_id: str) -> DataFrame:
    """Counts of every artifact of a model version, how many encoded columns
    each list column of the schema (original_column, column_names) has, whether the version is healthy and, if not, why: an
    artifact that is empty.  The tables are tagged, unioned and counted by one
    aggregation (no join); a list column with an empty list still counts."""

    def tagged(df: DataFrame, kind: str, item: Column | None = None, n: Column | None = None) -> DataFrame:
        item, n = F.lit(None) if item is None else item, F.lit(1) if n is None else n
        return df.select(F.lit(kind).alias("kind"), item.cast("string").alias("item"), n.cast("bigint").alias("n"))

    schema = tagged(schema_rows, "schema", F.col("original_column"), F.coalesce(F.array_size("column_names"), F.lit(0)))
    trees = nodes.select("tree_id").distinct()
    parts = tagged(normalization, "norm").unionByName(schema).unionByName(tagged(feature_names, "feature")).unionByName(tagged(trees, "tree"))
    n = parts.groupBy("kind", "item").agg(F.sum("n").alias("n"))
    kind = F.col("kind")

    def total(k: str) -> Column:
        return F.coalesce(F.sum(F.when(kind == k, F.col("n"))), F.lit(0)).cast("bigint")

    per_column = F.array_sort(F.collect_list(F.when(kind == "schema", F.concat("item", F.lit("="), F.col("n").cast("string")))))
    out = n.agg(
        total("feature").alias("features_count"),
        total("norm").alias("normalization_fields"),
        F.coalesce(F.sum(F.when(kind == "schema", 1)), F.lit(0)).cast("bigint").alias("schema_mappings"),
        F.array_join(per_column, "|").alias("categories"),
        total("tree").alias("n_trees"),
    )
    why = F.concat_ws("; ", *[
        F.when(F.col(c) == 0, F.lit(text))
        for c, text in (("features_count", "no model features"), ("normalization_fields", "empty normalization table"),
                        ("schema_mappings", "empty category schema"), ("n_trees", "no model trees"))
    ])
    return out.select(F.lit(version).alias("model_version"), F.lit(run_id).alias("run_id"), "*",
                      (why == "").alias("healthy"), F.when(why != "", why).alias("reason"))
