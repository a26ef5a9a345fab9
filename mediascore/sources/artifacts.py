"""Artifact scans: normalisation table, category schema, vocabularies, model.

Artifacts are read with Spark (JSON list files or any table) and collected to
the driver behind a size bound -- they parameterise one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediascore.bundle import (
    MAX_CODE,
    MAX_MODEL_NODES,
    MAX_NORMALIZATION_ROWS,
    MAX_SCHEMA_COLUMNS,
    MAX_VOCAB_ROWS,
    ArtifactError,
    ArtifactReadError,
    Bundle,
    IncompleteUpload,
    bounded_arrow,
    bounded_collect,
)
from mediascore.functions.text import parse_printed_array
from mediascore.operators.category import category_names
from mediascore.operators.trees import tree_arrays

NODE_SCHEMA = T.StructType(
    [
        T.StructField("tree_id", T.IntegerType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("feature", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("threshold", T.FloatType()),
        T.StructField("categories", T.ArrayType(T.IntegerType())),
        T.StructField("yes_id", T.IntegerType()),
        T.StructField("no_id", T.IntegerType()),
        T.StructField("missing_id", T.IntegerType()),
        T.StructField("leaf", T.FloatType()),
    ]
)


# -- JSON artifact files ------------------------------------------------------
def read_json_artifact(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON list file (``[{...}, ...]``) as a table, rows in file order."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json_artifact(table: DataFrame, path: str) -> None:
    """Write a small artifact table as ONE JSON list file (the exchange
    format of artifact stores).  The table is bounded (an artifact), so it is
    gathered into a single task on purpose; the size is checked first."""
    n = table.limit(MAX_VOCAB_ROWS + 1).count()
    if n > MAX_VOCAB_ROWS:
        raise ArtifactError(f"{n} rows is not an artifact-sized table")
    body = table.select(F.to_json(F.struct(*[F.col(c) for c in table.columns])).alias("j")).agg(
        F.concat(F.lit("["), F.concat_ws(",", F.collect_list("j")), F.lit("]")).alias("value")
    )
    body.coalesce(1).write.mode("overwrite").text(path)


# -- normalisation ------------------------------------------------------------
def normalization_rows(table: DataFrame, pos: str | None = None) -> DataFrame:
    """(feature, min, max) as DOUBLE, one row for each feature: of several the
    one with the highest position wins.  ``pos`` names the position column;
    without one it is the row's place in the table as Spark reads it (an
    artifact file is one partition, read in order)."""
    place = F.col(pos) if pos else F.monotonically_increasing_id()
    rows = table.select(
        F.col("feature").cast("string").alias("feature"),
        F.col("min").cast("double").alias("min"),
        F.col("max").cast("double").alias("max"),
        place.alias("pos"),
    )
    last = F.max_by(F.struct("min", "max"), "pos")
    return rows.groupBy("feature").agg(last.alias("w")).select("feature", "w.min", "w.max")


def load_normalization(table: DataFrame, pos: str | None = None) -> dict[str, tuple[float, float]]:
    """feature -> (min, max)."""
    out: dict[str, tuple[float, float]] = {}
    for r in bounded_collect(normalization_rows(table, pos), MAX_NORMALIZATION_ROWS, "normalization table"):
        if r["feature"] is None or r["min"] is None or r["max"] is None:
            raise ArtifactError(f"normalization row incomplete: {r}")
        out[r["feature"]] = (float(r["min"]), float(r["max"]))
    return out


# -- category schema -----------------------------------------------------------
def category_schema_rows(table: DataFrame) -> DataFrame:
    """(original_column, column_names ARRAY<STRING>) whatever the form: the
    long form has a row for each column_name; in the list form
    ``exploded_mapping`` is a list or a printed array string.
    """
    if is_long(table):
        return table.select(F.col("original_column").cast("string").alias("original_column"), F.array(F.col("column_name").cast("string")).alias("column_names"))
    mapping = table.schema["exploded_mapping"].dataType
    cols = F.col("exploded_mapping")
    parsed = cols if isinstance(mapping, T.ArrayType) else parse_printed_array(cols.cast("string"))
    return table.select(F.col("original_column").cast("string").alias("original_column"), parsed.alias("column_names"))


def is_long(table: DataFrame) -> bool:
    """Whether a category schema has a row for each encoded column; its names go by name."""
    return "column_name" in table.columns


def category_schema_from_long(long_table: DataFrame) -> DataFrame:
    """The list form of a long (original_column, column_name) schema table,
    names sorted within each column: the exchange format, in which a column's
    names are one value.  The library itself keeps the long form."""
    return long_table.groupBy("original_column").agg(
        F.sort_array(F.collect_list("column_name")).alias("exploded_mapping")
    ).orderBy("original_column")


def _schema_size(rows: DataFrame) -> None:
    """The names are counted before any are collected."""
    total = rows.agg(F.sum(F.greatest(F.size("column_names"), F.lit(1)))).first()[0] or 0
    if total > MAX_SCHEMA_COLUMNS:
        raise ArtifactError(f"category schema: {total} encoded columns exceed {MAX_SCHEMA_COLUMNS}")


def load_category_schema(table: DataFrame) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(original column, encoded names): the list form in table order, the long
    form by column and name."""
    rows = category_schema_rows(table)
    _schema_size(rows)
    found = rows.collect()
    if not is_long(table):
        return tuple((r["original_column"], tuple(r["column_names"] or ())) for r in found)
    names: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["original_column"], r["column_names"])):
        names.setdefault(r["original_column"], []).extend(r["column_names"])
    return tuple((c, tuple(n)) for c, n in names.items())


def load_category_maps(table: DataFrame) -> dict[str, dict[str, str]]:
    """Per original column: category -> encoded column, in schema order; of
    names with the same category the last wins."""
    rows = category_schema_rows(table)
    _schema_size(rows)
    named = category_names(rows).where(F.col("category").isNotNull()).collect()
    out: dict[str, dict[str, str]] = {}
    for r in sorted(named, key=lambda r: (r["original_column"], r["name"]) if is_long(table) else r["pos"]):
        out.setdefault(r["original_column"], {})[r["category"]] = r["name"]
    return out


# -- vocabularies ---------------------------------------------------------------
def load_vocab(table: DataFrame) -> dict[str, dict[str, int]]:
    """column -> value -> code of a bounded vocabulary table."""
    out: dict[str, dict[str, int]] = {}
    for r in bounded_collect(table.select("column", "value", "code"), MAX_VOCAB_ROWS, "vocabulary"):
        out.setdefault(r["column"], {})[r["value"]] = int(r["code"])
    return out


def large_vocabularies(table: DataFrame, bound: int = MAX_VOCAB_ROWS) -> tuple[str, ...]:
    """The columns of a vocabulary table with more values than ``bound``, which
    stay in the table; all others together must not exceed it."""
    n = {r["column"]: (r["n"], r["code"]) for r in table.groupBy("column").agg(F.count("*").alias("n"), F.max("code").alias("code")).collect()}
    for c, (_, code) in n.items():
        if code is not None and code > MAX_CODE:
            raise ArtifactError(f"vocabulary of {c!r}: codes over {MAX_CODE} have no exact FLOAT value")
    left, large = sum(k for k, _ in n.values()), []
    for c in sorted(n, key=lambda c: -n[c][0]):
        if left > bound:
            large.append(c)
            left -= n[c][0]
    return tuple(large)


# -- model ------------------------------------------------------------------------
def load_model(nodes: DataFrame, feature_names: list[str], categorical: list[str]):
    """Node table -> (TreeArrays, its columns in Arrow).  An empty node table
    is an artifact error (a broken version must never replace a good one)."""
    table = bounded_arrow(nodes.select(*NODE_SCHEMA.fieldNames()), MAX_MODEL_NODES, "model nodes")
    if not table.num_rows:
        raise ArtifactError("model has no nodes")
    return tree_arrays(table, feature_names, categorical), table


def load_shards(nodes: DataFrame, feature_names: list[str], categorical: list[str], shard_nodes: int = MAX_MODEL_NODES):
    """(shards of TreeArrays, the node table's columns where there is one
    shard): whole trees in order, at most ``shard_nodes`` nodes a shard.  The
    driver holds a shard's columns at a time, and a count for each tree."""
    if nodes.limit(shard_nodes + 1).count() <= shard_nodes:
        trees, table = load_model(nodes, feature_names, categorical)
        return (trees,), table
    counts = bounded_collect(nodes.groupBy("tree_id").agg(F.count("*").alias("n")), 1_000_000, "trees of the model")
    cuts, held = [], shard_nodes
    for r in sorted(counts, key=lambda r: r["tree_id"]):
        if r["n"] > shard_nodes:
            raise ArtifactError(f"tree {r['tree_id']}: {r['n']} nodes do not fit a shard of {shard_nodes}")
        if held + r["n"] > shard_nodes:
            cuts.append(r["tree_id"])
            held = 0
        held += r["n"]
    shards = []
    for first, end in zip(cuts, [*cuts[1:], None]):
        own = nodes.where((F.col("tree_id") >= first) & (F.lit(True) if end is None else F.col("tree_id") < end))
        shards.append(tree_arrays(own.select(*NODE_SCHEMA.fieldNames()).toArrow(), feature_names, categorical))
    return tuple(shards), None


def build_bundle(
    *,
    normalization: DataFrame,
    category_schema: DataFrame,
    vocab: DataFrame,
    nodes: DataFrame,
    feature_names: list[str],
    model_name: str = "model",
    version: str = "1",
    run_id: str = "",
    base_margin: float = 0.0,
    categorical_mode: str = "vocab",
) -> Bundle:
    """Read every artifact table and freeze them into one Bundle."""
    norm = load_normalization(normalization)
    schema = load_category_schema(category_schema)
    large = large_vocabularies(vocab)
    voc = load_vocab(vocab.where(~F.col("column").isin(*large)) if large else vocab)
    if not feature_names:
        raise ArtifactError("model has no feature names")
    from mediascore.schema import CATEGORICAL_FIELDS

    (trees, *more), node_rows = load_shards(nodes, list(feature_names), CATEGORICAL_FIELDS)
    return Bundle(
        model_name=model_name, version=str(version), run_id=run_id,
        normalization=norm, category_schema=schema, vocab=voc,
        feature_names=tuple(feature_names), trees=trees, nodes=node_rows,
        base_margin=float(base_margin), categorical_mode=categorical_mode,
        maps=load_category_maps(category_schema), more_trees=tuple(more),
        vocab_table=vocab.where(F.col("column").isin(*large)) if large else None, large_columns=large,
    )


# -- a versioned artifact folder -------------------------------------------------------
META_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("run_id", T.StringType()), T.StructField("base_margin", T.DoubleType()),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
])


MANIFEST_SCHEMA = T.StructType([
    T.StructField("artifact", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("digest", T.StringType()),
])
#: What a version's folder holds, and whether as a JSON list or as parquet.
ARTIFACTS = {"normalization": "json", "schema": "parquet", "vocab": "parquet", "meta": "json", "nodes": "parquet"}


def save_bundle_artifacts(root: str, version: str, *, normalization: DataFrame, category_schema: DataFrame,
                          vocab: DataFrame, nodes: DataFrame, feature_names: list[str], model_name: str,
                          run_id: str = "", base_margin: float = 0.0) -> str:
    """Write one model version as ``<root>/<version>/{normalization,meta}``
    (JSON list files) and ``{schema,vocab,nodes}`` (parquet, written in
    parallel), and last of all ``manifest``, which says what a whole upload holds."""
    spark = nodes.sparkSession
    path = f"{root.rstrip('/')}/{version}"
    write_json_artifact(normalization, path + "/normalization")
    category_schema.write.mode("overwrite").parquet(path + "/schema")
    vocab.write.mode("overwrite").parquet(path + "/vocab")
    meta = spark.createDataFrame([(model_name, str(version), run_id, float(base_margin), list(feature_names))], META_SCHEMA)
    write_json_artifact(meta, path + "/meta")
    nodes.select(*NODE_SCHEMA.fieldNames()).write.mode("overwrite").parquet(path + "/nodes")
    write_json_artifact(_states({name: _read(spark, path, name) for name in ARTIFACTS}), path + "/manifest")
    return path


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    if ARTIFACTS[name] == "json":
        return read_json_artifact(spark, f"{path}/{name}", META_SCHEMA if name == "meta" else None)
    return (spark.read.schema(NODE_SCHEMA) if name == "nodes" else spark.read).parquet(f"{path}/{name}")


def _states(tables: dict[str, DataFrame]) -> DataFrame:
    """(artifact, rows, digest) of tables; the digest is the sum of the rows'
    hashes, so the order of rows and columns does not matter."""
    out = None
    for name, t in tables.items():
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(t.columns)]))
        total = F.coalesce(F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.lit(0)).cast("string")
        one = t.agg(F.count("*").alias("rows"), total.alias("digest")).select(F.lit(name).alias("artifact"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def artifact_integrity(spark: SparkSession, root: str, version: str) -> DataFrame:
    """(version, artifact, expected_rows, found_rows, reason) of a version's
    tables against its manifest: reason is null where the table is as it was
    written, else ``missing``, ``rows`` or ``content``.  Without a manifest
    the upload has not ended: one row, ``manifest`` and ``unfinished upload``."""
    path = f"{root.rstrip('/')}/{version}"
    schema = "version string, artifact string, expected_rows long, found_rows long, reason string"
    try:
        # five rows
        expected = {r["artifact"]: r for r in bounded_collect(read_json_artifact(spark, path + "/manifest", MANIFEST_SCHEMA), 100, "manifest")}
    except ArtifactError:
        raise
    except Exception:  # no such file yet
        expected = {}
    if not expected:
        return spark.createDataFrame([(str(version), "manifest", None, None, "unfinished upload")], schema)
    tables = {}
    for name in ARTIFACTS:
        try:
            tables[name] = _read(spark, path, name)
        except Exception:  # the folder is not there: reported below
            continue
    found = {r["artifact"]: r for r in _states(tables).collect()} if tables else {}
    rows = []
    for name in ARTIFACTS:
        want, have = expected.get(name), found.get(name)
        reason = "missing" if want is None or have is None else "rows" if want["rows"] != have["rows"] else "content" if want["digest"] != have["digest"] else None
        rows.append((str(version), name, want and want["rows"], have and have["rows"], reason))
    return spark.createDataFrame(rows, schema)


def load_bundle_artifacts(spark: SparkSession, root: str, version: str, categorical_mode: str = "vocab") -> Bundle:
    """Read one model version back into a frozen Bundle, all of it or nothing:
    a version whose manifest is not there yet, or whose tables are not those
    of the manifest, raises IncompleteUpload, which names the table.  An empty
    or inconsistent artifact raises ArtifactError, one that cannot be read now
    ArtifactReadError (the caller keeps its last good bundle)."""
    path = f"{root.rstrip('/')}/{version}"
    try:
        broken = [r for r in artifact_integrity(spark, root, version).collect() if r["reason"]]
        if broken:
            raise IncompleteUpload(f"version {version}: " + "; ".join(f"{r['artifact']}: {r['reason']}" for r in broken))
        meta_rows = bounded_collect(_read(spark, path, "meta"), 1, "model meta")
        if not meta_rows:
            raise ArtifactError(f"version {version}: empty meta")
        meta = meta_rows[0]
        return build_bundle(
            normalization=_read(spark, path, "normalization"),
            category_schema=_read(spark, path, "schema"),
            vocab=_read(spark, path, "vocab"),
            nodes=_read(spark, path, "nodes"),
            feature_names=list(meta["feature_names"] or []),
            model_name=meta["model_name"], version=meta["version"], run_id=meta["run_id"] or "",
            base_margin=meta["base_margin"] or 0.0, categorical_mode=categorical_mode,
        )
    except ArtifactError:
        raise
    except Exception as e:  # unreadable or missing files
        raise ArtifactReadError(f"version {version}: {type(e).__name__}: {str(e)[:200]}") from e
