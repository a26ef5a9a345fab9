"""Every registered query: ``(spark, sf_dir) -> DataFrame`` over the given
tables (part, lineitem) or data Spark derives from them.

Outputs hold no arrays (lists are '|'-joined), integers are BIGINT and
doubles are rounded to 6 places, so each has a like-for-like DuckDB oracle.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediascore.bundle import Bundle
from mediascore.operators import features as FE
from mediascore.operators.category import category_map_table
from mediascore.operators.fit import (
    ENCODED_LIST_FIELDS,
    fit_category_schema,
    fit_category_schema_long,
    fit_category_vocab,
    fit_incremental,
    fit_normalization,
)
from mediascore.operators.registry import artifact_summary, folded_runs, latest_model_version, model_metadata, resolve_version, with_runs
from mediascore.operators.trees import qcol, sparse_scores
from mediascore.operators.validate import (
    accept_envelopes,
    envelope_rejections,
    validate,
    validate_report,
    validate_split_quarantine,
    validate_split_valid,
)
from mediascore.plans.fixture import ORACLE_DEPTH, ORACLE_TREES, fitted_artifacts, fixture_bundle
from mediascore.plans.predict import outcomes, predict, request_outcomes, results_envelope
from mediascore.schema import CONTINUOUS_FIELDS, CORRUPT_COL, FIELDS, INT_FIELDS, LIST_FIELDS, RULES
from mediascore.session import materialize, scratch_path
from mediascore.sources.artifacts import (
    category_schema_rows,
    load_category_maps,
    load_category_schema,
    load_model,
    load_normalization,
    load_shards,
    normalization_rows,
)
from mediascore.sources.fixtures import ITEMS_PER_REQUEST, fixture_nodes, media_envelopes, media_items, media_items_view, media_raw
from mediascore.sources.records import ENVELOPE, envelope_items, scan_batch_envelope, scan_json_records
from mediascore.sources.registry_fixture import MODEL, event_runs, registry_runs, registry_versions, supplier_registry

R6 = 6


def _r(c: Column) -> Column:
    return F.round(c.cast("double"), R6)


def _joined(c: str) -> Column:
    return F.array_join(F.col(c), "|").alias(c)


_ARTIFACTS: dict[tuple, tuple[DataFrame, DataFrame, DataFrame]] = {}


def table_state(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """Path, length and change time of the tables' files."""
    out = []
    for f in sorted(p for n in names for p in spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet").inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((f, status.getLen(), status.getModificationTime()))
    return tuple(out)


def artifacts_for(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The fitted artifact tables (written), once for each application and
    state of the tables; all model versions share them."""
    key = (spark.sparkContext.applicationId, table_state(spark, sf_dir, "part", "lineitem"))
    if key not in _ARTIFACTS:
        norm, schema, vocab = fitted_artifacts(media_items_view(spark, sf_dir))
        _ARTIFACTS[key] = (norm, materialize(schema, "schema"), materialize(vocab, "vocab"))
    return _ARTIFACTS[key]


def bundle_for(spark: SparkSession, sf_dir: str, version: str = "1", n_trees: int = ORACLE_TREES,
               depth: int = ORACLE_DEPTH, mode: str = "vocab") -> Bundle:
    """The fixture bundle for a registry version."""
    return fixture_bundle(spark, sf_dir, n_trees, depth, version=version, tree_offset=version_offset(version),
                          categorical_mode=mode, artifacts=artifacts_for(spark, sf_dir))


def version_offset(version: str) -> int:
    """Version v of the fixture model is the base model shifted by v - 1 trees."""
    return int(version) - 1


# -- sources -------------------------------------------------------------------------
def q_media_items(spark, sf):
    m = media_items_view(spark, sf)
    cols = []
    for n in FIELDS:
        if n in LIST_FIELDS:
            cols.append(_joined(n))
        elif n in INT_FIELDS:
            cols.append(F.col(n).cast("bigint").alias(n))
        elif n in ("tmdb_rating", "imdb_rating"):
            cols.append(F.col(n).cast("double").alias(n))
        else:
            cols.append(F.col(n))
    return m.select(*cols)


def _raw(spark, sf) -> DataFrame:
    return scan_json_records(media_raw(spark, sf))


def q_scan_json_records(spark, sf):
    r = _raw(spark, sf)
    return r.select(
        F.col("request_id").cast("bigint").alias("request_id"), F.col("pos").cast("bigint").alias("pos"),
        "imdb_id", F.col("release_year").alias("release_year_text"), _joined("genre"), _joined("origin_country"),
        "original_language", F.col(CORRUPT_COL).isNotNull().alias("is_corrupt"),
    )


def _envelopes(spark, sf) -> DataFrame:
    return scan_batch_envelope(media_envelopes(spark, sf))


def q_scan_batch_envelope(spark, sf):
    e = _envelopes(spark, sf)
    ok = F.col("items").isNotNull()
    return e.select(
        F.col("request_id").cast("bigint").alias("request_id"),
        ok.alias("is_envelope"),
        F.when(ok, F.size("items")).cast("bigint").alias("n_items"),
        F.when(ok, F.array_join(F.transform("items", lambda x: x["imdb_id"]), "|")).alias("ids"),
    )


def q_media_typed(spark, sf):
    """The typed-table path: any record table, no validation."""
    from mediascore.sources.records import typed_records

    return typed_records(media_items_view(spark, sf).drop("tagline", "overview")).select(
        "imdb_id", F.col("release_year").cast("bigint").alias("release_year"),
        F.col("tagline").isNull().alias("tagline_absent"), F.col("overview").isNull().alias("overview_absent"),
    )


# -- validation ------------------------------------------------------------------------
def _validated(spark, sf, rules=RULES) -> DataFrame:
    return validate(_raw(spark, sf), rules)


def _keys() -> list[Column]:
    return [F.col("request_id").cast("bigint").alias("request_id"), F.col("pos").cast("bigint").alias("pos")]


def q_parse_typed(spark, sf):
    v = _validated(spark, sf)
    return v.select(
        *_keys(), "imdb_id",
        *[F.col(n).cast("bigint").alias(n) for n in ("release_year", "budget", "rt_score")],
        *[F.col(n).cast("double").alias(n) for n in ("tmdb_rating", "imdb_rating")],
    )


def _rule_group(group: str) -> list:
    kinds = {
        "id": {"required", "pattern"},
        "ranges": {"range"},
        "decimal_scale": {"scale", "decimal_type"},
        "lengths": {"max_length", "length_eq"},
        "list_elements": {"no_null_elements", "element_length_eq", "element_max_length"},
        "types": {"int_type", "decimal_type", "json_type"},
    }[group]
    return [r for r in RULES if r[2] in kinds]


def _errors_query(group: str):
    def q(spark, sf):
        v = _validated(spark, sf, _rule_group(group))
        return v.select(*_keys(), "imdb_id", F.array_join("errors", "|").alias("errors"))

    q.__name__ = f"q_validate_{group}"
    return q


def q_validate_flags(spark, sf):
    """Absent or null optional fields are valid: validity and how many of the
    19 optional fields each record left out (one pass, no join)."""
    r = _raw(spark, sf)
    n_null = sum(F.when(F.col(n).isNull(), 1).otherwise(0) for n in FIELDS if n != "imdb_id")
    v = validate(r.withColumn("n_null", n_null.cast("bigint")))
    return v.select(*_keys(), "n_null", (F.size("errors") == 0).alias("is_valid"))


def q_validate_report(spark, sf):
    rep = validate_report(_validated(spark, sf))
    return rep.select("rule", F.col("n_rows").cast("bigint").alias("n_rows"))


def q_validate_split_valid(spark, sf):
    v = validate_split_valid(_validated(spark, sf))
    return v.select(
        *_keys(), "imdb_id", F.col("release_year").cast("bigint").alias("release_year"),
        F.col("budget").cast("bigint").alias("budget"), F.col("tmdb_rating").cast("double").alias("tmdb_rating"),
        _joined("genre"),
    )


def q_validate_split_quarantine(spark, sf):
    v = validate_split_quarantine(_validated(spark, sf))
    return v.select(*_keys(), "imdb_id", F.array_join("errors", "|").alias("errors"))


def q_batch_all_or_nothing(spark, sf):
    items = envelope_items(accept_envelopes(_envelopes(spark, sf)))
    return items.select(*_keys(), "imdb_id")


# -- artifacts -----------------------------------------------------------------------------
def _media(spark, sf) -> DataFrame:
    return media_items_view(spark, sf)


def q_fit_normalization(spark, sf):
    return fit_normalization(_media(spark, sf))


def q_fit_category_schema(spark, sf):
    return fit_category_schema_long(_media(spark, sf)).select("original_column", "category", "column_name")


def q_fit_category_vocab(spark, sf):
    v = fit_category_vocab(_media(spark, sf))
    return v.select("column", "value", F.col("code").cast("bigint").alias("code"))


def q_fit_incremental(spark, sf):
    """Records in four folders by part key: a fit of the files of the first
    three, then one of the last three, which reads the new folder's files alone
    and takes the first's away.  A folder has a file for each task that wrote."""
    base = scratch_path(spark, "incremental")
    items = media_items(spark, sf)
    for k in range(4):
        items.where(F.col("p_partkey") % 4 == k).drop("p_partkey").write.parquet(f"{base}/in/{k}")
    files = lambda ks: sorted(f for k in ks for f in spark.read.parquet(f"{base}/in/{k}").inputFiles())
    fit_incremental(spark, files((0, 1, 2)), base + "/state")
    norm, schema, vocab = fit_incremental(spark, files((1, 2, 3)), base + "/state")
    none = lambda kind: F.lit(None).cast(kind)
    return (
        norm.select(F.lit("norm").alias("kind"), F.col("feature").alias("column"), none("string").alias("value"), "min", "max", none("bigint").alias("code"))
        .unionByName(schema.select(F.lit("cat").alias("kind"), F.col("original_column").alias("column"), F.col("category").alias("value"), none("double").alias("min"), none("double").alias("max"), none("bigint").alias("code")))
        .unionByName(vocab.select(F.lit("voc").alias("kind"), "column", "value", none("double").alias("min"), none("double").alias("max"), F.col("code").cast("bigint").alias("code")))
    )


def q_load_normalization(spark, sf):
    fitted = fit_normalization(_media(spark, sf))
    n = len(CONTINUOUS_FIELDS)
    idx = F.array_position(F.array(*[F.lit(f) for f in CONTINUOUS_FIELDS]), F.col("feature"))
    stale = fitted.select("feature", (F.col("min") - 1).alias("min"), (F.col("max") + 1).alias("max"), idx.alias("pos"))
    fresh = fitted.select("feature", "min", "max", (idx + n).alias("pos"))
    return normalization_rows(stale.unionByName(fresh), "pos")


def printed_schema(schema_df: DataFrame) -> DataFrame:
    """Render the list form as printed-array text (the legacy artifact form),
    four names per line."""
    names = F.col("exploded_mapping")
    quoted = F.transform(
        names, lambda x, i: F.concat(F.when((i > 0) & (i % 4 == 0), F.lit("\n ")).otherwise(F.lit("")), F.lit("'"), x, F.lit("'"))
    )
    return schema_df.select(
        "original_column", F.concat(F.lit("["), F.array_join(quoted, " "), F.lit("]")).alias("exploded_mapping")
    )


def q_load_category_schema(spark, sf):
    rows = category_schema_rows(fit_category_schema(_media(spark, sf)))
    return rows.select("original_column", F.explode("column_names").alias("column_name"))


def q_category_map_parse(spark, sf):
    rows = category_schema_rows(printed_schema(fit_category_schema(_media(spark, sf))))
    return rows.select("original_column", F.explode("column_names").alias("column_name"))


def q_category_map_build(spark, sf):
    rows = category_schema_rows(printed_schema(fit_category_schema(_media(spark, sf))))
    return category_map_table(rows).drop("first_pos")


def q_clean_values(spark, sf):
    m = _media(spark, sf)

    def tag(c):
        return lambda v: F.struct(F.lit(c).alias("original_column"), v.alias("value"))

    pairs = F.flatten(F.array(*[F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), tag(c)) for c in ENCODED_LIST_FIELDS]))
    vals = m.select(F.inline(pairs)).where(F.col("value").isNotNull() & (F.col("value") != "")).distinct()
    from mediascore.functions.text import clean_value

    return vals.withColumn("cleaned", clean_value(F.col("value")))


def q_load_model(spark, sf):
    """The model as loaded: the fixture's node table is saved, read back and
    flattened by the loader; every media record is sent through the loaded
    trees, and the leaves that it reaches are joined to the saved nodes."""
    b = bundle_for(spark, sf)
    saved = materialize(fixture_nodes(spark, list(b.feature_names), ORACLE_TREES, ORACLE_DEPTH, list(b.categorical_features)), "nodes")
    trees, nodes = load_model(saved, list(b.feature_names), list(b.categorical_features))
    loaded = b.with_model("1", b.run_id, trees, nodes)
    features, *layout = FE.preprocess_sparse(_media(spark, sf), loaded)
    leaves = features.select(F.explode(sparse_scores(features, loaded, *layout, reached=True)).alias("end"))
    reached = leaves.groupBy("end").agg(F.count(F.lit(1)).alias("n_rows"))
    here = F.shiftleft(F.col("tree_id").cast("bigint"), 32) + F.col("node_id")
    return saved.join(reached, here == F.col("end")).select(
        F.col("tree_id").cast("bigint").alias("tree_id"), F.col("node_id").cast("bigint").alias("node_id"), "kind", _r(saved["leaf"]).alias("value"), "n_rows"
    )


def q_artifact_integrity(spark, sf):
    """Versions against their manifests: 10 is whole; of 12 five trees of
    eight and one vocabulary value have arrived; of 13 a normalisation bound
    is not what was written; the upload of 14 has not ended."""
    from mediascore.sources.artifacts import artifact_integrity, save_bundle_artifacts, write_json_artifact

    root = scratch_path(spark, "artifacts")
    norm, schema, vocab = artifacts_for(spark, sf)
    b = bundle_for(spark, sf, version="10")
    feats = list(b.feature_names)
    nodes = materialize(fixture_nodes(spark, feats, ORACLE_TREES, ORACLE_DEPTH, list(b.categorical_features), version_offset("10")), "nodes")
    for v in ("10", "12", "13"):
        save_bundle_artifacts(root, v, normalization=norm, category_schema=schema, vocab=vocab, nodes=nodes, feature_names=feats, model_name=MODEL, run_id=f"run-{v}")
    nodes.where("tree_id < 5").write.mode("overwrite").parquet(f"{root}/12/nodes")
    vocab.where((F.col("column") == "original_language") & (F.col("code") == 0)).write.mode("overwrite").parquet(f"{root}/12/vocab")
    write_json_artifact(norm.withColumn("max", F.when(F.col("feature") == "runtime", F.col("max") + 1).otherwise(F.col("max"))), f"{root}/13/normalization")
    nodes.write.parquet(f"{root}/14/nodes")
    out = None
    for v in ("10", "12", "13", "14"):
        one = artifact_integrity(spark, root, v)
        out = one if out is None else out.unionByName(one)
    return out


# -- features ---------------------------------------------------------------------------------
def q_normalize_minmax(spark, sf):
    b = bundle_for(spark, sf)
    out = FE.normalize_minmax(_media(spark, sf), b)
    return out.select("imdb_id", *[_r(F.col(f + "_norm")).alias(f + "_norm") for f in CONTINUOUS_FIELDS])


def q_normalize_nulls(spark, sf):
    b = bundle_for(spark, sf)
    m = _media(spark, sf)
    out = FE.normalize_minmax(m, b).where(
        F.col("release_year").isNull() | F.col("budget").isNull() | F.col("revenue").isNull()
    )
    return out.select("imdb_id", *[_r(F.col(f + "_norm")).alias(f + "_norm") for f in ("release_year", "budget", "revenue")])


DEGENERATE_RUNTIME = 40


def q_normalize_degenerate(spark, sf):
    """An artifact fitted where runtime is constant is applied to all rows:
    the value itself maps to 0.0, any other value is reported, never divided."""
    m = _media(spark, sf)
    norm = fit_normalization(m.where(F.col("runtime") == DEGENERATE_RUNTIME), ["runtime"])
    deg = replace(bundle_for(spark, sf), normalization=load_normalization(norm))
    out = FE.normalize_minmax(m, deg)
    return out.select(
        "imdb_id", _r(F.col("runtime_norm")).alias("runtime_norm"),
        F.array_join(F.col(FE.FEATURE_ERRORS), "|").alias("errors"),
    )


def _active(b: Bundle, df: DataFrame, names: list[str]) -> DataFrame:
    arr = F.filter(F.array(*[F.when(qcol(n) == 1, F.lit(n)) for n in sorted(names)]), lambda x: x.isNotNull())
    return df.select("imdb_id", F.array_join(arr, "|").alias("active"), F.size(arr).cast("bigint").alias("n_active"))


def q_multi_hot_encode(spark, sf):
    b = bundle_for(spark, sf)
    enc = FE.multi_hot_encode(FE.drop_unused(_media(spark, sf)), b)
    return _active(b, enc, FE.encoded_columns(b))


def q_encode_empty_map(spark, sf):
    """A schema whose spoken_languages names carry no '_' maps no category of
    that column: every listed name is emitted, all 0, beside the other
    columns' encoding."""
    b = bundle_for(spark, sf)
    m = _media(spark, sf)
    bare = F.transform("exploded_mapping", lambda n: F.substring_index(n, "_", -1))
    schema = fit_category_schema(m).withColumn(
        "exploded_mapping", F.when(F.col("original_column") == "spoken_languages", bare).otherwise(F.col("exploded_mapping"))
    )
    nb = replace(b, category_schema=load_category_schema(schema), maps=load_category_maps(schema))
    enc = FE.multi_hot_encode(FE.drop_unused(m), nb)
    names = dict(nb.category_schema)["spoken_languages"]
    total = sum((qcol(n) for n in names), F.lit(0))
    others = sum((qcol(n) for n in FE.encoded_columns(nb) if n not in names), F.lit(0))
    return enc.select(
        "imdb_id", F.lit(len(names)).cast("bigint").alias("n_columns"), total.cast("bigint").alias("total"), others.cast("bigint").alias("n_active")
    )


def q_encode_missing_column(spark, sf):
    b = bundle_for(spark, sf)
    enc = FE.multi_hot_encode(FE.drop_unused(_media(spark, sf)).drop("genre"), b)
    genre_cols = [n for oc, ns in b.category_schema if oc == "genre" for n in ns]
    total = sum((qcol(n) for n in genre_cols), F.lit(0))
    others = sorted(n for n in FE.encoded_columns(b) if n not in genre_cols)
    arr = F.filter(F.array(*[F.when(qcol(n) == 1, F.lit(n)) for n in others]), lambda x: x.isNotNull())
    return enc.select(
        "imdb_id", F.array_join(arr, "|").alias("active"), F.size(arr).cast("bigint").alias("n_active"),
        total.cast("bigint").alias("genre_total"),
    )


def q_drop_unused(spark, sf):
    out = FE.drop_unused(_media(spark, sf))
    return out.select(
        "imdb_id", F.lit(len(out.columns)).cast("bigint").alias("n_columns"),
        "production_status", "original_language", _joined("genre"),
    )


def q_single_value_category(spark, sf):
    b = bundle_for(spark, sf)
    out = FE.single_value_category(_media(spark, sf), b)
    return out.select("imdb_id", *[F.col(c).cast("bigint").alias(c) for c in b.categorical_features])


def q_fill_numeric(spark, sf):
    b = bundle_for(spark, sf)
    out = FE.fill_numeric(_media(spark, sf), b)
    return out.select("imdb_id", *[F.col(c).cast("bigint").alias(c) for c in ("release_year", "budget", "revenue", "tmdb_votes", "imdb_votes")])


def _long(df: DataFrame, b: Bundle) -> DataFrame:
    """Wide features -> (imdb_id, feature, value) for non-zero or null values."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), qcol(f).cast("double").alias("value")) for f in b.feature_names])
    return df.select("imdb_id", F.inline(pairs)).where(F.col("value").isNull() | (F.col("value") != 0)).select(
        "imdb_id", "feature", _r(F.col("value")).alias("value")
    )


def q_align_features(spark, sf):
    """Input lacking spoken_languages and original_language: missing numeric
    features are 0 (not listed), the missing categorical is null."""
    b = bundle_for(spark, sf)
    m = _media(spark, sf).drop("spoken_languages", "original_language")
    out = FE.align_features(FE.fill_numeric(FE.single_value_category(FE.multi_hot_encode(FE.drop_unused(FE.normalize_minmax(m, b)), b), b), b), b)
    return _long(out, b)


def q_numeric_coerce(spark, sf):
    b = bundle_for(spark, sf)
    out = FE.preprocess(_media(spark, sf), b)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), qcol(f).cast("double").alias("value")) for f in b.feature_names])
    return (
        out.select(F.inline(pairs))
        .groupBy("feature")
        .agg(
            F.sum(F.when(F.col("value") != 0, 1).otherwise(0)).cast("bigint").alias("n_nonzero"),
            F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).cast("bigint").alias("n_null"),
            _r(F.sum("value")).alias("total"),
        )
    )


def q_preprocess(spark, sf):
    b = bundle_for(spark, sf)
    return _long(FE.preprocess(_media(spark, sf), b), b)


# -- scoring ------------------------------------------------------------------------------------
def _scored(spark, sf, version="1", mode="vocab") -> DataFrame:
    return predict(_media(spark, sf), bundle_for(spark, sf, version=version, mode=mode), with_margin=True)


def q_tree_margin(spark, sf):
    return _scored(spark, sf).select("imdb_id", _r(F.col("margin")).alias("margin"))


def q_predict_proba(spark, sf):
    return _scored(spark, sf).select("imdb_id", _r(F.col("probability")).alias("probability"))


def q_predict_label(spark, sf):
    return _scored(spark, sf).select("imdb_id", "prediction")


def q_predict_sharded(spark, sf):
    """The fixture model in shards of at most three trees, with the languages' codes joined from their table."""
    b = bundle_for(spark, sf)
    _, _, vocab = artifacts_for(spark, sf)
    nodes = fixture_nodes(spark, list(b.feature_names), ORACLE_TREES, ORACLE_DEPTH, list(b.categorical_features))
    (first, *more), _ = load_shards(nodes, list(b.feature_names), list(b.categorical_features), shard_nodes=3 * (2 ** (ORACLE_DEPTH + 1) - 1))
    large = ("original_language",)
    sharded = replace(b, trees=first, more_trees=tuple(more), vocab_table=vocab.where(F.col("column").isin(*large)), large_columns=large,
                      vocab={c: v for c, v in b.vocab.items() if c not in large})
    return predict(_media(spark, sf), sharded).select("imdb_id", "prediction", _r(F.col("probability")).alias("probability"))


def q_predict_single(spark, sf):
    """One-record semantics: categoricals coded locally (0 for any value)."""
    return _scored(spark, sf, mode="local").select("imdb_id", "prediction", _r(F.col("probability")).alias("probability"))


def q_predict_batch(spark, sf):
    return _scored(spark, sf).select("imdb_id", "prediction", _r(F.col("probability")).alias("probability"))


def q_results_envelope(spark, sf):
    """Results of every accepted request in input order; a request without
    items comes back with an empty list (one row with nulls here)."""
    items = envelope_items(accept_envelopes(_envelopes(spark, sf)), outer=True)
    scored = predict(items, bundle_for(spark, sf), keep=("request_id", ENVELOPE, "pos", "imdb_id"))
    env = results_envelope(scored)
    return env.select(F.col("request_id").cast("bigint").alias("request_id"), F.posexplode_outer("results").alias("pos", "r")).select(
        "request_id", F.col("pos").cast("bigint").alias("pos"), "r.imdb_id", "r.prediction", _r(F.col("r.probability")).alias("probability")
    )


def _failing(spark, sf) -> DataFrame:
    """Outcomes of all records, ten to a request, with a normalisation table
    whose release_year is constant at its least value: a record of any other
    year cannot be scored, and fails its request."""
    b = bundle_for(spark, sf)
    least = b.normalization["release_year"][0]
    degenerate = replace(b, normalization={**b.normalization, "release_year": (least, least)})
    items = media_items(spark, sf).select(
        (F.col("p_partkey") / ITEMS_PER_REQUEST).cast("bigint").alias("request_id"), (F.col("p_partkey") % ITEMS_PER_REQUEST).cast("int").alias("pos"), *FIELDS
    )
    return request_outcomes(outcomes(items, degenerate, keep=("request_id", "pos", "imdb_id")))


def q_score_failures(spark, sf):
    """The items that failed their requests, and why."""
    bad = _failing(spark, sf).select("request_id", F.inline("failures"))
    return bad.select("request_id", F.col("pos").cast("bigint").alias("pos"), "imdb_id", "reason")


def q_score_answers(spark, sf):
    """The results of the requests without a failing item."""
    good = _failing(spark, sf).where(F.col("results").isNotNull()).select("request_id", F.posexplode("results").alias("pos", "r"))
    return good.select("request_id", F.col("pos").cast("bigint").alias("pos"), "r.imdb_id", "r.prediction", _r(F.col("r.probability")).alias("probability"))


def q_results_by_envelope(spark, sf):
    """Two envelopes share every request_id: each has its own results."""
    items = envelope_items(accept_envelopes(_envelopes(spark, sf).withColumn("request_id", F.expr("request_id div 2"))), outer=True)
    env = results_envelope(predict(items, bundle_for(spark, sf), keep=("request_id", ENVELOPE, "pos", "imdb_id")))
    ids = F.array_join(F.transform("results", lambda r: r["imdb_id"]), "|")
    return env.select("request_id", F.size("results").cast("bigint").alias("n_results"), ids.alias("ids"))


def q_envelope_rejections(spark, sf):
    """Why requests were rejected: request, item position and rule."""
    return envelope_rejections(_envelopes(spark, sf)).select(*_keys(), "rule")


# -- registry ----------------------------------------------------------------------------------------
def _score_version(spark, sf, version: str) -> DataFrame:
    s = _scored(spark, sf, version=version)
    return s.select("imdb_id", F.lit(version).alias("model_version"), _r(F.col("probability")).alias("probability"))


def q_latest_model_version(spark, sf):
    v = resolve_version(registry_versions(spark), MODEL, "latest")
    return _score_version(spark, sf, v)


def q_pinned_version(spark, sf):
    v = resolve_version(registry_versions(spark), MODEL, "9")
    return _score_version(spark, sf, v)


def q_model_metadata(spark, sf):
    """Metadata of the latest version plus metrics Spark measures by scoring
    the data with it, joined by version."""
    versions = registry_versions(spark)
    meta = model_metadata(versions, registry_runs(spark, ORACLE_TREES, ORACLE_DEPTH), MODEL, "latest")
    v = resolve_version(versions, MODEL, "latest")
    stats = _scored(spark, sf, version=v).withColumn("scored_version", F.lit(v)).groupBy("scored_version").agg(
        F.count(F.lit(1)).alias("n_scored"), F.avg(F.col("prediction").cast("double")).alias("positive_rate"),
    )
    return meta.join(stats, F.col("version") == F.col("scored_version"), "left").select(
        "model_name", "version", "run_id", "stage", "status", "description",
        "creation_timestamp", "last_updated_timestamp",
        *[_entries(c) for c in ("tags", "run_metrics", "run_params")],
        "n_scored", _r(F.col("positive_rate")).alias("positive_rate"),
    )


def q_registry_metadata(spark, sf):
    """The latest version of every model of the supplier registry with its
    run's metrics and params, folded from their rows."""
    runs = folded_runs(*event_runs(spark, sf))
    return with_runs(latest_model_version(supplier_registry(spark, sf)), runs).select(
        "model_name", "version", "run_id", "stage", F.array_join(F.array_sort(F.transform(F.map_entries("run_metrics"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 100).cast("bigint").cast("string")))), "|").alias("metrics_x100"),
        _entries("run_params"),
    )


def _entries(c: str) -> Column:
    """A map as sorted key=value text."""
    pairs = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(F.array_sort(pairs), "|").alias(c)


def q_artifact_summary(spark, sf):
    """The summary of version 10 and of version 11, whose node table is empty."""
    norm, schema, _ = artifacts_for(spark, sf)
    out = None
    for v in ("10", "11"):
        b = bundle_for(spark, sf, version=v)
        nodes = fixture_nodes(spark, list(b.feature_names), ORACLE_TREES, ORACLE_DEPTH, list(b.categorical_features), version_offset(v))
        feats = spark.createDataFrame([(f,) for f in b.feature_names], "feature string")
        one = artifact_summary(norm, category_schema_rows(schema), feats, nodes if v == "10" else nodes.limit(0), v, f"run-{v}")
        out = one if out is None else out.unionByName(one)
    return out


# -- streaming -------------------------------------------------------------------------------------------
def _stream_source(spark, sf) -> str:
    """Write the raw JSON lines as several files under the shared folder."""
    path = scratch_path(spark, "streams") + "/source"
    media_raw(spark, sf).select("value").repartition(4).write.text(path)
    return path


def q_stream_score(spark, sf):
    from mediascore.streaming import start_scoring_stream

    b = bundle_for(spark, sf)
    src = _stream_source(spark, sf)
    base = src.rsplit("/", 1)[0]
    start_scoring_stream(spark, b, src, base + "/scored", base + "/ckpt", base + "/quarantine", max_files_per_trigger=1).awaitTermination()
    out = spark.read.parquet(base + "/scored")
    return out.select("imdb_id", "prediction", _r(F.col("probability")).alias("probability"))


def _refreshed(spark, sf) -> str:
    """Three thirds of the requests arrive one after the other, each with a new
    version in the registry and a new driver: 9, then 10, then 11, whose
    upload has not ended, so that 10 goes on.  Versions are loaded from their
    artifact folders; what the drivers hand on lies under the checkpoint.
    Returns the folder of the sinks."""
    from mediascore.sources.artifacts import load_bundle_artifacts, save_bundle_artifacts
    from mediascore.streaming import ModelRefresher, VersionLog, start_refreshing_stream

    root, base = scratch_path(spark, "artifacts"), scratch_path(spark, "streams")
    norm, schema, vocab = artifacts_for(spark, sf)
    b = bundle_for(spark, sf)
    feats = list(b.feature_names)
    for v in ("9", "10", "11"):
        nodes = fixture_nodes(spark, feats, ORACLE_TREES, ORACLE_DEPTH, list(b.categorical_features), version_offset(v))
        if v == "11":
            nodes.write.parquet(f"{root}/{v}/nodes")
        else:
            save_bundle_artifacts(root, v, normalization=norm, category_schema=schema, vocab=vocab, nodes=nodes,
                                  feature_names=feats, model_name=MODEL, run_id=f"run-{v}")
    raw = media_raw(spark, sf)
    for k, newest in enumerate(("9", "10", "11")):
        raw.where(F.col("request_id") % 3 == k).select("value").write.mode("append").text(base + "/source")
        versions = registry_versions(spark, include_broken=True).where(F.col("version").cast("int") <= int(newest))
        refresher = ModelRefresher(None, lambda: resolve_version(versions, MODEL), lambda v: load_bundle_artifacts(spark, root, v),
                                   VersionLog(spark, base + "/ckpt/versions"))
        start_refreshing_stream(spark, refresher, base + "/source", base + "/scored", base + "/ckpt", base + "/quarantine").awaitTermination()
    return base


def _streamed_envelopes(spark, sf) -> str:
    from mediascore.streaming import start_envelope_stream

    base = scratch_path(spark, "streams")
    media_envelopes(spark, sf).repartition(4).write.parquet(base + "/source")
    start_envelope_stream(spark, bundle_for(spark, sf), base + "/source", base, base + "/ckpt", max_files_per_trigger=1).awaitTermination()
    return base


def q_stream_envelopes(spark, sf):
    """Results of envelopes that arrive in a stream: those of the batch."""
    env = spark.read.parquet(_streamed_envelopes(spark, sf) + "/results")
    return env.select("request_id", F.posexplode_outer("results").alias("pos", "r")).select(
        "request_id", F.col("pos").cast("bigint").alias("pos"), "r.imdb_id", "r.prediction", _r(F.col("r.probability")).alias("probability")
    )


def q_stream_envelope_rejections(spark, sf):
    return spark.read.parquet(_streamed_envelopes(spark, sf) + "/rejections").select("request_id", F.col("pos").cast("bigint").alias("pos"), "rule")


def q_stream_model_refresh(spark, sf):
    out = spark.read.parquet(_refreshed(spark, sf) + "/scored")
    return out.select("imdb_id", "model_version", _r(F.col("probability")).alias("probability"))


def q_stream_refresh_quarantine(spark, sf):
    out = spark.read.parquet(_refreshed(spark, sf) + "/quarantine")
    return out.select("imdb_id", "errors")


QUERIES = {
    "media_items": q_media_items,
    "media_typed": q_media_typed,
    "scan_json_records": q_scan_json_records,
    "scan_batch_envelope": q_scan_batch_envelope,
    "parse_typed": q_parse_typed,
    "validate_id": _errors_query("id"),
    "validate_ranges": _errors_query("ranges"),
    "validate_decimal_scale": _errors_query("decimal_scale"),
    "validate_lengths": _errors_query("lengths"),
    "validate_list_elements": _errors_query("list_elements"),
    "validate_types": _errors_query("types"),
    "validate_flags": q_validate_flags,
    "validate_report": q_validate_report,
    "validate_split_valid": q_validate_split_valid,
    "validate_split_quarantine": q_validate_split_quarantine,
    "batch_all_or_nothing": q_batch_all_or_nothing,
    "fit_normalization": q_fit_normalization,
    "fit_category_schema": q_fit_category_schema,
    "fit_category_vocab": q_fit_category_vocab,
    "fit_incremental": q_fit_incremental,
    "load_normalization": q_load_normalization,
    "load_category_schema": q_load_category_schema,
    "load_model": q_load_model,
    "artifact_integrity": q_artifact_integrity,
    "category_map_parse": q_category_map_parse,
    "category_map_build": q_category_map_build,
    "clean_values": q_clean_values,
    "normalize_minmax": q_normalize_minmax,
    "normalize_nulls": q_normalize_nulls,
    "normalize_degenerate": q_normalize_degenerate,
    "multi_hot_encode": q_multi_hot_encode,
    "encode_empty_map": q_encode_empty_map,
    "encode_missing_column": q_encode_missing_column,
    "drop_unused": q_drop_unused,
    "single_value_category": q_single_value_category,
    "fill_numeric": q_fill_numeric,
    "align_features": q_align_features,
    "numeric_coerce": q_numeric_coerce,
    "preprocess": q_preprocess,
    "tree_margin": q_tree_margin,
    "predict_proba": q_predict_proba,
    "predict_label": q_predict_label,
    "predict_sharded": q_predict_sharded,
    "predict_single": q_predict_single,
    "predict_batch": q_predict_batch,
    "results_envelope": q_results_envelope,
    "envelope_rejections": q_envelope_rejections,
    "results_by_envelope": q_results_by_envelope,
    "score_failures": q_score_failures,
    "score_answers": q_score_answers,
    "latest_model_version": q_latest_model_version,
    "pinned_version": q_pinned_version,
    "model_metadata": q_model_metadata,
    "registry_metadata": q_registry_metadata,
    "artifact_summary": q_artifact_summary,
    "stream_score": q_stream_score,
    "stream_envelopes": q_stream_envelopes,
    "stream_envelope_rejections": q_stream_envelope_rejections,
    "stream_model_refresh": q_stream_model_refresh,
    "stream_refresh_quarantine": q_stream_refresh_quarantine,
}
