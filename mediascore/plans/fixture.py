"""Artifacts fitted from the fixture media view, and the fixture model.

Fit (three Spark jobs, map-side combined) -> bounded collect -> features
sorted by name -> node table generated by Spark from that list -> Bundle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediascore.bundle import Bundle
from mediascore.operators.features import encoded_columns
from mediascore.operators.fit import fit_artifacts
from mediascore.schema import CATEGORICAL_FIELDS, NORM_SUFFIX
from mediascore.sources.artifacts import (
    build_bundle,
    load_category_maps,
    load_category_schema,
    load_normalization,
)
from mediascore.sources.fixtures import fixture_nodes, media_items_view

ORACLE_TREES, ORACLE_DEPTH = 8, 3
BENCH_TREES, BENCH_DEPTH = 200, 6


def fitted_artifacts(media: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(normalisation, category schema in long form, vocabulary) from one pass."""
    return fit_artifacts(media)


def model_features(normalization: dict, category_schema: tuple, maps: dict) -> list[str]:
    """Normalised fields + every encoded column + the two categoricals,
    sorted by name (the fixture model's feature order)."""
    probe = Bundle("", "", "", normalization, category_schema, {}, (), None, maps=maps)
    names = [f + NORM_SUFFIX for f in normalization] + encoded_columns(probe) + list(CATEGORICAL_FIELDS)
    return sorted(set(names))


def fixture_bundle(
    spark: SparkSession, sf_dir: str, n_trees: int = ORACLE_TREES, depth: int = ORACLE_DEPTH,
    version: str = "1", tree_offset: int = 0, media: DataFrame | None = None,
    model_name: str = "m1", categorical_mode: str = "vocab",
    artifacts: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> Bundle:
    """``artifacts`` may pass already fitted (normalisation, schema,
    vocabulary) tables; otherwise they are fitted from ``media``."""
    if artifacts is None:
        media = media if media is not None else media_items_view(spark, sf_dir)
        artifacts = fitted_artifacts(media)
    norm_df, schema_df, vocab_df = artifacts
    features = model_features(load_normalization(norm_df), load_category_schema(schema_df), load_category_maps(schema_df))
    nodes = fixture_nodes(spark, features, n_trees, depth, CATEGORICAL_FIELDS, tree_offset)
    return build_bundle(
        normalization=norm_df, category_schema=schema_df, vocab=vocab_df, nodes=nodes,
        feature_names=features, model_name=model_name, version=version,
        run_id=f"run-{version}", categorical_mode=categorical_mode,
    )
