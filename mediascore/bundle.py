"""The frozen artifact bundle a scoring job runs with.

Artifacts are tables.  The ones that parameterise the projection (the
normalisation table, the category schema, the vocabularies and the model's
node table) are bounded by the model width, not by the data: they are read
on the driver behind a size check and frozen into one immutable object, which
is swapped atomically on refresh (never field by field).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mediascore.schema import CATEGORICAL_FIELDS

# Upper bounds for driver-side artifacts.  They bound model width, not data.
MAX_NORMALIZATION_ROWS = 10_000
MAX_SCHEMA_COLUMNS = 100_000
MAX_VOCAB_ROWS = 1_000_000
# Larger vocabularies stay tables whose codes are joined, larger models are scored shard by shard.
MAX_MODEL_NODES = 5_000_000
# Codes are compared as FLOAT features: from here on they would not be exact.
MAX_CODE = 2**24


class ArtifactError(Exception):
    """An artifact is missing, empty, oversized or inconsistent."""


class ArtifactReadError(ArtifactError):
    """An artifact could not be read just now (missing or unreachable files):
    worth another try, unlike bad content."""


class IncompleteUpload(ArtifactReadError):
    """A version's upload has not ended, or its tables are not those its manifest names."""


def bounded_collect(df: DataFrame, max_rows: int, what: str) -> list:
    """Collect a small artifact table, refusing one that is larger than its
    documented bound (the check itself reads at most ``max_rows + 1`` rows)."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ArtifactError(f"{what}: more than {max_rows} rows; not a bounded artifact")
    return rows


def bounded_arrow(df: DataFrame, max_rows: int, what: str) -> pa.Table:
    """``bounded_collect`` into Arrow columns, without an object for each row."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        raise ArtifactError(f"{what}: more than {max_rows} rows; not a bounded artifact")
    return table


@dataclass(frozen=True)
class TreeArrays:
    """A tree ensemble flattened to global node arrays (one entry per node)."""

    feature: np.ndarray  # int32 feature index, -1 on leaves
    threshold: np.ndarray  # float32
    yes: np.ndarray  # int32 global node id
    no: np.ndarray
    missing: np.ndarray
    leaf: np.ndarray  # float32, 0 on internal nodes
    is_cat: np.ndarray  # bool
    cat_row: np.ndarray  # int32 row in cat_table, -1 when not categorical
    cat_table: np.ndarray  # bool [n_cat_nodes, n_codes] (empty when cat_keys is used)
    roots: np.ndarray  # int32 global id of every tree's root
    depth: int
    cat_keys: np.ndarray | None = None  # sorted cat_row * cat_width + code, for large tables
    cat_width: int = 1
    n_cat: int = 0
    tree_id: np.ndarray | None = None  # int64, the numbers that a node has in its table
    node_id: np.ndarray | None = None

    @property
    def n_trees(self) -> int:
        return int(self.roots.shape[0])


@dataclass(frozen=True)
class Bundle:
    """Everything the feature projection and the scorer need, frozen."""

    model_name: str
    version: str
    run_id: str
    normalization: dict[str, tuple[float, float]]
    category_schema: tuple[tuple[str, tuple[str, ...]], ...]
    vocab: dict[str, dict[str, int]]
    feature_names: tuple[str, ...]
    trees: TreeArrays | None
    nodes: pa.Table | None = field(default=None, repr=False)  # the node table's columns (expression scorer)
    base_margin: float = 0.0
    categorical_features: tuple[str, ...] = tuple(CATEGORICAL_FIELDS)
    categorical_mode: str = "vocab"  # 'vocab' codes, or 'local' (code 0 for any value)
    maps: dict[str, dict[str, str]] = field(default_factory=dict)  # list column -> category -> encoded column

    vocab_table: DataFrame | None = field(default=None, repr=False, compare=False)  # (column, value, code) of vocabularies over MAX_VOCAB_ROWS
    more_trees: tuple[TreeArrays, ...] = field(default=(), repr=False)  # further shards of a model over MAX_MODEL_NODES
    large_columns: tuple[str, ...] = ()  # the columns of vocab_table

    # -- derived ---------------------------------------------------------------
    def category_maps(self) -> dict[str, dict[str, str]]:
        """Per list column of the schema; a column whose names map nothing has an empty map."""
        return {oc: self.maps.get(oc, {}) for oc, _ in self.category_schema}

    def coded_columns(self) -> tuple[str, ...]:
        """Categoricals whose codes are joined; 'local' codes need no vocabulary."""
        return self.large_columns if self.categorical_mode == "vocab" else ()

    def with_model(self, version: str, run_id: str, trees: TreeArrays, nodes: pa.Table | None, base_margin: float = 0.0) -> "Bundle":
        return replace(self, version=version, run_id=run_id, trees=trees, nodes=nodes, base_margin=base_margin, more_trees=())
