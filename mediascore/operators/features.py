"""Feature engineering: one projection built from the frozen artifacts.

Order (the consumer contract): min-max normalise -> drop unused text columns
-> multi-hot encode list columns -> single-value categorical codes -> numeric
null fill -> align to the model's feature order -> numeric coercion.  Every
step is a narrow projection; nothing here shuffles.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediascore.bundle import ArtifactError, Bundle
from mediascore.functions.text import clean_values
from mediascore.operators.codes import with_codes
from mediascore.operators.trees import qcol
from mediascore.schema import CONTINUOUS_FIELDS, DROPPED_FIELDS, NORM_SUFFIX

FEATURE_ERRORS = "feature_errors"
MAX_LITERAL_VOCAB = 50_000
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _with(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.withColumns(cols) if cols else df


def _add_errors(df: DataFrame, checks: list[Column]) -> DataFrame:
    if not checks:
        return df
    new = F.filter(F.array(*checks), lambda e: e.isNotNull())
    if FEATURE_ERRORS in df.columns:
        new = F.concat(F.col(FEATURE_ERRORS), new)
    return df.withColumn(FEATURE_ERRORS, new)


# C1-C3 ---------------------------------------------------------------------------
def normalize_minmax(df: DataFrame, bundle: Bundle, fields=CONTINUOUS_FIELDS) -> DataFrame:
    """``<f>_norm = (x - min) / (max - min)`` for the fields present in both the
    artifact and the input; null -> 0.0 (same as min); no clamping.

    A degenerate range (max == min) never divides: x = min or null -> 0.0,
    any other value adds a ``<f>:degenerate_range`` entry to feature_errors.
    """
    cols: dict[str, Column] = {}
    checks: list[Column] = []
    for f in fields:
        if f not in bundle.normalization or f not in df.columns:
            continue
        mn, mx = bundle.normalization[f]
        x = qcol(f).cast("double")
        if mx != mn:
            cols[f + NORM_SUFFIX] = F.when(x.isNotNull(), (x - F.lit(mn)) / F.lit(mx - mn)).otherwise(F.lit(0.0))
        else:
            cols[f + NORM_SUFFIX] = F.lit(0.0)
            checks.append(F.when(x.isNotNull() & (x != F.lit(mn)), F.lit(f + ":degenerate_range")))
    return _add_errors(_with(df, cols), checks)


# C10 -------------------------------------------------------------------------------
def drop_unused(df: DataFrame) -> DataFrame:
    """Drop the free-text columns the model does not use (no-op if absent)."""
    return df.drop(*[c for c in DROPPED_FIELDS if c in df.columns])


# C7-C9 -----------------------------------------------------------------------------
def encoded_columns(bundle: Bundle) -> list[str]:
    """Names the encoder emits, in emission order."""
    out = []
    maps = bundle.category_maps()
    for oc, names in bundle.category_schema:
        out.extend(maps[oc].values() if maps[oc] else names)
    return out


def cleaned_lists(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Adds ``__clean_<c>``, every schema list column cleaned once."""
    emitted = encoded_columns(bundle)
    clash = set(emitted) & set(df.columns)
    dup = {c for c, n in Counter(emitted).items() if n > 1}
    if clash or dup:
        raise ArtifactError(f"encoded column names collide: {sorted(clash | dup)}")
    helpers: dict[str, Column] = {}
    for oc, _ in bundle.category_schema:
        if oc in df.columns:
            if not isinstance(df.schema[oc].dataType, T.ArrayType):
                raise ArtifactError(f"category schema names non-list column {oc!r}")
            helpers[f"__clean_{oc}"] = clean_values(qcol(oc))
    return _with(df, helpers)


def multi_hot_encode(df: DataFrame, bundle: Bundle) -> DataFrame:
    """One 0/1 INT column per mapped category of every schema list column.

    1 when any non-null, non-empty input value cleans to the category; unknown
    values are ignored; a missing, null or empty list gives all zeros; when no
    category of a column could be mapped, every schema name is emitted as 0.
    Each list is cleaned once into a helper column.
    """
    maps = bundle.category_maps()
    staged = cleaned_lists(df, bundle)
    out: list[Column] = []
    for oc, names in bundle.category_schema:
        src = qcol(f"__clean_{oc}") if oc in df.columns else None
        if maps[oc]:
            for cat, name in maps[oc].items():
                v = F.lit(0) if src is None else F.coalesce(F.array_contains(src, F.lit(cat)), F.lit(False)).cast("int")
                out.append(v.alias(name))
        else:
            out.extend(F.lit(0).alias(n) for n in names)
    return staged.select(*[qcol(c) for c in df.columns], *out)


# C11 --------------------------------------------------------------------------------
def single_value_category(df: DataFrame, bundle: Bundle) -> DataFrame:
    """production_status / original_language -> INT code (null when absent,
    null or unseen).  ``categorical_mode='local'`` gives 0 for any non-null
    value (the one-row-frame behaviour)."""
    cols = {}
    for c in bundle.categorical_features:
        if c not in df.columns:
            cols[c] = F.lit(None).cast("int")
            continue
        x = qcol(c).cast("string")
        if bundle.categorical_mode == "local":
            cols[c] = F.when(x.isNotNull(), F.lit(0))
            continue
        vocab = bundle.vocab.get(c, {})
        if not vocab:
            cols[c] = F.lit(None).cast("int")
            continue
        if len(vocab) > MAX_LITERAL_VOCAB:
            raise ArtifactError(f"vocabulary of {c!r} has {len(vocab)} values (> {MAX_LITERAL_VOCAB})")
        pairs = []
        for k, v in sorted(vocab.items(), key=lambda kv: kv[1]):
            pairs += [F.lit(k), F.lit(int(v))]
        cols[c] = F.try_element_at(F.create_map(*pairs), x).cast("int")
    return _with(df, cols)


# C12 ---------------------------------------------------------------------------------
def fill_numeric(df: DataFrame, bundle: Bundle, keep=()) -> DataFrame:
    """Null -> 0 on numeric columns; categorical codes stay null (missing), and
    so do the carried columns ``keep`` (keys and positions)."""
    numeric = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, _NUMERIC) and f.name not in bundle.categorical_features
        and (f.name not in keep or f.name in bundle.feature_names)
    ]
    return df.na.fill(0, subset=numeric) if numeric else df


# C13 ----------------------------------------------------------------------------------
def align_features(df: DataFrame, bundle: Bundle, keep=("imdb_id",)) -> DataFrame:
    """Exactly the model's features in model order (plus ``keep`` columns):
    missing numeric -> 0, missing categorical -> null, extras dropped."""
    keep = [k for k in keep if k in df.columns and k not in bundle.feature_names]
    cols = [qcol(k) for k in keep]
    for f in bundle.feature_names:
        if f in df.columns:
            cols.append(qcol(f))
        elif f in bundle.categorical_features:
            cols.append(F.lit(None).cast("int").alias(f))
        else:
            cols.append(F.lit(0).alias(f))
    if FEATURE_ERRORS in df.columns and FEATURE_ERRORS not in keep:
        cols.append(F.col(FEATURE_ERRORS))
    return df.select(*cols)


# C14 -----------------------------------------------------------------------------------
def numeric_coerce(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Every non-categorical feature to DOUBLE; unparsable, null or NaN -> 0.0,
    so no numeric feature ever reaches the model missing.  The expression is
    chosen from the column type, so integral and non-null columns get a plain
    cast (small generated code for wide feature lists)."""
    types = {f.name: (f.dataType, f.nullable) for f in df.schema.fields}
    cols = {}
    for f in bundle.feature_names:
        if f in bundle.categorical_features or f not in types:
            continue
        dt, nullable = types[f]
        x = qcol(f)
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            v = F.nanvl(x.cast("double"), F.lit(0.0))
        elif isinstance(dt, _NUMERIC) or isinstance(dt, T.BooleanType):
            v = x.cast("double")
        else:
            v = F.nanvl(x.try_cast("double"), F.lit(0.0))
        cols[f] = F.coalesce(v, F.lit(0.0)) if nullable or not isinstance(dt, _NUMERIC) else v
    return _with(df, cols)


# C15 -----------------------------------------------------------------------------------
def preprocess(df: DataFrame, bundle: Bundle, keep=("imdb_id",)) -> DataFrame:
    """The whole feature pipeline as one chain of narrow projections."""
    out = normalize_minmax(df, bundle)
    out = drop_unused(out)
    out = multi_hot_encode(out, bundle)
    out = single_value_category(out, bundle)
    out = fill_numeric(out, bundle, keep)
    out = align_features(out, bundle, keep=keep)
    return numeric_coerce(out, bundle)


# The scoring form --------------------------------------------------------------------
def sparse_layout(bundle: Bundle, columns: list[str]) -> tuple[list[str], dict[str, dict[str, int]], dict[str, int]]:
    """How a row reaches the scorer without one column for each category:
    (dense features, per list column category -> feature index, per categorical
    its feature index).  A categorical whose column is absent stays missing."""
    index = {f: i for i, f in enumerate(bundle.feature_names)}
    maps = bundle.category_maps()
    encoded = set(encoded_columns(bundle))
    lists = {
        oc: {cat: index[name] for cat, name in maps[oc].items() if name in index}
        for oc, _ in bundle.category_schema
        if oc in columns
    }
    cats = {c: index[c] for c in bundle.categorical_features if c in index and c in columns}
    dense = [f for f in bundle.feature_names if f not in encoded and f not in bundle.categorical_features]
    return dense, lists, cats


def preprocess_sparse(df: DataFrame, bundle: Bundle, keep=("imdb_id",)) -> tuple[DataFrame, list[str], dict[str, dict[str, int]], dict[str, int]]:
    """The feature pipeline up to the scorer's input: the kept columns, the
    dense features, the cleaned lists and the categoricals' text (of a column
    whose vocabulary is a table, the code found by joins).  Its plan and
    cost follow the record, not the model's width; the scorer looks values up
    in its own copy of the category maps and vocabularies."""
    out = cleaned_lists(drop_unused(normalize_minmax(df, bundle)), bundle)
    dense, lists, cats = sparse_layout(bundle, out.columns)
    coded = [c for c in cats if c in bundle.coded_columns()]
    if coded:
        out = with_codes(out, bundle.vocab_table, coded)
    out = _with(out, {f"__cat_{c}": qcol(f"__code_{c}" if c in coded else c).cast("string") for c in cats})
    narrow = replace(bundle, feature_names=tuple(dense))
    extra = [*keep, *[f"__clean_{c}" for c in lists], *[f"__cat_{c}" for c in cats]]
    out = align_features(fill_numeric(out, narrow, extra), narrow, keep=extra)
    return numeric_coerce(out, narrow), dense, lists, cats
