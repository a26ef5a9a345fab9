"""Record validation as columns.

Every rule is one boolean expression; the names of all broken rules of a row
are gathered into ``errors ARRAY<STRING>`` (rule order).  Rules are written
against a field getter, so the same rule set runs on flat rows and, inside
``forall``/``exists``, on the elements of an envelope's ``items`` array
(request-level all-or-nothing without any shuffle).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediascore.functions.typed import decimal_scale_ok, lax_decimal, lax_int
from mediascore.operators.trees import qcol
from mediascore.schema import (
    CORRUPT_COL,
    DECIMAL_FIELDS,
    FIELD_TYPES,
    FIELDS,
    INT_FIELDS,
    MALFORMED_RULE,
    RULES,
    TYPES_COL,
)

ERRORS = "errors"
Getter = Callable[[str], Column]


def _typed(get: Getter, name: str) -> tuple[Column, Column]:
    raw = get(name)
    if name in INT_FIELDS:
        return lax_int(raw.cast("string"), T.LongType())
    if name in DECIMAL_FIELDS:
        return lax_decimal(raw.cast("string"))
    return raw, F.lit(True)


def _rule(get: Getter, name: str, field: str, kind: str, args: tuple, typed=None) -> Column:
    typed = typed or (lambda f: _typed(get, f))
    raw = get(field)
    fails: Column
    if kind == "required":
        fails = raw.isNull()
    elif kind == "pattern":
        fails = raw.isNotNull() & ~raw.rlike(args[0])
    elif kind == "json_type":
        fails = F.array_contains(get(TYPES_COL), name)
    elif kind in ("int_type", "decimal_type"):
        fails = ~typed(field)[1]
    elif kind == "range":
        v = typed(field)[0]
        lo, hi = args
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (v < F.lit(lo))
        if hi is not None:
            bad = bad | (v > F.lit(hi))
        fails = v.isNotNull() & bad
    elif kind == "scale":
        d = typed(field)[0]
        fails = d.isNotNull() & ~decimal_scale_ok(raw.cast("string"), d, args[0])
    elif kind == "max_length":
        fails = raw.isNotNull() & (F.length(raw) > F.lit(args[0]))
    elif kind == "length_eq":
        fails = raw.isNotNull() & (F.length(raw) != F.lit(args[0]))
    elif kind == "no_null_elements":
        fails = raw.isNotNull() & F.exists(raw, lambda x: x.isNull())
    elif kind == "element_length_eq":
        fails = raw.isNotNull() & F.exists(raw, lambda x: x.isNotNull() & (F.length(x) != F.lit(args[0])))
    elif kind == "element_max_length":
        fails = raw.isNotNull() & F.exists(raw, lambda x: x.isNotNull() & (F.length(x) > F.lit(args[0])))
    else:  # pragma: no cover - the rule table is fixed
        raise ValueError(kind)
    return F.when(F.coalesce(fails, F.lit(False)), F.lit(name))


def errors_expr(get: Getter, corrupt: Column | None = None, rules=RULES, typed=None) -> Column:
    """ARRAY<STRING> of broken rule names (empty when valid).  A malformed
    JSON record reports only ``record:malformed_json``.

    The names are gathered with ``concat_ws`` (skips nulls) and ``split``
    rather than ``filter(array(...))``: a higher-order function is always
    interpreted, which would take every rule out of generated code.
    """
    joined = F.concat_ws("|", *[_rule(get, *r, typed=typed) for r in rules])
    checks = F.when(joined == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(joined, r"\|"))
    if corrupt is None:
        return checks
    return F.when(corrupt.isNotNull(), F.array(F.lit(MALFORMED_RULE))).otherwise(checks)


def _getter(df: DataFrame) -> Getter:
    cols = set(df.columns)

    def get(name: str) -> Column:
        if name in cols:
            return qcol(name)
        if name == TYPES_COL:
            return F.array().cast("array<string>")
        t = FIELD_TYPES[name]
        return F.lit(None).cast(t if isinstance(t, T.ArrayType) else T.StringType())

    return get


def validate(raw: DataFrame, rules=RULES) -> DataFrame:
    """Raw records (text scalars) -> typed records plus ``errors``.

    Stage 1 parses every numeric text exactly once into ``(value, ok)``
    helper columns; stage 2 evaluates the rules on those attributes.  Stage 1
    is emitted through a one-element generator so that a later filter on
    ``errors`` (the splits) stops above it instead of being pushed down with
    every parse inlined again.  Typed values of rows that break a rule may be
    null; carried columns (request keys, positions) are kept in front.
    """
    get = _getter(raw)
    extra = [c for c in raw.columns if c not in FIELDS and c not in (CORRUPT_COL, TYPES_COL)]
    parsed_cols = [qcol(c) for c in extra]
    parsed_cols += [get(n).alias(n) for n in FIELDS]
    parsed_cols += [qcol(c) for c in (CORRUPT_COL, TYPES_COL) if c in raw.columns]
    for n in INT_FIELDS + DECIMAL_FIELDS:
        v, ok = _typed(get, n)
        parsed_cols += [v.alias(f"__v_{n}"), ok.alias(f"__ok_{n}")]
    staged = raw.select(F.inline(F.array(F.struct(*parsed_cols))))

    def typed(n: str):
        return F.col(f"__v_{n}"), F.col(f"__ok_{n}")

    corrupt = F.col(CORRUPT_COL) if CORRUPT_COL in raw.columns else None
    out = [F.col(f"__v_{n}").try_cast(FIELD_TYPES[n]).alias(n) if n in INT_FIELDS + DECIMAL_FIELDS else qcol(n)
           for n in FIELDS]
    return staged.select(*[qcol(c) for c in extra], *out,
                         errors_expr(_getter(staged), corrupt, rules, typed).alias(ERRORS))


def validate_split_valid(validated: DataFrame) -> DataFrame:
    return validated.where(F.size(ERRORS) == 0).drop(ERRORS)


def validate_split_quarantine(validated: DataFrame) -> DataFrame:
    return validated.where(F.size(ERRORS) > 0)


def validate_report(validated: DataFrame) -> DataFrame:
    """(rule, n_rows): how often each rule broke (partial aggregation, a
    handful of keys)."""
    return (
        validated.select(F.explode(ERRORS).alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def reject_failed_batches(validated: DataFrame, key: str = "request_id") -> DataFrame:
    """All-or-nothing per batch key for flat rows: drop every row of a key
    that has any invalid row.  The failing keys are found with one
    distinct (map-side combined) and removed with a left-anti join, which AQE
    splits if one key is hot.  Rows without a key are one batch."""
    bad = validated.where(F.size(ERRORS) > 0).select(F.col(key).alias("__bad")).distinct()
    return validated.join(bad, F.col(key).eqNullSafe(F.col("__bad")), "left_anti")


ENVELOPE_RULE = "envelope:malformed"


def validate_envelopes(envelopes: DataFrame) -> DataFrame:
    """Scanned envelopes with every item typed and checked once, inside the
    array: ``items`` becomes ARRAY<STRUCT<20 typed fields, errors>>.  The
    result stands behind a generator, so acceptance, flattening and the
    rejection report read it without parsing or checking again."""

    def parse(x):
        raw = [x[n].alias(n) for n in (*FIELDS, TYPES_COL)]
        both = [(n, _typed(lambda f: x[f], n)) for n in INT_FIELDS + DECIMAL_FIELDS]
        return F.struct(*raw, *[v.alias(f"__v_{n}") for n, (v, _) in both], *[ok.alias(f"__ok_{n}") for n, (_, ok) in both])

    def check(x):
        typed = [(x[f"__v_{n}"].try_cast(FIELD_TYPES[n]) if n in INT_FIELDS + DECIMAL_FIELDS else x[n]).alias(n) for n in FIELDS]
        return F.struct(*typed, errors_expr(lambda f: x[f], F.when(F.array_contains(x[TYPES_COL], MALFORMED_RULE), True), typed=lambda f: (x[f"__v_{f}"], x[f"__ok_{f}"])).alias(ERRORS))

    keep = [qcol(c) for c in envelopes.columns if c not in ("items", CORRUPT_COL)]
    checked = F.transform(F.transform("items", parse), check)
    return envelopes.select(*keep, F.inline(F.array(F.struct(checked.alias("items"), qcol(CORRUPT_COL).alias(CORRUPT_COL)))))


def _checked(envelopes: DataFrame) -> DataFrame:
    return envelopes if ERRORS in envelopes.schema["items"].dataType.elementType.fieldNames() else validate_envelopes(envelopes)


def accept_envelopes(envelopes: DataFrame) -> DataFrame:
    """Keep only envelopes whose items are all valid (strict batch mode); an
    empty list is valid.  Items come out typed."""
    checked = _checked(envelopes)
    return checked.where(F.col("items").isNotNull() & F.forall("items", lambda x: F.size(x[ERRORS]) == 0))


def envelope_rejections(envelopes: DataFrame) -> DataFrame:
    """Why envelopes were rejected: the carried columns, pos and rule, a row
    for each broken rule of each item; a document that is no envelope has a
    null pos and ``envelope:malformed``."""
    checked = _checked(envelopes)
    keep = [qcol(c) for c in checked.columns if c not in ("items", CORRUPT_COL)]
    item = F.transform("items", lambda x, i: F.transform(x[ERRORS], lambda e: F.struct(i.alias("pos"), e.alias("rule"))))
    none = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(ENVELOPE_RULE).alias("rule")))
    return checked.select(*keep, F.inline(F.when(F.col("items").isNull(), none).otherwise(F.flatten(item))))
