"""Record sources: typed tables, JSON lines and batch envelopes.

JSON is parsed once into a VARIANT, which keeps each value's own type: a
malformed record keeps its text in ``_corrupt_record`` instead of failing the
job, unknown fields are ignored, text fields take strings only and list fields
lists of strings (what breaks that is named in ``_types``), and numbers stay
exact text until they are validated (lax typing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediascore.schema import CORRUPT_COL, FIELD_TYPES, FIELDS, INT_FIELDS, LIST_FIELDS, MALFORMED_RULE, TEXT_FIELDS, TYPES_COL

_STRINGS = ("ARRAY<STRING>", "ARRAY<VOID>")


def _one(alias: str, c: Column) -> Column:
    """A value behind a one-element generator: what filters on things derived
    from it stops there, instead of being pushed down with the value's
    expression repeated for every reference."""
    return F.inline(F.array(F.struct(c.alias(alias))))


def _parsed(text: Column) -> Column:
    """The text as the first element of a list that ends with the text's hash,
    as a VARIANT.  Spark's parser stops at the end of the first document, so a
    closing bracket in the text could hide what follows it; then the hash is
    not the second element."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text).cast("string"), F.lit("]")))


def _whole(doc: str, text: str) -> Column:
    """Whether the text is one JSON document and nothing else."""
    return F.coalesce(F.try_variant_get(doc, "$[1]", "bigint") == F.xxhash64(text), F.lit(False)) & F.try_variant_get(doc, "$[2]", "variant").isNull()


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


_PARTS = "struct<" + ",".join(f"{n}:variant" for n in FIELDS) + ">"


def _parts(v: Column) -> Column:
    """All record fields of a VARIANT object, in one walk over it."""
    return F.try_variant_get(v, "$", _PARTS)


def _kinds(part) -> Column:
    """The JSON type and the text of every field.  A number written with an
    exponent is given as a plain one, so that it is told from such a text."""
    out = []
    for n in FIELDS:
        t = F.schema_of_variant(part(n))
        out.append(t.alias(f"t_{n}"))
        if n in LIST_FIELDS:
            s = F.try_variant_get(part(n), "$", "array<string>")
        else:
            s = F.try_variant_get(part(n), "$", "string")
            if n not in TEXT_FIELDS:
                s = F.when(t == "DOUBLE", F.coalesce(F.try_variant_get(part(n), "$", "decimal(38,18)").cast("string"), s)).otherwise(s)
        out.append(s.alias(f"s_{n}"))
    return F.struct(*out)


def _fields(k) -> list[Column]:
    """The raw record columns and ``_types`` from what _kinds gave."""
    out, broken = [], []
    for n in FIELDS:
        t, s = k(f"t_{n}"), k(f"s_{n}")
        if n in TEXT_FIELDS:
            out.append(F.when(t == "STRING", s).alias(n))
            broken.append(F.when(~t.isin("STRING", "VOID"), f"{n}:type"))
        elif n in LIST_FIELDS:
            out.append(F.when(t.isin(*_STRINGS), s).alias(n))
            broken.append(F.when((t != "VOID") & ~F.startswith(t, F.lit("ARRAY")), f"{n}:type"))
            broken.append(F.when(F.startswith(t, F.lit("ARRAY")) & ~t.isin(*_STRINGS), f"{n}:element_type"))
        elif n in INT_FIELDS:
            # a JSON boolean counts as 1 or 0; its text does not
            out.append(F.when(t == "BOOLEAN", F.when(s == "true", "1").otherwise("0")).otherwise(s).alias(n))
        else:
            out.append(s.alias(n))
    names = F.concat_ws("|", *broken)
    types = F.when(names == "", F.array().cast("array<string>")).otherwise(F.split(names, r"\|"))
    return [*out, types.alias(TYPES_COL)]


def typed_records(df: DataFrame) -> DataFrame:
    """Any table with a subset of the record fields -> all 20 fields, in
    contract order and types; absent fields are typed nulls.  No validation
    (the dict path)."""
    cols = [
        (F.col(n).cast(FIELD_TYPES[n]) if n in df.columns else F.lit(None).cast(FIELD_TYPES[n])).alias(n)
        for n in FIELDS
    ]
    extra = [c for c in df.columns if c not in FIELDS]
    return df.select(*extra, *cols)


def scan_json_records(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """One JSON object per row of ``value_col`` -> raw record columns plus
    ``_types`` and ``_corrupt_record``; other input columns are carried
    through.  The text is parsed once per row."""
    names = [c for c in lines.columns if c != value_col]
    text = F.col(value_col)
    doc = lines.select(*names, text.alias("__text"), _one("__doc", _parsed(text)))
    first = F.try_variant_get("__doc", "$[0]", "variant")
    good = _is(first, "OBJECT") & _whole("__doc", "__text")
    record = doc.select(*names, "__text", F.inline(F.array(F.struct(good.alias("__good"), _parts(first).alias("__part")))))
    kinds = record.select(*names, "__text", "__good", _one("__k", _kinds(lambda n: F.when(F.col("__good"), F.col(f"__part.{n}")))))
    return kinds.select(
        *names, *_fields(lambda n: F.col(f"__k.{n}")), F.when(~F.col("__good"), F.coalesce("__text", F.lit(""))).alias(CORRUPT_COL)
    )


def scan_batch_envelope(envelopes: DataFrame, value_col: str = "value") -> DataFrame:
    """``{"items":[...]}`` documents -> (carried columns, items, _corrupt_record).

    A bare top-level array or malformed text is not an envelope: ``items`` is
    null and ``_corrupt_record`` holds the text.  An item that is no object is
    kept, with null fields and the malformed rule in its ``_types``.
    """
    names = [c for c in envelopes.columns if c != value_col]
    doc = envelopes.select(*names, F.col(value_col).alias("__text"), _one("__doc", _parsed(F.col(value_col))))
    items = F.try_variant_get("__doc", "$[0].items", "variant")
    good = _is(F.try_variant_get("__doc", "$[0]", "variant"), "OBJECT") & _is(items, "ARRAY") & _whole("__doc", "__text")

    def record(x):
        *fields, types = _fields(lambda n: x["k"][n])
        bad = F.array(F.lit(MALFORMED_RULE))
        return F.struct(*fields, F.when(x["ok"], types).otherwise(bad).alias(TYPES_COL))

    parts = F.transform(F.try_variant_get("__doc", "$[0].items", "array<variant>"), lambda x: F.struct(_is(x, "OBJECT").alias("ok"), _parts(x).alias("part")))
    kinds = F.transform(parts, lambda x: F.struct(x["ok"].alias("ok"), _kinds(lambda n: x["part"][n]).alias("k")))
    out = doc.select(*names, "__text", F.inline(F.array(F.struct(good.alias("__good"), F.transform(kinds, record).alias("items")))))
    return out.select(
        *names, F.when(F.col("__good"), F.col("items")).alias("items"), F.when(~F.col("__good"), F.coalesce("__text", F.lit(""))).alias(CORRUPT_COL)
    )


#: The key of an envelope among all that are scanned; callers may send one request_id twice.
ENVELOPE = "envelope_no"


def envelope_items(envelopes: DataFrame, outer: bool = False) -> DataFrame:
    """Flatten envelopes to one record per item, keeping the carried columns
    and pos, so results can be returned in input order, and envelope_no, a
    number of the scan that tells envelopes of the same request_id apart.
    Invalid envelopes yield no rows; an empty ``items`` list yields none, or
    with ``outer`` one row whose pos and fields are null."""
    keep = [c for c in envelopes.columns if c not in ("items", CORRUPT_COL, ENVELOPE)]
    names = [n for n in envelopes.schema["items"].dataType.elementType.fieldNames() if n in FIELDS]
    explode = F.posexplode_outer if outer else F.posexplode
    return (
        envelopes.where(F.col("items").isNotNull())
        .select(*keep, F.monotonically_increasing_id().alias(ENVELOPE), "items")
        .select(*keep, ENVELOPE, explode("items").alias("pos", "_it"))
        .select(*keep, ENVELOPE, F.col("pos").cast("int").alias("pos"), *[F.col(f"_it.{n}").alias(n) for n in names])
    )
