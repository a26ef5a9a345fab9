"""Scoring plans: features -> tree margin -> probability -> label.

The scoring path is narrow end to end: one JVM projection for the features,
one Arrow stage for the trees, one projection for the sigmoid.  No Exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediascore.bundle import Bundle
from mediascore.operators.features import FEATURE_ERRORS, preprocess, preprocess_sparse
from mediascore.operators.trees import arrow_margin, expr_margin, sparse_scores
from mediascore.session import materialize
from mediascore.sources.records import ENVELOPE

THRESHOLD = 0.5


def probability(margin: Column) -> Column:
    """Binary logistic: 1 / (1 + exp(-margin))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def predict_label(prob: Column) -> Column:
    return prob > F.lit(THRESHOLD)


REASON = "reason"


def score_features(features: DataFrame, bundle: Bundle, keep=("imdb_id",), scorer: str = "arrow") -> DataFrame:
    """Aligned features (the wide form) -> keep columns, margin and reason."""
    m = arrow_margin(features, bundle) if scorer == "arrow" else expr_margin(bundle)
    keep = [k for k in keep if k in features.columns]
    return features.select(*keep, F.when(_feature_reason(features).isNull(), m).alias("margin"), _feature_reason(features).alias(REASON))


def score_records(df: DataFrame, bundle: Bundle, keep=("imdb_id",)) -> DataFrame:
    """Records -> keep columns, margin and reason, through the sparse form."""
    features, *layout = preprocess_sparse(df, bundle, keep=keep)
    keep = [k for k in keep if k in features.columns]
    if bundle.more_trees:
        return _score_shards(features, bundle, layout, keep)
    scored = features.select(*keep, _feature_reason(features).alias("__why"), sparse_scores(features, bundle, *layout).alias("__score"))
    reason = F.coalesce("__why", "__score.reason")
    return scored.select(*keep, F.when(reason.isNull(), F.col("__score.margin")).alias("margin"), reason.alias(REASON))


def _score_shards(features: DataFrame, bundle: Bundle, layout: list, keep: list[str]) -> DataFrame:
    """A model larger than one broadcast: each shard of its trees scores all
    rows on its own, so that a worker holds one shard at a time, and a row's
    partial margins are added up in the shards' order.  The features are
    written once, and so is each row's number; the partial margins (a few
    numbers each) are what is shuffled."""
    rows = materialize(features.withColumn("__row", F.monotonically_increasing_id()), "sharded_features")
    parts = None
    for i, shard in enumerate((bundle.trees, *bundle.more_trees)):
        own = F.struct(*[F.col(f"`{k}`") for k in keep])
        kept = own if i == 0 else F.lit(None).cast(rows.select(own.alias("k")).schema["k"].dataType)
        one = rows.select("__row", F.lit(i).alias("shard"), kept.alias("kept"), _feature_reason(rows).alias("__why"), sparse_scores(rows, bundle, *layout, shard=shard).alias("__score"))
        one = one.select("__row", "shard", "kept", F.coalesce("__why", "__score.reason").alias("why"), F.col("__score.margin").alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    added = parts.groupBy("__row").agg(
        F.first("kept", ignorenulls=True).alias("kept"), F.first("why", ignorenulls=True).alias(REASON),
        F.array_sort(F.collect_list(F.struct("shard", "part"))).alias("parts"),
    )
    total = F.aggregate("parts", F.lit(float(bundle.base_margin)), lambda acc, x: acc + x["part"])
    return added.select(*[F.col(f"kept.`{k}`").alias(k) for k in keep], F.when(F.col(REASON).isNull(), total).alias("margin"), REASON)


def _feature_reason(features: DataFrame) -> Column:
    """Why a row's features could not be built, or null."""
    if FEATURE_ERRORS not in features.columns:
        return F.lit(None).cast("string")
    return F.when(F.size(FEATURE_ERRORS) > 0, F.array_join(FEATURE_ERRORS, ","))


def outcomes(df: DataFrame, bundle: Bundle, keep=("imdb_id",), scorer: str = "sparse") -> DataFrame:
    """Every input row (order and duplicates kept; nothing is deduped) with
    prediction, probability and margin, or where it cannot be scored nulls and
    the reason: ``<field>:degenerate_range`` or ``non_finite:<feature>``.
    ``scorer``: 'sparse' (one lookup for each list value), or for cross-checks
    the wide feature form with 'arrow' or 'expr' scoring."""
    if scorer == "sparse":
        margins = score_records(df, bundle, keep)
    else:
        margins = score_features(preprocess(df, bundle, keep=keep), bundle, keep=keep, scorer=scorer)
    keep = [k for k in keep if k in margins.columns]
    p = probability(F.col("margin"))
    return margins.select(*keep, predict_label(p).alias("prediction"), p.alias("probability"), "margin", REASON)


def predict(df: DataFrame, bundle: Bundle, keep=("imdb_id",), scorer: str = "sparse", with_margin: bool = False) -> DataFrame:
    """Score every input row as one batch: a row that cannot be scored fails
    the job, as one bad item fails its batch.  ``outcomes`` keeps the reason
    with the row instead, and ``request_outcomes`` folds it by request."""
    done = outcomes(df, bundle, keep, scorer)
    why = F.raise_error(F.concat(F.lit("feature error: "), F.col(REASON))).cast("double")
    checked = done.withColumn("margin", F.when(F.col(REASON).isNull(), F.col("margin")).otherwise(why))
    p = probability(F.col("margin"))
    keep = [k for k in keep if k in done.columns]
    cols = [*keep, predict_label(p).alias("prediction"), p.alias("probability")]
    return checked.select(*cols, "margin") if with_margin else checked.select(*cols)


_ANSWER = ("pos", "imdb_id", "prediction", "probability")


def _in_order(items: Column) -> Column:
    """Collected (pos, imdb_id, prediction, probability) as the results of a request."""
    there = F.array_sort(F.filter(items, lambda r: r["pos"].isNotNull()))
    return F.transform(there, lambda r: F.struct(r["imdb_id"].alias("imdb_id"), r["prediction"].alias("prediction"), r["probability"].alias("probability")))


def request_outcomes(scored: DataFrame, key: str = "request_id") -> DataFrame:
    """Outcomes folded by request: ``results`` in input order, or null where an
    item could not be scored, and ``failures`` (pos, imdb_id, reason).  One bad
    item fails its own request and no other.  Rows of scanned envelopes are
    told apart by their envelope_no, other rows by ``key``; a request's rows
    are as many as its envelope has items."""
    by = [c for c in (ENVELOPE, key) if c in scored.columns]
    bad = F.col(REASON).isNotNull()
    folded = scored.groupBy(*by).agg(
        F.collect_list(F.struct(*_ANSWER)).alias("items"),
        F.array_sort(F.collect_list(F.when(bad, F.struct("pos", "imdb_id", REASON)))).alias("failures"),
    )
    return folded.select(*by, F.when(F.size("failures") == 0, _in_order(F.col("items"))).alias("results"), "failures")


def results_envelope(scored: DataFrame, key: str = "request_id") -> DataFrame:
    """``{results:[...]}`` per request in input order; a request without items
    (one row with a null pos) gets an empty list.  Rows of scanned envelopes
    are told apart by their envelope_no, so a request_id that was sent twice
    gets two answers; other rows by ``key``.  Each request's list is exactly as
    large as the request envelope it answers (already one row on input), so
    the collect is bounded by the input record, not by the data."""
    by = [c for c in (ENVELOPE, key) if c in scored.columns]
    return scored.groupBy(*by).agg(_in_order(F.collect_list(F.struct(*_ANSWER))).alias("results")).drop(ENVELOPE)


def write_results(scored: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """The per-record result sink: ``imdb_id, prediction, probability`` plus
    whatever keys were kept, written by the executors (no driver collect)."""
    w = scored.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
