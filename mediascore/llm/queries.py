"""Queries of the training-data operators: each applies one operator to its
whole table and derives the digest columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from mediascore.llm import bitplane, decontaminate, embeddings, langid, merkle, packing, pii, quality, sharding, simhash, toxicity, turns, urls
from mediascore.llm.common import bucket_of, ship
from mediascore.session import materialize, scratch_path

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text.  Null, empty and letterless texts are und; rows that repeat an id are judged each by its text.  An empty table gives no rows, other columns are not read."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, bucket_of(4) != 2)
    return langid.predict(docs, model, F.col("doc_id"), (bucket_of(4) == 2).alias("held_out"))


def op2_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text; a null text is scored as an empty one, rows that repeat an id each by its text.  An empty table gives no rows, other columns are not read."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), bucket_of(3) != 1)
    return quality.scored(docs, model, F.col("doc_id"), (bucket_of(3) == 1).alias("held_out"))


def op3_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids in bit-plane files, read back.  Null texts hold the end id only; repeated ids go in any order among themselves.  An empty table gives no rows, other columns are not read."""
    path = scratch_path(spark, "bit_planes")
    bitplane.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=1)
    read = materialize(bitplane.read_ids(spark, path), "bit_planes_read")
    return bitplane.with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_spherical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors.  Null, zero and non-finite vectors link with nothing, equal vectors with each other.  An empty table gives no rows, other columns are not read."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole texts and their components; texts without a word have fingerprint zero.  An empty table gives no rows, other columns are not read."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op6_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every url; a null one has an empty host and path.  An empty table gives no rows, other columns are not read."""
    judged = urls.judge(table(spark, sf_dir, "pages"), URL_RULES, F.col("page_id"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as pieces in sequences; null and empty texts are their end id, repeated rows are packed each.  An empty table gives no rows, other columns are not read."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=2, capacity=1024)
    pieces = materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(pieces, 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_seed_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items they hold, best score of rows that repeat an id; null and empty texts hold none.  An empty table gives no rows, other columns are not read."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text; null and empty texts have none, rows that repeat an id are searched each.  An empty table gives no rows, other columns are not read."""
    found = materialize(pii.proposed(table(spark, sf_dir, "documents"), F.col("doc_id")), "spans")
    done = pii.decide(found, pii.fit(found))
    number = [F.size(F.filter("base", pii.is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return done.select("doc_id", *number, F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op10_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and place of every row, null and repeated ones among them.  An empty table gives no rows, other columns are not read."""
    path = scratch_path(spark, "shuffled")
    sharding.write_buckets(table(spark, sf_dir, "documents"), path, SEED)
    text = F.col("row.text")
    rows = spark.read.parquet(path).select(
        "bucket",
        "pos",
        F.col("row.doc_id").alias("doc_id"),
        sharding.row_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.place(rows, sharding.manifest(spark, path, 16), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_bigru_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text, in all its windows; null and empty texts are scored as one window without words.  An empty table gives no rows, other columns are not read."""
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), bucket_of(4) != 2)
    return toxicity.scored(docs, net, F.col("doc_id"), (bucket_of(4) == 2).alias("held_out"))


def op12_weighted_cyk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation; nulls count as one space, a null conv_id as a conversation.  An empty table gives no rows, other columns are not read."""
    conversations = table(spark, sf_dir, "conversations")
    return turns.report(conversations, turns.damaged(conversations))


def op13_nested_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, nulls and repeated rows included.  An empty table gives no rows, other columns are not read."""
    return merkle.checked(merkle.proofs(merkle.document_leaves(table(spark, sf_dir, "documents")), "doc_id"))


def _shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f)
    for f in (
        op1_nearest_centroid,
        op2_nb_svm,
        op3_bit_planes,
        op4_spherical_cells,
        op5_simhash,
        op6_path_templates,
        op7_best_fit,
        op8_seed_align,
        op9_weak_labels,
        op10_two_pass_shuffle,
        op11_bigru_attention,
        op12_weighted_cyk,
        op13_nested_rollup,
    )
}
QUERIES["pipeline"] = _shipped(corpus_pipeline.run)

ORACLES: dict[str, str] = {"op6_path_templates": urls.oracle(URL_RULES), "op12_weighted_cyk": turns.oracle(), "op13_nested_rollup": merkle.oracle()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
