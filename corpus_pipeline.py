"""The training-data pipeline over ``documents``: five stages, each one an
operator of mediascore.llm.  Every stage's result is written as Parquet in the
shared folder and read again, so a lost executor repeats one stage's tasks at
most.  All but the last stage return the columns of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mediascore.llm import decontaminate, packing, pii, quality, simhash
from mediascore.llm.common import bucket_of, ship
from mediascore.session import materialize

SEQUENCE = 1024
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _ready(spark: SparkSession) -> None:
    """Executors know the code, and read whole texts by 1,000 rows at most,
    which bounds what a worker holds beside a stage's own tables; a session
    that has set that number keeps its own.  run() takes it back at its end."""
    ship(spark)
    if spark.conf.get(ARROW_ROWS, None) is None:
        spark.conf.set(ARROW_ROWS, "1000")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.5) go.  It
    learns from the labels of two thirds of the ids, as the query does.  Null
    and empty texts are scored as texts without words; rows that repeat an id
    are each judged by their text; equal texts stay or go together."""
    _ready(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), bucket_of(3) != 1)
    return quality.keep_good(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id
    stays; of equal rows any one.  Texts without a word are one group."""
    _ready(spark)
    return simhash.drop_near_duplicates(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark``, whole or edited, go; null
    and empty texts hold none."""
    _ready(spark)
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows.
    Null texts stay null; no row goes."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token ids in sequences of SEQUENCE: doc_id, piece, start,
    length, ids (little-endian unsigned 32-bit), sequence_id, offset.  Null and
    empty texts are their end id alone."""
    _ready(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=2, capacity=SEQUENCE)
    done = packing.pack(materialize(pieces, "pieces"), SEQUENCE)
    return done.select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


STAGES = [
    ("quality", good_quality),
    ("simhash", one_of_each_group),
    ("decontamination", without_test_items),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: A linear model, tokenizers and alignments are beyond SQL; tests/llm/test_stages.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = spark.conf.get(ARROW_ROWS, None)
    try:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        if own is None:
            spark.conf.unset(ARROW_ROWS)
    return docs
