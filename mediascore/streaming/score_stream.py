"""Streaming jobs over arriving files.

* ``start_scoring_stream`` -- JSON lines: parse -> validate -> score every
  valid record with a fixed bundle; invalid records, and those that cannot be
  scored, go to a quarantine sink with the reason.
* ``start_envelope_stream`` -- batch envelopes: one stateless pass with three
  sinks, the results by request, the rejections and the failures.
* ``start_refreshing_stream`` -- ``foreachBatch``: at the head of every
  micro-batch the registry is asked for the latest version; a new version is
  loaded and swapped in as one immutable bundle, a failing load or check keeps
  the last good bundle.  Every row is written with the version that scored it,
  and the version is noted under the checkpoint before the micro-batch is
  scored, so a replay after a lost driver scores with the same one.

Checkpoints and sinks live under the shared checkpoint folder; a micro-batch
writes its own ``batch=<id>`` folder in overwrite mode, so a replayed batch
after a failure replaces its earlier output instead of duplicating it.
"""

from __future__ import annotations

import logging
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediascore.bundle import ArtifactError, ArtifactReadError, Bundle
from mediascore.operators.validate import accept_envelopes, envelope_rejections, validate, validate_envelopes, validate_split_quarantine, validate_split_valid
from mediascore.plans.predict import REASON, outcomes, request_outcomes
from mediascore.sources.marks import drop_mark, read_mark, write_mark
from mediascore.sources.records import ENVELOPE, envelope_items, scan_batch_envelope, scan_json_records

log = logging.getLogger(__name__)


def _lines(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(source_dir)


def _write_batch(batch: DataFrame, batch_id: int, bundle: Bundle, sink_dir: str, quarantine_dir: str | None) -> None:
    """Parse and validate a micro-batch once; valid records are scored into
    one sink, the others go with their errors into the other, as do those that
    cannot be scored, with the reason: no record ends the stream."""
    validated = validate(scan_json_records(batch)).withColumn("__no", F.monotonically_increasing_id()).persist()
    scored = outcomes(validate_split_valid(validated), bundle, keep=("imdb_id", "__no")).persist()
    try:
        good = scored.where(F.col(REASON).isNull()).select("imdb_id", "prediction", "probability", F.lit(bundle.version).alias("model_version"))
        good.write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")
        if quarantine_dir:
            invalid = validate_split_quarantine(validated).withColumn("errors", F.array_join("errors", "|"))
            failed = scored.where(F.col(REASON).isNotNull()).select(F.col("__no").alias("__failed"), REASON)
            unscored = validated.join(failed, F.col("__no") == F.col("__failed")).withColumn("errors", F.col(REASON)).drop("__failed", REASON)
            invalid.unionByName(unscored).drop("__no").write.mode("overwrite").parquet(f"{quarantine_dir}/batch={batch_id}")
    finally:
        scored.unpersist()
        validated.unpersist()


def _run(source: DataFrame, per_batch, checkpoint_dir: str, available_now: bool) -> StreamingQuery:
    trig = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return source.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir).trigger(**trig).start()


def _start(spark, source_dir, checkpoint_dir, per_batch, available_now, max_files_per_trigger) -> StreamingQuery:
    return _run(_lines(spark, source_dir, max_files_per_trigger), per_batch, checkpoint_dir, available_now)


def start_scoring_stream(
    spark: SparkSession, bundle: Bundle, source_dir: str, sink_dir: str, checkpoint_dir: str,
    quarantine_dir: str | None = None, available_now: bool = True, max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Score with one fixed bundle.  One query feeds both sinks, so the source
    is read and parsed once."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, batch_id, bundle, sink_dir, quarantine_dir)

    return _start(spark, source_dir, checkpoint_dir, per_batch, available_now, max_files_per_trigger)


def _dealt_out(batch: DataFrame) -> DataFrame:
    """The envelopes of a micro-batch in twice as many partitions as there are
    cores, or 16 for each one that is read where these are more.  They are
    sorted, so that a task that is run again numbers its envelopes the same."""
    cores = batch.sparkSession.sparkContext.defaultParallelism
    return batch.repartition(max(2 * cores, 16 * batch.rdd.getNumPartitions())).sortWithinPartitions("request_id", "value")


def start_envelope_stream(
    spark: SparkSession, bundle: Bundle, source_dir: str, sink_dir: str, checkpoint_dir: str,
    available_now: bool = True, max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Batch envelopes (request_id, value) that arrive as parquet files.  Each
    micro-batch is parsed and checked once and written to three sinks under
    ``sink_dir``: ``results`` (request_id, results in input order),
    ``rejections`` (request_id, pos, rule) of envelopes with a broken item, and
    ``failures`` (request_id, pos, imdb_id, reason) of envelopes with an item
    that cannot be scored.  Every envelope is answered in one of them.  The
    envelopes of a micro-batch are dealt out over the cluster before they are
    parsed, as one arriving file may be all of it and is read by few tasks."""
    reader = spark.readStream.schema("request_id long, value string")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        checked = validate_envelopes(scan_batch_envelope(_dealt_out(batch))).persist()
        items = envelope_items(accept_envelopes(checked), outer=True)
        folded = request_outcomes(outcomes(items, bundle, keep=("request_id", ENVELOPE, "pos", "imdb_id"))).persist()
        try:
            sinks = {
                "results": folded.where(F.col("results").isNotNull()).select("request_id", "results"),
                "rejections": envelope_rejections(checked),
                "failures": folded.select("request_id", F.inline("failures")),
            }
            for name, rows in sinks.items():
                rows.write.mode("overwrite").parquet(f"{sink_dir}/{name}/batch={batch_id}")
        finally:
            folded.unpersist()
            checked.unpersist()

    return _run(reader.parquet(source_dir), per_batch, checkpoint_dir, available_now)


class VersionLog:
    """Which version scores each micro-batch, and the last one that loaded:
    marks in a folder of the checkpoint that outlive the driver."""

    #: As many marks are kept as the checkpoint keeps batches (its default), twice.
    KEPT = 200

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self, batch_id: int) -> str | None:
        return read_mark(self.spark, f"{self.folder}/batch-{batch_id}")

    def note(self, batch_id: int, version: str) -> None:
        write_mark(self.spark, f"{self.folder}/batch-{batch_id}", version)
        drop_mark(self.spark, f"{self.folder}/batch-{batch_id - self.KEPT}")

    def last_good(self) -> str | None:
        return read_mark(self.spark, f"{self.folder}/last-good")

    def note_good(self, version: str) -> None:
        write_mark(self.spark, f"{self.folder}/last-good", version)


class ModelRefresher:
    """Holds the last good bundle; ``refresh()`` is called once per
    micro-batch on the driver.

    A version with bad content (ArtifactError) stays bad, as registry versions
    are immutable, and is not loaded again; any other failure, an unreadable
    file, an unfinished upload or an unreachable store, may pass and is tried
    again at the next micro-batch.

    With a ``log`` the choice is durable: a micro-batch that was begun before
    is scored with the version noted then, and without an ``initial`` bundle
    the last one that loaded is taken up again."""

    def __init__(self, initial: Bundle | None, latest: Callable[[], str], load: Callable[[str], Bundle], log: VersionLog | None = None):
        self._latest = latest
        self._load = load
        self._bad: set[str] = set()
        self.log = log
        self.history: list[tuple[str, str]] = []
        if initial is None:
            known = log.last_good() if log else None
            initial = load(known or latest())
        self.bundle = initial
        self._noted = None
        self._note_good()

    def _note_good(self) -> None:
        if self.log and self._noted != self.bundle.version:
            self.log.note_good(self.bundle.version)
            self._noted = self.bundle.version

    def refresh(self, batch_id: int | None = None) -> Bundle:
        if self.log and batch_id is not None:
            begun = self.log.version(batch_id)
            if begun is not None:
                self.history.append(("replayed", begun))
                return self.bundle if begun == self.bundle.version else self._load(begun)
        bundle = self._newest()
        if self.log and batch_id is not None:
            self._note_good()
            self.log.note(batch_id, bundle.version)
        return bundle

    def _newest(self) -> Bundle:
        try:
            wanted = self._latest()
        except Exception as e:  # registry unreachable: keep scoring
            log.warning("version check failed, keeping %s: %s", self.bundle.version, e)
            self.history.append(("check_failed", self.bundle.version))
            return self.bundle
        if wanted != self.bundle.version:
            if wanted in self._bad:
                self.history.append(("skipped_failed:" + wanted, self.bundle.version))
                return self.bundle
            try:
                fresh = self._load(wanted)
            except Exception as e:  # keep the last good bundle
                log.error("loading version %s failed, keeping %s: %s", wanted, self.bundle.version, e)
                if isinstance(e, ArtifactError) and not isinstance(e, ArtifactReadError):
                    self._bad.add(wanted)
                self.history.append(("load_failed:" + wanted, self.bundle.version))
                return self.bundle
            self.bundle = fresh  # one reference swap: never a half-updated bundle
            self.history.append(("loaded", fresh.version))
        return self.bundle


def start_refreshing_stream(
    spark: SparkSession, refresher: ModelRefresher, source_dir: str, sink_dir: str, checkpoint_dir: str,
    quarantine_dir: str, available_now: bool = True, max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Score every micro-batch with the newest good bundle; records that break
    a rule go to ``quarantine_dir``, so valid and quarantined rows together are
    the input.  The refresher's log is put under the checkpoint if it has none."""
    if refresher.log is None:
        refresher.log = VersionLog(spark, f"{checkpoint_dir.rstrip('/')}/versions")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, batch_id, refresher.refresh(batch_id), sink_dir, quarantine_dir)

    return _start(spark, source_dir, checkpoint_dir, per_batch, available_now, max_files_per_trigger)
