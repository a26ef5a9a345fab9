"""Registry tables (R1-R5) and streaming (T1, T2)."""

import gc
import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from mediascore.bundle import ArtifactError, ArtifactReadError
from mediascore.operators.registry import latest_model_version, model_metadata, resolve_version
from mediascore.operators.trees import _HELD, held_broadcast
from mediascore.plans.fixture import fixture_bundle
from mediascore.plans.predict import predict
from mediascore.operators.validate import validate, validate_split_valid
from mediascore.session import checkpoint_path
from mediascore.sources.fixtures import media_raw
from mediascore.sources.records import scan_json_records
from mediascore.sources.registry_fixture import MODEL, registry_runs, registry_versions
from mediascore.streaming import ModelRefresher, start_refreshing_stream, start_scoring_stream

SF = "/root/testdata/sf0.001"


def test_latest_pinned_and_metadata(spark):
    v = registry_versions(spark)
    assert resolve_version(v, MODEL) == "10"  # numeric order: 10 beats 9
    assert resolve_version(v, MODEL, "latest") == "10"
    assert resolve_version(v, MODEL, "2") == "2"
    with pytest.raises(ArtifactError):
        resolve_version(v, MODEL, "7")
    with pytest.raises(ArtifactError):
        resolve_version(v, "nope")
    staging_only = v.where(F.col("stage") != "Production")
    assert latest_model_version(staging_only).first()["version"] == "2"
    meta = model_metadata(v, registry_runs(spark, 8, 3), MODEL).first()
    assert (meta["version"], meta["run_id"], meta["run_metrics"]["n_trees"]) == ("10", "run-10", 8.0)


def test_refresher_keeps_last_good(bundle):
    calls = []

    def load(v):
        calls.append(v)
        if v == "11":
            raise ArtifactError("model has no nodes")
        return bundle.with_model(v, f"run-{v}", bundle.trees, bundle.nodes)

    r = ModelRefresher(bundle, lambda: "11", load)
    assert r.refresh() is bundle and r.bundle.version == bundle.version
    r2 = ModelRefresher(bundle, lambda: "12", load)
    assert r2.refresh().version == "12"

    def boom():
        raise RuntimeError("registry down")

    r3 = ModelRefresher(bundle, boom, load)
    assert r3.refresh() is bundle


def test_refresher_tries_a_passing_failure_again(spark, bundle):
    tries = []

    def load(v):
        tries.append(v)
        if len(tries) == 1:
            raise ArtifactReadError("store unreachable")
        return bundle.with_model(v, f"run-{v}", bundle.trees, bundle.nodes)

    r = ModelRefresher(bundle, lambda: "12", load)
    assert r.refresh() is bundle and r.refresh().version == "12" and tries == ["12", "12"]


def test_one_broadcast_for_each_model(spark, bundle):
    first = held_broadcast(spark, bundle.trees)
    assert held_broadcast(spark, bundle.trees) is first
    other = replace(bundle.trees)
    key = (spark.sparkContext.applicationId, id(other))
    held_broadcast(spark, other)
    assert key in _HELD
    del other
    gc.collect()
    assert key not in _HELD


def _source(spark):
    path = checkpoint_path(spark, "test-streams", uuid.uuid4().hex)
    media_raw(spark, SF).select("value").repartition(3).write.text(path + "/src")
    return path


def test_stream_equals_batch(spark, bundle):
    base = _source(spark)
    start_scoring_stream(spark, bundle, base + "/src", base + "/out", base + "/ckpt", base + "/bad", max_files_per_trigger=1).awaitTermination()
    streamed = spark.read.parquet(base + "/out").select("imdb_id", "prediction", "probability")
    batch = predict(validate_split_valid(validate(scan_json_records(media_raw(spark, SF)))), bundle)
    assert sorted(streamed.collect()) == sorted(batch.collect())
    bad = spark.read.parquet(base + "/bad")
    assert bad.count() + streamed.count() == media_raw(spark, SF).count()


def test_stream_refresh_keeps_version_10(spark):
    b10 = fixture_bundle(spark, SF, version="10", tree_offset=9)
    versions = registry_versions(spark, include_broken=True)

    def load(v):
        raise ArtifactError("broken upload")

    r = ModelRefresher(b10, lambda: resolve_version(versions, MODEL), load)
    base = _source(spark)
    start_refreshing_stream(spark, r, base + "/src", base + "/out", base + "/ckpt", base + "/bad", max_files_per_trigger=1).awaitTermination()
    assert spark.read.parquet(base + "/out").count() + spark.read.parquet(base + "/bad").count() == media_raw(spark, SF).count()
    out = spark.read.parquet(base + "/out")
    assert {row["model_version"] for row in out.select("model_version").distinct().collect()} == {"10"}
    assert out.select("batch").distinct().count() >= 2
    assert r.history[0][0] == "load_failed:11"
    assert all(h[0] in ("load_failed:11", "skipped_failed:11") for h in r.history)


def _saved(spark, bundle, *versions):
    """Whole versions of the fixture model in a new root."""
    from mediascore.plans.fixture import fitted_artifacts
    from mediascore.sources.artifacts import save_bundle_artifacts
    from mediascore.sources.fixtures import fixture_nodes, media_items_view

    root = checkpoint_path(spark, "test-registry", uuid.uuid4().hex)
    norm, schema, vocab = fitted_artifacts(media_items_view(spark, SF))
    feats = list(bundle.feature_names)
    for v in versions:
        nodes = fixture_nodes(spark, feats, 8, 3, list(bundle.categorical_features), int(v) - 1)
        save_bundle_artifacts(root, v, normalization=norm, category_schema=schema, vocab=vocab, nodes=nodes, feature_names=feats, model_name=MODEL, run_id=f"run-{v}")
    return root


def test_unfinished_upload_is_not_loaded_and_tried_again(spark, bundle):
    from mediascore.bundle import IncompleteUpload
    from mediascore.sources.artifacts import artifact_integrity, load_bundle_artifacts

    root = _saved(spark, bundle, "3", "4")
    nodes = spark.read.parquet(f"{root}/4/nodes").collect()
    cut = spark.createDataFrame(nodes, spark.read.parquet(f"{root}/4/nodes").schema).where("tree_id < 5")
    cut.write.mode("overwrite").parquet(f"{root}/4/nodes")
    assert all(r["reason"] is None for r in artifact_integrity(spark, root, "3").collect())
    assert {r["artifact"]: (r["reason"], r["found_rows"]) for r in artifact_integrity(spark, root, "4").collect() if r["reason"]} == {"nodes": ("rows", 75)}
    with pytest.raises(IncompleteUpload, match="nodes: rows"):
        load_bundle_artifacts(spark, root, "4")
    with pytest.raises(IncompleteUpload, match="unfinished"):
        load_bundle_artifacts(spark, root, "5")
    r = ModelRefresher(load_bundle_artifacts(spark, root, "3"), lambda: "4", lambda v: load_bundle_artifacts(spark, root, v))
    assert r.refresh().version == "3"
    spark.createDataFrame(nodes, cut.schema).write.mode("overwrite").parquet(f"{root}/4/nodes")  # the rest arrives
    assert r.refresh().version == "4" and [h[0] for h in r.history] == ["load_failed:4", "loaded"]


def test_replay_scores_with_the_version_it_began_with(spark, bundle):
    """The driver is lost after a micro-batch is scored and before it is
    committed; the registry changes; the replay takes the first version, and
    the next micro-batch the new one.  A restart takes up the last good one."""
    from mediascore.streaming import VersionLog, score_stream

    base = _source(spark)
    versions = {v: bundle.with_model(v, f"run-{v}", bundle.trees, bundle.nodes) for v in ("1", "2")}
    loads = []

    def load(v):
        loads.append(v)
        return versions[v]

    log = lambda: VersionLog(spark, base + "/ckpt/versions")
    whole = score_stream._write_batch

    def lost(*args):
        whole(*args)
        raise RuntimeError("driver lost")

    score_stream._write_batch = lost
    try:
        first = ModelRefresher(None, lambda: "1", load, log())
        with pytest.raises(Exception, match="driver lost"):
            start_refreshing_stream(spark, first, base + "/src", base + "/out", base + "/ckpt", base + "/bad", max_files_per_trigger=1).awaitTermination()
    finally:
        score_stream._write_batch = whole
    again = ModelRefresher(None, lambda: "2", load, log())
    assert again.bundle.version == "1"  # the last good one, though the registry names 2
    start_refreshing_stream(spark, again, base + "/src", base + "/out", base + "/ckpt", base + "/bad", max_files_per_trigger=1).awaitTermination()
    by_batch = {r["batch"]: r["model_version"] for r in spark.read.parquet(base + "/out").select("batch", "model_version").distinct().collect()}
    assert by_batch[0] == "1" and len(by_batch) == 3 and {v for b, v in by_batch.items() if b} == {"2"}
    assert again.history[0] == ("replayed", "1")
    down = ModelRefresher(None, lambda: 1 / 0, load, log())
    assert down.bundle.version == "2" and down.refresh(99).version == "2"


def test_broadcasts_stay_the_same_over_micro_batches(spark, bundle):
    m = media_raw(spark, SF).limit(50)
    valid = validate_split_valid(validate(scan_json_records(m)))
    predict(valid, bundle).count()
    held = len(_HELD)
    for _ in range(10):
        predict(valid, bundle).collect()
    assert len(_HELD) == held


def test_records_that_cannot_be_scored_are_quarantined(spark, bundle):
    least = bundle.normalization["runtime"][0]
    flat = replace(bundle, normalization={**bundle.normalization, "runtime": (least, least)})
    base = _source(spark)
    start_scoring_stream(spark, flat, base + "/src", base + "/out", base + "/ckpt", base + "/bad").awaitTermination()
    bad, good = spark.read.parquet(base + "/bad"), spark.read.parquet(base + "/out")
    assert bad.where("errors = 'runtime:degenerate_range'").count() > 0
    assert bad.count() + good.count() == media_raw(spark, SF).count()


def test_envelope_stream_answers_every_request(spark, bundle):
    from mediascore.plans.predict import results_envelope
    from mediascore.operators.validate import accept_envelopes, envelope_rejections
    from mediascore.sources.fixtures import media_envelopes
    from mediascore.sources.records import ENVELOPE, envelope_items, scan_batch_envelope
    from mediascore.streaming import start_envelope_stream

    base = checkpoint_path(spark, "test-streams", uuid.uuid4().hex)
    env = media_envelopes(spark, SF)
    env.repartition(3).write.parquet(base + "/src")
    least = bundle.normalization["runtime"][0]
    for name, b in (("plain", bundle), ("flat", replace(bundle, normalization={**bundle.normalization, "runtime": (least, least)}))):
        out = f"{base}/{name}"
        start_envelope_stream(spark, b, base + "/src", out, out + "/ckpt", max_files_per_trigger=1).awaitTermination()
        results, rejected, failed = (spark.read.parquet(f"{out}/{s}") for s in ("results", "rejections", "failures"))
        ids = [{r["request_id"] for r in t.select("request_id").distinct().collect()} for t in (results, rejected, failed)]
        assert set.union(*ids) == {r["request_id"] for r in env.select("request_id").collect()} and sum(map(len, ids)) == env.count()
        scanned = scan_batch_envelope(env)
        assert sorted(map(str, rejected.select("request_id", "pos", "rule").collect())) == sorted(map(str, envelope_rejections(scanned).select("request_id", "pos", "rule").collect()))
        if name == "plain":
            batch = results_envelope(predict(envelope_items(accept_envelopes(scanned), outer=True), bundle, keep=("request_id", ENVELOPE, "pos", "imdb_id")))
            assert sorted(map(str, results.select("request_id", "results").collect())) == sorted(map(str, batch.collect())) and not ids[2]
        else:
            assert ids[2]


def test_one_file_of_envelopes_is_dealt_out(spark, bundle, monkeypatch):
    """A micro-batch that is one small file is parsed by every core; envelopes that are sent twice are answered twice."""
    from mediascore.sources.fixtures import media_envelopes
    from mediascore.streaming import score_stream

    base = checkpoint_path(spark, "test-streams", uuid.uuid4().hex)
    env = media_envelopes(spark, SF)
    env.unionByName(env).coalesce(1).write.parquet(base + "/src")
    parts = []
    scan = score_stream.scan_batch_envelope

    def seen(batch):
        parts.append(batch.rdd.getNumPartitions())
        return scan(batch)

    monkeypatch.setattr(score_stream, "scan_batch_envelope", seen)
    score_stream.start_envelope_stream(spark, bundle, base + "/src", base, base + "/ckpt").awaitTermination()
    assert len(parts) == 1 and parts[0] >= spark.sparkContext.defaultParallelism
    results, rejected = (spark.read.parquet(f"{base}/{s}") for s in ("results", "rejections"))
    twice = [tuple(r) for r in results.groupBy("request_id").count().collect()]
    assert {n for _, n in twice} == {2}
    assert len(twice) + rejected.select("request_id").distinct().count() == env.count()


def test_runs_from_their_rows(spark):
    from mediascore.operators.registry import folded_runs

    metrics = [("r1", "auc", 0.5, 1, 10), ("r1", "auc", 0.7, 3, 5), ("r1", "auc", 0.6, 3, 4), ("r1", "loss", 0.1, 0, 0), ("r2", "auc", None, 9, 9), (None, "auc", 0.2, 1, 1), ("r1", None, 1.0, 1, 1)]
    params = [("r1", "depth", "3"), ("r3", "eta", "0.1"), ("r3", None, "x")]
    got = {r["run_id"]: (r["metrics"], r["params"]) for r in folded_runs(spark.createDataFrame(metrics, "run_id string, key string, value double, step long, timestamp long"), spark.createDataFrame(params, "run_id string, key string, value string")).collect()}
    assert got == {"r1": ({"auc": 0.7, "loss": 0.1}, {"depth": "3"}), "r2": ({"auc": None}, {}), "r3": ({}, {"eta": "0.1"}), None: ({"auc": 0.2}, {})}


def test_artifact_folder_round_trip(spark, bundle):
    from mediascore.plans.fixture import fitted_artifacts
    from mediascore.sources.artifacts import load_bundle_artifacts, save_bundle_artifacts
    from mediascore.sources.fixtures import fixture_nodes, media_items_view

    root = checkpoint_path(spark, "test-registry", uuid.uuid4().hex)
    norm, schema, vocab = fitted_artifacts(media_items_view(spark, SF))
    feats = list(bundle.feature_names)
    nodes = fixture_nodes(spark, feats, 8, 3, list(bundle.categorical_features))
    save_bundle_artifacts(root, "3", normalization=norm, category_schema=schema, vocab=vocab, nodes=nodes,
                          feature_names=feats, model_name=MODEL, run_id="run-3")
    save_bundle_artifacts(root, "4", normalization=norm, category_schema=schema, vocab=vocab, nodes=nodes.limit(0),
                          feature_names=feats, model_name=MODEL, run_id="run-4")
    b3 = load_bundle_artifacts(spark, root, "3")
    assert (b3.version, b3.run_id, b3.feature_names) == ("3", "run-3", bundle.feature_names)
    assert b3.normalization == bundle.normalization and b3.category_schema == bundle.category_schema
    m = media_items_view(spark, SF)
    assert sorted(predict(m, b3).collect()) == sorted(predict(m, bundle).collect())
    with pytest.raises(ArtifactError):
        load_bundle_artifacts(spark, root, "4")  # empty node table
    with pytest.raises(ArtifactError):
        load_bundle_artifacts(spark, root, "5")  # no such folder
