"""Feature engineering (C1-C15) on small typed frames."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mediascore.bundle import ArtifactError, Bundle
from mediascore.operators import features as FE
from mediascore.operators.fit import fit_category_schema, fit_category_vocab, fit_normalization
from mediascore.sources.artifacts import load_category_maps, load_category_schema, load_normalization, load_vocab
from mediascore.sources.records import typed_records


def mk_bundle(norm=None, schema=None, vocab=None, features=(), mode="vocab"):
    maps = {}
    if schema:
        rows = SparkSession.getActiveSession().createDataFrame([(c, list(n)) for c, n in schema], "original_column string, exploded_mapping array<string>")
        maps = load_category_maps(rows)
    return Bundle("m", "1", "r", norm or {}, tuple(schema or ()), vocab or {}, tuple(features), None, categorical_mode=mode, maps=maps)


def test_normalize_null_is_min_and_no_clamp(spark):
    df = spark.createDataFrame([("a", None), ("b", 10), ("c", 30)], "imdb_id string, budget long")
    b = mk_bundle(norm={"budget": (10.0, 20.0), "revenue": (0.0, 1.0)})
    out = {r["imdb_id"]: r["budget_norm"] for r in FE.normalize_minmax(df, b).collect()}
    assert out == {"a": 0.0, "b": 0.0, "c": 2.0}
    assert "revenue_norm" not in FE.normalize_minmax(df, b).columns


def test_degenerate_range_never_divides(spark):
    df = spark.createDataFrame([("a", 5), ("b", 6), ("c", None)], "imdb_id string, runtime long")
    out = FE.normalize_minmax(df, mk_bundle(norm={"runtime": (5.0, 5.0)}))
    got = {r["imdb_id"]: (r["runtime_norm"], r[FE.FEATURE_ERRORS]) for r in out.collect()}
    assert got == {"a": (0.0, []), "b": (0.0, ["runtime:degenerate_range"]), "c": (0.0, [])}


def test_multi_hot_rules(spark):
    schema = [("genre", ("genre_drama", "genre_crime", "genre_")), ("origin_country", ("origin_country_us",))]
    b = mk_bundle(schema=schema)
    df = spark.createDataFrame(
        [("a", ["Drama", "drama", "Opera"], ["US"]), ("b", None, []), ("c", ["!!!"], None), ("d", [None, ""], ["us"])],
        "imdb_id string, genre array<string>, origin_country array<string>",
    )
    out = {r["imdb_id"]: r.asDict() for r in FE.multi_hot_encode(df, b).collect()}
    assert (out["a"]["genre_drama"], out["a"]["genre_crime"], out["a"]["origin_country_us"]) == (1, 0, 1)
    assert (out["b"]["genre_drama"], out["b"]["origin_country_us"]) == (0, 0)
    assert out["c"]["genre_"] == 1  # '!!!' cleans to '' and matches category ''
    assert (out["d"]["genre_drama"], out["d"]["genre_"], out["d"]["origin_country_us"]) == (0, 0, 1)


def test_missing_column_and_empty_map(spark):
    b = mk_bundle(schema=[("genre", ("genre_drama",)), ("spoken_languages", ("en", "fr"))])
    df = spark.createDataFrame([("a", ["en"])], "imdb_id string, spoken_languages array<string>")
    r = FE.multi_hot_encode(df, b).first()
    assert (r["genre_drama"], r["en"], r["fr"]) == (0, 0, 0)


def test_collisions_and_non_list_schema_column_rejected(spark):
    df = spark.createDataFrame([("a", "x")], "imdb_id string, genre string")
    with pytest.raises(ArtifactError):
        FE.multi_hot_encode(df, mk_bundle(schema=[("genre", ("genre_x",))]))
    df2 = spark.createDataFrame([("a", ["x"])], "imdb_id string, genre array<string>")
    with pytest.raises(ArtifactError):
        FE.multi_hot_encode(df2.withColumn("genre_x", F.lit(1)), mk_bundle(schema=[("genre", ("genre_x",))]))


def test_categoricals_fill_align_coerce(spark):
    b = mk_bundle(vocab={"production_status": {"Released": 1, "Rumored": 2}},
                  features=("budget", "production_status", "original_language", "missing_num", "genre_drama"))
    df = spark.createDataFrame([("a", "Released", None), ("b", "Unknown", 5), ("c", None, None)],
                               "imdb_id string, production_status string, budget long")
    out = FE.numeric_coerce(FE.align_features(FE.fill_numeric(FE.single_value_category(df, b), b), b), b)
    assert out.columns == ["imdb_id", "budget", "production_status", "original_language", "missing_num", "genre_drama"]
    got = {r["imdb_id"]: tuple(r)[1:] for r in out.collect()}
    assert got == {"a": (0.0, 1, None, 0.0, 0.0), "b": (5.0, None, None, 0.0, 0.0), "c": (0.0, None, None, 0.0, 0.0)}
    local = mk_bundle(features=b.feature_names, mode="local")
    codes = {r["imdb_id"]: r["production_status"] for r in FE.single_value_category(df, local).collect()}
    assert codes == {"a": 0, "b": 0, "c": None}


def test_fitted_artifacts_round_trip(spark):
    df = typed_records(spark.createDataFrame(
        [("tt0000001", 1990, ["Drama", "Sci-Fi"], "Released"), ("tt0000002", 2000, ["drama", None], "Rumored")],
        "imdb_id string, release_year int, genre array<string>, production_status string"))
    norm = load_normalization(fit_normalization(df))
    assert norm == {"release_year": (1990.0, 2000.0)}
    schema = dict(load_category_schema(fit_category_schema(df)))
    assert schema["genre"] == ("genre_drama", "genre_sci_fi")
    assert load_vocab(fit_category_vocab(df)) == {"production_status": {"Released": 0, "Rumored": 1}}


def test_preprocess_keeps_rows_and_duplicates(spark, bundle):
    from mediascore.sources.fixtures import media_items_view

    m = media_items_view(spark, "/root/testdata/sf0.001")
    doubled = m.unionByName(m)
    out = FE.preprocess(doubled, bundle)
    assert out.count() == 2 * m.count()
    assert out.columns == ["imdb_id", *bundle.feature_names]


def test_single_pass_fit_equals_separate_fits(spark):
    from mediascore.operators.fit import fit_artifacts, fit_category_schema_long
    from mediascore.sources.fixtures import media_items_view

    m = media_items_view(spark, "/root/testdata/sf0.001")
    norm, schema_long, vocab = fit_artifacts(m)
    assert sorted(norm.collect()) == sorted(fit_normalization(m).collect())
    assert sorted(schema_long.collect()) == sorted(fit_category_schema_long(m).select("original_column", "category", "column_name").collect())
    assert sorted(vocab.collect()) == sorted(fit_category_vocab(m).select("column", "value", "code").collect())


def test_json_artifact_files_round_trip(spark, bundle):
    """Fitted tables -> JSON list files -> tables -> the same bundle."""
    import uuid

    from mediascore.operators.fit import fit_artifacts
    from mediascore.plans.fixture import model_features
    from mediascore.session import checkpoint_path
    from mediascore.sources.artifacts import (
        build_bundle, category_schema_from_long, read_json_artifact, write_json_artifact,
    )
    from mediascore.sources.fixtures import fixture_nodes, media_items_view

    m = media_items_view(spark, "/root/testdata/sf0.001")
    norm, schema_long, vocab = fit_artifacts(m)
    base = checkpoint_path(spark, "test-artifacts", uuid.uuid4().hex)
    write_json_artifact(norm, base + "/normalization")
    write_json_artifact(category_schema_from_long(schema_long), base + "/schema")
    write_json_artifact(vocab, base + "/vocab")
    text = spark.read.text(base + "/normalization").first()[0]
    assert text.startswith("[{") and text.endswith("}]")
    n2 = read_json_artifact(spark, base + "/normalization")
    s2 = read_json_artifact(spark, base + "/schema")
    v2 = read_json_artifact(spark, base + "/vocab")
    feats = model_features(load_normalization(n2), load_category_schema(s2), load_category_maps(s2))
    assert tuple(feats) == bundle.feature_names
    b2 = build_bundle(normalization=n2, category_schema=s2, vocab=v2,
                      nodes=fixture_nodes(spark, feats, 8, 3, ["original_language", "production_status"]),
                      feature_names=feats)
    assert b2.normalization == bundle.normalization and b2.vocab == bundle.vocab
    assert b2.category_schema == bundle.category_schema


def test_printed_array_schema_artifact(spark, bundle):
    """The legacy printed-array form of exploded_mapping loads the same."""
    from mediascore.plans.workloads import printed_schema
    from mediascore.sources.artifacts import category_schema_from_long
    from mediascore.operators.fit import fit_category_schema_long
    from mediascore.sources.fixtures import media_items_view

    m = media_items_view(spark, "/root/testdata/sf0.001")
    printed = printed_schema(category_schema_from_long(fit_category_schema_long(m)))
    assert isinstance(printed.schema["exploded_mapping"].dataType.__class__.__name__, str)
    assert load_category_schema(printed) == bundle.category_schema


def test_large_vocabulary_fits_saves_loads_and_scores(spark, bundle):
    """200,000 values: numbered over several partitions, written, read back, looked up by the scorer."""
    import uuid
    from dataclasses import replace

    from mediascore.plans.predict import predict
    from mediascore.session import checkpoint_path
    from mediascore.sources.artifacts import read_json_artifact, write_json_artifact

    n = 200_000
    df = spark.range(n).select(F.concat(F.lit("status "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("production_status"))
    vocab = fit_category_vocab(df.union(df.limit(50)))
    assert vocab.count() == n
    assert vocab.where(F.col("value") != F.concat(F.lit("status "), F.lpad(F.col("code").cast("string"), 6, "0"))).isEmpty()
    path = checkpoint_path(spark, "test-artifacts", uuid.uuid4().hex)
    write_json_artifact(vocab, path)
    loaded = load_vocab(read_json_artifact(spark, path))
    assert len(loaded["production_status"]) == n
    big = replace(bundle, vocab={**bundle.vocab, **loaded})
    one = spark.createDataFrame([("tt1", "status 199999"), ("tt2", "status 000001"), ("tt3", "unknown")], "imdb_id string, production_status string")
    by = {r["imdb_id"]: r["margin"] for r in predict(one, big, with_margin=True).collect()}
    known = {"status 199999": 199_999, "status 000001": 1}
    small = {r["imdb_id"]: r["margin"] for r in predict(one, replace(bundle, vocab={**bundle.vocab, "production_status": known}), with_margin=True).collect()}
    assert by == small


def test_vocabulary_of_three_million_values(spark, bundle, monkeypatch):
    """Over the bound the vocabulary stays a table; codes found by joins score
    like those of the map, with a hot value, unknown ones and nulls."""
    from dataclasses import replace

    from mediascore.plans.predict import predict
    from mediascore.sources import artifacts

    n = 3_000_000
    name = lambda c: F.concat(F.lit("status "), F.lpad(c.cast("string"), 7, "0"))
    vocab = spark.range(n).select(F.lit("production_status").alias("column"), name(F.col("id")).alias("value"), F.col("id").cast("int").alias("code"))
    assert artifacts.large_vocabularies(vocab) == ("production_status",)
    big = replace(bundle, vocab={c: v for c, v in bundle.vocab.items() if c != "production_status"}, vocab_table=vocab, large_columns=("production_status",))
    rows = spark.range(3000).select(
        F.concat(F.lit("tt"), F.col("id").cast("string")).alias("imdb_id"),
        F.when(F.col("id") % 3 == 0, name(F.lit(1))).when(F.col("id") % 100 == 1, F.lit(None)).when(F.col("id") % 100 == 2, F.lit("unknown")).otherwise(name(F.col("id") * 997 % n)).alias("production_status"),
    )
    got = {r["imdb_id"]: r["margin"] for r in predict(rows, big, with_margin=True).collect()}
    known = {r["production_status"] for r in rows.collect()} - {None, "unknown"}
    small = replace(bundle, vocab={**bundle.vocab, "production_status": {v: int(v.split()[1]) for v in known}})
    want = {r["imdb_id"]: r["margin"] for r in predict(rows, small, with_margin=True).collect()}
    assert got == want and len(got) == 3000


def test_fit_of_changed_files_alone(spark):
    """Adding and removing files gives the artifacts of a full fit; known files are not read."""
    import uuid

    from mediascore.operators.fit import fit_artifacts, fit_incremental
    from mediascore.session import checkpoint_path
    from mediascore.sources.fixtures import media_items

    base = checkpoint_path(spark, "test-incremental", uuid.uuid4().hex)
    items = media_items(spark, "/root/testdata/sf0.001")
    for k in range(3):
        items.where(F.col("p_partkey") % 3 == k).coalesce(1).write.parquet(f"{base}/in/{k}")
    files = lambda *ks: [f for k in ks for f in spark.read.parquet(f"{base}/in/{k}").inputFiles()]
    reads = []

    def read(paths):
        reads.extend(paths)
        return spark.read.parquet(*paths)

    for now, fresh in (((0, 1), (0, 1)), ((0, 1), ()), ((1, 2), (2,)), ((2,), ()), ((), ()), ((0, 1, 2), (0, 1, 2))):
        reads.clear()
        got = fit_incremental(spark, files(*now), base + "/state", read)
        assert sorted(reads) == sorted(files(*fresh))
        want = fit_artifacts(spark.read.parquet(*files(*now)) if now else items.limit(0))
        for a, b in zip(got, want):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_incremental_fit_of_many_files_is_one_scan(spark, monkeypatch):
    """Files of any name and of two schemas, forty of them: the artifacts of a full fit, and a plan that does not grow with the files."""
    import uuid
    from urllib.parse import unquote

    from pyspark.sql import DataFrameWriter

    from mediascore.operators.fit import fit_artifacts, fit_incremental
    from mediascore.session import checkpoint_path
    from mediascore.sources.fixtures import media_items_view

    base = checkpoint_path(spark, "test-incremental", uuid.uuid4().hex)
    items = media_items_view(spark, "/root/testdata/sf0.001")
    items.repartition(20).write.parquet(f"{base}/é a%20+b=1")
    items.drop("runtime").withColumn("budget", F.col("budget").cast("double")).repartition(20).write.parquet(f"{base}/in/k=2")
    files = [unquote(f) for d in ("é a%20+b=1", "in/k=2") for f in spark.read.parquet(f"{base}/{d}").inputFiles()]
    assert len(files) == 40
    plans = []
    written = DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().analyzed().toString())
        return written(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    got = fit_incremental(spark, files, base + "/state")
    assert plans[0].count("Relation [") == 2
    both = items.unionByName(items.drop("runtime").withColumn("budget", F.col("budget").cast("double")), allowMissingColumns=True)
    for a, b in zip(got, fit_artifacts(both)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.fixture
def eight_partitions(spark):
    """Shuffles keep their eight partitions, however small."""
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_incremental_query_writes_its_files_in_parallel(spark, eight_partitions, monkeypatch):
    """No part of the input is drawn into one task."""
    from mediascore.plans import workloads

    base = workloads.scratch_path(spark, "incremental")
    monkeypatch.setattr(workloads, "scratch_path", lambda *_: base)
    assert workloads.q_fit_incremental(spark, "/root/testdata/sf0.001").count() > 0
    assert [len(spark.read.parquet(f"{base}/in/{k}").inputFiles()) for k in range(4)] == [8] * 4


def test_refresh_sources_are_written_in_parallel(spark, eight_partitions, monkeypatch):
    """Each third of the requests arrives as the files of all tasks."""
    from types import SimpleNamespace

    import mediascore.streaming as streaming
    from mediascore.plans import workloads
    from mediascore.sources.fixtures import media_raw

    monkeypatch.setattr(streaming, "ModelRefresher", lambda *_: None)
    monkeypatch.setattr(streaming, "start_refreshing_stream", lambda *_: SimpleNamespace(awaitTermination=lambda: None))
    source = spark.read.text(workloads._refreshed(spark, "/root/testdata/sf0.001") + "/source")
    assert len(source.inputFiles()) == 3 * 8
    assert source.count() == media_raw(spark, "/root/testdata/sf0.001").count()
