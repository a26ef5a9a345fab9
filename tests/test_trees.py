"""Tree scoring (M1-M5): numpy traversal vs a per-row walk, Arrow vs
expressions, probability and label."""

from dataclasses import replace

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediascore.bundle import ArtifactError
from mediascore.operators.trees import margins_numpy, tree_arrays
from mediascore.plans.predict import predict
from mediascore.sources.fixtures import media_items_view


def walk(nodes_by_tree, features, row):
    """Test-only per-row walk of every tree."""
    total = 0.0
    for t, nodes in nodes_by_tree.items():
        n = nodes[0]
        while n["kind"] != "leaf":
            x = row[features.index(n["feature"])]
            if x is None or (isinstance(x, float) and math.isnan(x)):
                nxt = n["missing_id"]
            elif n["kind"] == "cat":
                nxt = n["yes_id"] if int(x) in n["categories"] else n["no_id"]
            else:
                nxt = n["yes_id"] if np.float32(x) < np.float32(n["threshold"]) else n["no_id"]
            n = nodes[nxt]
        total += float(np.float32(n["leaf"]))
    return total


def irregular_model():
    nodes = [
        dict(tree_id=0, node_id=0, feature="a", kind="num", threshold=0.5, categories=None, yes_id=1, no_id=2, missing_id=2, leaf=None),
        dict(tree_id=0, node_id=1, feature=None, kind="leaf", threshold=None, categories=None, yes_id=None, no_id=None, missing_id=None, leaf=0.25),
        dict(tree_id=0, node_id=2, feature="c", kind="cat", threshold=None, categories=[0, 3], yes_id=3, no_id=4, missing_id=4, leaf=None),
        dict(tree_id=0, node_id=3, feature=None, kind="leaf", threshold=None, categories=None, yes_id=None, no_id=None, missing_id=None, leaf=-0.5),
        dict(tree_id=0, node_id=4, feature="b", kind="num", threshold=0.1, categories=None, yes_id=5, no_id=6, missing_id=5, leaf=None),
        dict(tree_id=0, node_id=5, feature=None, kind="leaf", threshold=None, categories=None, yes_id=None, no_id=None, missing_id=None, leaf=1.0),
        dict(tree_id=0, node_id=6, feature=None, kind="leaf", threshold=None, categories=None, yes_id=None, no_id=None, missing_id=None, leaf=2.0),
        dict(tree_id=1, node_id=0, feature=None, kind="leaf", threshold=None, categories=None, yes_id=None, no_id=None, missing_id=None, leaf=0.125),
    ]
    return nodes, ["a", "b", "c"]


def test_numpy_traversal_matches_walk_irregular():
    nodes, feats = irregular_model()
    ta = tree_arrays(nodes, feats, ["c"])
    assert ta.depth == 3
    rng = np.random.default_rng(1)
    X = rng.random((500, 3)).astype(np.float32)
    X[:, 2] = rng.integers(0, 5, 500)
    X[::7, 0] = np.nan
    X[::5, 2] = np.nan
    X[::11, 1] = np.nan
    by_tree = {}
    for n in nodes:
        by_tree.setdefault(n["tree_id"], {})[n["node_id"]] = n
    expect = [walk(by_tree, feats, [None if np.isnan(v) else float(v) for v in row]) for row in X]
    np.testing.assert_allclose(margins_numpy(X, ta), expect, rtol=0, atol=1e-12)


def test_fixture_model_matches_walk(bundle):
    rng = np.random.default_rng(2)
    F_ = len(bundle.feature_names)
    X = rng.random((300, F_)).astype(np.float32)
    for c in bundle.categorical_features:
        i = bundle.feature_names.index(c)
        X[:, i] = rng.integers(0, 4, 300)
        X[::9, i] = np.nan
    by_tree = {}
    for n in bundle.nodes.to_pylist():
        by_tree.setdefault(n["tree_id"], {})[n["node_id"]] = n
    expect = [walk(by_tree, list(bundle.feature_names), [None if np.isnan(v) else float(v) for v in row]) for row in X]
    np.testing.assert_allclose(margins_numpy(X, bundle.trees), expect, rtol=0, atol=1e-12)


def test_bad_models_rejected():
    nodes, feats = irregular_model()
    with pytest.raises(ArtifactError):
        tree_arrays(nodes, ["a", "b"], [])  # unknown feature c
    broken = [dict(n) for n in nodes]
    broken[0]["yes_id"] = 99
    with pytest.raises(ArtifactError):
        tree_arrays(broken, feats, ["c"])


def test_arrow_equals_expr_and_probability(spark, bundle):
    m = media_items_view(spark, "/root/testdata/sf0.001")
    a = predict(m, bundle, with_margin=True)
    e = predict(m, bundle, scorer="expr", with_margin=True).select("imdb_id", F.col("margin").alias("m2"))
    j = a.join(e, "imdb_id")
    r = j.agg(F.max(F.abs(F.col("margin") - F.col("m2"))).alias("d"), F.count(F.lit(1)).alias("n"),
              F.min("probability").alias("lo"), F.max("probability").alias("hi")).first()
    assert r["n"] == m.count() and r["d"] == 0.0
    assert 0.0 <= r["lo"] <= r["hi"] <= 1.0
    for row in a.limit(20).collect():
        p = 1.0 / (1.0 + math.exp(-row["margin"]))
        assert abs(p - row["probability"]) < 1e-12 and row["prediction"] == (p > 0.5)


def test_single_equals_batch_and_duplicates_kept(spark, bundle):
    m = media_items_view(spark, "/root/testdata/sf0.001")
    one = m.limit(1)
    key = one.first()["imdb_id"]
    single = predict(one, bundle).first()
    batch = predict(m, bundle).where(F.col("imdb_id") == key).first()
    assert single == batch
    dup = predict(one.unionByName(one), bundle).collect()
    assert len(dup) == 2 and dup[0] == dup[1]


def test_minimal_record_scores(spark, bundle):
    from mediascore.sources.records import typed_records

    df = typed_records(spark.createDataFrame([("tt0111161",)], "imdb_id string"))
    r = predict(df, bundle).first()
    assert r["imdb_id"] == "tt0111161" and 0.0 <= r["probability"] <= 1.0


def test_feature_error_fails_the_batch(spark, bundle):
    df = spark.createDataFrame([("tt0000001", 7)], "imdb_id string, runtime long")
    deg = replace(bundle, normalization={"runtime": (5.0, 5.0)})
    with pytest.raises(Exception, match="feature error"):
        predict(df, deg).collect()


def test_sparse_form_scores_as_the_wide_form(spark, bundle):
    """Nulls, empty lists, unknown and repeated values, absent columns, extra features."""
    m = media_items_view(spark, "/root/testdata/sf0.001")
    odd = spark.createDataFrame(
        [("tt1", None, ["Drama", "drama", None, "", "??", "unknown"], ["US", "US"], "Released", None), ("tt2", [], None, ["xx"], "no such", "fr"), ("tt3", ["en"], [], None, None, "")],
        "imdb_id string, spoken_languages array<string>, genre array<string>, origin_country array<string>, production_status string, original_language string",
    )
    wider = replace(bundle, feature_names=(*bundle.feature_names, "nowhere", "budget"))
    for b in (bundle, wider, replace(bundle, categorical_mode="local"), replace(bundle, vocab={})):
        for df in (m, m.drop("genre", "original_language", "budget"), odd):
            sparse = predict(df, b, with_margin=True)
            wide = predict(df, b, scorer="arrow", with_margin=True)
            assert sorted(sparse.collect(), key=str) == sorted(wide.collect(), key=str)


def test_sparse_category_membership_is_exact(bundle):
    rng = np.random.default_rng(3)
    X = rng.random((700, len(bundle.feature_names))).astype(np.float32)
    for c in bundle.categorical_features:
        i = bundle.feature_names.index(c)
        X[:, i] = rng.integers(-1, 6, 700)
        X[::13, i] = np.nan
    dense = margins_numpy(X, bundle.trees)
    sparse = margins_numpy(X, bundle.trees, max_dense_cells=0)
    np.testing.assert_array_equal(dense, sparse)


def test_one_bad_item_fails_its_own_request(spark, bundle):
    from mediascore.plans.predict import outcomes, request_outcomes

    least, most = bundle.normalization["budget"]
    flat = replace(bundle, normalization={**bundle.normalization, "budget": (least, least), "revenue": (0.0, 1e-300)})
    rows = [(1, 0, "tt1", int(least), None), (1, 1, "tt2", int(least) + 1, None), (2, 0, "tt3", None, None), (3, 0, "tt4", int(least), 10**15), (2, 1, "tt5", int(least), 0)]
    items = spark.createDataFrame(rows, "request_id long, pos int, imdb_id string, budget long, revenue long")
    got = {r["request_id"]: r for r in request_outcomes(outcomes(items, flat, keep=("request_id", "pos", "imdb_id"))).collect()}
    assert [tuple(x) for x in got[1]["failures"]] == [(1, "tt2", "budget:degenerate_range")] and got[1]["results"] is None
    assert [x["imdb_id"] for x in got[2]["results"]] == ["tt3", "tt5"] and got[2]["failures"] == []
    assert [tuple(x) for x in got[3]["failures"]] == [(0, "tt4", "non_finite:revenue_norm")]
    with pytest.raises(Exception, match="feature error"):
        predict(items, flat).collect()
    # without a bad item, outcomes are the predictions
    good = items.where("imdb_id in ('tt1', 'tt3', 'tt5')")
    assert sorted(predict(good, flat).collect()) == sorted(outcomes(good, flat).select("imdb_id", "prediction", "probability").collect())


def test_packing_has_no_object_for_a_node():
    """A million nodes, shuffled: the arrays of the complete trees, in seconds; faults are named."""
    import time

    import pyarrow as pa

    per, trees = 1023, 1000
    n = per * trees
    rng = np.random.default_rng(4)
    order = rng.permutation(n)
    tree, node = np.divmod(np.arange(n), per)
    inner = node < per // 2
    none = lambda x: pa.array(x[order], pa.int32(), mask=~inner[order])
    table = pa.table({
        "tree_id": pa.array(tree[order], pa.int32()), "node_id": pa.array(node[order], pa.int32()), "feature": pa.array(np.array(["a", "b"])[node[order] % 2], mask=~inner[order]),
        "kind": pa.array(np.where(inner, "num", "leaf")[order]), "threshold": pa.array((node[order] % 97 / 97).astype(np.float32), mask=~inner[order]),
        "categories": pa.nulls(n, pa.list_(pa.int32())), "yes_id": none(2 * node + 1), "no_id": none(2 * node + 2), "missing_id": pa.nulls(n, pa.int32()),
        "leaf": pa.array((node[order] % 7).astype(np.float32), mask=inner[order]),
    })
    begin = time.time()
    got = tree_arrays(table, ["a", "b"], [])
    assert time.time() - begin < 20 and got.depth == 9 and got.n_trees == trees
    assert (got.roots == np.arange(trees) * per).all() and (got.yes[inner] == (tree * per + 2 * node + 1)[inner]).all() and (got.missing == got.yes).all()
    assert (got.yes[~inner] == np.flatnonzero(~inner)).all() and (got.leaf == np.where(inner, 0, node % 7)).all() and (got.feature[inner] == node[inner] % 2).all()
    with pytest.raises(ArtifactError, match="more than one row"):
        tree_arrays(pa.concat_tables([table, table.slice(0, 1)]), ["a", "b"], [])
    nodes, feats = irregular_model()
    for change, what in (({"no_id": 77}, "dangling child no_id"), ({"kind": "odd"}, "unknown kind"), ({"yes_id": 0, "no_id": 0}, "cycle"), ({"threshold": None}, "no threshold")):
        with pytest.raises(ArtifactError, match=what):
            tree_arrays([{**nodes[0], **change}, *nodes[1:]], feats, ["c"])
    with pytest.raises(ArtifactError, match="category code"):
        tree_arrays([nodes[0], nodes[1], {**nodes[2], "categories": [-1]}, *nodes[3:]], feats, ["c"])


def test_codes_over_a_million(spark, bundle):
    """Category codes beyond a million split like small ones."""
    leaf = dict(feature=None, kind="leaf", threshold=None, categories=None, yes_id=None, no_id=None, missing_id=None)
    nodes = [dict(tree_id=0, node_id=0, feature="c", kind="cat", threshold=None, categories=[3, 5_000_000], yes_id=1, no_id=2, missing_id=2, leaf=None),
             dict(tree_id=0, node_id=1, leaf=1.0, **leaf), dict(tree_id=0, node_id=2, leaf=2.0, **leaf)]
    got = margins_numpy(np.array([[3], [5_000_000], [5_000_001], [np.nan], [4]], np.float32), tree_arrays(nodes, ["c"], ["c"]))
    assert got.tolist() == [1.0, 1.0, 2.0, 2.0, 2.0]


def test_shards_add_up_to_the_whole_model(spark, bundle):
    from mediascore.sources.artifacts import load_shards
    from mediascore.sources.fixtures import fixture_nodes

    feats, cats = list(bundle.feature_names), list(bundle.categorical_features)
    nodes = fixture_nodes(spark, feats, 8, 3, cats)
    (one,), table = load_shards(nodes, feats, cats)
    assert table.num_rows == 120 and (one.yes == bundle.trees.yes).all()
    shards, none = load_shards(nodes, feats, cats, shard_nodes=50)
    assert none is None and [s.n_trees for s in shards] == [3, 3, 2] and max(len(s.yes) for s in shards) <= 50
    with pytest.raises(ArtifactError, match="do not fit a shard"):
        load_shards(nodes, feats, cats, shard_nodes=14)
    m = media_items_view(spark, "/root/testdata/sf0.001").unionByName(media_items_view(spark, "/root/testdata/sf0.001"))
    sharded = replace(bundle, trees=shards[0], more_trees=shards[1:], base_margin=0.5)
    got, want = (sorted(predict(m, b, with_margin=True).collect()) for b in (sharded, replace(bundle, base_margin=0.5)))
    assert len(got) == len(want) and all(a["imdb_id"] == b["imdb_id"] and abs(a["margin"] - b["margin"]) < 1e-12 for a, b in zip(got, want))
