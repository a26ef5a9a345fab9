"""Merkle manifest against the plain tree."""

import hashlib
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediascore.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def tree(nodes):
    """The root of a list of digests, and each one's siblings (left, right)."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = range(0, len(nodes), 3)
        for i in runs:
            for k, members in enumerate(below[i : i + 3]):
                for m in members:
                    paths[m].append(("".join(nodes[i : i + k]), "".join(nodes[i + k + 1 : i + 3])))
        nodes, below = [h(*nodes[i : i + 3]) for i in runs], [sum(below[i : i + 3], []) for i in runs]
    return nodes[0], paths


def expected(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, out = [], []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        sub, paths = tree([leaf(r, r[1]) for r in own])
        subs.append(sub)
        out += [(r, name, sub, p) for r, p in zip(own, paths)]
    if not subs:
        return []
    root, tops = tree(subs)
    done = []
    for r, name, sub, p in out:
        p = p + tops[names.index(name)]
        own = leaf(r, r[1])
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        node = leaf(r, r[1].replace("\n", "") if changed and r[1] is not None else r[1])
        for a, b in p:
            node = h(a, node, b)
        done.append((r[0], own, sub, root, h(*[a + b for a, b in p]), node, node == root))
    return sorted(done, key=str)


def found(spark, rows):
    out = merkle.checked(merkle.proofs(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA)), "doc_id"))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def many(n):
    """A hot source with a third of all rows, others, one of a single row, and one without a name."""
    return [(i, f"line {i}\nnext" if i % 5 else "one line", "en", ["hot", f"s{i % 7}", None, "é", "hot"][i % 5] if i else "lone", i) for i in range(n)]


ODD = [(None, None, None, None, None), (None, "a\n", "x", None, 1), (None, "a\n", "x", None, 1), (5, "", "", "", 0), (5, "", "", "", 0), (6, "\n", "en", "", 1), (7, "é ü" * 50000, "fr", "z", None)]


@pytest.mark.parametrize("digits", [1, 6])
def test_against_plain_tree(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rows = many(120) + ODD
    assert found(spark, rows) == expected(rows)


@pytest.mark.parametrize("rows", [[], ODD[:1], ODD[3:5], many(4)], ids=["empty", "null", "repeated", "few"])
def test_small_tables(spark, rows):
    assert found(spark, rows) == expected(rows)


def test_other_columns_and_sql(spark):
    rows = many(60) + [r for r in ODD if r[0] != 5]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = docs
    for name in ("grp", "rank", "hash", "probe", "path", "root", "node", "size", "block", "place", "row"):
        clash = clash.withColumn(name, F.lit(1))
    got = merkle.checked(merkle.proofs(merkle.document_leaves(clash), "doc_id"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    cursor = con.execute(merkle.oracle(6))
    assert [c[0] for c in cursor.description] == got.columns
    assert sorted(cursor.fetchall(), key=str) == expected(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=3), min_size=1, max_size=30))
def test_every_path_of_the_plain_tree_gives_its_root(texts):
    nodes = [h(t) for t in texts]
    root, paths = tree(nodes)
    for node, path in zip(nodes, paths):
        for a, b in path:
            node = h(a, node, b)
        assert node == root
