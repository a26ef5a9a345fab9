"""Near-duplicates, components and decontamination against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from mediascore.llm import decontaminate, embeddings, simhash
from mediascore.llm.common import ship
from mediascore.llm.components import components


def smallest(n, pairs):
    """The smallest number reachable from each of n."""
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(i, i + 1) for i in range(400, 480)] + [(500, k) for k in range(501, 700)]
    rows = [(a, b) for a, b in pairs] + [(None, 3), (3, None)]
    got = dict(components(spark.createDataFrame(rows, "x long, y long"), "x", "y").collect())
    want = smallest(700, pairs)
    assert all(got.get(i, i) == want[i] for i in range(700))
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \n ", "a", "A b", "a b c", "É é É x\x0by z", "x\u00a0y z w", "w" * 3000 + " a b " + "q" * 1500, "the " * 5000, "one two three four five six " * 30, "\x1c a \x1f b c d"]


def test_fingerprints():
    assert simhash.fingerprints(TEXTS, block=100).tolist() == [fingerprint(t) for t in TEXTS]


def near(fp):
    f = np.array(fp, np.uint64)
    return [(i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3) + i + 1]


@pytest.mark.parametrize("block", [1024, 7])
def test_pigeonring_loses_no_link(spark, block):
    ship(spark)
    rng, f = np.random.default_rng(1), []
    for base in rng.integers(0, 2**63, 25, dtype=np.uint64):
        for _ in range(60):
            x = int(base)
            for k in rng.choice(64, rng.integers(0, 9), replace=False):
                x ^= 1 << int(k)
            f.append(x)
    f = np.unique(np.array(f, np.uint64))
    nodes = spark.createDataFrame([(int(x), i) for i, x in enumerate(f.view(np.int64))], "fp long, rep long")
    got = dict(components(simhash.links(nodes, block), "a", "b").collect())
    want = smallest(len(f), near(f))
    assert [got.get(i, i) for i in range(len(f))] == want


@pytest.fixture(scope="module")
def copies(spark):
    ship(spark)
    rng = np.random.default_rng(5)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for g in range(12):
        words = list(rng.choice(vocabulary, 300))
        for k in range(12):
            own = list(words)
            for i in rng.choice(300, k // 4, replace=False):
                own[i] = "changed"
            rows.append((len(rows), " ".join(own), "en", "s", 1, "clash"))
    rows += [(len(rows) + i, t, None, None, None, None) for i, t in enumerate(TEXTS)]
    rows += [(None, "a b c", "en", "s", 1, "clash"), (3, rows[3][1], "en", "s", 1, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string").repartition(4)


def test_simhash_components(copies):
    rows = sorted(((r.doc_id, r.text) for r in copies.collect() if r.doc_id is not None), key=lambda x: x[0])
    pairs = near([fingerprint(t) for _, t in rows])
    want = smallest(len(rows), pairs)
    got = simhash.near_duplicates(copies)
    assert got.count() == copies.count()
    found = {r.doc_id: r.component_id for r in got.collect()}
    assert found.pop(None) is None
    assert found == {d: rows[c][0] for (d, _), c in zip(rows, want)}
    kept = simhash.drop_near_duplicates(copies).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({d for d, c in found.items() if d == c})
    assert sum(r.doc_id is None for r in kept) == 1 and kept[0].__fields__ == copies.columns


def test_simhash_of_no_documents(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute(vectors, threshold):
    ok = [v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v) for _, v in vectors]
    n, pairs = [0] * len(vectors), []
    for i, (_, a) in enumerate(vectors):
        for j, (_, b) in enumerate(vectors[:i]):
            if ok[i] and ok[j]:
                a_, b_ = np.float32(a).astype(float), np.float32(b).astype(float)
                if a_ @ b_ / np.sqrt((a_ @ a_) * (b_ @ b_)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    pairs.append((i, j))
    return n, smallest(len(vectors), pairs)


def test_embeddings(spark):
    ship(spark)
    rng = np.random.default_rng(2)
    vectors = []
    for c in rng.normal(size=(15, 8)):
        for _ in range(14):
            vectors.append([float(x) for x in c + 0.15 * rng.normal(size=8)])
    vectors += [vectors[0]] * 40 + [[2 * x for x in vectors[1]], None, [], [0.0] * 8, [1.0] * 7, [1.0] * 9, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [1.0] * 7]
    rows = list(enumerate(vectors))
    n, comp = brute(rows, 0.95)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n_links string")
    for margin, block in ((0.32, 2048), (0.32, 20)):  # the exact margin: no link may be lost
        got = sorted(embeddings.near_duplicates(df, 0.95, margin=margin, cell_rows=30, block=block).collect())
        assert [tuple(r) for r in got] == [(i, n[i], comp[i], comp[i] == i) for i, _ in rows]
    default = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, 0.95, cell_rows=30).collect()}
    assert all(default[i] <= n[i] for i, _ in rows) and sum(default.values()) >= 0.9 * sum(n)
    odd = embeddings.near_duplicates(spark.createDataFrame([(None, [1.0]), (4, [1.0])], "vec_id long, embedding array<float>"), 0.95).collect()
    assert Row(vec_id=None, n_links=0, component_id=None, kept=True) in odd and len(odd) == 2
    assert embeddings.near_duplicates(df.limit(0), 0.95).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(1, [0.0])], "vec_id long, embedding array<float>"), 0.95).collect() == [Row(1, 0, 1, True)]


def test_recall_of_the_registered_margin(spark):
    """Against brute force on a given table, with copies of every nearness added, over many cells."""
    ship(spark)
    data = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(data.embedding.values).astype(np.float32)
    rng = np.random.default_rng(8)
    near = [x]
    for cosine in (0.952, 0.96, 0.975, 0.99, 0.999):
        unit = x[:400] / np.linalg.norm(x[:400], axis=1, keepdims=True)
        off = rng.normal(size=unit.shape)
        off -= (off * unit).sum(1, keepdims=True) * unit
        near.append((cosine * unit + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off, axis=1, keepdims=True)).astype(np.float32))
    x = np.concatenate(near)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(table, 0.95, cell_rows=60).collect()}
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = (x @ x.T >= 0.95).sum(1) - 1
    have = np.array([got[i] for i in range(len(x))])
    assert n.sum() > 3000 and (have <= n).all() and have.sum() >= 0.98 * n.sum()


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (1 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(max(r) for r in h)


def plain(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_alignment():
    rng = np.random.default_rng(4)
    item = rng.integers(1, 6, 12).astype(np.uint64)
    windows = rng.integers(0, 6, (50, 30)).astype(np.uint64)
    assert decontaminate.align(item, windows).tolist() == [smith_waterman(item.tolist(), [w or -1 for w in row.tolist()]) for row in windows]


def test_decontamination(spark):
    ship(spark)
    rng = np.random.default_rng(6)
    vocabulary = ["v%d" % i for i in range(300)] + ["the", "of", "in"] * 60
    say = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, " ".join(say(int(n)))) for i, n in enumerate(rng.integers(12, 40, 20))]
    items += [(90, None), (91, ""), (None, "no id here at all"), (92, "zq"), (93, "zq zr"), (5, "a second item of the same number five")]
    docs = []
    for d in range(120):
        words = say(int(rng.integers(0, 300)))
        if d % 3 == 0:  # a whole, edited or shortened copy
            copy = items[d % 20][1].split()
            for i in rng.choice(len(copy), len(copy) * (d % 4) // 12, replace=False):
                copy[i] = ["changed", "", "two words"][i % 3]
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = " ".join(copy).upper().split()
        docs.append((d, " ".join(words), "clash"))
    docs += [(200, None, None), (201, "", ""), (202, "the " * 20_000, ""), (203, "before zq, ZR! after", ""), (None, items[0][1], "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t, _ in docs:
        for i, x in items:
            if i is not None and plain(x):
                s = smith_waterman(plain(x), plain(t)) if d != 202 else 0
                if counts(plain(x), plain(t), s):
                    want[d, i] = max(s / len(plain(x)), want.get((d, i), 0))
    for block in (decontaminate.BLOCK_WORDS, 100):  # one block of items, and several
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(df, bench, block).collect()}
        assert set(got) <= set(want) and all(abs(got[k] - want[k]) <= 0.2 for k in got)
        # a copy without four words in a row need not be found
        assert {k for k, s in want.items() if s >= 0.7} <= set(got)
        assert len(got) >= 0.95 * len(want)
    clean = decontaminate.remove(df, bench)
    assert clean.columns == df.columns
    bad = {d for d, _ in got}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _, _ in docs if d not in bad)
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.remove(df, bench.limit(0)).count() == len(docs)
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def counts(item, text, score):
    """Whether a score (in words) is enough: half of the item and five words, or all of a shorter item; of one or two words only as a whole text."""
    return score >= max(len(item) / 2, min(len(item), 5)) and (len(item) >= 3 or len(text) == len(item))


def test_short_items_do_not_mark_longer_texts(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "the dog ran home"), (2, "a bird"), (3, "The cat."), (4, "A"), (5, "x the cat sat y"), (6, "the cat slept"), (7, "one two three four nine")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the cat"), (2, "a"), (3, "the cat sat"), (4, "one two three four five six seven")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == {(3, 1), (4, 2), (5, 3)}
    assert sorted(r.doc_id for r in decontaminate.remove(docs, items).collect()) == [1, 2, 6, 7]


def test_seeds_of_a_full_block():
    """A block of BLOCK_WORDS words: seeds are chosen in whole columns, within seconds."""
    rng = np.random.default_rng(3)
    words = list(rng.integers(1, 1 << 62, decontaminate.BLOCK_WORDS).astype(np.uint64).reshape(-1, 50))
    items = decontaminate.Items.of(list(range(len(words))), words, decontaminate._all_grams(words))
    f = rng.integers(0, 9, len(items.seeds[2][0]))
    kept = decontaminate._rarest(items, {2: f}).seeds[2]
    for i in range(0, len(words), 2500):
        own = decontaminate.grams(words[i], 2)
        known = f[np.searchsorted(items.seeds[2][0], own)]
        rarest = np.argsort(known, kind="stable")[: 49 - 24 + 1]
        assert sorted(kept[3][kept[2] == i]) == sorted(int(k) for k in rarest if known[k])


def test_every_copy_of_the_threshold_is_found(spark):
    """Edits all over an item, whose intact n-grams lie between ones that no document holds; scores are exact."""
    ship(spark)
    rng = np.random.default_rng(9)
    items, docs = [], []
    for n in (1, 2, 3, 4, 5, 15, 38, 59):
        words = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for every in (2, 3, 4, 5):
            copies = [[w if k % every else f"other{k}" for k, w in enumerate(words, 1)], [x for k, w in enumerate(words, 1) for x in ([w] if k % every else [w, f"more{k}"])]]
            copies.append([w for k, w in enumerate(words, 1) if k % every])
            copies.append([x for k, w in enumerate(words) for x in ([w] if k < n // 2 else [w, "late"] if k % 2 else [w])])
            docs += [["before"] * int(rng.integers(0, 80)) + c + ["after"] * int(rng.integers(0, 80)) for c in copies]
        for _ in range(20):  # any mix of edits
            kind = rng.choice(4, n, p=[0.7, 0.1, 0.1, 0.1])
            docs.append([x for w, k in zip(words, kind) for x in ([w], [f"r{w}"], [w, "new"], [])[k]])
    docs += [i[1].split() for i in items[3:]] * 5  # whole copies make all n-grams common
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i): s / len(x.split()) for d, t in enumerate(docs) for i, x in items if counts(x.split(), t, s := smith_waterman(x.split(), t))}
    for table, expected in ((df, want), (df.where("doc_id < %d" % (len(docs) - 25)), {k: s for k, s in want.items() if k[0] < len(docs) - 25})):
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(table, bench).collect()}
        assert got == expected and len(got) > 100
    assert {r.doc_id for r in decontaminate.remove(df, bench).collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_default_margin_loses_no_link_in_a_group_of_few_directions(spark):
    """A hot group that k-means splits along its own directions, with many links across boundaries."""
    ship(spark)
    rng = np.random.default_rng(11)
    for directions in (2, 3, 8):
        base, basis = rng.normal(size=24), rng.normal(size=(directions, 24))
        x = (base / np.linalg.norm(base) + 0.25 * rng.normal(size=(1200, directions)) @ (basis / np.linalg.norm(basis, axis=1, keepdims=True))).astype(np.float32)
        x = np.concatenate([x, x[:50], rng.normal(size=(200, 24)).astype(np.float32)])
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
        x = x.astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        link = x @ x.T >= 0.95
        n, comp = link.sum(1) - 1, smallest(len(x), np.argwhere(np.triu(link, 1)).tolist())
        for block in (2048, 50):
            got = {r.vec_id: r for r in embeddings.near_duplicates(table, 0.95, cell_rows=60, block=block).collect()}
            assert [got[i].n_links for i in range(len(x))] == n.tolist() and [got[i].component_id for i in range(len(x))] == comp


def test_vectors_of_every_length_are_compared(spark):
    """Two lengths that fill several cells, and a rare one."""
    ship(spark)
    rng = np.random.default_rng(12)
    vectors = []
    for dim, groups in ((6, 20), (9, 20), (4, 2)):
        for c in rng.normal(size=(groups, dim)):
            vectors += [(c + 0.15 * rng.normal(size=dim)).astype(np.float32) for _ in range(8)]
    vectors = [vectors[i] for i in rng.permutation(len(vectors))] + vectors[:3]
    link = np.array([[len(a) == len(b) and bool(a.astype(float) @ b.astype(float) >= 0.95 * np.sqrt((a.astype(float) ** 2).sum() * (b.astype(float) ** 2).sum())) for b in vectors] for a in vectors])
    n, comp = link.sum(1) - 1, smallest(len(vectors), np.argwhere(np.triu(link, 1)).tolist())
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    got = {r.vec_id: r for r in embeddings.near_duplicates(table, 0.95, cell_rows=30, block=40).collect()}
    assert [got[i].n_links for i in range(len(vectors))] == n.tolist() and [got[i].component_id for i in range(len(vectors))] == comp
    assert all(n[[len(v) == d for v in vectors]].sum() > 0 for d in (4, 6, 9))


def test_rows_that_share_an_id_are_dropped_by_their_own_text(spark):
    ship(spark)
    rng = np.random.default_rng(13)
    a, b, c, d = (" ".join(rng.choice(["w%d" % i for i in range(400)], 300)) for _ in range(4))
    e = next(x for k in range(300) if fingerprint(x := " ".join(w if i != k else "new" for i, w in enumerate(c.split()))) != fingerprint(c) and near([fingerprint(c), fingerprint(x)]))
    rows = [(3, a, "1"), (7, a, "2"), (7, b, "3"), (9, b, "4"), (11, e, "5"), (12, c, "6"), (12, d, "7"), (12, d, "8"), (None, a, "9"), (None, a, "10")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted(map(tuple, kept), key=str) in [sorted([rows[i] for i in (0, 2, 4, last, 8, 9)], key=str) for last in (6, 7)]


def test_huge_and_tiny_vectors_are_compared(spark):
    ship(spark)
    rng = np.random.default_rng(14)
    x = np.repeat(rng.normal(size=(12, 8)), 3, 0) + 0.05 * rng.normal(size=(36, 8))
    size = 10.0 ** rng.choice([-300, -200, 0, 200, 300], len(x))
    table = spark.createDataFrame([(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, size))], "vec_id long, embedding array<double>").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    n, comp = link.sum(1) - 1, smallest(len(x), np.argwhere(np.triu(link, 1)).tolist())
    got = {r.vec_id: r for r in embeddings.near_duplicates(table, 0.95, cell_rows=6, block=10).collect()}
    assert [got[i].n_links for i in range(len(x))] == n.tolist() and [got[i].component_id for i in range(len(x))] == comp and n.sum() > 30
