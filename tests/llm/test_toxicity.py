"""The recurrent network against a plain forward pass, numeric gradients and held-out labels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediascore.llm import toxicity
from mediascore.llm.common import bucket_of, ship
from mediascore.llm.queries import op11_bigru_attention

SF = "/root/testdata/sf0.1"


def test_tokens_and_windows():
    assert [w for x in toxicity.token_lists("A b-c, É " + "x" * 20) for w in x] == ["a", "b", "c", "é", "x" * 16, "x" * 4]
    assert list(toxicity.token_lists(None)) == list(toxicity.token_lists("")) == []
    text = "word " * 1000 + "y" * 70 + " " + "tail, " * 500
    assert [w for x in toxicity.token_lists(text, 97) for w in x] == [w for x in toxicity.token_lists(text) for w in x]
    for n in range(300):
        start, length = toxicity.windows(n)
        assert start[0] == 0 and (np.diff(start) == toxicity.STRIDE).all() and start[-1] + length[-1] == n
        assert (length[:-1] == toxicity.WINDOW).all() and length[-1] <= toxicity.WINDOW


def plain_pool(p, x):
    """Attention-pooled states of one sequence of vectors, step by step."""
    hidden = len(p["v"])
    sig = lambda v: 1 / (1 + np.exp(-v))
    sides = []
    for d, seq in (("f", x), ("b", x[::-1])):
        h, out = np.zeros(hidden), []
        for v in seq:
            a, g = v @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
            z, r = sig(a[:hidden] + g[:hidden]), sig(a[hidden : 2 * hidden] + g[hidden : 2 * hidden])
            m = np.tanh(a[2 * hidden :] + r * (g[2 * hidden :] + p[f"c{d}"]))
            h = (1 - z) * m + z * h
            out.append(h)
        sides.append(out if d == "f" else out[::-1])
    states = np.concatenate([np.array(sides[0]), np.array(sides[1])], 1)
    e = np.tanh(states @ p["A"] + p["a"]) @ p["v"]
    w = np.exp(e - e.max())
    return (w / w.sum()) @ states


def small_net(dtype=np.float64):
    return toxicity.Net.new(["ab", "cde", "fool"], list("abcdeflo"), 1, dtype)


def plain_margin(net, tokens):
    if not tokens:
        return float(net.top[-1])
    rows = [np.concatenate([net.E[net.words.get(w, 0)], plain_pool(net.chars, net.L[[net.letters.get(c, 0) for c in w]])]) for w in tokens]
    return float(plain_pool(net.tokens, np.array(rows)) @ net.top[:-1] + net.top[-1])


def test_scores_are_those_of_every_window():
    net = small_net()
    net.low, net.high, net.cut = 0.1, 0.9, 0.3
    rng = random.Random(4)
    texts = [None, "", " ?! ", "ab", "AB. fool"] + [" ".join(rng.choice(["ab", "cde", "fool", "zé", "abcdefabcdefabcdef"]) for _ in range(n)) for n in (5, 63, 64, 65, 130, 400)]
    score, count, where = toxicity.Scorer(net, cache=3).score(texts)
    again = toxicity.Scorer(net).score(texts[::-1])[0][::-1]
    assert np.allclose(score, again, atol=1e-5)
    for i, text in enumerate(texts):
        tokens = [w for x in toxicity.token_lists(text) for w in x]
        start, length = toxicity.windows(len(tokens))
        margins = [plain_margin(net, tokens[s : s + n]) for s, n in zip(start, length)]
        assert count[i] == len(margins) and math.isclose(margins[where[i] // toxicity.STRIDE], max(margins), abs_tol=1e-4)
        assert abs(score[i] - 0.1 - 0.8 / (1 + math.exp(0.3 - max(margins)))) < 1e-4


def test_gradients():
    net = small_net()
    words = ["ab", "cde", "f", "aé", "bcdefa"]
    flat, start, length = np.array([0, 1, 2, 3, 4, 1, 0, 2, 2, 4, 3, 1]), np.array([0, 5, 9]), np.array([5, 4, 3])
    y, weight = np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])
    loss = lambda: toxicity.loss_and_gradients(net, words, flat, start, length, y, weight)
    _, grads = loss()
    rng = np.random.default_rng(0)
    for name, w in net.weights().items():
        for _ in range(8):
            at = tuple(rng.integers(n) for n in w.shape)
            old = w[at]
            w[at] = old + 1e-5
            up = loss()[0]
            w[at] = old - 1e-5
            down = loss()[0]
            w[at] = old
            assert math.isclose((up - down) / 2e-5, grads[name][at], rel_tol=1e-4, abs_tol=1e-7), name


def test_one_class_gives_the_prior():
    net = toxicity.train([(0, ["a b c"])] * 20, 0.2)
    assert toxicity.Scorer(net).score([None, "a b", "x " * 500])[0].tolist() == [0.2, 0.2, 0.2]
    assert toxicity.Scorer(toxicity.train([], 0.5)).score(["a"])[0].tolist() == [0.5]


@pytest.fixture(scope="module")
def texts(spark):
    """Made-up words; toxic texts hold one of three words somewhere, some of them far inside."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abdegiklmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(600):
        own = [rng.choice(words) for _ in range(rng.choice([5, 30, 120, 500]))]
        if toxic := i % 3 == 0:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["Idiotz", "scumz!", "trashz"]))
        rows.append((i, " ".join(own), int(toxic)))
    return rows


def test_held_out_labels(spark, texts):
    ship(spark)
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    odd = [(None, "a b"), (1, None), (1, ""), (10_000, "word " * 60_000 + "scumz idiotz trashz " + "word " * 60_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    for name in ("score", "predicted", "windows", "toxic", "__net", "label"):
        docs = docs.withColumn(name, F.lit("other"))
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, bucket_of(4) != 2, fit_rows=300)
    got = toxicity.scored(docs, net, F.col("doc_id"), (bucket_of(4) == 2).alias("held_out")).collect()
    assert len(got) == len(texts) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    label = {i: y for i, _, y in texts}
    own = [r for r in got if r["held_out"] and r["doc_id"] in label and r["windows"] and not (r["doc_id"] == 1)]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in own) >= 0.97 * len(own)
    long = next(r for r in got if r["doc_id"] == 10_000)
    assert long["predicted"] == 1 and abs(long["at"] - 60_000) <= toxicity.WINDOW and long["windows"] == 3750


def test_no_rows(spark):
    ship(spark)
    docs = spark.createDataFrame([], "doc_id long, text string")
    net = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.scored(docs, net, F.col("doc_id")).count() == 0


def test_query_on_given_documents(spark):
    got = op11_bigru_attention(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    # about a fifth of the toxic labels have nothing in their texts that bears them out
    found = [r for r in rows if r["predicted"]]
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.95 * len(rows)
    assert sum(r["toxic"] for r in found) >= 0.85 * len(found) and sum(r["toxic"] for r in found) >= 0.75 * sum(r["toxic"] for r in rows)
