"""Each stage of the pipeline, and the quality score, against a plain version over a small corpus."""

import math
import struct

import numpy as np
import public_tokenizers
import pytest
from test_filters import base_spans
from test_groups import counts, fingerprint, near, smallest, smith_waterman
from tokenizers import Tokenizer

import corpus_pipeline
from mediascore.llm import pii, quality
from mediascore.llm.common import bucket_of, ship
from mediascore.session import materialize, scratch_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    """Short documents of the given tables with copies, near copies, edited test items, personal data and odd rows; (sf_dir, documents)."""
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(12)
    short = [tuple(r) for r in docs.where("size(split(text, ' ')) < 160").orderBy("doc_id").limit(110).collect()]
    held = [r.text for r in items.collect()]
    rng = np.random.default_rng(2)
    extra = [(10_000 + i, t, "en", "src0", len(t)) for i, t in enumerate([short[3][1], short[3][1], short[5][1] + " end", short[7][1] + "."])]
    for i, t in enumerate(held[:6]):
        words = t.split()
        words[int(rng.integers(len(words)))] = "changed"
        extra.append((11_000 + i, short[i][1] + " " + " ".join(words) + " " + short[i + 9][1], "en", "src1", 0))
    extra += [(12_000, "write a1@b.com or +1 (017) 555-7713. " + short[20][1], "en", None, 5), (12_001, None, None, None, None), (12_002, "", "en", "x", 0), (12_003, "word " * 3000, "en", "x", 1)]
    table = spark.createDataFrame(short + extra, docs.schema).repartition(3)
    path = scratch_path(spark, "corpus")
    table.write.parquet(path + "/documents.parquet")
    items.write.parquet(path + "/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(path + "/labels.parquet")
    return path, spark.read.parquet(path + "/documents.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality(spark, corpus):
    path, docs = corpus
    model = quality.fit(docs, spark.read.parquet(path + "/labels.parquet"), bucket_of(3) != 1)

    def plain(text):
        x = np.zeros(quality.SIZE)
        x[quality.indicators(text)] = 1
        x *= model.ratio
        norm = math.sqrt(float(x @ x))
        w = np.divide(model.weights, model.ratio, out=np.zeros_like(model.weights), where=model.ratio != 0)
        margin = float(w @ x) / max(norm, 1e-12) + model.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * margin + model.shift))))

    score = {r.doc_id: r.score for r in quality.scored(docs, model, docs["doc_id"]).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(abs(score[i] - plain(t)) < 1e-9 for i, t in texts.items()) and min(score.values()) < 0.5 < max(score.values())
    kept = corpus_pipeline.good_quality(spark, docs, path)
    assert rows(kept) == sorted((tuple(r) for r in docs.collect() if plain(r.text) >= 0.5), key=str)


def test_near_duplicates(spark, corpus):
    path, docs = corpus
    own = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    groups = smallest(len(own), near([fingerprint(r[1]) for r in own]))
    assert rows(corpus_pipeline.one_of_each_group(spark, docs, path)) == sorted((r for i, r in enumerate(own) if groups[i] == i), key=str)
    assert len(set(groups)) <= len(own) - 2


def test_decontamination(spark, corpus):
    import re

    path, docs = corpus
    words = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    items = [words(r.text) for r in spark.read.parquet(path + "/benchmark.parquet").collect()]
    small = docs.where("doc_id < 12003")
    bad = {r.doc_id for r in small.collect() if any(i and set(i) & set(words(r.text)) and counts(i, words(r.text), smith_waterman(i, words(r.text))) for i in items)}
    assert bad >= set(range(11_000, 11_006))
    assert rows(corpus_pipeline.without_test_items(spark, small, path)) == sorted((tuple(r) for r in small.collect() if r.doc_id not in bad), key=str)


def test_personal_data(spark, corpus):
    path, docs = corpus
    found = materialize(pii.proposed(docs, docs["doc_id"]), "t")
    spans = {r.doc_id: r.spans for r in pii.decide(found, pii.fit(found)).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.without_personal_data(spark, docs, path).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        assert {(s.kind, s.start, s.end) for s in spans[r.doc_id]} >= set(base_spans(r.text))
        want, at = "", 0
        for a, b, kind in sorted((s.start, -s.end, s.kind) for s in spans[r.doc_id]):
            if a >= at:
                want, at = want + r.text[at:a] + f"[{kind.upper()}]", -b
        new = got[r.doc_id]
        assert new.text == (None if r.text is None else want + r.text[at:])
        assert (new.lang, new.source) == (r.lang, r.source) and (new.text is None or new.n_chars == len(new.text))


def test_packing(spark, corpus):
    path, docs = corpus
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, capacity = {}, corpus_pipeline.SEQUENCE
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces[r.doc_id, k] = (a, ids[a:b])
    gaps = []
    for n in sorted((len(ids) for _, ids in pieces.values()), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            i = min(fits, key=lambda i: gaps[i])
            gaps[i] -= n
        else:
            gaps.append(capacity - n)
    got = corpus_pipeline.packed(spark, docs, path).collect()
    assert {(r.doc_id, r.piece): (r.start, list(struct.unpack(f"<{r.length}I", r.ids))) for r in got} == pieces
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(held) == len(gaps)
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
