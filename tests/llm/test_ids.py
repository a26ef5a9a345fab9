"""Bit-plane files, packing and shards: exact round trips."""

import os
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mediascore.llm import bitplane, packing, sharding
from mediascore.llm.common import ship
from mediascore.llm.tokens import SegmentEncoder, WordEncoder
from mediascore.llm.tokens import encoder as encoder_of
from mediascore.session import checkpoint_path, materialize

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", " a", "  a  b\n\nc ", "don't it's\tx", "é x", "\u0301a b", "x\u00a0 y", "A'S b", "...a, b!!", "ΣΑΣ, x", "日本 語", "1 2 33,4", "a\r\nb", "<|endoftext|> z", "a) 's", "x" * 5000, "the and " * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, nulls, repeated rows and ids, and extra columns that are named as the operators' own."""
    ship(spark)
    rows = [(i, t, "en", "s", 1, "x", 7) for i, t in enumerate(ODD)]
    rows += [(None, "no id", None, None, None, None, None), (100, None, None, None, None, None, None), (3, "same id", "en", "s", 1, "x", 7)]
    rows += [(50, "twice the same", "en", "s", 1, "x", 7)] * 3
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def new_path(spark):
    return checkpoint_path(spark, "test-llm", uuid.uuid4().hex)


@pytest.mark.parametrize("path,spaced", [(WORDS, False), (BYTES, True)])
def test_segments_give_the_librarys_ids(path, spaced):
    encoder = SegmentEncoder(path, spaced, keep=50)  # both cache generations turn over
    tokenizer = encoder.tokenizer

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet="ab ,.\n\t'sté1ßÀ%|)\u00a0\u0301\u3000", max_size=40), max_size=4))
    def check(texts):
        assert encoder.encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

    check()
    assert encoder.encode([*ODD, None]) == [np.array(library(path, t), "<u4").tobytes() for t in [*ODD, None]]


def test_latin_words_are_single_pretokens(monkeypatch):
    """Any letter below U+0180, after a space or a line's end: the library's ids without a call for the whole text; words with marks are not kept."""
    letters = [chr(c) for c in range(128, 0x180) if chr(c).isalpha()]
    texts = [f"{c}a b{c}z {c}x, {c}{c}\n{c}w {c}" for c in letters]
    want = [np.array(library(BYTES, t), "<u4").tobytes() for t in ("".join(texts),)]
    encoder = SegmentEncoder(BYTES, True)
    whole = encoder._library
    monkeypatch.setattr(encoder, "_library", lambda part: whole(part) if not any(map(str.isalpha, part)) else pytest.fail(part))
    assert encoder.encode(["".join(texts)]) == want
    assert not any("," in w for w in encoder.words)


def test_latin_words_of_the_word_tokenizer_go_to_the_model(monkeypatch):
    """Any letter below U+0180, alone and within words of any case: the library's ids without a call for the text."""
    letters = [chr(c) for c in range(128, 0x180) if chr(c).isalpha() and c != 0x130]
    texts = [w for c in letters for w in (c, f"a{c}", f"{c}b", f"Xa{c}yZ", c + c, f"{c}x,")] + [a + b for a in letters[::5] for b in letters]
    want = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    encoder = SegmentEncoder(WORDS, False)
    whole = encoder._library
    monkeypatch.setattr(encoder, "_library", lambda part: whole(part) if not any(map(str.isalpha, part)) else pytest.fail(part))
    assert encoder.encode(texts) == want


def test_columns_give_the_librarys_ids():
    """Columns of odd texts, nulls and slices, with words that fall out and come back."""
    encoder = WordEncoder(WORDS, keep=5)
    tokenizer = encoder.tokenizer

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.none() | st.text(alphabet="ab ,.\n\t'sté1ßÀİ%|)<\x1c\u00a0\u0301\u3000", max_size=40), max_size=6), st.sampled_from([pa.string(), pa.large_string()]))
    def check(texts, kind):
        column = pa.array(["a b", *texts], kind).slice(1)
        assert list(encoder.encode_column(column)) == [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert len(encoder.kept_words) == len(encoder.kept_ids) <= 5

    check()
    texts = [*ODD, None]
    assert list(encoder.encode_column(pa.array(texts))) == [np.array(library(WORDS, t), "<u4").tobytes() for t in texts]


def test_a_columns_words_are_looked_up_once(monkeypatch):
    """Python sees a word once a column and not at all while it is kept; long words are not kept."""
    encoder = encoder_of(WORDS, False)
    seen = Counter()
    fresh = encoder.fresh
    monkeypatch.setattr(encoder, "fresh", lambda part: seen.update([part]) or fresh(part))
    monkeypatch.setattr(encoder, "encode", lambda texts: pytest.fail("not by column"))
    column = pa.array(["qzone, qztwo qzthree"] * 1000 + ["qztwo\nqzthree " + "qz" * 100])
    list(encoder.encode_column(column))
    assert seen == {w: 1 for w in ("qzone,", "qzone", ",", "qztwo", "qzthree", "qz" * 100)}
    list(encoder.encode_column(column))
    assert seen == {w: 1 for w in ("qzone,", "qzone", ",", "qztwo", "qzthree")} | {"qz" * 100: 2}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.booleans())
def test_planes_round_trip(ids, bits):
    ids = np.array(ids, "<u4")
    assert (bitplane.ids_of(bitplane.planes_of(ids, bits), len(ids)) == ids).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000), max_size=30), max_size=8), st.integers(1, 20), st.booleans())
def test_file_round_trip(lists, chunk, bits):
    writer = bitplane.FileWriter(5, chunk, bits)
    raw = [np.array(x, "<u4").tobytes() for x in lists]
    body = b"".join(r + b"\n" for i, x in enumerate(raw) for r in writer.add(i if i else None, x)) + b"".join(r + b"\n" for r in writer.end())
    read = bitplane.FileReader(body)
    assert read.number == 5 and [(d, x) for d, _, x in read.documents()] == [(i if i else None, x) for i, x in enumerate(raw)]


@pytest.mark.parametrize("bits", [True, False])
def test_bit_plane_files(spark, docs, bits):
    path = new_path(spark)
    bitplane.write_ids(docs, path, WORDS, False, 1, chunk_ids=64, bits=bits)
    assert any(n.startswith("part-") for n in os.listdir(path.removeprefix("file:")))
    rows = bitplane.with_starts(materialize(bitplane.read_ids(spark, path, with_ids=True), "t")).orderBy("start").collect()
    expected = {(r.doc_id, tuple(library(WORDS, r.text)) + (1,)) for r in docs.collect()}
    assert {(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows} == expected and len(rows) == docs.count()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens


def test_bit_plane_files_of_no_documents(spark, none):
    path = new_path(spark)
    bitplane.write_ids(none, path, WORDS, False, 1)
    assert bitplane.with_starts(bitplane.read_ids(spark, path)).count() == 0


def best_fit_decreasing(lengths, capacity):
    """One piece at a time: the plain algorithm."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_sweeps_are_best_fit_decreasing(lengths):
    placed, used = packing.sweeps(dict(Counter(lengths)), 24)
    room = {}
    for length, lo, hi, first, per, offset in placed:
        for r in range(lo, hi):
            room.setdefault(first + (r - lo) // per, []).append((offset + (r - lo) % per * length, length))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 24
    assert sorted(n for p in room.values() for _, n in p) == sorted(lengths)
    assert used == len(room) and sorted(24 - sum(n for _, n in p) for p in room.values()) == best_fit_decreasing(lengths, 24)


def test_packing(spark, docs):
    pieces = materialize(packing.token_pieces(docs, BYTES, True, 2, 64), "pieces")
    rows = packing.pack(pieces, 64).collect()
    by_doc = Counter()
    for r in docs.collect():
        ids = library(BYTES, r.text) + [2]
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        by_doc.update((r.doc_id, k, a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == by_doc
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) == len(best_fit_decreasing([r.length for r in rows], 64))


def test_packing_no_documents(none):
    assert packing.pack(materialize(packing.token_pieces(none, BYTES, True, 2, 64), "pieces"), 64).count() == 0


def test_shards_hold_every_row_once(spark, docs):
    path = new_path(spark)
    sharding.write_buckets(docs, path, 42, bucket_bytes=4096)
    assert spark.read.parquet(path).select("bucket").distinct().count() > 3
    shards = [sharding.read_shard(spark, path, 4, k) for k in range(4)]
    sizes = [s.count() for s in shards]
    assert max(sizes) - min(sizes) <= 1
    got = Counter()
    for s in shards:
        rows = s.collect()
        assert [r.slot for r in rows] == list(range(len(rows))) and s.columns == ["slot", *docs.columns]
        got.update(tuple(r)[1:] for r in rows)
    assert got == Counter(tuple(r) for r in docs.collect())


def test_shards_do_not_follow_the_input(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 20).alias("text"))
    orders = []
    for seed in (1, 2):
        path = new_path(spark)
        sharding.write_buckets(df, path, seed, bucket_bytes=8192)
        rows = sharding.place(spark.read.parquet(path), sharding.manifest(spark, path, 8), 8).select("row.doc_id", "shard", "slot").orderBy("shard", "slot").collect()
        orders.append([r.doc_id for r in rows])
    for o in orders:
        assert sorted(o) == list(range(4000))
        assert abs(np.corrcoef(o, range(4000))[0, 1]) < 0.1
        assert np.mean(np.abs(np.diff(o)) == 1) < 0.01
    assert orders[0] != orders[1]


def test_shards_of_no_documents(spark, none):
    path = new_path(spark)
    sharding.write_buckets(none, path, 42)
    assert sharding.place(spark.read.parquet(path), sharding.manifest(spark, path, 4), 4).count() == 0
