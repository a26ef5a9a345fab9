"""SimHash near-duplicates with a pigeonring filter.

Two fingerprints differ in at most 3 of 64 bits.  In a ring of four 16-bit
segments some start then exists from which every chain of l segments has at
most floor(l * 3 / 4) differing bits: 0, 1, 2, 3 for l = 1 to 4 (pigeonring
principle, Qin and Xiao, 2018).  From a start, the first segment is equal, and
of the four bytes of the next two segments (at most 1 bit in the first two,
2 in all) two are equal that are not both in the second of these segments.
That gives 5 keys of 32 equal bits for each of 4 starts: fingerprints meet
where they share such a key, the whole chain is checked from that start, and
what is left gets the full Hamming check.  No pair within the distance is lost.

Equal fingerprints are one node from the outset.  A bucket of more than
``block`` fingerprints is dealt out as pairs of blocks, so no task holds an
unbounded bucket, and a block pair gives a spanning forest, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mediascore.llm.common import text_parts
from mediascore.llm.components import components, forest
from mediascore.session import materialize

SEED = 42
DISTANCE = 3
#: The primes of the XXH64 hash.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Byte pairs of the two segments after the start that may be the equal ones, and bits a chain may differ in.
EQUAL_BYTES = ((2, 3), (2, 4), (2, 5), (3, 4), (3, 5))
BUDGET = tuple(k * DISTANCE // 4 for k in range(1, 5))


def _rotl(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(h, k):
    return _rotl(h ^ (_rotl(k * P2, 31) * P1), 27) * P1 + P4


def xxh64(buf: bytes, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of a buffer at once."""
    data = np.frombuffer(buf + bytes(8), np.uint8)
    u8 = np.ndarray((len(buf) + 1,), "<u8", data, 0, (1,))
    u4 = np.ndarray((len(buf) + 5,), "<u4", data, 0, (1,))
    n = length.astype(np.uint64)
    h = np.uint64((seed + int(P5)) % 2**64) + n
    at = start.copy()
    left = length.copy()
    wide = np.flatnonzero(length >= 32)
    if len(wide):
        a, m = at[wide], left[wide] // 32
        first = (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1))
        v = [np.full(len(wide), s % 2**64, np.uint64) for s in first]
        for k in range(int(m.max())):
            on = np.flatnonzero(m > k)
            for j in range(4):
                v[j][on] = _rotl(v[j][on] + u8[a[on] + 32 * k + 8 * j] * P2, 31) * P1
        x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for j in range(4):
            x = (x ^ (_rotl(v[j] * P2, 31) * P1)) * P1 + P4
        h[wide] = x + n[wide]
        at[wide] += 32 * m
        left[wide] -= 32 * m
    for _ in range(3):
        on = np.flatnonzero(left >= 8)
        h[on] = _lane(h[on], u8[at[on]])
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    h[on] = _rotl(h[on] ^ (u4[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
    at[on] += 4
    left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(left > 0)
        h[on] = _rotl(h[on] ^ (data[at[on]].astype(np.uint64) * P5), 11) * P1
        at[on] += 1
        left[on] -= 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def fingerprints(texts: list[str | None], words: int = 3, block: int = 1 << 16) -> np.ndarray:
    """64-bit fingerprints of whole texts.  A-Z are lower-cased, words are
    separated by ASCII white space; a bit is set if it is in more than half of
    the shingles' hashes.  A null text or one without words has 0."""
    split = [t.encode().lower().split() if t else [] for t in texts]
    count = np.array([len(w) for w in split], np.int64)
    buf = b"\n".join(b" ".join(w) for w in split)
    out = np.zeros(len(texts), np.uint64)
    if not count.sum():
        return out
    arr = np.frombuffer(buf, np.uint8)
    gap = np.concatenate([[True], (arr == 32) | (arr == 10), [True]])
    begin = np.flatnonzero(gap[:-1] & ~gap[1:])
    end = np.flatnonzero(~gap[:-1] & gap[1:])
    doc = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    nth, of = np.arange(len(doc)) - first[doc], count[doc]
    at = np.flatnonzero((of - nth >= words) | ((nth == 0) & (of < words)))
    last = np.where(of[at] >= words, at + words - 1, at + of[at] - 1)
    start, length, doc = begin[at], end[last] - begin[at], doc[at]
    ones = np.zeros((len(texts), 64), np.int64)
    total = np.bincount(doc, minlength=len(texts))
    for k in range(0, len(doc), block):
        s, n, d = start[k : k + block], length[k : k + block], doc[k : k + block]
        long = n > 1024
        h = xxh64(buf, np.where(long, 0, s), np.where(long, 0, n))
        for i in np.flatnonzero(long):
            h[i] = xxhash.xxh64_intdigest(buf[s[i] : s[i] + n[i]], SEED)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        ones[d[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long."""

    def run(batches):
        for batch in batches:
            for k, texts in text_parts(batch):
                fp = fingerprints(texts).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, len(texts)), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _close(a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """The pigeonring chain from ``start`` (0 to 3), then the full Hamming check."""
    x = a ^ b
    ring = _rotl(x, 16 * start) if not isinstance(start, np.ndarray) else (x << (16 * start.astype(np.uint64))) | (x >> ((64 - 16 * start.astype(np.uint64)) % np.uint64(64)))
    ok = np.bitwise_count(ring >> np.uint64(48)) <= BUDGET[0]
    for k in (1, 2):
        ok &= np.bitwise_count(ring >> np.uint64(48 - 16 * k)) <= BUDGET[k]
    return ok & (np.bitwise_count(x) <= DISTANCE)


def _bucket_links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, run: np.ndarray, small: int = 8):
    """Links (rep, rep) within runs of equal ``run`` number; key's high half names the table."""
    start = (key >> 32) // len(EQUAL_BYTES)
    edge = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
    size = np.diff(edge)
    a_out, b_out = [], []
    few = np.repeat(size <= small, size)
    for d in range(1, min(small, int(size.max(initial=1)))):
        i = np.flatnonzero(few[:-d] & (run[d:] == run[:-d]))
        i = i[_close(fp[i], fp[i + d], start[i])]
        a_out.append(rep[i])
        b_out.append(rep[i + d])
    for k in np.flatnonzero(size > small):
        at = slice(edge[k], edge[k + 1])
        f, r = fp[at], rep[at]
        first = int(start[at][0])
        link = np.zeros((len(f), len(f)), bool)
        for j in range(0, len(f), 512):
            link[j : j + 512] = _close(f[j : j + 512, None], f[None, :], first)
        label, _ = forest(link)
        a_out.append(r)
        b_out.append(r[label])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_out, b_out))
    keep = a != b
    return np.unique(np.stack([a[keep], b[keep]], 1), axis=0)


def links(nodes: DataFrame, block: int = 1024) -> DataFrame:
    """Links (a, b) that connect just what pairs within DISTANCE connect.
    ``nodes``: distinct fp with a number ``rep``, written."""
    ring = [F.expr(f"shiftleft(fp, {16 * s}) | shiftrightunsigned(fp, {64 - 16 * s})") if s else F.col("fp") for s in range(4)]
    byte = lambda r, k: F.shiftrightunsigned(r, 56 - 8 * k).bitwiseAND(F.lit(255))
    keys = [
        (F.lit((s * len(EQUAL_BYTES) + t) << 32) + F.shiftrightunsigned(r, 48) * 65536 + byte(r, i) * 256 + byte(r, j))
        for s, r in enumerate(ring)
        for t, (i, j) in enumerate(EQUAL_BYTES)
    ]
    keyed = nodes.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, F.col("key") == F.col("k")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp", "rep")

    def run(batches):
        def flush(parts):
            key, p, q, fp, rep = (np.concatenate(c) for c in zip(*parts))
            new = np.concatenate([[False], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            got = _bucket_links(key, fp.view(np.uint64), rep, np.cumsum(new))
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

        held: list[tuple] = []
        rows = 0
        for batch in batches:
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if rows >= 100_000:
                # up to the first change of bucket goes with what is held
                last = tuple(c[-1] for c in held[-1][:3])
                same = (cols[0] == last[0]) & (cols[1] == last[1]) & (cols[2] == last[2])
                cut = len(same) if same.all() else int(np.argmin(same))
                held.append(tuple(c[:cut] for c in cols))
                rows += cut
                if cut == len(same):
                    continue
                yield flush(held)
                held, rows = [], 0
                cols = tuple(c[cut:] for c in cols)
            held.append(cols)
            rows += len(cols[0])
        if held:
            yield flush(held)

    return met.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that a
    chain of links reaches, the row's own included.  One row for each input
    row.  A null or empty text has fingerprint 0 and links like any other; a
    row with a null doc_id is not compared and has a null component_id; rows
    that repeat a doc_id are each compared and returned; no rows give no rows.  Columns
    other than doc_id and text are not read."""
    return _with_components(materialize(with_fingerprints(docs), "fingerprints"))


def _with_components(prints: DataFrame) -> DataFrame:
    nodes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = components(links(nodes), "a", "b")
    by_print = nodes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("c"))
    out = prints.join(by_print, F.col("fp") == F.col("f"), "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, of those with the group's
    smallest doc_id, with all columns.  A row belongs to its own text's group:
    rows of other groups stay even if they share its doc_id, and so do rows
    with a null doc_id."""
    prints = materialize(with_fingerprints(docs), "fingerprints")
    if prints.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        found = materialize(_with_components(prints).where("doc_id is not null"), "groups")
        gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("__gone"))
        return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    # a doc_id does not tell its rows apart: fingerprints are the nodes, and doc_id and fingerprint name what stays
    nodes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("rep", F.col("fp"))
    nodes = materialize(nodes, "nodes")
    found = components(links(nodes.select("fp", "rep")), "a", "b")
    groups = nodes.join(found, F.col("rep") == F.col("node"), "left").groupBy(F.coalesce("component", "rep").alias("c")).agg(F.min(F.struct("first", "fp")).alias("s"))
    stays = materialize(groups.select(F.col("s.first").alias("__first"), F.col("s.fp").alias("__print")), "groups")
    schema = StructType([*docs.schema.fields, StructField("__fp", LongType())])

    def run(batches):
        for batch in batches:
            fp = [fingerprints(texts).view(np.int64) for _, texts in text_parts(batch)]
            fp = np.concatenate(fp) if fp else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*batch.schema.names, "__fp"])

    id_ = F.col("doc_id").cast("long")
    rows = docs.where(id_.isNotNull()).mapInArrow(run, schema).withColumn("__id", id_)
    kept = rows.join(stays, (F.col("__id") == F.col("__first")) & (F.col("__fp") == F.col("__print")), "left_semi").dropDuplicates(["__id", "__fp"])
    return kept.drop("__id", "__fp").union(docs.where(id_.isNull()))
