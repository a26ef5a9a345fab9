"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman.

Words are lower-cased runs of letters and digits.  An alignment whose m
matches lie in r unbroken runs scores at most m - (r - 1) and keeps m - r word
pairs, so one that scores s keeps at least s - 1 of the item's word pairs.
Seeds are the pairs that the fewest documents hold, just as many as cannot all
be missed at that count: every copy with such a score meets a
seed, wherever it is edited and however common the item is in the corpus.  A
short item says little: at least LEAST_WORDS words have to be aligned, or the
whole item where it has fewer, and an item of less than LEAST_ITEM words counts
only in a document that consists of it.  (The seeds of an item of one word are
the word.)  A document's seeds lead
to windows around the item's place, wide enough for any alignment with such a
score; each window is aligned with the item by Smith-Waterman over words
(match 1, mismatch and gap -1), which scores edited and paraphrased copies.
The score is the best alignment over the item's length, 1 for a whole copy.

Items are the stated query set.  They are read in blocks of ``block_words``
words, each block's seeds are broadcast, and all documents pass each block;
nothing is gathered by document or by seed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediascore.llm.common import text_parts

THRESHOLD = 0.5
#: The least score in words, and the least words of an item that is found within a longer text.
LEAST_WORDS, LEAST_ITEM = 5, 3
#: The most words of one block of items; what is broadcast is a few times as many numbers.
BLOCK_WORDS = 1_000_000
_OTHER = re.compile(r"[\W_]+")
#: Odd multiplier of the words' polynomial hash and its inverse modulo 2**64, and the n-gram's multipliers.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        _POWERS[base] = got = np.multiply.accumulate(got)
    return got[:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and how many words each text has."""
    plain = [_OTHER.sub(" ", t.lower()).strip() if t else "" for t in texts]
    buf = np.frombuffer("\n".join(plain).encode("utf-8", "replace"), np.uint8)
    count = np.array([p.count(" ") + 1 if p else 0 for p in plain], np.int64)
    if not count.sum():
        return np.zeros(0, np.uint64), count
    gap = np.concatenate([[True], (buf == 32) | (buf == 10), [True]])
    begin, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(buf.astype(np.uint64) * _powers(_BASE, len(buf)))])
    h = (sums[end] - sums[begin]) * _powers(_INVERSE, len(buf))[begin]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_BASE)
    return (h ^ (h >> np.uint64(29))) | np.uint64(1), count  # never 0, which stands for no word


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on (fewer at the end: none)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = sum(words[k : k + n] * _PLACE[k] for k in range(size))
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Items:
    """A block of test items and the postings of their n-grams."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: list[int], words: list[np.ndarray], chosen: dict[int, list[np.ndarray]]) -> "Items":
        """``chosen``: for each n-gram size, for each item, the offsets of its n-grams to use."""
        seeds = {}
        for size, offsets in chosen.items():
            item = np.repeat(np.arange(len(ids)), [len(o) for o in offsets])
            at = np.concatenate(offsets).astype(np.int64) if offsets else np.zeros(0, np.int64)
            code = np.array([c for w, o in zip(words, offsets) for c in grams(w, size)[o]], np.uint64)
            order = np.argsort(code, kind="stable")
            code, item, at = code[order], item[order], at[order]
            keys, first = np.unique(code, return_index=True)
            if len(keys):
                mask = np.zeros(1 << 20, bool)
                mask[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
                seeds[size] = (keys, np.append(first, len(code)), item, at, mask)
        return Items(ids, words, seeds)

    def hits(self, words: np.ndarray, count: np.ndarray, size: int):
        """(position, seed number) of every seed of a size within a text."""
        keys, _, _, _, mask = self.seeds[size]
        code = grams(words, size)
        pos = np.flatnonzero(mask[(code & np.uint64(0xFFFFF)).astype(np.int64)])
        seed = np.minimum(np.searchsorted(keys, code[pos]), len(keys) - 1)
        own = keys[seed] == code[pos]
        pos, seed = pos[own], seed[own]
        doc = np.repeat(np.arange(len(count)), count)
        own = doc[pos] == doc[pos + size - 1] if len(pos) else np.zeros(0, bool)
        return pos[own], seed[own], doc


def _need(words: int) -> int:
    """The least alignment score that counts for an item of so many words."""
    return max(int(np.ceil(THRESHOLD * words)), min(words, LEAST_WORDS))


def _size(words: int) -> int:
    """The n-gram size of an item's seeds."""
    return 2 if _need(words) > 1 else 1


def align(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best Smith-Waterman score of the item with each window (a row of words, 0 for none)."""
    k, width = windows.shape
    step = np.arange(width, dtype=np.int32)
    above = np.zeros((k, width + 1), np.int32)
    best = np.zeros(k, np.int32)
    for word in item:
        t = np.maximum(above[:, :-1] + np.where(windows == word, 1, -1), above[:, 1:] - 1)
        np.maximum(t, 0, out=t)
        row = np.maximum.accumulate(t + step, axis=1) - step
        above[:, 1:] = row
        np.maximum(best, row.max(1), out=best)
    return best


def matches(items: Items, words: np.ndarray, count: np.ndarray) -> list[tuple[int, int, float]]:
    """(text number, item number, score) of the items that texts hold with a score of THRESHOLD or more."""
    first = np.cumsum(count) - count
    found: list[np.ndarray] = []
    for size in items.seeds:
        pos, seed, doc = items.hits(words, count, size)
        _, start, item_of, at_of, _ = items.seeds[size]
        if not len(pos):
            continue
        n = start[seed + 1] - start[seed]
        for k in range(0, len(pos), 50_000):  # postings of some hits at a time
            p, s, m = pos[k : k + 50_000], seed[k : k + 50_000], n[k : k + 50_000]
            post = np.repeat(start[s], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            at = np.repeat(p, m)
            item = item_of[post]
            slack = _slack(items)[item]
            found.append(np.unique(np.stack([doc[at], item, (at - first[doc[at]] - at_of[post]) // slack], 1), axis=0))
    if not found:
        return []
    windows = np.unique(np.concatenate(found), axis=0)
    windows = windows[np.argsort(windows[:, 1], kind="stable")]
    out: dict[tuple[int, int], float] = {}
    edges = np.flatnonzero(np.concatenate([[True], windows[1:, 1] != windows[:-1, 1], [True]]))
    padded = np.append(words, np.uint64(0))
    for a, b in zip(edges[:-1], edges[1:]):
        i = int(windows[a, 1])
        item = items.words[i]
        slack = int(_slack(items)[i])
        for k in range(a, b, 2048):
            doc, bucket = windows[k : min(b, k + 2048), 0], windows[k : min(b, k + 2048), 2]
            place = (bucket * slack - slack)[:, None] + np.arange(len(item) + 3 * slack)[None, :]
            inside = (place >= 0) & (place < count[doc][:, None])
            window = padded[np.where(inside, place + first[doc][:, None], len(words))]
            # a score takes at least as many words of the item
            enough = np.isin(window, item).sum(1) >= _need(len(item))
            if len(item) < LEAST_ITEM:
                enough &= count[doc] == len(item)
            doc, score = doc[enough], align(item, window[enough])
            doc, score = doc[score >= _need(len(item))], score[score >= _need(len(item))]
            for d, s in zip(doc.tolist(), (score / len(item)).tolist()):
                out[d, i] = max(out.get((d, i), 0.0), s)
    return [(d, i, s) for (d, i), s in sorted(out.items())]


def _slack(items: Items) -> np.ndarray:
    """More than an alignment with a score of THRESHOLD may leave a seed's diagonal by, for each item."""
    return np.array([1 + len(w) - _need(len(w)) for w in items.words], np.int64)


def _all_grams(words: list[np.ndarray]) -> dict[int, list[np.ndarray]]:
    out = {}
    for size in (1, 2):
        offsets = [np.arange(len(w) - size + 1) if _size(len(w)) == size else np.zeros(0, np.int64) for w in words]
        if any(len(o) for o in offsets):
            out[size] = offsets
    return out


def _rarest(items: Items, frequency: dict[int, np.ndarray]) -> Items:
    """The items with their rarest n-grams: so many that fewer are left out
    than an alignment with a sufficient score keeps.  Those that no document
    holds count among them, and need not be looked for.  ``frequency``: for
    each n-gram size the documents of every seed."""
    length = np.array([len(w) for w in items.words], np.int64)
    need = np.array([_need(n) for n in length], np.int64)
    seeds = {}
    for size, (keys, first, item, at, _) in items.seeds.items():
        seed = np.repeat(np.arange(len(keys)), np.diff(first))
        f = frequency[size][seed]
        order = np.lexsort((at, f, item))  # an item's n-grams, the rarest first
        begin = np.searchsorted(item[order], np.arange(len(length)))
        place = np.arange(len(order)) - begin[item[order]]
        wanted = (length - size + 1) - (need - (size - 1)) + 1
        used = np.zeros(len(order), bool)
        used[order] = place < wanted[item[order]]
        used &= f > 0
        left, first = np.unique(seed[used], return_index=True)
        if len(left):
            mask = np.zeros(1 << 20, bool)
            mask[(keys[left] & np.uint64(0xFFFFF)).astype(np.int64)] = True
            seeds[size] = (keys[left], np.append(first, int(used.sum())), item[used], at[used], mask)
    return Items(items.ids, items.words, seeds)


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """Blocks of items with a word and an id, read one block at a time."""
    ids, words, held = [], [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        w, _ = word_hashes([r["text"]])
        if not len(w):
            continue
        ids.append(r["item_id"])
        words.append(w)
        held += len(w)
        if held >= block_words:
            yield Items.of(ids, words, _all_grams(words))
            ids, words, held = [], [], 0
    if ids:
        yield Items.of(ids, words, _all_grams(words))


def rare_seeds(docs: DataFrame, items: Items) -> Items:
    """Count, over all documents, how many hold each n-gram of the items, and keep the rarer ones."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_WORDS words and one item

    def count(batches):
        it = shared.value
        total = {size: np.zeros(len(s[0]), np.int64) for size, s in it.seeds.items()}
        for batch in batches:
            for _, texts in text_parts(batch):
                words, n = word_hashes(texts)
                for size, t in total.items():
                    pos, seed, doc = it.hits(words, n, size)
                    if len(pos):
                        pairs = np.unique(doc[pos] * len(t) + seed)
                        t += np.bincount(pairs % len(t), minlength=len(t))
        for size, t in total.items():
            there = np.flatnonzero(t)
            if len(there):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), size, np.int32)), pa.array(there), pa.array(t[there])], ["size", "seed", "n"])

    # three numbers for each n-gram of a block, as columns
    rows = docs.select("text").mapInArrow(count, "size int, seed long, n long").groupBy("size", "seed").agg(F.sum("n").alias("n")).toArrow()
    size, seed, n = (rows.column(c).to_numpy() for c in ("size", "seed", "n"))
    frequency = {}
    for k, s in items.seeds.items():
        frequency[k] = np.zeros(len(s[0]), np.int64)
        frequency[k][seed[size == k]] = n[size == k]
    return _rarest(items, frequency)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score) of every document and test item that it holds
    with a score of THRESHOLD or more.  Null or empty texts and items, and
    items with a null id, match nothing; rows that repeat a doc_id or item_id
    are each compared and give one row with their best score; tables without
    rows give none.  Other columns are not read."""
    spark = docs.sparkSession
    out = None
    for block in item_blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(rare_seeds(docs, block))

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                ids = batch.column("doc_id")
                for k, texts in text_parts(batch):
                    got = matches(items, *word_hashes(texts))
                    if got:
                        d, i, s = zip(*got)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([k + x for x in d])), pa.array([items.ids[x] for x in i], pa.int64()), pa.array(s, pa.float64())], ["doc_id", "item_id", "score"]
                        )

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, score double")
        out = rows if out is None else out.union(rows)
    if out is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("double").alias("score")).where(F.lit(False))
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def remove(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no test item, with all their columns.  Same
    rules as contaminated(); a row is judged by its own text."""
    out = docs
    for block in item_blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(rare_seeds(docs, block))

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                bad = set()
                for k, texts in text_parts(batch):
                    bad.update(k + d for d, _, _ in matches(items, *word_hashes(texts)))
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
