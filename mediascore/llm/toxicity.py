"""Toxicity by a bidirectional gated recurrent network over characters and words.

A text is its tokens (runs of letters, digits and underscores, lower-cased, in
pieces of at most PIECE characters), read in windows of WINDOW tokens that
overlap by half.  A token's vector is its word embedding (one for all words
that the sample does not know) beside what a bidirectional GRU with attention
pooling makes of its characters; a second such network over the tokens of a
window, pooled likewise, gives the window's margin.  A text's margin is that of
its highest window, and a curve fitted on documents that the weights were not
trained on makes it a probability.

Labels belong to documents, not to windows: training first takes windows of a
toxic document at random, then the one that the network holds most toxic, and
of a clean document the worst mistake beside one at random.  Forward, backward
and Adam steps are numpy.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediascore.llm.common import text_parts

PIECE = 16
WINDOW = 64
STRIDE = WINDOW // 2
#: The fit's sample: so many toxic texts and twice as many clean ones, of each so many windows, evenly spread.
FIT_ROWS = 1000
FIT_WINDOWS = 32
#: Words with an embedding of their own: the most frequent of the sample, each in so many of its documents.
MAX_WORDS = 20_000
MIN_DOCS = 3
MAX_CHARACTERS = 500
WORD_DIM, CHAR_DIM, WORD_HIDDEN, CHAR_HIDDEN = 16, 8, 16, 8
#: Windows scored at once, and words whose input is kept by a worker.
BLOCK = 1024
CACHE = 250_000
THRESHOLD = 0.3
_TOKEN = re.compile(rf"\w{{1,{PIECE}}}")
_GAP = re.compile(r"\W")


def token_lists(text: str | None, most: int = 1 << 20):
    """The tokens of a text, about ``most`` characters at a time."""
    text = (text or "").lower()
    at = 0
    while at < len(text):
        end = at + most
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield _TOKEN.findall(text, at, end)
        at = end


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the windows over n tokens; a text without tokens has one empty window."""
    start = np.arange(1 + max(0, -(-(n - WINDOW) // STRIDE)), dtype=np.int64) * STRIDE
    return start, np.minimum(WINDOW, n - start)


# -- the network ---------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = x * x.dtype.type(0.5)
    np.tanh(out, out=out)
    out += 1
    out *= 0.5
    return out


def new_layer(rng, wide: int, hidden: int, dtype=np.float32) -> dict[str, np.ndarray]:
    """Weights of a bidirectional GRU with attention pooling; gates in the order update, reset, candidate."""
    draw = lambda *shape: rng.uniform(-1, 1, shape).astype(dtype) / math.sqrt(hidden)
    out = {"A": draw(2 * hidden, hidden), "a": np.zeros(hidden, dtype), "v": draw(hidden)}
    for d in "fb":
        out |= {f"W{d}": draw(wide, 3 * hidden), f"b{d}": np.zeros(3 * hidden, dtype), f"U{d}": draw(hidden, 3 * hidden), f"c{d}": np.zeros(hidden, dtype)}
    return out


def inputs(p: dict, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each vector adds to the gates of either direction."""
    return vectors @ p["Wf"] + p["bf"], vectors @ p["Wb"] + p["bb"]


def pooled(p: dict, tables, flat: np.ndarray, start: np.ndarray, length: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """The attention-pooled states of sequences flat[start : start + length] of
    rows of ``tables``; lengths descend and are at least 1.  ``tape`` keeps
    what the way back needs."""
    hidden = len(p["v"])
    n, steps = len(start), int(length[0])
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]  # sequences longer than t
    states = np.zeros((steps, n, 2 * hidden), tables[0].dtype)
    every, full = np.arange(n), alive[-1]
    for half, d in enumerate("fb"):
        h = np.zeros((n, hidden), states.dtype)
        U, c, table = p[f"U{d}"], p[f"c{d}"], tables[half]
        for t in range(steps):
            k = alive[t]
            place = np.full(k, t) if d == "f" else length[:k] - 1 - t
            ids = flat[start[:k] + place]
            x, before = table.take(ids, 0, mode="clip"), h[:k]
            g = before @ U
            gates = _sigmoid(x[:, : 2 * hidden] + g[:, : 2 * hidden])
            z, r = gates[:, :hidden], gates[:, hidden:]
            q = g[:, 2 * hidden :] + c
            m = r * q
            m += x[:, 2 * hidden :]
            np.tanh(m, out=m)
            now = before - m
            now *= z
            now += m
            if tape is not None:
                tape[d, t] = (ids, place, before.copy(), z, r, q, m)
            h[:k] = now
            side = slice(half * hidden, (half + 1) * hidden)
            same = k if d == "f" else min(k, full)  # rows whose place is the first one's
            states[place[0], :same, side] = now[:same]
            states[place[same:], every[same:k], side] = now[same:]
    u = np.tanh(states @ p["A"] + p["a"])
    e = u @ p["v"]
    e[np.arange(steps)[:, None] >= length[None, :]] = -np.inf
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    out = np.einsum("tn,tnh->nh", w, states)
    if tape is not None:
        tape["pool"] = (states, u, w, alive)
    return out


def pooled_back(p: dict, tables, tape: dict, d_out: np.ndarray) -> tuple[dict, list[np.ndarray]]:
    """Gradients of the layer's weights (but for Wf, bf, Wb, bb) and of its two tables."""
    hidden = len(p["v"])
    states, u, w, alive = tape["pool"]
    steps, n, _ = states.shape
    d_states = w[..., None] * d_out
    d_w = np.einsum("nh,tnh->tn", d_out, states)
    d_e = w * (d_w - (w * d_w).sum(0))
    d_u = d_e[..., None] * p["v"] * (1 - u * u)
    flat_u = d_u.reshape(-1, hidden)
    grads = {"v": np.einsum("tn,tna->a", d_e, u), "a": flat_u.sum(0), "A": states.reshape(-1, 2 * hidden).T @ flat_u}
    d_states += d_u @ p["A"].T
    d_tables = []
    every = np.arange(n)
    for half, d in enumerate("fb"):
        U = p[f"U{d}"]
        d_U, d_c = np.zeros_like(U), np.zeros_like(p[f"c{d}"])
        dh = np.zeros((n, hidden), states.dtype)
        rows, d_rows = [], []
        for t in reversed(range(steps)):
            k = alive[t]
            ids, place, before, z, r, q, m = tape[d, t]
            now = dh[:k] + d_states[place, every[:k], half * hidden : (half + 1) * hidden]
            d_m = now * (1 - z) * (1 - m * m)
            d_z = now * (before - m) * z * (1 - z)
            d_r = d_m * q * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_m * r], 1)
            d_U += before.T @ d_g
            d_c += d_g[:, 2 * hidden :].sum(0)
            dh[:k] = now * z + d_g @ U.T
            rows.append(ids)
            d_rows.append(np.concatenate([d_z, d_r, d_m], 1))
        grads |= {f"U{d}": d_U, f"c{d}": d_c}
        d_tables.append(_summed(np.concatenate(rows), np.concatenate(d_rows), len(tables[half])))
    return grads, d_tables


def _summed(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by their id below n."""
    order = np.argsort(ids, kind="stable")
    found, first = np.unique(ids[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[found] = np.add.reduceat(rows[order], first)
    return out


def inputs_back(p: dict, vectors: np.ndarray, d_tables, grads: dict) -> np.ndarray:
    """Adds the gradients of inputs() and returns that of the vectors."""
    for d, t in zip("fb", d_tables):
        grads[f"W{d}"], grads[f"b{d}"] = vectors.T @ t, t.sum(0)
    return d_tables[0] @ p["Wf"].T + d_tables[1] @ p["Wb"].T


def curve(margin: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float, float]:
    """(low, high, cut) of the probability low + (high - low) * sigmoid(margin
    - cut): the cut between two margins, and the toxic shares below and above
    it, under which the labels are likeliest (toxic ones weighing ``prior``
    together).  Wrong labels far from the cut change the shares only, where
    they would flatten a logistic curve."""
    order = np.argsort(margin, kind="stable")
    m, y = margin[order], toxic[order]
    weight = np.where(y, prior / max(1, y.sum()), (1 - prior) / max(1, (~y).sum())) * len(y)
    best = (-np.inf, prior, prior, 0.0)
    of = np.cumsum(weight)[:-1]
    bad = np.cumsum(weight * y)[:-1]
    for k in np.flatnonzero(np.diff(m) > 0):
        low = (bad[k] + prior) / (of[k] + 1)
        high = ((weight * y).sum() - bad[k] + prior) / (weight.sum() - of[k] + 1)
        if high <= low:
            continue
        p = np.where(np.arange(len(y)) <= k, low, high)
        fit = float((weight * np.where(y, np.log(p), np.log1p(-p))).sum())
        best = max(best, (fit, low, high, float(m[k] + m[k + 1]) / 2))
    return best[1:]


@dataclass
class Net:
    """words and letters number what has an embedding (from 1; 0 is any other)."""

    words: dict[str, int]
    letters: dict[str, int]
    E: np.ndarray
    L: np.ndarray
    chars: dict[str, np.ndarray]
    tokens: dict[str, np.ndarray]
    top: np.ndarray  # weights of the pooled window, and the bias
    low: float = 0.0
    high: float = 1.0
    cut: float = 0.0

    @staticmethod
    def new(words: list[str], letters: list[str], seed: int = 42, dtype=np.float32) -> "Net":
        rng = np.random.default_rng(seed)
        number = lambda names: {w: i + 1 for i, w in enumerate(names)}
        E = rng.normal(0, 0.1, (len(words) + 1, WORD_DIM)).astype(dtype)
        L = rng.normal(0, 0.3, (len(letters) + 1, CHAR_DIM)).astype(dtype)
        chars, tokens = new_layer(rng, CHAR_DIM, CHAR_HIDDEN, dtype), new_layer(rng, WORD_DIM + 2 * CHAR_HIDDEN, WORD_HIDDEN, dtype)
        top = np.concatenate([rng.normal(0, 0.1, 2 * WORD_HIDDEN), [0]]).astype(dtype)
        return Net(number(words), number(letters), E, L, chars, tokens, top)

    def weights(self) -> dict[str, np.ndarray]:
        out = {"E": self.E, "L": self.L, "top": self.top}
        return out | {f"c.{k}": v for k, v in self.chars.items()} | {f"t.{k}": v for k, v in self.tokens.items()}

    def spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Letters of the words as (flat, start, length), longest word first, and that order."""
        length = np.array([len(w) for w in words], np.int64)
        get = self.letters.get
        flat = np.array([get(c, 0) for w in words for c in w], np.int64)
        order = np.argsort(-length, kind="stable")
        return flat, (np.cumsum(length) - length)[order], length[order], order

    def vectors(self, words: list[str], tape: dict | None = None, unknown: np.ndarray | None = None) -> np.ndarray:
        """The words' vectors: embedding and pooled letters."""
        flat, start, length, order = self.spelled(words)
        tables = inputs(self.chars, self.L)
        made = pooled(self.chars, tables, flat, start, length, tape)
        own = np.empty_like(made)
        own[order] = made
        ids = np.array([self.words.get(w, 0) for w in words], np.int64)
        if unknown is not None:
            ids[unknown] = 0
        if tape is not None:
            tape["word"] = (ids, order, tables)
        return np.concatenate([self.E[ids], own], 1)

    def margins(self, tables, flat, start, length, tape: dict | None = None) -> np.ndarray:
        """The windows' margins; lengths descend, an empty window has the bias."""
        full = int(np.count_nonzero(length))
        out = np.full(len(start), self.top[-1], self.top.dtype)
        if full:
            made = pooled(self.tokens, tables, flat, start[:full], length[:full], tape)
            out[:full] += made @ self.top[:-1]
            if tape is not None:
                tape["made"] = made
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        share = 1 / (1 + np.exp(-np.clip(margin.astype(float) - self.cut, -30, 30)))
        return np.round(self.low + (self.high - self.low) * share, 6)


def loss_and_gradients(net: Net, words: list[str], flat, start, length, y, weight, unknown=None) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean log loss of windows over the words' numbers, and its gradients.  Lengths descend and are at least 1."""
    word_tape: dict = {}
    tape: dict = {}
    vectors = net.vectors(words, word_tape, unknown)
    tables = inputs(net.tokens, vectors)
    margin = net.margins(tables, flat, start, length, tape)
    share = (weight / weight.sum()).astype(vectors.dtype)
    loss = float((share * (np.logaddexp(0, margin) - y * margin)).sum())
    d_margin = share * (_sigmoid(margin) - y).astype(vectors.dtype)
    out = {"top": np.concatenate([tape["made"].T @ d_margin, [d_margin.sum()]])}
    grads, d_tables = pooled_back(net.tokens, tables, tape, d_margin[:, None] * net.top[:-1])
    d_vectors = inputs_back(net.tokens, vectors, d_tables, grads)
    out |= {f"t.{k}": v for k, v in grads.items()}
    ids, order, letter_tables = word_tape["word"]
    out["E"] = _summed(ids, d_vectors[:, :WORD_DIM], len(net.E))
    grads, d_tables = pooled_back(net.chars, letter_tables, word_tape, d_vectors[order, WORD_DIM:])
    out["L"] = inputs_back(net.chars, net.L, d_tables, grads)
    return loss, out | {f"c.{k}": v for k, v in grads.items()}


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01, decay: float = 1e-4):
        self.weights, self.rate, self.decay, self.t = weights, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.s = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / max(size, 1e-12))
        rate = self.rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, w in self.weights.items():
            g = grads[k] * scale + self.decay * w
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.001 * (g * g - self.s[k])
            w -= (rate * self.m[k] / (np.sqrt(self.s[k]) + 1e-8)).astype(w.dtype)


# -- fitting -------------------------------------------------------------------


class _Sample:
    """Labelled documents as lists of windows over numbered words."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        number: dict[str, int] = {}
        self.label = np.array([toxic for toxic, _ in rows], bool)
        self.windows = [[np.array([number.setdefault(w, len(number)) for w in x.split(" ")], np.int64) for x in texts if x] for _, texts in rows]
        self.names = list(number)
        docs = np.zeros(len(number), np.int64)
        for own in self.windows:
            if own:
                docs[np.unique(np.concatenate(own))] += 1
        self.docs = docs

    def batch(self, chosen: list[np.ndarray]):
        """(words, flat, start, length, order) of windows, longest first."""
        length = np.array([len(x) for x in chosen], np.int64)
        order = np.argsort(-length, kind="stable")
        used, flat = np.unique(np.concatenate(chosen), return_inverse=True)
        return [self.names[i] for i in used], flat, (np.cumsum(length) - length)[order], length[order], order

    def best(self, net: Net, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's highest margin and the window that has it; the bias and -1 without windows."""
        margin, at = np.full(len(docs), float(net.top[-1])), np.full(len(docs), -1)
        pairs = [(i, j, x) for i, d in enumerate(docs) for j, x in enumerate(self.windows[d])]
        for k in range(0, len(pairs), BLOCK):
            part = pairs[k : k + BLOCK]
            words, flat, start, length, order = self.batch([x for *_, x in part])
            got = net.margins(inputs(net.tokens, net.vectors(words)), flat, start, length)
            for g, o in zip(got, order):
                i, j, _ = part[o]
                if at[i] < 0 or g > margin[i]:
                    margin[i], at[i] = g, j
        return margin, at


def train(rows: list[tuple[int, list[str]]], prior: float, seed: int = 42, rounds: tuple[int, int] = (4, 4), batch: int = 64, least_steps: int = 150) -> Net:
    """The network fitted on (toxic, windows) of documents; ``prior`` is the
    share of toxic documents.  Either phase takes ``rounds`` passes, or more
    until it has made ``least_steps`` steps.  With one class or none every
    score is the prior."""
    sample = _Sample(rows)
    common = np.flatnonzero(sample.docs >= MIN_DOCS)
    common = common[np.lexsort((common, -sample.docs[common]))][:MAX_WORDS]
    seen: dict[str, int] = {}
    for name, n in zip(sample.names, sample.docs):
        for c in name:
            seen[c] = seen.get(c, 0) + int(n)
    letters = sorted(seen, key=lambda c: (-seen[c], c))[:MAX_CHARACTERS]
    net = Net.new([sample.names[i] for i in common], letters, seed)
    rng = np.random.default_rng(seed)
    docs = rng.permutation(len(rows))
    held = docs[: len(docs) // 5]  # the curve is fitted on these
    docs = np.array([d for d in docs[len(docs) // 5 :] if sample.windows[d]], np.int64)
    bad, good = docs[sample.label[docs]], docs[~sample.label[docs]]
    if not len(bad) or not len(good) or len(set(sample.label[held])) < 2:
        net.top[:] = 0
        net.low = net.high = prior
        return net
    adam = Adam(net.weights())
    more = -(-least_steps // -(-2 * len(docs) // batch))
    rounds = tuple(max(r, more) for r in rounds)
    for epoch in range(sum(rounds)):
        chosen = [(d, int(rng.integers(len(sample.windows[d])))) for d in docs for _ in range(2 if epoch < rounds[0] else 1 if not sample.label[d] else 0)]
        trust = np.ones(len(chosen))
        if epoch >= rounds[0]:
            margin, at = sample.best(net, docs)
            chosen += list(zip(docs, at))
            # a toxic label that nothing in the text bears out counts less
            trust = np.concatenate([trust, np.where(sample.label[docs], _sigmoid(margin), 1.0)])
        y = np.array([sample.label[d] for d, _ in chosen], float)
        # either class weighs the same
        weight = trust * np.where(y == 1, 0.5 / max(1e-9, (trust * y).sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        place = rng.permutation(len(chosen))
        adam.rate = 0.01 if epoch < rounds[0] else 0.01 * 0.13 ** ((epoch - rounds[0] + 1) / rounds[1])
        for k in range(0, len(place), batch):
            part = place[k : k + batch]
            words, flat, start, length, order = sample.batch([sample.windows[chosen[i][0]][chosen[i][1]] for i in part])
            unknown = rng.random(len(words)) < 0.15
            own = part[order]
            _, grads = loss_and_gradients(net, words, flat, start, length, y[own], weight[own], unknown)
            adam.step(grads)
    margin, _ = sample.best(net, held)
    net.low, net.high, net.cut = curve(margin, sample.label[held], prior)
    return net


def fit(docs: DataFrame, labels: DataFrame, training: Column, fit_rows: int = FIT_ROWS) -> Net:
    """Fit on the texts of ``docs`` whose doc_id has a toxic of 0 or 1 in
    ``labels`` and for which ``training``, a condition on doc_id, holds: at
    most ``fit_rows`` toxic ids and twice as many clean ones, the first by a
    hash, and at most twice as many distinct texts, of each at most FIT_WINDOWS
    windows.  A
    doc_id with both labels counts as toxic; null labels, ids and texts are
    skipped.  The prior is the share of toxic ids among all labelled ones."""
    known = labels.where(training & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("l_toxic"))
    n = {r["l_toxic"]: r["n"] for r in known.groupBy("l_toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    first = [known.where(F.col("l_toxic") == c).orderBy(F.xxhash64(F.lit("toxicity"), "l_id"), "l_id").limit(n_) for c, n_ in ((0, 2 * fit_rows), (1, fit_rows))]
    # at most 3 * fit_rows ids and labels
    chosen = first[0].unionByName(first[1])
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).where(F.col("text").isNotNull())

    def cut(batches):
        for batch in batches:
            out = []
            for toxic, text in zip(batch.column("l_toxic").to_pylist(), batch.column("text").to_pylist()):
                tokens = [w for part in token_lists(text) for w in part]
                start, length = windows(len(tokens))
                at = np.unique(np.linspace(0, len(start) - 1, min(len(start), FIT_WINDOWS)).astype(int))
                out.append((toxic, [" ".join(tokens[start[i] : start[i] + length[i]]) for i in at]))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.int32()), pa.array([x for _, x in out], pa.list_(pa.string()))], ["toxic", "windows"])

    # copies of one text count once
    distinct = sample.select("l_toxic", "text").mapInArrow(cut, "toxic int, windows array<string>").groupBy("windows").agg(F.max("toxic").alias("toxic"))
    rows = sorted((r["toxic"], r["windows"]) for r in distinct.limit(6 * fit_rows).toArrow().to_pylist())
    rows.sort(key=lambda r: zlib.crc32(" ".join(r[1]).encode()))
    return train(rows, (n.get(1, 0) + 1) / (sum(n.values()) + 2))


# -- scoring -------------------------------------------------------------------


class Scorer:
    """Scores texts; keeps the inputs of at most CACHE words between calls."""

    def __init__(self, net: Net, cache: int = CACHE):
        self.net, self.cache = net, cache
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.tables = [np.zeros((0, 3 * WORD_HIDDEN), np.float32)] * 2
        self.used = 0

    def _learn(self, new: list[str]) -> None:
        """Add the inputs of new words."""
        for k in range(0, len(new), 2 * BLOCK):
            part = new[k : k + 2 * BLOCK]
            made = inputs(self.net.tokens, self.net.vectors(part))
            if self.used + len(part) > len(self.tables[0]):
                more = max(8192, len(self.tables[0]))
                self.tables = [np.concatenate([t, np.zeros((more, t.shape[1]), np.float32)]) for t in self.tables]
            for t, m in zip(self.tables, made):
                t[self.used : self.used + len(part)] = m
            for i, w in enumerate(part):
                self.number[w] = self.used + i
            self.used += len(part)

    def _numbered(self, texts: list[str | None], most: int = 1 << 18):
        """(text, ids) of the texts' tokens in order; new words are learned for many lists of tokens at once."""
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush():
            number = self.number
            new = [w for w in dict.fromkeys(chain.from_iterable(tokens for _, tokens in held)) if w not in number]
            if new:
                self._learn(new)
            for i, tokens in held:
                yield i, np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))

        for i, text in enumerate(texts):
            for tokens in token_lists(text):
                held.append((i, tokens))
                size += len(tokens)
                if size >= most:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, number of windows and first token of the highest window of each text."""
        best, where = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        size = np.zeros(len(texts), np.int64)
        flat = []
        for i, ids in self._numbered(texts):
            flat.append(ids)
            size[i] += len(ids)
        cut = [windows(int(n)) for n in size]
        count = np.array([len(start) for start, _ in cut], np.int64)
        if not texts:
            return best, count, where
        flat = np.concatenate([*flat, np.zeros(0, np.int32)])
        start = np.concatenate([start for start, _ in cut]) + np.repeat(np.cumsum(size) - size, count)
        length, own = np.concatenate([length for _, length in cut]), np.repeat(np.arange(len(texts)), count)
        order = np.argsort(-length, kind="stable")
        margin = np.empty(len(start))
        for k in range(0, len(order), BLOCK):
            part = order[k : k + BLOCK]
            margin[part] = self.net.margins(self.tables, flat, start[part], length[part])
        np.maximum.at(best, own, margin)
        first = np.cumsum(count) - count
        for i in range(len(texts)):
            where[i] = int(margin[first[i] : first[i] + count[i]].argmax()) * STRIDE
        if self.used > self.cache:
            self._forget()
        return self.net.probability(best), count, where


def scored(docs: DataFrame, net: Net, *keep: Column) -> DataFrame:
    """Adds to the columns ``keep`` of each row: score, predicted (1 if score
    >= THRESHOLD, else 0), windows (how many the text has) and at (the first
    token of the highest one).  Null and empty texts are scored as a window
    without tokens.  Only the text is read besides ``keep``; equal texts have
    equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of bounded size: MAX_WORDS embeddings at most
    rows = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for k, texts in text_parts(batch, column="__text"):
                score, count, where = scorer.score(texts)
                own = [batch.column(i).slice(k, len(texts)) for i in range(batch.num_columns - 1)]
                more = [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(count), pa.array(where)]
                yield pa.RecordBatch.from_arrays([*own, *more], [*batch.schema.names[:-1], "score", "predicted", "windows", "at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, score double, predicted int, windows long, at long")
