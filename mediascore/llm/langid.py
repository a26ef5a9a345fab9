"""Language identification by nearest centroid.

A text is the unit vector of its TF-IDF weighted byte n-grams.  Each language
has several centroids, from spherical k-means over its own training vectors;
the nearest centroid by cosine gives the language.  A text farther from that
centroid than nearly all training texts of its cell is marked rejected.

Document frequencies are counted over all training texts.  The centroids are
fitted on a bounded sample of each language, one task for a language; there
may be any number of languages.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediascore.llm.common import text_parts
from mediascore.llm.embeddings import spherical_kmeans
from mediascore.llm.grams import counts
from mediascore.session import materialize

SIZES = (1, 2, 3)
BITS = 13
#: About how many different training texts of one language its centroids are fitted on.
FIT_ROWS = 800
CENTROIDS = 4
#: Of each centroid its largest weights are kept (6 bytes each).
WEIGHTS = 2048
#: Up to so many centroids are scored as one dense table, more by their lists of weights.
DENSE = 1024
_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text's letters: all else counts as a space.  None for
    a text without letters."""
    if not text or not _LETTER.search(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return counts(_OTHER.sub(" ", text), SIZES, BITS)


@dataclass(frozen=True)
class Model:
    """Centroid c has the weights ids[at[c] : at[c + 1]], a unit vector."""

    idf: np.ndarray
    at: np.ndarray
    ids: np.ndarray  # uint16
    weight: np.ndarray  # float32
    language: list[str]  # of each centroid, in order
    reach: np.ndarray  # largest distance (1 - cosine) that is not rejected, of each centroid


class Nearest:
    """Cosines of a text's vector to all centroids."""

    def __init__(self, m: Model):
        owner = np.repeat(np.arange(len(m.language)), np.diff(m.at))
        if len(m.language) <= DENSE:
            self.table = np.zeros((1 << BITS, len(m.language)), np.float32)
            self.table[m.ids, owner] = m.weight
            return
        self.table = None
        order = np.argsort(m.ids, kind="stable")  # for each n-gram its centroids
        self.first = np.searchsorted(m.ids[order], np.arange((1 << BITS) + 1))
        self.owner, self.weight, self.n = owner[order], m.weight[order], len(m.language)

    def cosines(self, ids: np.ndarray, value: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return value.astype(np.float32) @ self.table[ids]
        size = self.first[ids + 1] - self.first[ids]
        place = np.repeat(self.first[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.owner[place], self.weight[place] * np.repeat(value, size), self.n)


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values of a text's unit TF-IDF vector; none for a text without letters."""
    ids, n = grams(text)
    value = (1 + np.log(n)) * idf[ids]
    norm = np.sqrt((value * value).sum())
    return ids, value / norm if norm else value


def _frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts have letters, and in how many of them each n-gram occurs: a row for each n-gram and task is shuffled."""

    def count(batches):
        n, df = 0, np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for _, texts in text_parts(batch):
                for text in texts:
                    ids, _ = grams(text)
                    df[ids] += 1
                    n += bool(len(ids))
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], n))], ["id", "n"])

    total = texts.select("text").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # 2**BITS + 1 rows at most
    ids, n = total.column("id").to_numpy(), total.column("n").to_numpy()
    df = np.zeros(1 << BITS)
    df[ids[ids >= 0]] = n[ids >= 0]
    return int(n[ids < 0].sum()), df


def fit(docs: DataFrame, training: Column, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS, kept: float = 0.995) -> Model:
    """Fit on the text and lang of rows where ``training`` holds and neither
    is null.  Of each language about ``fit_rows`` different texts are drawn by a
    hash of doc_id and text, all of them where there are fewer and one at
    least, so that no language is lost, whatever its ids; equal rows count
    once.  The model has WEIGHTS numbers for each of a language's centroids."""
    usable = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.lit("language"), "doc_id", "text").alias("place"))
    n, df = _frequencies(usable)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    per = usable.groupBy(F.col("lang").alias("p_lang")).agg(F.approx_count_distinct("place").alias("n"), F.min("place").alias("least"))
    per = materialize(per, "languages")
    small = per.count() <= 100_000  # a hundred bytes each
    share = (F.col("place").cast("double") + 2.0**63) / 2.0**64
    drawn = usable.join(F.broadcast(per) if small else per, F.col("lang") == F.col("p_lang")).where((share < fit_rows / F.col("n")) | (F.col("place") == F.col("least")))
    sample = drawn.groupBy("lang", "place").agg(F.first("text").alias("text"))

    def gather(batches):
        for batch in batches:
            got = [grams(t) for _, texts in text_parts(batch) for t in texts]
            columns = [batch.column("lang"), batch.column("place"), pa.array([i.astype("<u2").tobytes() for i, _ in got]), pa.array([n.astype("<u4").tobytes() for _, n in got])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "place", "ids", "n"])

    def cells(key, table):
        rows = sorted(zip(table.column("place").to_pylist(), table.column("ids").to_pylist(), table.column("n").to_pylist()))
        x = np.zeros((len(rows), 1 << BITS), np.float32)
        for k, (_, ids, n) in enumerate(rows):
            ids = np.frombuffer(ids, "<u2")
            x[k, ids] = (1 + np.log(np.frombuffer(n, "<u4"))) * idf[ids]
        x /= np.maximum(np.sqrt((x * x).sum(1)), 1e-30)[:, None]
        c = spherical_kmeans(x.astype(float), centroids)
        if c.shape[1] > WEIGHTS:
            c[c < np.partition(c, -WEIGHTS, 1)[:, -WEIGHTS, None]] = 0
            c /= np.maximum(np.sqrt((c * c).sum(1)), 1e-30)[:, None]
        sims = x @ c.T
        home = sims.argmax(1)
        out = []
        for j in range(len(c)):
            mine = 1 - sims[home == j, j]
            ids = np.flatnonzero(c[j])
            reach = float(np.quantile(mine, kept)) if len(mine) else 1.0
            out.append((key[0].as_py(), j, ids.astype("<u2").tobytes(), c[j, ids].astype("<f4").tobytes(), reach))
        types = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.float64()]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], ["lang", "cell", "ids", "weight", "reach"])

    with_letters = sample.mapInArrow(gather, "lang string, place long, ids binary, n binary").where(F.length("ids") > 0)
    # a group has about fit_rows rows; the centroids alone come to the driver
    fitted = with_letters.groupBy("lang").applyInArrow(cells, "lang string, cell int, ids binary, weight binary, reach double")
    rows = sorted(fitted.toArrow().to_pylist(), key=lambda r: (r["lang"], r["cell"]))
    ids = [np.frombuffer(r["ids"], "<u2") for r in rows]
    at = np.cumsum([0, *map(len, ids)])
    weight = [np.frombuffer(r["weight"], "<f4") for r in rows]
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Model(idf, at, join(ids, np.uint16), join(weight, np.float32), [r["lang"] for r in rows], np.array([r["reach"] for r in rows]))


def predict(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """Adds to the columns ``keep`` of each row: lang_pred, score (cosine to
    the nearest centroid, 0 to 1) and rejected (farther from it than training
    texts are).  A null text, an empty one or one without letters has und, 0
    and true; so has every text if nothing could be learned.  Equal cosines go
    to the first language in order.  Only the text is read besides ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS * WEIGHTS numbers for each language
    rows = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches):
        m = shared.value
        nearest = Nearest(m)
        for batch in batches:
            for k, texts in text_parts(batch, column="__text"):
                lang, score, rejected = [], [], []
                for text in texts:
                    ids, value = vector(text, m.idf)
                    if not len(ids) or not m.language:
                        lang.append("und")
                        score.append(0.0)
                        rejected.append(True)
                        continue
                    sims = nearest.cosines(ids, value)
                    best = int(sims.argmax())
                    lang.append(m.language[best])
                    score.append(min(1.0, max(0.0, float(sims[best]))))
                    rejected.append(bool(1 - sims[best] > m.reach[best] + 1e-5))
                own = [batch.column(i).slice(k, len(texts)) for i in range(batch.num_columns - 1)]
                names = [*batch.schema.names[:-1], "lang_pred", "score", "rejected"]
                yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
