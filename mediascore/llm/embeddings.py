"""Near-duplicate vectors: spherical k-means cells and blocked cosines.

A bounded sample trains spherical k-means.  Every vector has its nearest
centroid's cell as home and visits the cells whose boundary is within
``margin`` of it (the sine of the angle to the boundary); within a cell, blocks
of visitors are multiplied with blocks of residents in double precision.  The
arc between two vectors of different cells crosses the boundary, so the nearer
of them is within half of their angle of it and visits the other's home: with a
margin of the sine of half the threshold's angle, the default, no pair is lost.
A pair is counted for x where x, at home or on a visit, meets y's home, and
there for y too unless y visits x's home, so once for each.  Vectors of each
length have cells of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediascore.llm.components import components, forest
from mediascore.session import materialize

#: The most vectors that k-means is trained on, and the most cells.
FIT_ROWS = 16384
MAX_CELLS = 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Unit centroids of unit rows; a cell that runs empty takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        sims = x @ c.T
        home = sims.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        for j in np.flatnonzero(norm < 1e-12):
            far = sims.max(1).argmin()
            sums[j], norm[j] = x[far], 1.0
            sims[far] = 2
        c = sums / norm[:, None]
    return c


def _unit(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # by a power of two, which is exact: no square of a huge or tiny component leaves the doubles
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def near_duplicates(vectors: DataFrame, threshold: float, margin: float | None = None, cell_rows: int = 1000, block: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``
    (vec_id, embedding).  Links join vectors with cosine >= threshold (above 0); n_links
    counts the other rows linked directly, component_id is the smallest vec_id
    that links reach, kept marks it.  Null, empty and zero vectors, vectors
    with null or non-finite components, and rows with a null vec_id link with
    nothing (n_links 0, own component); vectors of different lengths do not link.
    Rows with equal vectors count as links of each other.  No rows give no
    rows; other columns are not read."""
    if margin is None:
        margin = np.sqrt((1 - threshold) / 2) + 1e-6  # with some room for rounding
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & sound, F.lit(False))
    # equal vectors are one node from the outset, whatever their number
    nodes = v.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    nodes = materialize(nodes.withColumn("dim", F.size("embedding")), "vectors")
    if nodes.isEmpty():
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # lengths that fill several cells, at most half of MAX_CELLS; vectors of any other length have one cell
    counts = nodes.groupBy("dim").agg(F.count("*").alias("rows")).where(F.col("rows") >= 2 * cell_rows).orderBy(F.desc("rows"), "dim").limit(MAX_CELLS // 2).collect()
    total = sum(r["rows"] for r in counts)
    cells = {r["dim"]: min(r["rows"] // cell_rows, MAX_CELLS * r["rows"] // total) for r in counts}
    sample = nodes.where(F.col("dim").isin([d for d, k in cells.items() if k > 1])).orderBy(F.xxhash64("rep")).limit(FIT_ROWS).select("dim", "embedding").toArrow()
    fitted, first = {}, 0
    for dim in np.unique(sample["dim"].to_numpy()).tolist():
        x = _unit(sample.filter(pc.equal(sample["dim"], dim))["embedding"], dim)
        fitted[dim] = (first, spherical_kmeans(x, cells[dim]))
        first += len(fitted[dim][1])
    shared = spark.sparkContext.broadcast(fitted)  # at most MAX_CELLS rows

    def assign(batches):
        apart = {dim: np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-9)) for dim, (_, c) in shared.value.items()}
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                dims = batch.column("dim").slice(k, 1024).to_numpy()
                for dim in np.unique(dims).tolist():
                    part = batch.slice(k, 1024).filter(pa.array(dims == dim))
                    if dim in apart:
                        first, c = shared.value[dim]
                        sims = _unit(part.column("embedding"), dim) @ c.T
                        at = sims.argmax(1)
                        near = (sims[np.arange(len(at)), at][:, None] - sims) / apart[dim][at] <= margin
                    else:
                        first, at, near = -dim, np.zeros(part.num_rows, np.int64), np.ones((part.num_rows, 1), bool)
                    bits = pa.array([b.tobytes() for b in np.packbits(near, axis=1)], pa.binary())
                    row, cell = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((first + cell).astype(np.int32)), pa.array(cell == at[row]), pa.array(at[row].astype(np.int32)), bits.take(pa.array(row))]
                        + [part.column(c_).take(pa.array(row)) for c_ in ("rep", "n", "embedding")],
                        ["cell", "home", "at", "visits", "rep", "n", "embedding"],
                    )

    kind = dict(nodes.dtypes)["embedding"]
    placed = materialize(nodes.select("rep", "n", "dim", "embedding").mapInArrow(assign, f"cell int, home boolean, at int, visits binary, rep long, n long, embedding {kind}"), "cells")
    sizes = placed.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.sum(F.col("home").cast("int")) / block).alias("nh"), F.ceil(F.count("*") / block).alias("nq"))
    sizes = sizes.select("c", F.greatest("nh", F.lit(1)).cast("int").alias("nh"), "nq")  # at most MAX_CELLS rows and one for each other length
    hb, qb = F.pmod(F.xxhash64("rep"), F.col("nh")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("nq")).cast("int")
    rows = placed.join(F.broadcast(sizes), F.col("cell") == F.col("c")).withColumn("hb", hb).withColumn("qb", qb.cast("int"))
    spots = F.expr(
        "concat(transform(sequence(0, nh - 1), h -> struct(h AS h, qb AS q, home AND h = hb AS resident, true AS visitor)),"
        " transform(filter(sequence(0, cast(nq AS int) - 1), q -> home AND q != qb), q -> struct(hb AS h, q AS q, true AS resident, false AS visitor)))"
    )
    own = ["at", "visits", "rep", "n", "embedding"]
    rows = rows.select("cell", *own, F.explode(spots).alias("s")).select("cell", "s.h", "s.q", "s.resident", "s.visitor", *own)

    def compare(group: pa.Table) -> pa.Table:
        rep, n = group["rep"].to_numpy(), group["n"].to_numpy()
        is_h, is_q = group["resident"].to_numpy(), group["visitor"].to_numpy()
        x = _unit(group["embedding"], len(group["embedding"][0]))
        h, q = np.flatnonzero(is_h), np.flatnonzero(is_q)
        link = (x[q] @ x[h].T >= threshold) & (rep[q][:, None] != rep[h][None, :])
        links = link @ n[h]
        # a resident counts the visitors whose home it does not visit itself
        visits = np.frombuffer(b"".join(group["visits"].take(pa.array(h)).to_pylist()), np.uint8).reshape(len(h), -1)
        at = group["at"].to_numpy()[q]
        meets = (visits[:, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        back = n[q] @ (link & ~meets.T)
        rows, cols = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
        a, b = forest(link[np.ix_(rows, cols)])
        ids = np.concatenate([rep[q][rows], rep[h][cols]])
        return pa.table({"rep": ids, "links": np.concatenate([links[rows], back[cols]]), "root": ids[np.concatenate([a, b])]})

    found = materialize(rows.groupBy("cell", "h", "q").applyInArrow(compare, "rep long, links long, root long"), "links")
    groups = components(found, "rep", "root")
    total = found.groupBy("rep").agg(F.sum("links").alias("links"))
    about = (
        nodes.join(total.withColumnRenamed("rep", "r1"), F.col("rep") == F.col("r1"), "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select(F.col("embedding").alias("e"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("c"))
    )
    # the key is null for rows that link with nothing, so they join nothing
    keyed = v.withColumn("key", F.when(usable, F.col("embedding")))
    out = keyed.join(about, F.col("key") == F.col("e"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
