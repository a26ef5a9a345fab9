"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediascore.session import materialize


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``links``; component is the
    smallest node reachable.  Large-star and small-star steps (Kiveris et al.,
    2014) until every node points at its component's smallest: each step is
    two aggregations and two joins on the links, never a list of a node's
    neighbours.  Each round's links are written, which cuts the lineage.
    Self-links and null ends are ignored; no links give no rows."""
    ends = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a != b")
    pairs = materialize(ends.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    state = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        if not now[0]:
            break
        # large star: a node's larger neighbours move to its smallest neighbour (or itself)
        both = pairs.select(F.col("lo").alias("u"), F.col("lo").alias("v")).union(pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = pairs.join(least, F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo"))
        # small star: a node and its smaller neighbours move to the smallest of these
        large = materialize(large.distinct(), "links_large")
        mins = large.groupBy(F.col("hi").alias("h")).agg(F.min("lo").alias("m"))
        moved = large.join(mins, F.col("hi") == F.col("h")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo")
        pairs = materialize(moved.union(mins.select("h", "m")).distinct(), "links")
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def forest(link):
    """Labels of the rows and columns of a boolean link matrix: two are equal
    where a chain of links joins them.  Rows get the numbers 0.., columns go on
    after them; a label is the smallest number of its group."""
    import numpy as np

    rows, cols = link.shape
    a, b = np.arange(rows), np.arange(rows, rows + cols)
    far = rows + cols
    while True:
        # smallest label over the linked columns, then over the linked rows
        to_a = np.minimum(a, np.where(link, b[None, :], far).min(1, initial=far))
        to_b = np.minimum(b, np.where(link, to_a[:, None], far).min(0, initial=far))
        if (to_a == a).all() and (to_b == b).all():
            return a, b
        a, b = to_a, to_b
