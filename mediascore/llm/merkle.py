"""Merkle manifest of a table, as a rollup of nested structs.

Leaves are ranked within their group; the base-3 digits of a rank say which
node of each run of three a leaf descends from.  Digits are grouped away one
after the other, each time nesting a run's structs in their parent's, within
blocks of 3**DIGITS leaves: one shuffle by block serves all levels, and a block
is a row of bounded size whatever the size of its group.  Blocks' digests are
the next tier's nodes, up to a subroot for each group, and the subroots are
rolled up likewise to the root.

Proofs go the other way: a block's row meets its own path (by one grouping of
both on the block's key, no join), and transform and explode walk down its
nested structs, adding each level's siblings.

A node is the digest of its children's digests one after the other, as
lowercase hex text; the last run of a level may be shorter, and a run of one
is hashed like any other.  A level exists while a group has several nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediascore.llm.common import crc32_sql
from mediascore.session import materialize

RUN = 3
#: Levels rolled up within a block: at most RUN**DIGITS leaves in one row.
DIGITS = 6
PATH = "array<struct<left:string,right:string>>"


def digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the columns' values one after the other: `-`
    for a null, else the UTF-8 byte count, a colon and the value (integers in
    decimal).  So no two rows of different values have the same input."""
    parts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]).cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]).cast("binary"), 256))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Adds rank (from 0, by ``order``, within the column grp, which has no
    nulls) and size (rows of the grp).  Rows are sorted by range, so a group
    with most of the rows lies over many tasks; equal rows are told apart by
    their row number.  Only a count for each task and group is shuffled by group."""
    numbered = rows.withColumn("row_no", F.monotonically_increasing_id())
    spread = numbered.repartitionByRange("grp", *order, "row_no").sortWithinPartitions("grp", *order, "row_no").drop("row_no")
    # the place of a row: its task, and its number there
    place = F.monotonically_increasing_id()
    placed = materialize(spread.withColumn("place", place), "merkle_placed")
    placed = placed.withColumn("part", F.shiftright("place", 33)).withColumn("at", F.col("place").bitwiseAND((1 << 33) - 1))
    runs = placed.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "grp", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(group).alias("size"))
    return placed.join(runs, ["part", "grp"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "place", "shift")


def _nested(nodes: DataFrame, tier: int, payload: list[str]) -> DataFrame:
    """(grp, size, block, node) of nodes (grp, size, rank, hash and payload):
    node is the block's struct of hash and kids, DIGITS levels deep."""
    digits = [F.expr(f"cast((rank div {RUN**j}) % {RUN} as int)").alias(f"d{j}") for j in range(DIGITS)]
    block = F.expr(f"rank div {RUN**DIGITS}").alias("block")
    rows = nodes.select("grp", "size", block, *digits, F.struct("hash", *payload).alias("node")).repartition("grp", "block")
    for j in range(DIGITS):
        keys = ["grp", "size", "block", *[f"d{i}" for i in range(j + 1, DIGITS)]]
        # array_sort is by the digit: no two children of a run share one
        kids = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{j}").alias("digit"), "node"))).alias("kids"))
        hashes = F.concat_ws("", F.transform("kids", lambda k: k["node"]["hash"]))
        several = F.col("size") > F.lit(RUN ** (tier * DIGITS + j))
        parent = F.when(several, F.sha2(hashes.cast("binary"), 256)).otherwise(hashes)
        rows = kids.select(*keys, F.struct(parent.alias("hash"), "kids").alias("node"))
    return rows


def _descended(blocks: DataFrame, tier: int) -> DataFrame:
    """Walks down the nested structs of blocks (grp, size, block, node, path
    and other columns): a row for each of the nodes that _nested took, with
    rank and the siblings of its levels put before those of ``path``."""
    other = [c for c in blocks.columns if c not in ("block", "node", "path")]
    rows = blocks.withColumnRenamed("block", "rank")
    for j in reversed(range(DIGITS)):
        several = F.col("size") > F.lit(RUN ** (tier * DIGITS + j))
        rows = rows.select(*other, F.inline(F.transform("node.kids", _child(several))))
    return rows


def _child(several: Column):
    """What a run's i-th kid takes over: rank, node, and the path with its siblings where the level exists."""

    def child(k: Column, i: Column) -> Column:
        hashes = F.transform("node.kids", lambda x: x["node"]["hash"])
        here = F.struct(F.concat_ws("", F.slice(hashes, F.lit(1), i)).alias("left"), F.concat_ws("", F.slice(hashes, i + 2, F.lit(RUN))).alias("right"))
        path = F.when(several, F.concat(F.array(here), F.col("path"))).otherwise(F.col("path")).cast(PATH)
        return F.struct((F.col("rank") * RUN + k["digit"]).alias("rank"), k["node"].alias("node"), path.alias("path"))

    return child


def _tiers(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """The blocks of every tier, each written; a group has one block in the last."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    out = [materialize(_nested(nodes, 0, payload), "merkle_tier")]
    while largest > RUN ** (DIGITS * len(out)):
        above = out[-1].select("grp", "size", F.col("block").alias("rank"), F.col("node.hash").alias("hash"))
        out.append(materialize(_nested(above, len(out), []), "merkle_tier"))
    return out


def _met(blocks: DataFrame, paths: DataFrame, others: list[str]) -> DataFrame:
    """Blocks with the path and other columns of their key (grp, block): one
    grouping of both, in which each key has one row of either."""
    names = ["size", "node", "path", *others]
    left = blocks.select("grp", "block", "size", "node", F.lit(None).cast(PATH).alias("path"), *[F.lit(None).cast("string").alias(c) for c in others])
    right = paths.select("grp", "block", F.lit(None).cast("long").alias("size"), F.lit(None).cast(blocks.schema["node"].dataType).alias("node"), "path", *others)
    return left.unionByName(right).groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


def _proved(tiers: list[DataFrame], top: DataFrame, others: list[str]) -> DataFrame:
    """Every node of the first tier's blocks with its path; ``top`` has each
    group's path above its subroot (grp, path and other columns)."""
    paths = top.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(range(len(tiers))):
        rows = _descended(_met(tiers[tier], paths, others), tier)
        paths = rows.select("grp", F.col("rank").alias("block"), "path", *others)
    return rows


def proofs(leaves: DataFrame, *order: str) -> DataFrame:
    """For each row of ``leaves``, which has the columns hash, source (the
    group, a string or null) and ``order`` (what it is ranked by within its
    group, nulls first; ties by hash): row (a struct of all its columns,
    whatever their names), rank, path (its siblings' digests left and right of
    it, from the lowest level up to the root), subroot and root.

    Groups are ordered with null first, then by UTF-8 bytes.  Repeated rows
    are leaves of their own (equal ones in any order).  An empty table gives
    no rows."""
    group = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("grp")
    row = F.struct(*[F.col(f"`{c}`") for c in leaves.columns]).alias("row")
    nodes = leaves.select(group, F.col("hash").alias("hash"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], row)
    tiers = _tiers(ranked(nodes, *[f"o{i}" for i in range(len(order))], "hash"), ["row"])
    # the groups' subroots are rolled up as one group
    subroots = tiers[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("node.hash").alias("hash"))
    above = _tiers(ranked(subroots, "name"), ["name"])
    root = above[-1].select("grp", F.array().cast(PATH).alias("path"), F.col("node.hash").alias("root"))
    top = _proved(above, root, ["root"]).select(F.col("node.name").alias("grp"), "path", F.col("node.hash").alias("subroot"), "root")
    return _proved(tiers, top, ["subroot", "root"]).select("node.row", "rank", "path", "subroot", "root")


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, hash, probe) of documents: hash is the digest of
    doc_id, source, lang, n_chars and text, probe that of the same row with
    its text's line ends deleted, for every second document by the crc32 of
    its decimal doc_id (null for the others, and for a null doc_id).  Other
    columns of ``docs`` are left aside."""
    own = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    probe = F.when(chosen, digest(*own, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), digest(*own, F.col("text")).alias("hash"), probe.alias("probe"))


def checked(proved: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (SHA-256 of the path's
    digests, from the lowest level up and left to right; of nothing where
    there are no siblings), folded_root (from the probe, or the leaf where
    there is none, and the leaf's path) and verified."""
    siblings = F.concat_ws("", F.transform("path", lambda x: F.concat(x["left"], x["right"])))
    out = proved.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.hash").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        fold(F.coalesce("row.probe", "row.hash"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 14) -> str:
    """The result as DuckDB SQL, level by level by windows, for up to
    3**levels documents a source and as many sources."""
    enc = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    sql = [
        f"""with leaves as (
            select doc_id, source, {leaf("text")} as leaf,
                   case when doc_id is not null and {crc32_sql("cast(doc_id as varchar)")} % 2 = 0 then {leaf("replace(text, chr(10), '')")} end as probe
            from documents),
        l0 as (select *, coalesce('=' || source, '') as grp, leaf as node, coalesce(probe, leaf) as folded, '' as proof,
                      row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as rank,
                      count(*) over (partition by source) as size from leaves)"""
    ]

    def climb(name: str, part: str, k: int) -> str:
        # one row a leaf; leaves below a node share it, so a run's digests are those of its distinct nodes
        run = f"partition by {part}, rank // {RUN}"
        kid = lambda i: f"coalesce(max(case when rank % {RUN} = {i} then node end) over ({run}), '')"
        return f"""{name}{k + 1} as (
            select doc_id, source, leaf, probe, grp, {", ".join(c for c in ("subroot",) if name == "s") + ", " if name == "s" else ""}
                   case when size > 1 then sha256(k0 || k1 || k2) else node end as node,
                   case when size > 1 then sha256(case when child = 0 then folded else k0 end || case when child = 1 then folded else k1 end || case when child = 2 then folded else k2 end) else folded end as folded,
                   case when size > 1 then proof || case when child = 0 then '' else k0 end || case when child = 1 then '' else k1 end || case when child = 2 then '' else k2 end else proof end as proof,
                   rank // {RUN} as rank, (size + {RUN - 1}) // {RUN} as size
            from (select *, rank % {RUN} as child, {kid(0)} as k0, {kid(1)} as k1, {kid(2)} as k2 from {name}{k}))"""

    for k in range(levels):
        sql.append(climb("l", "grp", k))
    sql.append(
        f"""s0 as (select doc_id, source, leaf, probe, grp, node as subroot, node, folded, proof,
                      dense_rank() over (order by grp) - 1 as rank, (select count(distinct grp) from l0) as size from l{levels})"""
    )
    for k in range(levels):
        sql.append(climb("s", "1", k))
    return (
        ",\n".join(sql)
        + f"\nselect doc_id, leaf, subroot, node as root, sha256(proof) as proof_sha256, folded as folded_root, folded = node as verified from s{levels}"
    )
