"""Repair of conversations by weighted interval parsing (CYK).

The wanted role initials are `(s?(ua)+)?`.  Its grammar in Chomsky normal form
has a nonterminal (p, q) for every two places of that pattern: the texts that
lead from p to q.  Binary rules are (p, q) -> (p, r) (r, q); the terminal rules
are a row's edits; an insertion closure around every cell stands for the rows
that may be put in.  The cell of a nonterminal over a span of rows holds the
cheapest (cost, audit), ties going to the least audit in ASCII.  As a
nonterminal names its first and last place, whatever row a span is cut at, each
derivation has a place r there: one cut gives the same cell as all of them.  So
spans are combined bottom-up by span length (1, 2, 4, ... rows), which takes
n log n steps instead of n cubed.

Rows are sorted over all tasks by conversation and turn, so that a conversation
with most of the rows lies over many tasks.  A task parses its blocks of at
most BLOCK_ROWS rows; the spans of conversations in several blocks are then
combined FAN at a time in Spark, and their rows are streamed once more to write
the repaired text.

Two audits of one span never tie with one a prefix of the other (the audit
gives the cost, and what follows the prefix could only be insertions, which
cost), so the least of joined audits joins the least ones.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields, replace
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediascore.llm.common import crc32_sql
from mediascore.session import materialize

BLOCK_ROWS = 4096
#: A block is closed early when its texts reach so many characters.
BLOCK_CHARS = 1 << 23
FAN = 16
#: Places of the pattern, the initial that leads on from each, and where a conversation may end.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
PLACES = range(4)
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
BLANK = r"[\x20\x09-\x0D]"

Cells = dict  # (p, q): (cost, audit)


def _insertions() -> Cells:
    """The cheapest rows put in between any two places."""
    out = {(p, p): (0, "") for p in PLACES}
    for _ in PLACES:
        for (p, q), (cost, audit) in list(out.items()):
            for role in ROLES:
                to = STEP.get((q, role))
                if to is not None:
                    out[p, to] = min(out.get((p, to), (cost + INSERT, audit + "I")), (cost + INSERT, audit + "I"))
    return out


def joined(a: Cells, b: Cells) -> Cells:
    """The cells of two adjoining spans' union, by the binary rules."""
    out: Cells = {}
    for (p, r), (cost_a, audit_a) in a.items():
        for q in PLACES:
            right = b.get((r, q))
            if right is None:
                continue
            cost = cost_a + right[0]
            best = out.get((p, q))
            if best is None or cost < best[0] or (cost == best[0] and audit_a + right[1] < best[1]):
                out[p, q] = (cost, audit_a + right[1])
    return out


CLOSURE = _insertions()


@lru_cache(4096)
def row_cells(initial: str, drop: bool, truncated: bool) -> Cells:
    """The cells of one row: kept, given another role, or deleted (the only edit where ``drop``)."""
    edits: Cells = {(p, p): (DELETE, "D") for p in PLACES}
    if not drop:
        for p in PLACES:
            options = [(STEP.get((p, initial)), (KEEP + truncated, "K"))] + [(STEP.get((p, r)), (REROLE + truncated, "R")) for r in ROLES]
            for q, edit in options:
                if q is not None:
                    edits[p, q] = min(edits.get((p, q), edit), edit)
    return joined(joined(CLOSURE, edits), CLOSURE)


def dropped_cells(n: int) -> Cells:
    """The cells of n rows that must all be deleted."""
    return joined({(p, p): (DELETE * n, "D" * n) for p in PLACES}, CLOSURE)


def parsed(cells: list[Cells]) -> Cells:
    """The cells of adjoining spans' union, combined bottom-up by span length."""
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else CLOSURE


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(cells[0, q] for q in ENDS if (0, q) in cells)


@dataclass
class Span:
    """What is known of adjoining rows of a conversation."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str = ""
    last: str = ""
    least_turn: int | None = None
    most_turn: int | None = None
    turns: int = 0
    cells: Cells | None = None

    def then(self, b: "Span", cells: Cells | None = None) -> "Span":
        shared = self.most_turn is not None and self.most_turn == b.least_turn
        return Span(
            self.blank + b.blank,
            self.duplicate + b.duplicate,
            self.truncated + b.truncated,
            self.illegal + b.illegal + (self.last + b.first not in ("su", "ua", "au")),
            self.first,
            b.last,
            b.least_turn if self.least_turn is None else self.least_turn,
            self.most_turn if b.most_turn is None else b.most_turn,
            self.turns + b.turns - shared,
            cells,
        )

    def row(self) -> dict:
        own = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "cells"}
        return own | {"cells": [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in self.cells.items()]}

    @staticmethod
    def of(row: dict) -> "Span":
        own = {f.name: row[f.name] for f in fields(Span) if f.name != "cells"}
        return Span(**own, cells={(x["p"], x["q"]): (x["cost"], x["audit"]) for x in row["cells"]})


def row_span(r: dict) -> Span:
    """The span of one distinct row and its r["n"] copies, of which all but the first must go."""
    drop = r["blank"] or r["repeated"]
    cells = row_cells(r["initial"] if r["initial"] in ("s", "u", "a") else "", drop, not drop and r["cut"])
    more = r["n"] - 1
    if more:
        cells = dropped_cells(r["n"]) if drop else joined(cells, dropped_cells(more))
    return Span(
        blank=r["n"] * r["blank"],
        duplicate=0 if r["blank"] else more + r["repeated"],
        truncated=int(r["cut"] and not drop),
        illegal=more,
        first=r["initial"],
        last=r["initial"],
        least_turn=r["turn"],
        most_turn=r["turn"],
        turns=int(r["turn"] is not None),
        cells=cells,
    )


def block_span(rows: list[dict]) -> Span:
    spans = [row_span(r) for r in rows]
    out = spans[0]
    for s in spans[1:]:
        out = out.then(s)
    return replace(out, cells=parsed([s.cells for s in spans]))


class Writer:
    """Applies an audit to a conversation's rows, in as many parts as they come in."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.started = audit, 0, 0, False

    def _line(self, role: str | None, text: str) -> tuple[str, str]:
        wanted = ROLES["ua"[self.place % 2]]
        self.place += role is None or self.started or role[:1] != "s"
        self.started = True
        return (wanted if role is None else role), text

    def _inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._line(None, "")

    def rows(self, rows):
        """The (role, text) lines up to the last of ``rows`` (role, text, n)."""
        for role, text, n in rows:
            for _ in range(n):
                yield from self._inserted()
                edit = self.audit[self.at]
                self.at += 1
                if edit != "D":
                    yield self._line(role if edit == "K" else None, text)

    def rest(self):
        yield from self._inserted()


class LineHash:
    """SHA-256 of lines `role:text` joined by newlines."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, lines) -> "LineHash":
        for role, text in lines:
            self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True
        return self

    def hex(self) -> str:
        return self.hash.hexdigest()


SPAN_FIELDS = (
    "blank long, duplicate long, truncated long, illegal long, first string, last string, least_turn long, most_turn long, turns long, "
    "cells array<struct<p:int,q:int,cost:long,audit:string>>"
)
_CELLS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SPAN = [(n, pa.string() if n in ("first", "last") else pa.int64()) for n in (f.name for f in fields(Span)) if n != "cells"] + [("cells", _CELLS)]
_RESULT = [("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n (copies) of the rows left by the
    damage: the crc32 of `conv_id:turn` modulo 20 says whether a row is dropped
    (0), loses its text (1) or its `.!?` (2), is repeated (3) or becomes the
    user's (4).  A null counts as one space, in that key too."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    role = F.when(fault == 4, "user").otherwise(one("role"))
    return conversations.where(fault != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).cast("long").alias("n")
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` as ``faults`` takes them; a null role or text counts as one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role"), one("text"), F.lit(1).cast("long").alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies (n) and what is wrong with them: blank
    (nothing but white space), repeated (role and text occur at an earlier
    turn; null turns come first), cut (the last character that is no white
    space is none of `.!?`); and initial and digest of role and text."""
    distinct = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    told = distinct.select(
        "*",
        digest.alias("digest"),
        F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?]{BLANK}*\z")).alias("cut"),
    )
    # a text that one conversation repeats at most turns: combined before the shuffle, and a skewed join is split
    earliest = told.groupBy(F.col("conv_id").alias("e_conv"), F.col("digest").alias("e_digest")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("e_first"))
    found = told.join(earliest, F.col("conv_id").eqNullSafe(F.col("e_conv")) & (F.col("digest") == F.col("e_digest")))
    later = F.struct(F.col("turn").isNotNull().alias("has"), "turn") > F.col("e_first")
    return found.select("conv_id", "turn", "digest", "role", "text", "n", "initial", "blank", "cut", later.alias("repeated"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Sorted over all tasks; rows of one turn go by their digest."""
    return rows.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """A row for each block: its span, whether its conversation is known to be
    whole in it (closed), and the result as if it were."""
    schema = f"conv_id long, part int, block int, closed boolean, {SPAN_FIELDS}, cost long, audit string, repaired_sha256 string"
    arrow = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("closed", pa.bool_()), *_SPAN, *_RESULT])

    def run(batches):
        part = TaskContext.get().partitionId()
        count = 0
        held: list[dict] = []
        size = 0
        alone = False  # whether the block begins its conversation, which another one in this task precedes
        out: list[dict] = []

        def close(whole: bool):
            nonlocal count, held, size
            span = block_span(held)
            cost, audit = cheapest(span.cells)
            sha = LineHash().add((w := Writer(audit)).rows((r["role"], r["text"], r["n"]) for r in held)).add(w.rest()).hex()
            if whole:
                span.cells = {}  # nothing to combine
            out.append({"conv_id": held[0]["conv_id"], "part": part, "block": count, "closed": whole, "cost": cost, "audit": audit, "repaired_sha256": sha} | span.row())
            count += 1
            held, size = [], 0

        for batch in batches:
            for r in batch.to_pylist():
                if held and r["conv_id"] != held[0]["conv_id"]:
                    close(alone)
                    alone = True
                elif len(held) >= block_rows or size >= BLOCK_CHARS:
                    close(False)
                    alone = False
                held.append(r)
                size += len(r["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if held:
            close(False)
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(run, schema)


def _combined(blocks: DataFrame) -> DataFrame:
    """(conv_id, span fields) of conversations in several blocks: FAN adjoining spans become one until one is left."""
    names = [n for n, _ in _SPAN]
    schema = f"conv_id long, idx long, {SPAN_FIELDS}"
    arrow = pa.schema([("conv_id", pa.int64()), ("idx", pa.int64()), *_SPAN])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                spans = [Span.of(x) for x in r["spans"]]
                whole = spans[0]
                for s in spans[1:]:
                    whole = whole.then(s)
                whole.cells = parsed([s.cells for s in spans])
                out.append({"conv_id": r["conv_id"], "idx": r["idx"]} | whole.row())
            yield pa.RecordBatch.from_pylist(out, arrow)

    spans = blocks
    while (most := spans.agg(F.max("idx")).first()[0]) is not None and most > 0:
        groups = spans.groupBy("conv_id", F.expr(f"idx div {FAN}").alias("idx")).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("at"), *names))).alias("spans"))
        spans = materialize(groups.mapInArrow(run, schema), "turns_spans")
    return spans.select("conv_id", *names)


def _streamed(rows: DataFrame, audits: DataFrame, lines: bool) -> DataFrame:
    """Each conversation of ``audits`` (conv_id, audit) repaired in one pass
    over its rows in order: its lines (conv_id, place, role, text), or
    (conv_id, repaired_sha256), which has to be taken in order.  A task holds
    one audit and one batch, never a conversation's rows."""
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("digest", "string"), ("role", "string"), ("n", "long"))}
    heads = audits.select("conv_id", F.lit(0).alias("kind"), *[none[c] for c in ("turn", "digest", "role")], F.col("audit").alias("text"), none["n"])
    own = rows.join(audits.select(F.col("conv_id").alias("a_conv")), F.col("conv_id").eqNullSafe(F.col("a_conv")), "left_semi")
    both = heads.unionByName(own.select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text", "n"))
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest").select("conv_id", "kind", "role", "text", "n")
    key = pa.field("conv_id", pa.int64())
    arrow = pa.schema([key, ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())] if lines else [key, ("repaired_sha256", pa.string())])

    def run(batches):
        conv, writer, hashed, place = None, None, None, 0

        def put(found):
            nonlocal place
            if not lines:
                hashed.add(found)
                return
            for role, text in found:
                yield {"conv_id": conv, "place": place, "role": role, "text": text}
                place += 1

        def end():
            if writer is not None:
                if lines:
                    yield from put(writer.rest())
                else:
                    yield {"conv_id": conv, "repaired_sha256": hashed.add(writer.rest()).hex()}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    out += end()
                    conv, writer, hashed, place = r["conv_id"], Writer(r["text"]), LineHash(), 0
                elif lines:
                    out += put(writer.rows([(r["role"], r["text"], r["n"])]))
                else:
                    hashed.add(writer.rows([(r["role"], r["text"], r["n"])]))
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        out = list(end())
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return dealt.mapInArrow(run, "conv_id long, place long, role string, text string" if lines else "conv_id long, repaired_sha256 string")


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def parse(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text
    without nulls, n copies): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.  A null conv_id is a conversation;
    null turns come first and leave no gaps; rows of one turn go by digest."""
    found = materialize(faults(rows), "turns_faults")
    blocks = materialize(_blocks(_in_order(found), block_rows), "turns_blocks")
    open_ = blocks.where(~F.col("closed")).select(F.col("conv_id").alias("o_conv"), F.col("part").alias("o_part"), F.col("block").alias("o_block"))
    group = Window.partitionBy("o_conv")
    numbered = open_.select("*", (F.row_number().over(group.orderBy("o_part", "o_block")) - 1).cast("long").alias("idx"), F.count("*").over(group).alias("of"))
    placed = blocks.join(numbered, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("part") == F.col("o_part")) & (F.col("block") == F.col("o_block")), "left")
    placed = materialize(placed.drop("o_conv", "o_part", "o_block"), "turns_placed")
    alone = placed.where(F.col("of").isNull() | (F.col("of") == 1))
    several = _combined(placed.where("of > 1").select("conv_id", "idx", *[n for n, _ in _SPAN]))
    ends = F.filter("cells", lambda c: (c["p"] == 0) & c["q"].isin(*ENDS))
    best = F.array_min(F.transform(ends, lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    several = several.withColumn("best", best).select("*", "best.cost", "best.audit").drop("best")
    hashes = _streamed(found, several.select("conv_id", "audit"), lines=False).withColumnRenamed("conv_id", "h_conv")
    several = several.join(hashes, F.col("conv_id").eqNullSafe(F.col("h_conv")))
    gaps = F.when(F.col("least_turn").isNull(), 0).otherwise(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns")).cast("long")
    names = ["conv_id", gaps.alias("gaps"), *COUNTS, "cost", "audit", "repaired_sha256"]
    return alone.select(*names).unionByName(several.select(*names))


def report(conversations: DataFrame, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``parse`` of ``rows``, with zeros, an empty audit and the empty
    string's hash for conversations of ``conversations`` that have no rows left."""
    done = parse(rows, block_rows).withColumnRenamed("conv_id", "p_conv")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(done, F.col("conv_id").eqNullSafe(F.col("p_conv")), "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repaired(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role and text.
    A conversation whose rows are all deleted has none."""
    rows = undamaged(conversations)
    audits = materialize(parse(rows, block_rows).select("conv_id", "audit"), "turns_audits")
    return _streamed(materialize(faults(rows), "turns_faults"), audits, lines=True)


def oracle() -> str:
    """The report on damaged conversations as DuckDB SQL: shortest paths
    through the pattern's places, row by row."""
    cost = lambda c, n, a: f"{{'c': {c}.c + {n}, 'a': {c}.a || '{a}'}}"
    cell = lambda q: f"acc.cells[{q + 1}]"
    raw = []
    for q in PLACES:
        options = [cost(cell(q), DELETE, "D")]
        for (p, initial), to in STEP.items():
            if to == q:
                options.append(f"case when not x.del and x.ini = '{initial}' then {cost(cell(p), 'x.cut', 'K')} end")
                if initial in ROLES:
                    options.append(f"case when not x.del then {cost(cell(p), f'{REROLE} + x.cut', 'R')} end")
        raw.append(f"list_sort(list_filter([{', '.join(options)}], lambda o: o is not null))[1]")
    closed = []
    for q in PLACES:
        closed.append("list_sort([" + ", ".join(cost(f"r[{p + 1}]", c, a) for (p, to), (c, a) in CLOSURE.items() if to == q) + "])[1]")
    far = "{'c': 1000000000::bigint, 'a': ''}"
    start = ", ".join(f"{{'c': {CLOSURE[0, q][0]}::bigint, 'a': '{CLOSURE[0, q][1]}'}}" if (0, q) in CLOSURE else far for q in PLACES)
    key = "coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"
    return f"""
    with keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql(key)} % 20 as fault from conversations),
    hurt as (select conv_id, turn, case when fault = 4 then 'user' else role end as role,
                    case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                    unnest(range(case when fault = 3 then 2 else 1 end)) as copy
             from keyed where fault <> 0),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(role) || ':' || role || text), copy) as pos from hurt),
    told as (select *, substr(role, 1, 1) as ini, lag(substr(role, 1, 1)) over (partition by conv_id order by pos) as earlier,
                    case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'b'
                         when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'd'
                         when not regexp_matches(text, '[.!?]{BLANK}*\\z') then 't' else '' end as fault
             from placed),
    parsed as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                      count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
                      count(*) filter (where pos > 1 and earlier || ini not in ('su', 'ua', 'au')) as illegal,
                      list_reduce(list_prepend({{'cells': [{start}], 'ini': '', 'del': false, 'cut': 0::bigint}},
                                               list({{'cells': [{", ".join([far] * len(PLACES))}], 'ini': ini, 'del': fault in ('b', 'd'), 'cut': (fault = 't')::bigint}} order by pos)),
                                  lambda acc, x: {{'cells': list_transform([[{", ".join(raw)}]], lambda r: [{", ".join(closed)}])[1], 'ini': '', 'del': false, 'cut': 0::bigint}}).cells as cells
               from told group by conv_id),
    best as (select *, list_sort([{", ".join(f"cells[{q + 1}]" for q in ENDS)}])[1] as done from parsed),
    edits as (select conv_id, i, substr(done.a, i, 1) as edit, count(*) filter (where substr(done.a, i, 1) <> 'I') over (partition by conv_id order by i) as pos
              from (select *, unnest(range(1, length(done.a) + 1)) as i from best)),
    kept as (select e.conv_id, i, edit, t.role, t.text, row_number() over (partition by e.conv_id order by i) as place,
                    first_value(edit = 'K' and t.ini = 's') over (partition by e.conv_id order by i) as system
             from edits e left join told t on e.conv_id is not distinct from t.conv_id and e.pos = t.pos and edit <> 'I' where edit <> 'D'),
    written as (select conv_id, string_agg(case when edit = 'K' then role when (place - system::int) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by i) as lines
                from kept group by conv_id)
    select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
           coalesce(illegal, 0) as illegal, coalesce(done.c, 0) as cost, coalesce(done.a, '') as audit, sha256(coalesce(lines, '')) as repaired_sha256
    from (select distinct conv_id from conversations) c
    left join best b on c.conv_id is not distinct from b.conv_id left join written w on c.conv_id is not distinct from w.conv_id"""
