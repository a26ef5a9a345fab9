"""Best-fit packing in bulk-synchronous sweeps.

Pieces (at most ``capacity`` tokens) go into sequences of ``capacity`` tokens,
longest first, each into the smallest gap that holds it.  Piece lengths and
gaps are integers up to the capacity, so the sorted pieces are runs of equal
length and the sorted gaps runs of equal room, and a sweep moves runs at once
whatever the number of rows:

* every piece gets its rank among the pieces of its length (local rank in its
  task plus the counts of the tasks before);
* a sweep gives the run of the next length to the successor in the sorted gap
  runs.  Where several pieces want a gap, ranks decide: rank r of the run takes
  the (r div k)-th sequence of the gap run, k pieces fitting into each;
* the gaps that change become runs of the smaller room, the rest stay, and the
  sweep is repeated until the run is placed; what no gap holds opens sequences;
* the placements, at most a few for each pair of lengths, are rank intervals,
  joined to the pieces in Spark by length and rank.

The driver sees the counts by length (``capacity`` rows at most), never a row.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediascore.llm.tokens import encoder

PIECES = "part int, rank long, doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, capacity: int) -> DataFrame:
    """Encode every text (null: empty), append ``end_id`` and cut documents
    of more than ``capacity`` ids into pieces of ``capacity``, the first one
    shorter if need be.  Returns PIECES: ids are little-endian unsigned 32-bit
    integers, part and rank number the pieces of a length within a task.
    Repeated rows are packed as often as they occur; a null doc_id stays null.
    The result must be written before it is read twice (ranks follow the
    order in which a task reads its rows)."""

    def cut(batches):
        enc = encoder(tokenizer, spaced)
        end = struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            docs_ = batch.column("doc_id").to_pylist()
            for k in range(0, len(docs_), 256):
                rows = []
                for doc, got in zip(docs_[k : k + 256], enc.encode(batch.column("text").slice(k, 256).to_pylist())):
                    ids = got + end
                    n = len(ids) // 4
                    at, piece = 0, 0
                    while at < n:
                        length = n if n <= capacity else (n % capacity or capacity) if at == 0 else capacity
                        rows.append((part, seen[length], doc, piece, at, length, ids[4 * at : 4 * (at + length)]))
                        seen[length] += 1
                        at += length
                        piece += 1
                if rows:
                    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def sweeps(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Placements (length, rank_from, rank_to, sequence_from, per_sequence,
    offset) of all pieces, and the number of sequences.  Rank r of an interval
    goes into sequence sequence_from + (r - rank_from) div per_sequence."""
    runs: dict[int, list[tuple[int, int]]] = {}  # room: runs of sequences (first, how many)
    rooms: list[int] = []  # the sorted gaps
    placed: list[tuple] = []
    used = 0

    def gap(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(rooms, length)  # the successor
            if k < len(rooms):
                room = rooms[k]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(k)
            else:
                room = capacity
                first, n = used, -(-left // (capacity // length))
                used += n
            per = room // length
            full = min(n, left // per)
            if full:
                placed.append((length, rank, rank + full * per, first, per, capacity - room))
                gap(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < n:
                placed.append((length, rank, rank + left, first + full, left, capacity - room))
                gap(room - left * length, first + full, 1)
                full, left = full + 1, 0
            gap(room, first + full, n - full)
    return placed, used


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to written pieces (columns part, rank and
    length are needed, others are kept): within a sequence offsets are gapless
    from 0.  An empty table gives no rows."""
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    placed, _ = sweeps(counts, capacity)
    rules = spark.createDataFrame(placed, "r_length long, r_from long, r_to long, r_first long, r_per long, r_offset long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select(F.col("part").alias("o_part"), F.col("length").alias("o_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o_before"))
    ranked = pieces.join(offsets, (F.col("part") == F.col("o_part")) & (F.col("length") == F.col("o_length"))).withColumn("rank", F.col("rank") + F.col("o_before"))
    # the placements are bounded by the capacity, not by the rows
    fits = (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("r_from")) & (F.col("rank") < F.col("r_to"))
    ranked = ranked.join(F.broadcast(rules), fits)
    nth = F.col("rank") - F.col("r_from")
    return (
        ranked.withColumn("sequence_id", F.col("r_first") + F.expr("(rank - r_from) div r_per"))
        .withColumn("offset", F.col("r_offset") + (nth % F.col("r_per")) * F.col("length"))
        .drop("part", "rank", "o_part", "o_length", "o_before", "r_length", "r_from", "r_to", "r_first", "r_per", "r_offset")
    )
