"""Token ids as bit-plane files.

Documents are range-partitioned and sorted by doc_id; every partition encodes
its texts and streams the ids into one binary file.  A file is a sequence of
records, each followed by one newline byte (Spark's writer adds it):

* chunk: up to ``chunk_ids`` ids, transposed into bit planes (plane k holds
  bit k of every id, eight ids to a byte) or byte planes, each plane a
  zstandard frame; planes that are all zero take no bytes;
* index: the chunks' byte offsets, lengths, id counts and plane lengths, then
  the documents' ids, null marks and token counts, each a zstandard frame;
* footer: 48 bytes, which begin with the magic bytes and give the index's
  place, the file's number and its totals.

The files go through Spark's own text writer (a binary value cast to string
keeps its bytes), so they land in any store that Spark writes to, with its
commit protocol: a lost or repeated task leaves no partial or double file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediascore.llm.common import text_slices
from mediascore.llm.tokens import encoder

MAGIC = b"BPLANES1"
#: magic, index offset, index length, file number, documents, ids, planes per id.
FOOTER = struct.Struct("<8sQQIIQI")
CHUNK = struct.Struct("<QQI")
LEVEL = 3


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of little-endian uint32 ids: 32 bit planes or 4 byte planes."""
    raw = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() if raw[:, k].any() else b"" for k in range(4)]
    out = []
    for k in range(4):
        col = raw[:, k]
        for j in range(8):
            plane = (col >> j) & 1
            out.append(np.packbits(plane, bitorder="little").tobytes() if plane.any() else b"")
    return out


def ids_of(planes: list[bytes], n: int) -> np.ndarray:
    """The ids whose planes these are; an empty plane is all zero."""
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if not plane:
            continue
        got = np.frombuffer(plane, np.uint8)
        if len(planes) == 4:
            raw[:, k] = got
        else:
            raw[:, k // 8] |= np.unpackbits(got, count=n, bitorder="little") << (k % 8)
    return raw.reshape(-1).view("<u4")


class FileWriter:
    """The records of one file, from documents in order."""

    def __init__(self, number: int, chunk_ids: int, bits: bool):
        self.number, self.chunk_ids, self.bits = number, chunk_ids, bits
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.offset = 0
        self.ids = 0
        self.waiting = bytearray()
        self.chunks: list[bytes] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []

    def _record(self, body: bytes) -> bytes:
        self.offset += len(body) + 1
        return body

    def _chunk(self, raw: bytes) -> bytes:
        planes = [self.pack(p) if p else b"" for p in planes_of(np.frombuffer(raw, "<u4"), self.bits)]
        body = b"".join(planes)
        lengths = struct.pack(f"<{len(planes)}I", *map(len, planes))
        self.chunks.append(CHUNK.pack(self.offset, len(body), len(raw) // 4) + lengths)
        return self._record(body)

    def add(self, doc_id: int | None, ids: bytes):
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self.waiting += ids
        size = 4 * self.chunk_ids
        while len(self.waiting) >= size:
            yield self._chunk(bytes(self.waiting[:size]))
            del self.waiting[:size]

    def end(self):
        if self.waiting:
            yield self._chunk(bytes(self.waiting))
        parts = [
            self.pack(b"".join(self.chunks)),
            self.pack(np.array([d or 0 for d in self.docs], "<i8").tobytes()),
            self.pack(np.array([d is None for d in self.docs], "u1").tobytes()),
            self.pack(np.array(self.lengths, "<u8").tobytes()),
        ]
        index = struct.pack("<4Q", *map(len, parts)) + b"".join(parts)
        at = self.offset
        yield self._record(index)
        yield FOOTER.pack(MAGIC, at, len(index), self.number, len(self.docs), self.ids, 32 if self.bits else 4)


class FileReader:
    """Reads a file's bytes through its chunk index."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        end = len(content) - 1  # the last newline
        magic, at, size, self.number, n, self.n_ids, self.n_planes = FOOTER.unpack(self.content[end - FOOTER.size : end])
        if magic != MAGIC:
            raise ValueError("not a bit-plane file")
        self.unpack = zstandard.ZstdDecompressor().decompress
        index = self.content[at : at + size]
        lengths, parts, k = struct.unpack("<4Q", index[:32]), [], 32
        for x in lengths:
            parts.append(self.unpack(index[k : k + x]) if x else b"")
            k += x
        row = CHUNK.size + 4 * self.n_planes
        self.chunks = [parts[0][i : i + row] for i in range(0, len(parts[0]), row)]
        ids = np.frombuffer(parts[1], "<i8")
        null = np.frombuffer(parts[2], "u1").astype(bool)
        self.docs = [None if z else int(d) for d, z in zip(ids, null)]
        self.lengths = np.frombuffer(parts[3], "<u8").astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        at, size, n = CHUNK.unpack(self.chunks[k][: CHUNK.size])
        planes = []
        for x in struct.unpack(f"<{self.n_planes}I", self.chunks[k][CHUNK.size :]):
            planes.append(self.unpack(self.content[at : at + x]) if x else b"")
            at += x
        return ids_of(planes, n)

    def documents(self):
        """(doc_id, ids before it in this file, its ids' bytes), holding one chunk and one document at a time."""
        have, k, before = bytearray(), 0, 0
        for doc, n in zip(self.docs, self.lengths.tolist()):
            while len(have) < 4 * n:
                have += self.chunk(k).tobytes()
                k += 1
            yield doc, before, bytes(have[: 4 * n])
            del have[: 4 * n]
            before += n


def write_ids(docs: DataFrame, path: str, tokenizer: str, spaced: bool, end_id: int, chunk_ids: int = 65536, bits: bool = True) -> None:
    """Encode every text (null: empty), append ``end_id`` and write the ids as
    bit-plane files in ascending doc_id order (null ids first; repeated ids in
    input order, dealt by a row number too, so that a hot id is split).  An
    empty table writes files without documents or none.  Other columns are
    not read."""

    def encode(batches):
        enc = encoder(tokenizer, spaced)
        end = struct.pack("<I", end_id)
        out = FileWriter(TaskContext.get().partitionId(), chunk_ids, bits)
        record = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["record"])
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for k, texts in text_slices(batch, 1 << 23):
                for doc, got in zip(ids[k : k + len(texts)], enc.encode_column(texts)):
                    for x in out.add(doc, got + end):
                        yield record(x)
        for x in out.end():
            yield record(x)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row_no"))
    ordered = rows.repartitionByRange("doc_id", "row_no").sortWithinPartitions("doc_id", "row_no").drop("row_no")
    ordered.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value")).write.text(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of files that write_ids wrote: file_no, doc_id,
    file_start (ids before it in its file), n_tokens, ids_crc32 and, if asked
    for, ids (little-endian unsigned 32-bit integers)."""

    def decode(batches):
        for batch in batches:
            for content in batch.column("content"):
                file = FileReader(content.as_py())
                rows: list[tuple] = []
                held = 0
                for doc, before, ids in file.documents():
                    rows.append((file.number, doc, before, len(ids) // 4, zlib.crc32(ids)) + ((ids,) if with_ids else ()))
                    held += len(ids)
                    if len(rows) >= 4096 or with_ids and held > 1 << 23:
                        yield _batch(rows, with_ids)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, with_ids)

    schema = "file_no int, doc_id long, file_start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.where("length > 0").select("content").mapInArrow(decode, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = ["file_no", "doc_id", "file_start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def with_starts(read: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before, over all files.  Only
    the files' totals (a row for each file) meet in one task."""
    totals = read.groupBy("file_no").agg(F.sum("n_tokens").alias("file_ids"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file_no", F.coalesce(F.sum("file_ids").over(before), F.lit(0)).alias("before_file"))
    return read.join(totals, "file_no").withColumn("start", F.col("before_file") + F.col("file_start")).drop("before_file")
