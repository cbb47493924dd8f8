"""Token ids in binary files, with Elias-Fano coded document boundaries.

A file holds consecutive documents in ascending doc_id order:

    head      8 letters, then ten big-endian 64-bit numbers: partition, block,
              documents, documents without doc_id, ids, bytes of an id, least
              doc_id, and the bytes of the three parts that follow
    borders   Elias-Fano: where each document starts, and the end
    doc_ids   Elias-Fano: doc_id less the least one (without the nulls, which
              come first)
    ids       2 bytes each below 65,536 ids, else 4, little-endian
    newline   written by Spark

There is no 64-bit offset table: ``select`` on the borders tells where a
document starts and ends, at about 2 + log2(ids / documents) bits each.

Documents are range-partitioned and sorted by doc_id (null first; rows of one
doc_id by a hash of their text, then as they stand in the input), a task
encodes its documents in that order and closes a file at ``BLOCK_IDS`` ids,
so that neither a task nor a reader holds more than one file.  Files are
written by Spark's text writer, one row of bytes each, so they go to any file
system that Spark writes to and only finished tasks' files are seen.

``start`` numbers count over all files: the ids of each file are summed in
two levels, by file within ``GROUP`` partitions and over such groups.

Null and empty texts have the end id only.  Repeated rows are written as
often as they stand; further columns are not read; an empty table has no
file and gives no row.  A very long text is a file by itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .elias_fano import EliasFano, encode
from .segments import ID, ByteLevel, loaded
from .words import text_slices

MAGIC = b"IDS+EF01"
_HEAD = struct.Struct(">8s6Qq3Q")
END_ID = 2
BLOCK_IDS = 4 << 20                                       # a task holds a file's ids some five times over while it writes
PART_BYTES = 64 << 20                                      # of text in a partition
LEAST_BYTES = 1 << 20
GROUP = 1024
ROWS = "part long, block long, doc_id long, first long, n_tokens long, ids_crc32 long"


class TokenFile:
    """One file's bytes."""

    def __init__(self, data: bytes | memoryview):
        (magic, self.part, self.block, self.n_docs, self.n_null, self.n_ids, width, self.least,
         *sizes) = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.borders = EliasFano(data, _HEAD.size)
        self.doc_ids = EliasFano(data, _HEAD.size + sizes[0])
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, _HEAD.size + sizes[0] + sizes[1])

    @staticmethod
    def write(part: int, block: int, doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
        """The bytes of documents in ascending order, those without id first."""
        known = [d for d in doc_ids if d is not None]
        least = known[0] if known else 0
        ends = np.cumsum([0, *(len(i) for i in ids)])
        borders = encode(ends, int(ends[-1]) + 1)
        steps = encode(np.array([d - least for d in known], np.uint64), known[-1] - least + 1 if known else 1)
        flat = np.concatenate(ids).astype(f"<u{width}") if ids else np.zeros(0, f"<u{width}")
        head = _HEAD.pack(MAGIC, part, block, len(doc_ids), len(doc_ids) - len(known), len(flat), width, least,
                          len(borders), len(steps), flat.nbytes)
        return b"".join((head, borders, steps, flat.tobytes()))

    def span(self, nr: int) -> tuple[int, int]:
        """Where the nr-th document of the file starts and ends."""
        return self.borders.select(nr), self.borders.select(nr + 1)

    def document(self, nr: int) -> np.ndarray:
        start, end = self.span(nr)
        return self.ids[start:end]

    def doc_id(self, nr: int) -> int | None:
        return None if nr < self.n_null else self.least + self.doc_ids.select(nr - self.n_null)

    def find(self, doc_id: int) -> list[int]:
        """The numbers of the documents with this doc_id."""
        if doc_id < self.least:
            return []
        a, b = (self.doc_ids.first_not_below(doc_id - self.least + k) for k in (0, 1))
        return list(range(self.n_null + a, self.n_null + b))


def partitions(docs: DataFrame) -> int:
    """By the bytes of all texts: ``PART_BYTES`` each, or fewer where that
    leaves cores idle."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // PART_BYTES), min(4 * cores, -(-size // LEAST_BYTES)))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts by the byte-level BPE file ``tokenizer`` (special
    strings inside texts as the library handles them), ``end_id`` behind each,
    and write the files into the folder ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(ByteLevel, tokenizer, False)
        width = 2 if max(len(model.tokens), end_id + 1) <= 1 << 16 else 4
        part, block, size = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([TokenFile.write(part, block, names, held, width)], pa.binary())], ["file"])

        for batch in batches:
            for cut in text_slices(batch, "text"):
                encoded = model.ids([t or "" for t in cut.column(1).to_pylist()])
                for name, raw in zip(cut.column(0).to_pylist(), encoded, strict=True):
                    ids = np.append(np.frombuffer(raw, ID), ID.type(end_id)).astype(f"<u{width}")
                    if held and size + len(ids) > block_ids:
                        yield file()
                        block, size, names, held = block + 1, 0, [], []
                    names.append(name)
                    held.append(ids)
                    size += len(ids)
        if held:
            yield file()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("nr")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"),
                       F.monotonically_increasing_id().alias("nr"))
    dealt = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    (dealt.mapInArrow(run, "file binary").select(F.col("file").cast("string"))
     .write.mode("overwrite").option("maxRecordsPerFile", 1).text(path))


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def _number(place: int) -> Column:
    """The place-th number of a file's head."""
    return F.conv(F.hex(F.expr(f"substring(content, {9 + 8 * place}, 8)")), 16, 10).cast("long")


def bases(held: DataFrame) -> DataFrame:
    """(part, block, base): the ids of all files before each."""
    heads = held.select(_number(0).alias("part"), _number(1).alias("block"), _number(4).alias("n_ids"))
    heads = heads.withColumn("group", F.floor(F.col("part") / GROUP))
    inside = Window.partitionBy("group").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    groups = heads.groupBy("group").agg(F.sum("n_ids").alias("total"))
    over = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)   # a row for GROUP partitions
    groups = groups.select("group", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("earlier"))
    return (heads.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(groups, "group")
            .select("part", "block", (F.col("inside") + F.col("earlier")).alias("base")))


def documents(held: DataFrame) -> DataFrame:
    """ROWS: every document of the files, by its place in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(memoryview(content.as_buffer()))
                n, cuts = file.n_docs, file.borders.all().astype(np.int64)
                names = [None] * file.n_null + (file.doc_ids.all().astype(np.int64) + file.least).tolist()
                wide = memoryview(file.ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(wide[4 * a:4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, file.part, np.int64)), pa.array(np.full(n, file.block, np.int64)),
                     pa.array(names, pa.int64()), pa.array(cuts[:-1]), pa.array(np.diff(cuts)), pa.array(sums, pa.int64())],
                    ["part", "block", "doc_id", "first", "n_tokens", "ids_crc32"])

    return held.select("content").mapInArrow(run, ROWS)


def report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the folder's files."""
    held = files(spark, path)
    return (documents(held).join(bases(held), ["part", "block"])
            .select("doc_id", (F.col("first") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every document in the folder's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(memoryview(content.as_buffer()))
                names = [None] * file.n_null + (file.doc_ids.all().astype(np.int64) + file.least).tolist()
                ids = pa.ListArray.from_arrays(pa.array(file.borders.all().astype(np.int32)), pa.array(file.ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), ids], ["doc_id", "ids"])

    return files(spark, path).select("content").mapInArrow(run, "doc_id long, ids array<int>")
