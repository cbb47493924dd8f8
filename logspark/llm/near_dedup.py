"""Near-duplicate classes by DartMinHash signatures and banded joins.

Documents are weighted sets: their distinct five-word shingles (folded
words), weighted by how often they stand there; similarity is the weighted
Jaccard coefficient, sum of the smaller weights over sum of the larger.
A text of fewer words, but not none, is one shingle.

*Signatures.*  Each shingle owns a plane of weight and rank into which darts
fall with density one, the same for all documents, because hashes of the
shingle place them.  A document collects the darts below its weight and
below a rank at which about ``k log k`` darts are expected over all its
shingles; each dart belongs to one of ``k`` coordinates, and the earliest of
each coordinate is kept.  Two documents agree in a coordinate with
probability equal to their similarity, and the work follows the number of
darts, not shingles times coordinates.  A document with an empty coordinate
throws again to twice the rank.

*Join.*  ``BANDS`` bands of ``ROWS`` coordinates: a pair of similarity 0.8
shares no band with probability (1 - 0.8**5)**32 < 4e-6.

1. Documents with equal shingles and weights are collapsed to the smallest.
2. In each band bucket all are paired with the bucket's centre, the document
   that shares most buckets with others (the original of a group of altered
   copies); candidates are verified by their exact similarity, components
   are formed.
3. A bucket whose documents still fall into several components has its other
   pairs across components compared by a longer signature, in blocks of
   bounded size; those that may reach the threshold are verified as well.
   Hence any two documents that share a band and are similar end in one
   class.  Pairs inside a component are never written; across components all
   that the estimate does not rule out are, which is many where a bucket's
   documents are just below the threshold to each other.

The texts of documents that share a bucket are shuffled once and kept beside
for the exact comparisons.

A class is named by its smallest document, which stays.  Texts without words
are alike to none.  Null texts count as empty; repeated rows are separate
documents; a null doc_id comes first.  Very long texts are read whole; empty
tables give no rows.  Further columns of any name are carried, not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .numbering import numbered
from .scratch import Scratch
from .words import flat_words, mix, sequence_hash, text_slices

GRAM = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
DOCS_AT_ONCE = 512
BLOCK = 512                                               # documents on each side of a block of a bucket
LONG = 1024                                               # coordinates of the longer signature, a byte each
SLACK = 0.0625                                            # 5 standard errors of its estimate
_HALF = np.uint64(1) << np.uint64(48)


def shingles(column: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of at most 65,536 texts, sorted; shingles are
    48-bit hashes."""
    words, first = flat_words(column, folded=True)
    sizes = np.diff(first)
    count = np.where(sizes >= gram, sizes - gram + 1, 0)
    grams = sequence_hash(words, gram)
    doc = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    keys = grams[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes < gram))
    if len(short):
        whole = np.array([sequence_hash(words[first[d]:first[d + 1]], int(sizes[d]))[0] ^ np.uint64(sizes[d])
                          for d in short], np.uint64)
        doc, keys = np.concatenate([doc, short]), np.concatenate([keys, whole])
    packed = np.sort(doc.astype(np.uint64) * _HALF + (keys >> np.uint64(16)))
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    begin = np.flatnonzero(new)
    weight = np.diff(np.append(begin, len(packed)))
    packed = packed[begin]
    return (packed >> np.uint64(48)).astype(np.int64), packed & (_HALF - np.uint64(1)), weight


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int = COORDINATES) -> np.ndarray:
    """docs x k dart identities; rows without elements are 0."""
    out = np.zeros((docs, k), np.uint64)
    total = np.bincount(doc, weight, docs)
    todo = np.flatnonzero(total > 0)
    darts = k * (np.log(k) + 2.0)
    while len(todo):
        mine = np.zeros(docs, bool)
        mine[todo] = True
        own = mine[doc]
        slot, rank, dart = throw(doc[own], element[own], weight[own], darts / np.maximum(total, 1), k)
        best = np.full(docs * k, np.inf)
        np.minimum.at(best, slot, rank)
        earliest = rank == best[slot]
        flat = np.zeros(docs * k, np.uint64)
        flat[slot[earliest]] = dart[earliest]
        filled = np.isfinite(best).reshape(docs, k).all(1)
        done = todo[filled[todo]]
        out[done] = flat.reshape(docs, k)[done]
        todo = todo[~filled[todo]]
        darts *= 2.0
    return out


def throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, reach: np.ndarray, k: int):
    """(document and coordinate, rank, identity) of all darts below the
    elements' weights and each document's rank."""
    slots, ranks, darts = [], [], []
    strip, low, width = 0, 0.0, 1.0                        # weight strips [0, 1), [1, 2), [2, 4), [4, 8) ...
    while True:
        inside = np.flatnonzero(weight > low)
        if not len(inside):
            break
        d, w = doc[inside], weight[inside]
        state = mix(element[inside] * np.uint64(64) + np.uint64(strip))
        rank = np.zeros(len(inside))
        while len(d):                                     # the darts of a strip, in the order of their ranks
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            rank = rank - np.log(_uniform(state)) / width
            live = rank <= reach[d]
            d, w, state, rank = d[live], w[live], state[live], rank[live]
            place = mix(state ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            hit = low + width * _uniform(place) < w
            slots.append(d[hit] * k + (mix(place[hit]) % np.uint64(k)).astype(np.int64))
            ranks.append(rank[hit])
            darts.append(place[hit])
        strip, low, width = strip + 1, low + width, width if strip == 0 else width * 2.0
    return np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)


def bands(signature: np.ndarray) -> np.ndarray:
    """docs x BANDS hashes; a band's number is part of its hash."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out


def sign(rows: DataFrame) -> DataFrame:
    """(row, digest, total, bands) of the texts that have words.  ``digest``
    is equal for equal weighted sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, (doc, element, weight) in weighted_sets(batches, DOCS_AT_ONCE):
            total = np.bincount(doc, weight, few.num_rows).astype(np.int64)
            digest = np.zeros(few.num_rows, np.uint64)
            np.add.at(digest, doc, mix(element) * weight.astype(np.uint64))
            full = np.flatnonzero(total)
            hashes = bands(signatures(doc, element, weight, few.num_rows)[full]).view(np.int64)
            offsets = pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [few.column(0).take(pa.array(full)), pa.array(digest[full].view(np.int64)), pa.array(total[full]),
                 pa.ListArray.from_arrays(offsets, pa.array(hashes.ravel()))], ["row", "digest", "total", "bands"])

    return rows.mapInArrow(run, "row long, digest long, total long, bands array<long>")


def weighted_sets(batches: Iterator[pa.RecordBatch], most: int):
    """Parts of the batches (row, text) of at most ``most`` rows, with their shingles."""
    for batch in batches:
        for part in text_slices(batch, "text", 2 << 20):
            for at in range(0, part.num_rows, most):
                few = part.slice(at, most)
                yield few, shingles(few.column(1))
    pa.default_memory_pool().release_unused()              # the worker stays, its memory need not


def sign_long(rows: DataFrame) -> DataFrame:
    """(row, signature): ``LONG`` coordinates, cut to one byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, (doc, element, weight) in weighted_sets(batches, DOCS_AT_ONCE // 4):
            signed = signatures(doc, element, weight, few.num_rows, LONG).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([few.column(0), pa.array([x.tobytes() for x in signed], pa.binary())],
                                             ["row", "signature"])

    return rows.mapInArrow(run, "row long, signature binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard coefficient of two (shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def verified(candidates: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """The candidates (a, b) of at least the threshold, compared whole.  Texts
    of ``b`` travel to the ``a`` they are compared with; an ``a`` of many
    candidates is dealt to several tasks."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = candidates.join(candidates.groupBy("a").agg(F.count("*").alias("n")), "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / 256)).cast("int").alias("salt"))
    right = sized.join(rows.withColumnRenamed("row", "b"), "b").select("a", "salt", "b", "text")
    left = sized.select("a", "salt").distinct().join(rows.withColumnRenamed("row", "a"), "a").select(
        "a", "salt", F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for batch in batches:
            out_a, out_b = [], []
            for part in text_slices(batch, "text"):
                doc, element, weight = shingles(part.column(3))
                edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
                for i, (a, salt, b) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)):
                    bag = element[edges[i]:edges[i + 1]], weight[edges[i]:edges[i + 1]]
                    if b is None:
                        held, own = (a, salt), bag
                    elif held == (a, salt) and similarity(own, bag) >= threshold:
                        out_a.append(a)
                        out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return (left.unionByName(right).repartition(parts, "a", "salt")
            .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long"))


def across(members: DataFrame, threshold: float) -> DataFrame:
    """Candidates (a, b) between components inside buckets.  ``members``: (band,
    row, component, signature, bands, chunks); a bucket's documents are cut
    into chunks and every two chunks meet in one block.  A pair is looked at
    in the first of the bands that it shares."""
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")
    dealt = (members.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .select("band", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"),
                     "row", "component", "signature", "bands"))
    least = threshold - SLACK

    def pairs(band: int, block: list[tuple]) -> list[tuple[int, int]]:
        rows, comps = (np.array([r[i] for r in block], np.int64) for i in (0, 1))
        signs = np.frombuffer(b"".join(r[2] for r in block), np.uint8).reshape(len(block), -1)
        own = np.array([r[3] for r in block], np.int64)
        out = []
        for i in range(len(block) - 1):
            rest = np.flatnonzero(comps[i + 1:] != comps[i]) + i + 1
            rest = rest[(signs[rest] == signs[i]).mean(1) >= least]
            if len(rest):
                first = own[i][(own[rest] == own[i]).argmax(1)]
                out += [(int(rows[i]), int(rows[j])) for j in rest[first == band]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found):
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held, block = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                for band, x, y, *member in zip(*(c.to_pylist() for c in batch.slice(at, BLOCK).columns), strict=True):
                    if held != (band, x, y):
                        if len(block) > 1:
                            yield batch_of(pairs(held[0], block))
                        held, block = (band, x, y), []
                    block.append(member)
        if len(block) > 1:
            yield batch_of(pairs(held[0], block))

    return (dealt.repartition(parts, "band", "x", "y").sortWithinPartitions("band", "x", "y", "row")
            .select("band", "x", "y", "row", "component", "signature", "bands").mapInArrow(run, "a long, b long").distinct())


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with ``_logspark_row``, (row, class) of all rows that are alike to another)."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    docs, _ = numbered(docs, scratch)
    rows = docs.select(F.col("_logspark_row").alias("row"), "text")
    signed = scratch.write(sign(rows), "signed")
    same = signed.groupBy("digest", "total").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = scratch.write(signed.select("row", "digest", "total").join(same, ["digest", "total"]).select("row", "first"),
                           "copies")
    gone = copies.where("row <> first").select("row")
    banded = signed.select("row", "bands").join(gone, "row", "left_anti").select("row", F.explode("bands").alias("band"))
    buckets = scratch.write(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = scratch.write(banded.join(buckets, "band").select("band", "row", "n"), "shared")
    scratch.drop("buckets")
    scratch.free_shuffles()
    # A merge join at every size: what shares a bucket grows with the documents.
    texts = scratch.write(rows.join(shared.select("row").distinct().hint("merge"), "row"), "texts")
    scratch.free_shuffles()
    degree = shared.groupBy("row").agg(F.sum("n").alias("degree"))
    best = F.max(F.struct("degree", (-F.col("row")).alias("minus")))
    centres = scratch.write(shared.join(degree, "row").groupBy("band").agg(best.alias("best"))
                            .select("band", (-F.col("best.minus")).alias("centre")), "centres")
    placed = shared.join(centres, "band").where("row <> centre")
    star = scratch.write(placed.select(F.col("centre").alias("a"), F.col("row").alias("b")).distinct(), "star")
    links = scratch.write(verified(star, texts, threshold), "links")
    scratch.free_shuffles()
    label = components(links, scratch)
    # Buckets of three or more whose documents are still in several components.
    placed = (placed.where("n > 2").join(label.withColumnRenamed("node", "row"), "row", "left")
              .select("band", "row", "n", F.coalesce("component", "row").alias("component")))
    torn = (placed.groupBy("band")
            .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("n").alias("n"))
            .where("lo <> hi").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")))
    members = scratch.write(placed.join(torn, "band").select("band", "row", "component", "chunks"), "members")
    if members.limit(1).count():
        long = scratch.write(sign_long(texts.join(members.select("row").distinct(), "row")), "long")
        tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = scratch.write(across(members.join(long.join(signed.select("row", "bands"), "row"), "row"), threshold).join(tested, ["a", "b"], "left_anti"), "more")
        if more.limit(1).count():
            links = links.unionByName(scratch.write(verified(more, texts, threshold), "more-links"))
            label = components(links, scratch, "components2")
    label = label.select(F.col("node").alias("first"), "component")
    merged = (copies.join(label, "first", "left").select("row", F.coalesce("component", "first").alias("class"))
              .unionByName(label.join(copies.where("row = first").select("first"), "first", "left_anti")
                           .select(F.col("first").alias("row"), F.col("component").alias("class"))))
    out = scratch.write(merged, "classes")
    scratch.drop("signed", "shared", "texts", "centres", "star", "links", "members", "long", "more", "more-links", "copies")
    scratch.free_shuffles()
    return docs, out


def report(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (doc_id of the class's document that stays),
    class_size and kept for every document."""
    docs, found = classes(docs, threshold)
    size = found.groupBy("class").agg(F.count("*").alias("n"))
    ids = docs.select("_logspark_row", "doc_id")
    full = (ids.join(found.withColumnRenamed("row", "_logspark_row"), "_logspark_row", "left")
            .withColumn("class", F.coalesce("class", "_logspark_row")).join(size, "class", "left"))
    names = ids.select(F.col("_logspark_row").alias("class"), F.col("doc_id").alias("class_id"))
    return full.join(names, "class").select(
        "doc_id", "class_id", F.coalesce("n", F.lit(1)).alias("class_size"), (F.col("_logspark_row") == F.col("class")).alias("kept"))


def deduplicate(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents that stay: all but those alike to a smaller one of their class."""
    columns = docs.columns
    docs, found = classes(docs, threshold)
    gone = found.where("row <> class").select(F.col("row").alias("_logspark_row"))
    return docs.join(gone.hint("merge"), "_logspark_row", "left_anti").select(*columns)
