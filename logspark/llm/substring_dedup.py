"""Substring deduplication: removal of passages that stand earlier in the corpus.

A window is ``window`` consecutive words; a word goes when a window over it
has its word sequence at an earlier place too (smaller document, or earlier
in the same).  Windows are judged on the input.

1. Every window has a key: the smallest hash of its ``GRAM``-word sequences.
   Runs of consecutive windows with one key are a *segment*, so equal windows
   of any two documents lie in segments of one key.  A key that the corpus
   holds once has no repeated window; its segment is not looked at again.
2. Equal segments are collapsed to the earliest, before any of them meet.
3. The distinct segments are dealt to shards by key.  Each shard builds a
   compressed FM-index (:mod:`fm_index`) over its segments in the order of
   their places and streams them through it by backward search: the matching
   statistics give for every window the earliest place of its sequence.
   A key with more than ``HOT_SEGMENTS`` distinct segments is dealt by its
   single windows instead, equal ones again collapsed first.
4. Every occurrence of a segment is compared with the places found; windows
   found earlier are removed from the whole text.

Words are compared as 64-bit hashes.  Null or empty texts have no words.
Rows that repeat a doc_id are told apart and ordered by a hash of their
text; a null doc_id comes first.  Very long texts are read whole, cut into
segments of bounded size; empty tables give no rows.  Further columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .numbering import numbered
from .scratch import Scratch
from .words import flat_words, mix, plain_words, powers, sequence_hash, text_slices

WINDOW = 20
GRAM = 8
SEGMENT_WINDOWS = 64
SHARD_WORDS = 500_000
HOT_SEGMENTS = 20_000
RUNS = "runs array<struct<at:int,n:int,doc:long,place:int>>"
RUN = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("doc", pa.int64()), ("place", pa.int32())]))
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))


_POW = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        _POW[:] = [powers(_BASE, 2 * n), powers(_BASE_INV, 2 * n)]
    return _POW[0][:n], _POW[1][:n]


def smallest_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def segments(words: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(document index, start in it, words, key, content hash, whether the key
    stands in it twice) of the segments of flat words."""
    n = len(words) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    grams = sequence_hash(words, gram)
    keys = smallest_ahead(grams, window - gram + 1)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)[:n]
    valid = np.arange(n) + window <= first[doc + 1]
    change = np.ones(n, bool)
    change[1:] = (keys[1:] != keys[:-1]) | ~valid[:-1] | (doc[1:] != doc[:-1])
    runs = np.flatnonzero(change & valid)
    run = np.cumsum(change & valid) - 1
    inside = np.arange(n) - runs[np.maximum(run, 0)] if len(runs) else np.zeros(n, np.int64)
    begin = valid & (inside % SEGMENT_WINDOWS == 0)
    starts = np.flatnonzero(begin)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    per = np.bincount((np.cumsum(begin) - 1)[valid], minlength=len(starts))
    length = per + window - 1
    power, inverse = _tables(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[:-1], out=total[1:])
    content = mix((total[starts + length] - total[starts]) * inverse[starts] + length.astype(np.uint64))
    count = length - gram + 1                              # of grams
    edges = np.cumsum(count) - count
    flat = np.arange(int(count.sum())) - np.repeat(edges - starts, count)
    twice = np.add.reduceat((grams[flat] == np.repeat(keys[starts], count)).astype(np.int32), edges) > 1
    return doc[starts], starts - first[doc[starts]], length, keys[starts], content, twice


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def all_segments(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = part.column(0).to_numpy()
                doc, start, n, key, content, twice = segments(*flat_words(part.column(1), folded=False), window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                     _signed(key), _signed(content), pa.array(twice)],
                    ["row", "start", "n", "key", "content", "twice"])

    return rows.mapInArrow(run, "row long, start int, n int, key long, content long, twice boolean")


def fetch_words(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words (hashes, 8 bytes each) of segments, read from the texts."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "n", "key", "content", "copies", "hot")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                words, first = flat_words(part.column(1), folded=False)
                lists = part.column(2)
                flat = lists.flatten()
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), sizes)
                start, n = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                at, edges = first[row] + start, np.cumsum(n) - n
                places = np.arange(int(n.sum())) - np.repeat(edges - at, n)
                raw = words[places].tobytes()
                offsets = pa.array(np.append(edges, int(n.sum())) * 8, pa.int64()).cast(pa.int32())
                body = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.column(0).to_numpy()[row]), flat.field(0), flat.field(2), flat.field(3),
                     flat.field(4), flat.field(5), body],
                    ["row", "start", "key", "content", "copies", "hot", "words"])

    return rows.join(lists, "row").select("row", "text", "list").mapInArrow(
        run, "row long, start int, key long, content long, copies long, hot boolean, words binary")


def earliest_runs(shards: DataFrame, window: int) -> DataFrame:
    """Each partition is one shard: (row, start, key, content, copies, runs).
    A run says that from its ``at``-th window on, ``n`` windows stand
    earliest at consecutive places from (doc, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        row, start = (table.column(c).to_numpy() for c in ("row", "start"))
        order = np.lexsort((start, row))
        table = table.take(pa.array(order)).combine_chunks()
        row, start = row[order], start[order].astype(np.int64)
        body = table.column("words").combine_chunks()
        body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset:body.offset + len(body) + 1]
        words = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(np.uint64)
        lengths = np.diff(offsets).astype(np.int64) // 8
        index = FMIndex(words, lengths, window)
        length, found = index.stream(words, lengths)
        ends = np.cumsum(lengths)
        inside = np.arange(len(words)) - np.repeat(ends - lengths, lengths)
        hits = np.flatnonzero(length == window)            # every window, at least at its own place
        owner = np.repeat(np.arange(len(lengths)), lengths)[hits]
        source = np.searchsorted(index.starts, found[hits], "right") - 1
        doc, place, at = row[source], start[source] + found[hits] - index.starts[source], inside[hits]
        new = np.ones(len(hits), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(hits)))
        per = np.bincount(owner[begin], minlength=len(lengths))
        flat = pa.StructArray.from_arrays([pa.array(at[begin].astype(np.int32)), pa.array(count.astype(np.int32)),
                                           pa.array(doc[begin]), pa.array(place[begin].astype(np.int32))],
                                          ["at", "n", "doc", "place"])
        runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), flat)
        out = pa.Table.from_arrays([table.column(c) for c in ("row", "start", "key", "content", "copies")] + [runs],
                                   ["row", "start", "key", "content", "copies", "runs"])
        yield from out.to_batches(max_chunksize=20_000)

    return shards.select("row", "start", "key", "content", "copies", "words").mapInArrow(
        run, f"row long, start int, key long, content long, copies long, {RUNS}")


def single_windows(found: DataFrame, window: int) -> DataFrame:
    """The windows of segments, one row each, with a hash of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, start, key, content, copies, body in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                words = np.frombuffer(body, np.uint64)
                for at, value in enumerate(sequence_hash(words, window).view(np.int64).tolist()):
                    out.append((row, start + at, value, key, content, copies, at, words[at:at + window].tobytes()))
            names = ["row", "start", "value", "key", "content", "copies", "at", "words"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return found.select("row", "start", "key", "content", "copies", "words").mapInArrow(
        run, "row long, start int, value long, key long, content long, copies long, at int, words binary")


def removed_spans(places: DataFrame, window: int) -> DataFrame:
    """(row, spans): the words removed from each occurrence (row, start, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(2)
            sizes = np.diff(runs.offsets.to_numpy()).astype(np.int64)
            flat = runs.flatten()
            at, n, doc, place = (flat.field(k).to_numpy().astype(np.int64) for k in range(4))
            row = np.repeat(batch.column(0).to_numpy(), sizes)
            start = np.repeat(batch.column(1).to_numpy().astype(np.int64), sizes) + at
            gone = (doc < row) | ((doc == row) & (place < start))
            yield pa.RecordBatch.from_arrays([pa.array(row[gone]), pa.array(start[gone].astype(np.int32)),
                                              pa.array((start + n + window - 1)[gone].astype(np.int32))],
                                             ["row", "start", "end"])

    return places.select("row", "start", "runs").mapInArrow(run, "row long, start int, end int")


def find(docs: DataFrame, window: int = WINDOW, hot_segments: int = HOT_SEGMENTS,
         shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(rows, ids, spans): numbered documents and the word spans to remove."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    docs, plain = numbered(docs, scratch)
    rows = docs.select(F.col("_logspark_row").alias("row"), "text")
    ids = None if plain else docs.select(F.col("_logspark_row").alias("row"), "doc_id")
    every = all_segments(rows, window)
    repeated = (every.groupBy("key").agg(F.count("*").alias("seen"), F.max("twice").alias("twice"))
                .where("seen > 1 or twice").select("key"))
    places = scratch.write(every.drop("twice").join(repeated, "key"), "places")
    scratch.free_shuffles()
    distinct = places.groupBy("key", "content").agg(F.min(F.struct("row", "start")).alias("first"),
                                                    F.max("n").alias("n"), F.count("*").alias("copies"))
    distinct = scratch.write(distinct.select("key", "content", "first.row", "first.start", "n", "copies"), "distinct")
    scratch.free_shuffles()
    hot = distinct.groupBy("key").agg(F.count("*").alias("segments")).where(F.col("segments") > hot_segments)
    hot = scratch.write(hot.select("key", F.lit(True).alias("is_hot")), "hot")
    any_hot = bool(hot.limit(1).count())
    marked = (distinct.join(hot, "key", "left").withColumn("hot", F.coalesce("is_hot", F.lit(False))) if any_hot
              else distinct.withColumn("hot", F.lit(False)))
    found = fetch_words(rows, marked)
    total = distinct.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    if any_hot:
        found = scratch.write(found, "words")
    cold = earliest_runs(found.where("not hot").repartition(shards, "key"), window)
    runs = cold
    if any_hot:
        single = scratch.write(single_windows(found.where("hot"), window), "windows")
        first = single.groupBy("value").agg(F.min(F.struct("row", "start", "words")).alias("first"))
        alone = first.select("first.row", "first.start", F.col("value").alias("key"), F.col("value").alias("content"),
                             F.lit(1).cast("long").alias("copies"), "first.words")
        answer = earliest_runs(alone.repartition(shards, "key"), window).select(
            F.col("key").alias("value"), F.col("runs")[0].alias("run"))
        back = (single.drop("words").join(answer, "value").groupBy("key", "content")
                .agg(F.min(F.struct("row", "start", "copies")).alias("first"),
                     F.collect_list(F.struct("at", F.lit(1).alias("n"), F.col("run.doc").alias("doc"),
                                             F.col("run.place").alias("place"))).alias("runs")))
        runs = cold.unionByName(back.select("first.row", "first.start", "key", "content", "first.copies", "runs"))
    runs = scratch.write(runs, "runs")
    scratch.drop("words", "windows", "hot", "distinct")
    scratch.free_shuffles()
    lone = runs.where("copies = 1").select("row", "start", "runs")
    copied = places.select("row", "start", "key", "content").join(
        runs.where("copies > 1").select("key", "content", "runs"), ["key", "content"]).select("row", "start", "runs")
    spans = removed_spans(lone.unionByName(copied), window)
    spans = scratch.write(spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")),
                          "spans")
    scratch.drop("places", "runs")
    scratch.free_shuffles()
    return rows, ids, spans


def kept_words(text: str | None, spans) -> tuple[int, list[bytes]]:
    """The number of words and those that stay."""
    words = plain_words(text)
    if not spans:
        return len(words), words
    kept, at = [], 0
    for span in spans:
        if span["start"] > at:
            kept += words[at:span["start"]]
        at = max(at, span["end"])
    return len(words), kept + words[at:]


def _ided(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    return rows.withColumnRenamed("row", "doc_id") if ids is None else rows.join(ids, "row").drop("row")


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    rows, ids, spans = find(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, digests = [], [], []
            for text, own in zip(batch.column(1), batch.column(2), strict=True):
                n, kept = kept_words(text.as_py(), own.as_py())
                sizes.append(n)
                gone.append(n - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(digests, pa.string())],
                                             ["row", "n_words", "n_removed", "kept_sha256"])

    out = rows.join(spans, "row", "left").select("row", "text", "spans").mapInArrow(
        run, "row long, n_words long, n_removed long, kept_sha256 string")
    return _ided(out, ids).select("doc_id", "n_words", "n_removed", "kept_sha256")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text (the kept words joined by one space) and the removed spans."""
    rows, ids, spans = find(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b" ".join(kept_words(t.as_py(), s.as_py())[1]).decode("utf-8", "surrogatepass")
                     for t, s in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()),
                                              batch.column(2).cast(SPAN)], ["row", "text", "spans"])

    out = rows.join(spans, "row", "left").select("row", "text", "spans").mapInArrow(
        run, "row long, text string, spans array<struct<start:int,end:int>>")
    return _ided(out, ids).select("doc_id", "text", "spans")
