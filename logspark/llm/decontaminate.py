"""Benchmark decontamination: a prefix-filtered join of item windows.

Every ``window`` consecutive words of a benchmark item are one window; an
item with fewer words, but not none, is one window of its own size.  The
documents' windows of the same size that hold one are found by
:mod:`phrase_join`, rarity being counted over all documents.

The distinct windows are sent to all tasks in blocks of ``block_rows`` at
most, one pass over the documents for each block: a benchmark of any size is
joined whole and what a task holds stays bounded.

Null or empty texts have no words; an item without words matches nothing.
Repeated documents are judged each for itself, repeated items (equal text)
all count.  Empty tables give no rows or no hits.  Only ``doc_id``, ``text``
and ``item_id`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .phrase_join import PhraseIndex, word_counts
from .scratch import Scratch
from .words import folded_words

WINDOW = 10
BLOCK_ROWS = 200_000
HITS = "_row long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, window): the distinct windows of each item, words joined by a space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = folded_words(text)
                own = {b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))} if words else ()
                names += [item] * len(own)
                texts += own
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())],
                                             ["item", "window"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return named.mapInArrow(cut, "item string, window binary").distinct()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without overlaps, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def hits_of_block(rows: DataFrame, windows: list[tuple[str, bytes]], counts: dict[bytes, int],
                  share: float, every_row: bool) -> DataFrame:
    """``HITS`` of the documents (all, or those that have hits) for one block of windows."""
    by_window: dict[bytes, list[str]] = {}
    for item, text in windows:
        by_window.setdefault(text, []).append(item)
    texts = sorted(by_window)
    index = PhraseIndex.build([t.split(b" ") for t in texts], counts, share)
    sent = rows.sparkSession.sparkContext.broadcast((index, [by_window[t] for t in texts]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, items_of = sent.value
        for batch in batches:
            out = ([], [], [], [])
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = folded_words(text.as_py())
                found = index.matches(words)
                if not (found or every_row):
                    continue
                spans = merged([(start, start + len(index.phrases[nr])) for nr, start, _ in found])
                names = sorted({name for nr, _, _ in found for name in items_of[nr]})
                for column, value in zip(out, (row, len(words), [{"start": a, "end": b} for a, b in spans], names),
                                         strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(out[3], pa.list_(pa.string()))], ["_row", "n_words", "spans", "items"])

    return rows.select("_row", "text").mapInArrow(scan, HITS)


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = 1.0,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For every document: doc_id, n_words, spans (of hit words, merged) and
    items (sorted ids of those with occurring windows)."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    windows = scratch.write(item_windows(items, window), "windows")
    blocks = max(1, -(-windows.count() // block_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("_row"), "text")
    if blocks > 1:                                        # a key that tells repeated documents apart
        rows = scratch.write(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "docs")
    parts = []
    for nr in range(blocks):
        block = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == nr).collect()
        pairs = [(r["item"], bytes(r["window"])) for r in block]
        counts = word_counts(docs, {w for _, t in pairs for w in t.split(b" ")}) if pairs else {}
        part = hits_of_block(rows, pairs, counts, share, every_row=blocks == 1 or nr == 0)
        parts.append(part if blocks == 1 else scratch.write(part, f"hits{nr}"))
    if blocks == 1:
        return parts[0].withColumnRenamed("_row", "doc_id")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    joined = every.groupBy("_row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return (rows.select("_row", "doc_id").join(joined.withColumn("spans", merged_spans(F.col("spans"))), "_row")
            .select("doc_id", "n_words", "spans", "items"))


def merged_spans(spans) -> F.Column:
    """:func:`merged` as an expression."""
    last = lambda acc: F.element_at(acc, -1)
    widen = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
        last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))
    empty = F.slice(spans, 1, 0)
    return F.aggregate(F.array_sort(spans), empty, lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), widen(acc, s)).otherwise(
        F.concat(acc, F.array(s))))


def digest_of_items(items) -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of :func:`find`'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        digest_of_items(F.col("items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of any item.  The rows themselves
    are judged in place: nothing is joined or shuffled."""
    scratch = Scratch(docs.sparkSession, "decontaminate-keep")
    windows = scratch.write(item_windows(items, window), "windows")
    blocks = max(1, -(-windows.count() // BLOCK_ROWS))
    schema, kept = docs.schema, docs
    place = docs.columns.index("text")
    for nr in range(blocks):
        texts = sorted({bytes(r["window"]) for r in
                        windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == nr).collect()})
        counts = word_counts(kept, {w for t in texts for w in t.split(b" ")}) if texts else {}
        sent = docs.sparkSession.sparkContext.broadcast(PhraseIndex.build([t.split(b" ") for t in texts], counts))

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                mask = [not index.matches(folded_words(t.as_py())) for t in batch.column(place)]
                yield batch.filter(pa.array(mask, pa.bool_()))

        kept = kept.mapInArrow(keep, schema)
        if blocks > 1:
            kept = scratch.write(kept, f"kept{nr}")
    return kept
