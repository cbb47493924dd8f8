"""Alignment of two tokenizers' tokens by the bytes that they cover.

A is a byte-level BPE (``tokenizers``) of blank + text, B a sentence-piece
model of the text, whose library puts that blank itself.  Both token rows
cut the same bytes, so two tokens overlap exactly when one of them starts
inside the other.

1. Slices of a batch are encoded and laid out as two frames (document, start,
   token).  ``pandas.merge_asof``, keyed by document, finds for each A start
   the B token that covers it and for each B start the A token; the union of
   both directions is every overlapping pair (a *link*) once.  Bytes at which
   tokens of both sides end close a *group*.
2. Consecutive documents of a task, about ``CHUNK_BYTES`` of text, are one
   row: their figures, the chunk's distinct id pairs, and for each document
   the pairs that its links hold.  The chunks are written once.
3. A chunk names each of its pairs once, so the corpus counts are sums over
   few rows, also for the most frequent pair.  They are joined back by pair,
   one row per chunk and pair, and gathered by chunk.  The only broadcast
   side is the highest count of each B id: as many rows as B has ids.

Documents without tokens (null, empty, or bytes that one side cannot give
back) have zeros and an empty digest.  Rows are independent: repeated rows
and doc_ids count each, null doc_ids stay null, further columns are not read,
an empty table gives an empty result.  A very long text is a chunk by itself.
Ties for the highest count all count as best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .segments import ID, ByteLevel, SentencePiece, loaded
from .words import text_slices

SLICE_BYTES = 1 << 20
CHUNK_BYTES = 8 << 20
DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
CHUNK = f"chunk long, docs array<struct<{DOC.replace(' ', ':').replace(',:', ',')}>>, sizes array<int>, " \
        "width int, gaps binary, times binary, pairs array<long>, counts array<long>"
SCHEMA = f"{DOC}, n_best long, count_sum long"
SHIFT = 32


class Slice:
    """Tokens, links and groups of some texts."""

    def __init__(self, texts: list[str], a: ByteLevel, b: SentencePiece):
        live = [i for i, t in enumerate(texts) if t]
        raw = [(" " + texts[i]).encode("utf-8", "surrogatepass") for i in live]
        rows = [np.array([], np.int64)] * 2
        ids = [[], []]
        for side, encoded in enumerate((a.ids([texts[i] for i in live], blank=True), b.ids([texts[i] for i in live]))):
            ids[side] = [np.frombuffer(x, ID) for x in encoded]
        same = [i for i in range(len(live)) if self._bytes(ids[0][i], a) == raw[i] == self._bytes(ids[1][i], b)]
        self.docs = np.array([live[i] for i in same], np.int64)
        base = np.cumsum([0, *(len(raw[i]) for i in same)]).astype(np.int64)
        self.ids, self.doc, self.start, self.end = [], [], [], []
        for side, tokenizer in enumerate((a, b)):
            mine = [ids[side][i] for i in same]
            flat = np.concatenate(mine).astype(np.int64) if mine else rows[0]
            ends = np.cumsum(tokenizer.recurring.sizes[flat])
            self.ids.append(flat)
            self.doc.append(np.repeat(np.arange(len(mine)), [len(m) for m in mine]))
            self.end.append(ends)
            self.start.append(ends - tokenizer.recurring.sizes[flat])
        self.base, self.n = base, len(same)

    @staticmethod
    def _bytes(ids: np.ndarray, tokenizer) -> bytes:
        return b"".join(map(tokenizer.tokens.__getitem__, ids.tolist()))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(A token, B token) of every overlapping pair, as places in the slice."""
        a, b = (pd.DataFrame({"doc": self.doc[s], "at": self.start[s], name: np.arange(len(self.ids[s])), f"from_{name}": self.start[s]})
                for s, name in enumerate("ab"))
        onto_b = pd.merge_asof(a, b, on="at", by="doc")      # the B token that covers an A start
        onto_a = pd.merge_asof(b, a, on="at", by="doc")
        onto_a = onto_a[onto_a["from_a"] < onto_a["from_b"]]  # equal starts are in the other direction
        both = pd.concat([onto_b[["a", "b"]], onto_a[["a", "b"]]], ignore_index=True)
        return both["a"].to_numpy(np.int64), both["b"].to_numpy(np.int64)

    def groups(self, a_words: pa.Array, b_words: pa.Array) -> tuple[np.ndarray, list[str]]:
        """The number of groups and the digest of their listing, per document.
        ``*_words``: for each id its decimal digits with ',' behind, and with
        the mark that ends its side of a group behind."""
        ends = np.intersect1d(self.end[0], self.end[1], assume_unique=True)
        group = [np.searchsorted(ends, e) for e in self.end]
        size = [np.bincount(g, minlength=len(ends)) for g in group]
        before = [np.cumsum(s) - s for s in size]
        n = [len(i) for i in self.ids]
        place = [np.arange(n[0]) + before[1][group[0]], np.arange(n[1]) + before[0][group[1]] + size[0][group[1]]]
        word = np.zeros(n[0] + n[1], np.int64)
        offset = len(a_words)
        for s in (0, 1):
            is_last = np.ones(n[s], bool)
            is_last[:-1] = group[s][1:] != group[s][:-1]
            word[place[s]] = self.ids[s] * 2 + is_last + s * offset
        text = pa.concat_arrays([a_words, b_words]).take(pa.array(word))
        cuts = np.frombuffer(text.buffers()[1], np.int64)[:len(word) + 1] if len(word) else np.zeros(1, np.int64)
        body = memoryview(text.buffers()[2]) if len(word) else memoryview(b"")
        tokens = np.cumsum([0, *(np.bincount(self.doc[0], minlength=self.n) + np.bincount(self.doc[1], minlength=self.n))])
        digests = [hashlib.sha256(body[cuts[tokens[i]]:cuts[tokens[i + 1]] - 1]).hexdigest() for i in range(self.n)]
        return np.diff(np.searchsorted(ends, self.base, "right")), digests


def listed(n: int, mark: str) -> pa.Array:
    """For each id below ``n``: 'id,' and 'id' + mark."""
    return pa.array([f"{i}{m}" for i in range(n) for m in (",", mark)], pa.large_string())


def chunks(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per run of consecutive documents of a task (see CHUNK)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = loaded(ByteLevel, a_path, True), loaded(SentencePiece, b_path)
        words = listed(len(a.tokens), "|"), listed(len(b.tokens), ";")
        key = TaskContext.get().partitionId() << 33          # unique, and written with the rows
        held, size = [], 0
        for batch in batches:
            for part in text_slices(batch, "text", min(SLICE_BYTES, chunk_bytes)):
                held.append(figures(part, a, b, words))
                size += part.column(1).nbytes
                if size >= chunk_bytes:
                    yield chunk(key, held)
                    key, held, size = key + 1, [], 0
        if held:
            yield chunk(key, held)

    return docs.select("doc_id", "text").mapInArrow(run, CHUNK)


def figures(part: pa.RecordBatch, a: ByteLevel, b: SentencePiece, words) -> dict:
    """Per document of a slice: its figures, its distinct pairs and how many
    links hold each."""
    texts = [t or "" for t in part.column(1).to_pylist()]
    cut = Slice(texts, a, b)
    left, right = cut.links()
    pair = cut.ids[0][left] << SHIFT | cut.ids[1][right]
    doc = cut.doc[0][left]
    order = np.lexsort((pair, doc))
    doc, pair = doc[order], pair[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n_groups, digests = cut.groups(*words)
    out = {"doc_id": part.column(0), "pair": pair[first], "times": np.diff(np.append(first, len(pair)))}
    for name, values in (("n_a", np.bincount(cut.doc[0], minlength=cut.n)), ("n_b", np.bincount(cut.doc[1], minlength=cut.n)),
                         ("n_groups", n_groups), ("n_links", np.bincount(doc, minlength=cut.n)),
                         ("sizes", np.bincount(doc[first], minlength=cut.n))):
        out[name] = np.zeros(len(texts), np.int64)
        out[name][cut.docs] = values
    out["sha"] = [""] * len(texts)
    for at, digest in zip(cut.docs.tolist(), digests, strict=True):
        out["sha"][at] = digest
    return out


def chunk(key: int, held: list[dict]) -> pa.RecordBatch:
    """Slices as one row.  A document's pairs are places in the chunk's sorted
    pairs, ascending, each written as the step from the one before."""
    flat = {name: np.concatenate([h[name] for h in held]) for name in
            ("n_a", "n_b", "n_groups", "n_links", "sizes", "pair", "times")}
    pairs, place = np.unique(flat["pair"], return_inverse=True)
    counts = np.bincount(place, weights=flat["times"], minlength=len(pairs)).astype(np.int64)
    starts = np.cumsum(flat["sizes"]) - flat["sizes"]
    gaps = np.diff(place, prepend=0)
    heads = starts[flat["sizes"] > 0]
    gaps[heads] = place[heads]
    width = 2 if max(len(pairs), int(flat["times"].max(initial=0))) < 1 << 16 else 4
    docs = pa.StructArray.from_arrays(
        [pa.concat_arrays([h["doc_id"].cast(pa.int64()) for h in held]),
         *(pa.array(flat[name]) for name in ("n_a", "n_b", "n_groups", "n_links")),
         pa.array([s for h in held for s in h["sha"]], pa.string())],
        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    row = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays(
        [pa.array([key], pa.int64()), row(docs), row(pa.array(flat["sizes"].astype(np.int32))), pa.array([width], pa.int32()),
         pa.array([gaps.astype(f"<u{width}").tobytes()], pa.binary()),
         pa.array([flat["times"].astype(f"<u{width}").tobytes()], pa.binary()), row(pa.array(pairs)), row(pa.array(counts))],
        ["chunk", "docs", "sizes", "width", "gaps", "times", "pairs", "counts"])


def _scores(row: dict, answers: list) -> tuple[np.ndarray, np.ndarray]:
    """(n_best, count_sum) of each document of a chunk."""
    sizes = np.array(row["sizes"], np.int64)
    step = np.frombuffer(row["gaps"], f"<u{row['width']}").astype(np.int64)
    times = np.frombuffer(row["times"], f"<u{row['width']}").astype(np.int64)
    total = np.cumsum(step)
    starts = np.cumsum(sizes) - sizes
    live = sizes > 0
    before = np.zeros(len(sizes), np.int64)
    before[live] = total[starts[live]] - step[starts[live]]
    place = total - np.repeat(before, sizes)
    corpus, best = np.zeros(len(answers[0]), np.int64), np.zeros(len(answers[0]), np.int64)
    corpus[answers[0]], best[answers[0]] = answers[1], answers[2]
    out = []
    for values in (best[place] * times, corpus[place] * times):
        sums = np.append(0, np.cumsum(values))
        out.append(sums[starts + sizes] - sums[starts])
    return out[0], out[1]


def finished(joined: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in ("sizes", "width", "gaps", "times")}
                found = batch.column("found")[k].values
                answers = ([found.field(c).to_numpy(zero_copy_only=False) for c in range(3)] if found is not None
                           else [np.zeros(0, np.int64)] * 3)
                n_best, count_sum = _scores(row, answers)
                docs = batch.column("docs")[k].values
                yield pa.RecordBatch.from_arrays([*docs.flatten(), pa.array(n_best), pa.array(count_sum)],
                                                 [*(f.name for f in docs.type), "n_best", "count_sum"])

    return joined.select("docs", "sizes", "width", "gaps", "times", "found").mapInArrow(run, SCHEMA)


def pair_counts(cut: DataFrame) -> DataFrame:
    """(pair, n, best): the links of each id pair in the corpus, and whether
    that is the highest count of its B id (1 or 0)."""
    each = cut.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    return counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).cast("int").alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum
    for every document."""
    scratch = Scratch(docs.sparkSession, "token-alignment")
    cut = scratch.write(chunks(docs, a_path, b_path, chunk_bytes), "chunks")
    counts = scratch.write(pair_counts(cut), "counts")
    scratch.free_shuffles()
    named = cut.select("chunk", F.posexplode("pairs").alias("nr", "pair"))
    found = named.join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("nr", "n", "best")).alias("found"))
    return finished(cut.join(found, "chunk", "left"))


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a, b, a_id, b_id, start, end: every overlapping pair of tokens,
    by their places in the document, with the bytes (of blank + text) that
    both cover."""
    schema = "doc_id long, a long, b long, a_id long, b_id long, start long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = loaded(ByteLevel, a_path, True), loaded(SentencePiece, b_path)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                cut = Slice([t or "" for t in part.column(1).to_pylist()], one, other)
                left, right = cut.links()
                doc = cut.doc[0][left]
                first = [np.searchsorted(cut.doc[s], np.arange(cut.n)) for s in (0, 1)]
                start = np.maximum(cut.start[0][left], cut.start[1][right]) - cut.base[doc]
                end = np.minimum(cut.end[0][left], cut.end[1][right]) - cut.base[doc]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cut.docs[doc])),
                     *(pa.array(v) for v in (left - first[0][doc], right - first[1][doc], cut.ids[0][left], cut.ids[1][right],
                                             start, end))],
                    ["doc_id", "a", "b", "a_id", "b_id", "start", "end"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
