"""Periodic runs: stretches of words that repeat with a period.

A *run* is a stretch of consecutive words with smallest period q, of at least
``max(min_words, times * q)`` words, that no neighbouring word extends.

Descending-LCP Kruskal, per document: the suffixes are sorted and the common
prefix lengths (LCP) of neighbours are edges.  Going down the LCPs, union-find
joins suffix classes, each with its ordered set of positions.  When a join at
LCP l makes positions i < j adjacent and d = j - i <= l, the words from i on
have period d for d + l words.  d is the smallest: a smaller one would have
put a position between them earlier.  Each run is seeded so exactly once by
its first position, where the word before does not continue the period.

A run of ``n >= max(min_words, times * q)`` words has l = n - q, hence
``l >= min_words * (times - 1) / times``: edges with shorter prefixes cannot
seed one and are left out, as are documents in which no word sequence of that
length recurs.  This loses nothing.

Null and empty texts have no words.  Rows are independent: repeated rows,
null doc_ids and further columns need no care, an empty table gives an empty
result.  A document of n words takes about 4 n log2(longest repeat) bytes in
its task, and documents are taken in slices of about 1 MB of text.  Of runs
with equal exponents the first start, then the shorter period, is reported.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import plain_words, text_slices

MIN_WORDS = 24
TIMES = 3
Run = tuple[int, int, int]                                  # start, words, period
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, " \
         "runs_sha256 string, collapsed_sha256 string"


class Suffixes:
    """Ranks of all suffixes of some sequences by their first 1, 2, 4, ...
    elements; no element of one sequence equals one of another."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        """``codes``: dense numbers from 0; ``ends``: for each place the end of its sequence."""
        self.ends, self.ranks = ends, [codes.astype(np.int64)]
        n, step = len(codes), 1
        while self.ranks[-1].max(initial=-1) + 1 < n:
            rank = self.ranks[-1]
            ahead = np.arange(n) + step
            inside = ahead < ends
            second = np.zeros(n, np.int64)
            second[inside] = rank[ahead[inside]] + 1
            _, both = np.unique(rank * (n + 1) + second, return_inverse=True)
            self.ranks.append(both)
            step *= 2

    def order(self) -> np.ndarray:
        return np.argsort(self.ranks[-1])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many first elements the suffixes at ``a`` and ``b`` share."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            inside = (a < self.ends_of(a, total)) & (b < self.ends_of(b, total))
            same = np.zeros(len(a), bool)
            same[inside] = rank[a[inside]] == rank[b[inside]]
            a[same] += 1 << level
            b[same] += 1 << level
            total[same] += 1 << level
        return total

    def ends_of(self, at: np.ndarray, moved: np.ndarray) -> np.ndarray:
        return self.ends[at - moved]


class Classes:
    """Union-find over suffixes, with the ordered positions of each class."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.positions: dict[int, list[int]] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: int, b: int) -> list[tuple[int, int]]:
        """Unite the classes of two suffixes; the pairs of positions, one of
        each class, that are adjacent in the united set."""
        a, b = self.find(a), self.find(b)
        large, small = self.positions.get(a) or [a], self.positions.get(b) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        new, last = [], -1
        for nr, x in enumerate(small):
            at = bisect_left(large, x)
            follows = small[nr + 1] if nr + 1 < len(small) else None
            if at and large[at - 1] > last:
                new.append((large[at - 1], x))
            if at < len(large) and (follows is None or large[at] < follows):
                new.append((x, large[at]))
            last = x
        if 8 * len(small) > len(large):
            large = sorted(large + small)                   # two ascending rows: merged in one pass
        else:
            for x in small:
                insort(large, x)
        self.parent[b] = a
        self.positions[a] = large
        self.positions.pop(b, None)
        return new


def seeded(codes: list[int], edges: Iterator[tuple[int, int, int]], min_words: int, times: int) -> list[Run]:
    """The runs of one sequence from its edges (LCP, suffix, suffix), by falling LCP."""
    classes, runs = Classes(), []
    for length, a, b in edges:
        for i, j in classes.join(a, b):
            period = j - i
            whole = length + period
            if whole >= min_words and whole >= times * period and (not i or codes[i - 1] != codes[j - 1]):
                runs.append((i, whole, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of(texts: list[list], min_words: int = MIN_WORDS, times: int = TIMES) -> list[list[Run]]:
    """The runs of each word list."""
    shortest = -(-min_words * (times - 1) // times)
    codes = []
    for words in texts:
        number = {w: nr for nr, w in enumerate(dict.fromkeys(words))}
        codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    out: list[list[Run]] = [[] for _ in texts]
    live = [nr for nr, own in enumerate(codes) if len(own) >= min_words]
    live = [nr for nr, again in zip(live, recurring([codes[nr] for nr in live], shortest), strict=True) if again]
    if not live:
        return out
    sizes = [len(codes[nr]) for nr in live]
    starts = np.cumsum([0, *sizes])
    distinct = np.cumsum([0, *(int(codes[nr].max()) + 1 for nr in live)])
    flat = np.concatenate([codes[nr] + base for nr, base in zip(live, distinct.tolist(), strict=False)])
    suffixes = Suffixes(flat, np.repeat(starts[1:], sizes))
    order = suffixes.order()
    a, b = order[:-1], order[1:]
    near = suffixes.ends[a] == suffixes.ends[b]
    a, b = a[near], b[near]
    lcp = suffixes.common(a, b)
    kept = np.flatnonzero(lcp >= shortest)
    owner = np.searchsorted(starts, a[kept], "right") - 1
    kept = kept[np.lexsort((-lcp[kept], owner))]
    owner = np.searchsorted(starts, a[kept], "right") - 1
    cuts = np.searchsorted(owner, np.arange(len(live) + 1))
    for k, nr in enumerate(live):
        mine = kept[cuts[k]:cuts[k + 1]]
        if len(mine):
            edges = zip(lcp[mine].tolist(), (a[mine] - starts[k]).tolist(), (b[mine] - starts[k]).tolist(), strict=True)
            out[nr] = seeded(codes[nr].tolist(), edges, min_words, times)
    return out


_R = np.uint64(0x9E3779B97F4A7C15)


def recurring(codes: list[np.ndarray], length: int) -> list[bool]:
    """Whether a sequence may hold one word sequence of ``length`` twice (by
    hashes: a chance equality costs time only)."""
    if not codes:
        return []
    flat = np.concatenate(codes).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(c) for c in codes])
    doc = np.repeat(np.arange(len(codes)), sizes)
    n = len(flat) - length + 1
    value = np.zeros(n, np.uint64)
    for k in range(length):
        value = value * _R + (flat[k:k + n] ^ (flat[k:k + n] << np.uint64(31)))
    inside = doc[:n] == doc[length - 1:]
    value, doc = value[inside], doc[:n][inside]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    again = np.zeros(len(codes), bool)
    again[doc[1:][(value[1:] == value[:-1]) & (doc[1:] == doc[:-1])]] = True
    return again.tolist()


def best(runs: list[Run]) -> Run | None:
    """The run of the greatest length / period."""
    top = None
    for run in runs:                                        # by start, then period
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that a run holds behind its first period."""
    kept, at = [], 0
    for start, end in sorted((s + p, s + n) for s, n, p in runs):
        if end > at:
            kept += words[at:max(at, start)]
            at = end
    return kept + words[at:]


def looped(words: list, doc_id: int | None) -> list:
    """The words of a document as the query takes them: of every tenth crc32
    of a doc_id the rest from some word on is made periodic, so that runs of
    many periods are among its input.  A null doc_id has no number: unchanged."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def report(docs: DataFrame, change: Callable[[list, int | None], list] | None = None,
           min_words: int = MIN_WORDS, times: int = TIMES) -> DataFrame:
    """SCHEMA for every document; ``change`` may alter its words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = part.column(0).to_pylist()
                texts = [plain_words(t) for t in part.column(1).to_pylist()]
                if change is not None:
                    texts = [change(words, doc_id) for words, doc_id in zip(texts, ids, strict=True)]
                rows = []
                for doc_id, words, runs in zip(ids, texts, runs_of(texts, min_words, times), strict=True):
                    top = best(runs)
                    start, length, period = top or (None, None, None)
                    listing = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                    rows.append((doc_id, len(runs), start, length, period, top and 1000 * length // period,
                                 hashlib.sha256(listing.encode()).hexdigest(),
                                 hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
                types = [pa.int64()] * 6 + [pa.string()] * 2
                names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def collapse(docs: DataFrame, min_words: int = MIN_WORDS, times: int = TIMES) -> DataFrame:
    """doc_id, text (the kept words joined by one space) and the runs found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = [plain_words(t) for t in part.column(1).to_pylist()]
                found = runs_of(texts, min_words, times)
                kept = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(texts, found, strict=True)]
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(rows, kind)],
                                                 ["doc_id", "text", "runs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, text string, runs array<struct<start:long,length:long,period:long>>")
