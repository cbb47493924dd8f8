"""Exact token counts of byte-pair encodings, for texts and all their prefixes.

A byte-level BPE splits a text into pieces by a pattern and merges inside
each piece.  Inside a piece a dynamic programme over its prefixes gives the
encoding of each: the last token of a prefix is the one token that ends
there and can stand behind the last token of the prefix before it, that is,
whose neighbour no earlier merge would have joined to it.  So

    count[end] = count[end - len(last token)] + 1

holds for every prefix, and the count of a whole text is the sum over its
pieces.  Truncation and budget questions (:meth:`Prefixes.tokens_at`,
:meth:`Prefixes.longest`) are looked up: the running counts at the ends of the
pieces, and the programme's own counts of all prefixes of the piece at the
border.  Only where a cut changes what stands there (a text that ends in white
space, in a contraction's or an added token's first characters) these few are
counted by themselves; nothing is encoded again for each trial.  A piece of a
million characters costs one pass.

The vocabulary file (``tokenizers`` JSON of a byte-level BPE) is read on the
driver and sent to the tasks.  Added tokens inside a text are one token
each, as that library counts them by default.  Null counts as empty: no
bytes, no tokens.  Rows are independent: repeated rows, further columns and
an empty table need no care.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# fixed value: the split pattern of byte-level BPE files
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
                       r"| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
WHITE = regex.compile(r"\p{White_Space}+")
LIMIT = 1024
CACHE = 1_000_000                                          # pieces, and pairs, that a Python worker remembers
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_bytes long"


def _byte_characters() -> dict[str, int]:
    """The characters by which such files write bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens by their bytes; ids are in the order of the merges."""

    def __init__(self, text: str):
        file = json.loads(text)
        model, split = file["model"], file["pre_tokenizer"]
        if model["type"] != "BPE" or file["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"]:
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        byte = _byte_characters()
        raw = lambda token: bytes(byte[c] for c in token)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ids = {bytes([b]): b for b in range(256)}
        self.left, self.right, self.pairs = [0] * 256, [0] * 256, {}
        for a, b in merges:
            pair = self.ids[raw(a)], self.ids[raw(b)]
            self.ids[raw(a + b)] = self.pairs[pair] = len(self.left)
            self.left.append(pair[0])
            self.right.append(pair[1])
        for token in [t for t, nr in self.ids.items() if nr >= 256 and not self.is_own_encoding(nr)]:
            del self.ids[token]                            # never the encoding of anything
        self.ends = {t[i:] for t in self.ids for i in range(len(t))}
        self.known: dict[int, bool] = {}
        added = [t["content"] for t in file["added_tokens"]]
        self.added = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.cache: dict[str, int] = {}

    def stands(self, a: int, b: int, joined_at: int = -1) -> bool:
        """Whether tokens ``a``, ``b`` side by side stay as they are (or are
        first joined by the merge ``joined_at``).  Takes back the later of
        their merges, again and again, and looks whether the parts at the
        border would have been joined before it."""
        before = len(self.left)
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < before and joined != joined_at:
                return False
            if a > b:
                if a < 256:
                    return True
                before, a = a, self.right[a]
            else:
                if b < 256:
                    return True
                before, b = b + 1, self.left[b]            # of equal merges the left one comes first

    def is_own_encoding(self, token: int) -> bool:
        """Whether the bytes of a token, whose parts are their own encodings,
        are encoded as that token."""
        return self.stands(self.left[token], self.right[token], token)

    def prefix_counts(self, piece: bytes) -> list[int]:
        """The number of tokens of every prefix of a piece, from the empty one."""
        ids, ends, known = self.ids, self.ends, self.known
        counts, last = [0] * (len(piece) + 1), [0] * (len(piece) + 1)
        for end in range(1, len(piece) + 1):
            at = end - 1
            while (tail := piece[at:end]) in ends:
                if tail in ids:
                    token = ids[tail]
                    if not at:
                        counts[end], last[end] = 1, token
                        break
                    pair = last[at] << 20 | token
                    stands = known.get(pair)
                    if stands is None:
                        if len(known) >= CACHE:
                            known.clear()
                        stands = known[pair] = self.stands(last[at], token)
                    if stands:
                        counts[end], last[end] = counts[at] + 1, token
                        break
                at -= 1
        return counts

    def piece_tokens(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass")
        n = 1 if raw in self.ids else self.prefix_counts(raw)[-1]
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(piece) <= 64:
            self.cache[piece] = n
        return n

    def tokens(self, text: str) -> int:
        total, cache = 0, self.cache
        for part, is_added in self.parts(text):
            if is_added:
                total += 1
                continue
            for piece in PIECES.findall(part):
                n = cache.get(piece)
                total += self.piece_tokens(piece) if n is None else n
        return total

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between added tokens, and these."""
        at = 0
        if self.added is not None and self.added.search(text):
            for found in self.added.finditer(text):
                if found.start() > at:
                    yield text[at:found.start()], False
                yield found.group(), True
                at = found.end()
        if at < len(text):
            yield text[at:], False


class Prefixes:
    """The token counts of all prefixes (in characters) of one text."""

    def __init__(self, vocabulary: Vocabulary, text: str, added: bool = True):
        self.vocabulary, self.text = vocabulary, text
        self.pieces, self.is_added, sums = [], [], []
        for part, is_added in vocabulary.parts(text) if added else [(text, False)]:
            for piece in [part] if is_added else PIECES.findall(part):
                self.pieces.append(piece)
                self.is_added.append(is_added)
                sums.append(1 if is_added else vocabulary.cache.get(piece) or vocabulary.piece_tokens(piece))
        self.starts = [0, *accumulate(map(len, self.pieces))][:len(self.pieces)]
        self.sums = [0, *accumulate(sums)]
        self.stored: dict[int, list[int]] = {}

    def _programme(self, piece: str) -> list[int]:
        """The counts of a piece's prefixes, by characters."""
        counts = self.vocabulary.prefix_counts(piece.encode("utf-8", "surrogatepass"))
        if len(counts) == len(piece) + 1:
            return counts
        return [counts[at] for at in accumulate((len(c.encode("utf-8", "surrogatepass")) for c in piece), initial=0)]

    def inside(self, nr: int) -> list[int]:
        """The counts of the texts that end 1, 2, ... characters into a piece
        (the entry at 0 is not one)."""
        if nr not in self.stored:
            self.stored = {nr: self._inside(nr)}           # one piece may be the whole text
        return self.stored[nr]

    def _inside(self, nr: int) -> list[int]:
        piece = self.pieces[nr]
        if self.is_added[nr]:                              # cut short, it is plain text and may lengthen the piece before
            first = nr - 1 if nr and not self.is_added[nr - 1] else nr
            skip = self.starts[nr] - self.starts[first]
            plain = Prefixes(self.vocabulary, self.text[self.starts[first]:self.starts[nr] + len(piece) - 1], added=False)
            return [0, *(self.sums[first] + plain.tokens_at(skip + k) for k in range(1, len(piece))), self.sums[nr + 1]]
        if piece in CONTRACTIONS:
            return [self.sums[nr] + self.vocabulary.tokens(piece[:k]) for k in range(len(piece))] + [self.sums[nr + 1]]
        counts = [self.sums[nr] + n for n in self._programme(piece)]
        blank = WHITE.match(piece)
        if blank:                                          # a text that ends here ends in one piece of white space
            first, size = nr, blank.end()
            while first and not self.is_added[first - 1] and WHITE.fullmatch(self.pieces[first - 1]):
                first -= 1
            skip = self.starts[nr] - self.starts[first]
            run = self._programme(self.text[self.starts[first]:self.starts[nr] + size])
            counts[1:size + 1] = [self.sums[first] + n for n in run[skip + 1:]]
        return counts

    def tokens_at(self, end: int) -> int:
        """Tokens of ``text[:end]``."""
        if end <= 0 or not self.pieces:
            return 0
        nr = bisect.bisect_left(self.starts, min(end, len(self.text))) - 1     # the last piece that begins before
        return self.inside(nr)[min(end, len(self.text)) - self.starts[nr]]

    def longest(self, limit: int) -> int:
        """Characters of the longest prefix of at most ``limit`` tokens."""
        if self.sums[-1] <= limit:
            return len(self.text)
        # a cut joins the pieces of one stretch of white space, two at most:
        # behind the second piece after the limit every prefix has more
        last = min(bisect.bisect_left(self.sums, limit) + 1, len(self.pieces) - 1)
        for nr in range(last, -1, -1):
            counts = self.inside(nr)
            for k in range(len(counts) - 1, 0, -1):
                if counts[k] <= limit:
                    return self.starts[nr] + k
        return 0


_LOADED: dict[int, Vocabulary] = {}


def loaded(text: str) -> Vocabulary:
    """The vocabulary, made once in a Python worker."""
    key = hash(text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(text)
    return _LOADED[key]


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and limit_bytes (bytes of the
    longest prefix of at most ``limit`` tokens) for every document."""
    with open(path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(sent.value)
        for batch in batches:
            sizes, totals, cuts = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                size, total = len(text.encode("utf-8", "surrogatepass")), vocabulary.tokens(text)
                sizes.append(size)
                totals.append(total)
                cuts.append(len(text[:Prefixes(vocabulary, text).longest(limit)].encode("utf-8", "surrogatepass"))
                            if total > limit else size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()),
                 pa.array([n > limit for n in totals], pa.bool_()), pa.array(cuts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
