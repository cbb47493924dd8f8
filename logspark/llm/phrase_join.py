"""Prefix-filtered join of word phrases with documents.

A phrase of n words matches an n-word window of a document when at least
``need`` of its words stand there at their places (``need = n``: the window
is the phrase).  All words are ordered by how often the corpus has them; a
window that matches must hold one of the phrase's ``n - need + 1`` rarest
words at its place, so only these are looked up (the prefix filter).  A
window must lie inside the document (the length filter), and the place of
the word fixes where it starts (the positional filter); what is left is
compared word for word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import folded_words


@dataclass
class PhraseIndex:
    """Phrases under their rarest words.  ``entries``: word to (phrase, place
    of the word); ``needs``: for each phrase the words that must agree."""
    phrases: list[list[bytes]] = field(default_factory=list)
    needs: list[int] = field(default_factory=list)
    entries: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)

    @classmethod
    def build(cls, phrases: Iterable[list[bytes]], counts: dict[bytes, int], share: float = 1.0) -> PhraseIndex:
        index = cls()
        for nr, phrase in enumerate(phrases):
            need = max(1, -int(-share * len(phrase) // 1))
            by_rarity = sorted(range(len(phrase)), key=lambda i: (counts.get(phrase[i], 0), phrase[i], i))
            index.phrases.append(phrase)
            index.needs.append(need)
            for place in by_rarity[:len(phrase) - need + 1]:
                index.entries.setdefault(phrase[place], []).append((nr, place))
        return index

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(phrase, start, words that agree) for all matching windows, each once."""
        entries, phrases, needs, n = self.entries, self.phrases, self.needs, len(words)
        found = {}
        for at, word in enumerate(words):
            if word in entries:
                for nr, place in entries[word]:
                    start, phrase = at - place, phrases[nr]
                    if start < 0 or start + len(phrase) > n:
                        continue
                    if needs[nr] == len(phrase):
                        if words[start:start + len(phrase)] == phrase:
                            found[nr, start] = len(phrase)
                    elif (nr, start) not in found:
                        agree = sum(a == b for a, b in zip(words[start:start + len(phrase)], phrase, strict=True))
                        if agree >= needs[nr]:
                            found[nr, start] = agree
        return [(nr, start, agree) for (nr, start), agree in found.items()]


def word_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often all documents hold each word of a bounded vocabulary."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        wanted = known.value
        for batch in batches:
            for text in batch.column(0):
                total.update(w for w in folded_words(text.as_py()) if w in wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
                                         ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}
