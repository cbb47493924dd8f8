"""Licence scan: an exact set-similarity join of text blocks with templates.

Two joins run in one pass over the documents, both on words ordered by how
often the whole corpus holds them:

* base phrases (``BASE``) are found wherever their words stand
  consecutively, by the prefix-filtered phrase join;
* a block (``SPAN`` times the template's words in a row, wherever lines
  break) meets a template (``TEMPLATES``) when it holds at least
  ``threshold`` of the template's distinct words.  A text with such a block
  must hold one of the template's ``n - need + 1`` rarest words (prefix
  filter), must have ``need`` distinct words (length filter), and from the
  place of the rarest shared word in the template's order at most the rest
  of that order can still be shared (positional filter).  A window is then
  moved over the words around each of those rarest words.

A template's blocks are told from left to right and do not overlap, each by
the line of its first word: the fullest of the windows that begin in it.
Labels are those of the base phrases and of the templates met.  The score
is the largest containment of a template that is met, 1 with a base phrase,
else 0.  Null texts count as empty: no words, no labels, score 0.  Repeated
rows give repeated results, an empty table none; very long texts are read
whole.  Further columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .phrase_join import PhraseIndex, word_counts
from .words import folded_words

# fixed values: the base phrases and their labels
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# fixed values: opening sentences of public licence notices
TEMPLATES = (
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation", "gpl"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation", "lgpl"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files", "mit"),
    ("Released under the MIT License", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("All rights reserved", "all-rights-reserved"),
)
THRESHOLD = 0.8
SPAN = 2                                                  # words of a window, in those of the template
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
          "labels array<string>, score double, blocks array<struct<line:int,label:string,containment:double>>")


class TemplateIndex:
    """Templates as word sets in rarity order, under their prefix words."""

    def __init__(self, templates, counts: dict[bytes, int], threshold: float):
        self.templates, self.spans, self.prefixes = [], [], []
        self.entries: dict[bytes, list[tuple[int, int]]] = {}
        for nr, (text, label) in enumerate(templates):
            sequence = folded_words(text)
            words = sorted(set(sequence), key=lambda w: (counts.get(w, 0), w))
            need = max(1, -int(-threshold * len(words) // 1))
            self.templates.append((frozenset(words), need, len(words), label))
            self.spans.append(SPAN * len(sequence))
            self.prefixes.append(frozenset(words[:len(words) - need + 1]))
            for place, word in enumerate(words[:len(words) - need + 1]):
                self.entries.setdefault(word, []).append((nr, place))

    def shared(self, block: set[bytes]) -> Iterator[tuple[int, int]]:
        """(number, distinct words held) of each template that a word set meets."""
        first: dict[int, int] = {}
        for word in block & self.entries.keys():
            for nr, place in self.entries[word]:
                first[nr] = min(place, first.get(nr, place))
        for nr in sorted(first):
            words, need, size, _ = self.templates[nr]
            if len(block) >= need and size - first[nr] >= need:
                held = len(words & block)
                if held >= need:
                    yield nr, held

    def met(self, block: set[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of each template that the block meets."""
        return [(self.templates[nr][3], held / self.templates[nr][2]) for nr, held in self.shared(block)]

    def blocks(self, words: list[bytes]) -> list[tuple[int, str, float]]:
        """(first word, label, containment) of each block of a text that meets a template."""
        out = []
        for nr, _ in self.shared(set(words)):
            wanted, span, near, until = self.templates[nr][0], self.spans[nr], [], 0
            for place, word in enumerate(words):
                if word in self.prefixes[nr]:
                    near += [i for i in range(max(until, place - span + 1), min(len(words), place + span)) if words[i] in wanted]
                    until = place + span
            out += [(start, self.templates[nr][3], held / len(wanted)) for start, held in self.windows(nr, words, near)]
        return sorted(out)

    def windows(self, nr: int, words: list[bytes], hits: list[int]) -> Iterator[tuple[int, int]]:
        """(first word, distinct words held) of a template's blocks, from the places of its words."""
        _, need, size, _ = self.templates[nr]
        held: Counter[bytes] = Counter()
        at = left = most = after = start = limit = 0
        while True:
            ended = at == len(hits)
            if not ended:
                held[words[hits[at]]] += 1
                while hits[left] <= hits[at] - self.spans[nr] or held[words[hits[left]]] > 1:
                    word = words[hits[left]]
                    held[word] -= 1
                    if not held[word]:
                        del held[word]
                    left += 1
            if most and (ended or hits[left] > limit or most == size):
                yield start, most
                held.clear()
                at = left = after
                most = 0
                continue
            if ended:
                return
            if len(held) >= need and len(held) > most:
                most, start, after, limit = len(held), hits[left], at + 1, hits[at]
            at += 1


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document, with the blocks that met a template."""
    phrases = [folded_words(p) for p, _ in base]
    vocabulary = {w for p in phrases for w in p} | {w for t, _ in templates for w in folded_words(t)}
    counts = word_counts(docs, vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(
        (PhraseIndex.build(phrases, counts), TemplateIndex(templates, counts, threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, wanted = sent.value
        prefix = wanted.entries.keys()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                words = folded_words(text)
                starts = [(start, nr) for nr, start, _ in index.matches(words)]
                own = {base[nr][1] for _, nr in starts}
                blocks = []
                if not prefix.isdisjoint(words):
                    met = wanted.blocks(words)
                    ends = list(accumulate(len(folded_words(line)) for line in text.split("\n"))) if met else []
                    blocks = [{"line": bisect_right(ends, start), "label": label, "containment": share}
                              for start, label, share in met]
                score = 1.0 if starts else max((b["containment"] for b in blocks), default=0.0)
                rows.append((doc_id, len(words), len(starts), min(starts)[0] if starts else None,
                             max(starts)[0] if starts else None, sorted(own),
                             sorted(own | {b["label"] for b in blocks}), score, blocks))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), TYPES, strict=True)] if rows
                else [pa.array([], kind) for kind in TYPES], NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()),
         pa.float64(), pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()),
                                           ("containment", pa.float64())]))]
