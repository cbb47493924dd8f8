"""Toxicity scores from a learned lexicon, matched with spelling errors.

*Lexicon.*  Terms are words and word beginnings (stems) that stand in toxic
but hardly in clean documents of a labelled sample; a greedy cover picks the
few that explain the toxic documents several times over.

*Matching.*  The terms form a trie; a Levenshtein automaton runs over it,
its states being sets of (trie node, errors so far).  The product is a
deterministic automaton, built as words need it, that accepts a word when
some term lies within the errors its length allows.

*Context.*  A match counts by what stands around it, ``SPAN`` words to each
side: within quotation marks or on a quoting line, or next to a word of
report, it counts for ``QUOTED``; next to a word of address it counts in
full even there; else in full.

*Score.*  A logistic model on the counts (exact, misspelled, quoted,
density) fitted to the sample.  Labels come only from rows that are not held
out; labels, lang, source and doc_id are not inputs of the score.

The sample is bounded: at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` different
texts, those with the smallest hashes.  Without toxic or clean rows to learn
from every score is 0.  Null and empty texts count as texts without matches.
Repeated rows get equal scores; a null doc_id is held out by the crc32 of "".
Of equal labelled texts with both labels the toxic one stands.  Very long
texts are read whole; an empty table gives no rows.  Further columns of any
name are carried by ``accepted`` and not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 8_000
STEM_LENGTHS = range(4, 11)
LEAST_RATIO = 8.0                                         # share of words in toxic texts over that in clean ones
COVER = 4                                                 # terms that each toxic text should hold
SPAN = 6
QUOTED = 0.3
THRESHOLD = 0.7
CACHE = 300_000
# fixed values: words of report (a quotation follows) and of address, in the languages of the corpus
REPORT = frozenset("said says wrote quoted called quote dit disait écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your youre u tu toi vous te du dich ihr euch tú usted ustedes vosotros".split())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARKS = re.compile(r"[\"«»„“”]|(?m:^[ \t]*>)|\n")


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """Levenshtein automata of all terms over their trie, determinised step by
    step.  ``terms``: text, whether it is a stem (may go on), and weight.
    Outcomes are (errors, -weight): the smallest is the nearest, then the
    heaviest term."""

    def __init__(self, terms: Iterable[tuple[str, bool, float]]):
        self.children: list[dict[str, int]] = [{}]
        self.budget = [0]                                 # most errors of any term below a node
        self.ends: list[list[tuple[int, bool, float]]] = [[]]   # (errors allowed, is a stem, -weight)
        for text, is_stem, weight in sorted(terms):
            node, allowed = 0, errors_allowed(text)
            self.budget[0] = max(self.budget[0], allowed)
            for letter in text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                    self.ends.append([])
                node = self.children[node][letter]
                self.budget[node] = max(self.budget[node], allowed)
            self.ends[node].append((allowed, is_stem, -weight))
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, float] | None] = []  # outcome if the word ends here
        self.holds: list[tuple[int, float] | None] = []    # outcome by a stem that is whole here
        self.start = self._number(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> frozenset:
        """Adds letters left out of the word (a trie step for one error)."""
        todo = list(nodes.items())
        while todo:
            node, errors = todo.pop()
            if nodes[node] < errors:
                continue
            for child in self.children[node].values():
                if errors + 1 <= self.budget[child] and errors + 1 < nodes.get(child, 99):
                    nodes[child] = errors + 1
                    todo.append((child, errors + 1))
        return frozenset(nodes.items())

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.sets)
            self.sets.append(state)
            self.steps.append({})
            whole = [(errors, weight, is_stem) for node, errors in state
                     for allowed, is_stem, weight in self.ends[node] if errors <= allowed]
            self.accepts.append(min(((e, w) for e, w, _ in whole), default=None))
            self.holds.append(min(((e, w) for e, w, is_stem in whole if is_stem), default=None))
        return self.numbers[state]

    def _step(self, number: int, letter: str) -> int:
        nodes: dict[int, int] = {}
        for node, errors in self.sets[number]:
            own = self.children[node].get(letter)
            if own is not None:
                nodes[own] = min(errors, nodes.get(own, 99))
            if errors < self.budget[node]:
                for child in self.children[node].values():   # another letter
                    if errors + 1 <= self.budget[child]:
                        nodes[child] = min(errors + 1, nodes.get(child, 99))
                nodes[node] = min(errors + 1, nodes.get(node, 99))   # a letter too many
        found = self.steps[number][letter] = self._number(self._closed(nodes)) if nodes else -1
        return found

    def match(self, word: str) -> tuple[int, float] | None:
        """(errors, -weight) of the nearest term that the word matches."""
        if len(self.sets) > 50_000:                       # built anew rather than without bound
            self.numbers, self.sets, self.steps, self.accepts, self.holds = {}, [], [], [], []
            self.start = self._number(self._closed({0: 0}))
        state, best = self.start, None
        for letter in word:
            step = self.steps[state].get(letter)
            state = self._step(state, letter) if step is None else step
            if state < 0:
                return best
            held = self.holds[state]
            if held is not None and (best is None or held < best):
                best = held
        ended = self.accepts[state]
        return ended if ended is not None and (best is None or ended < best) else best


@dataclass
class Model:
    """The learned lexicon and the weights of the score."""
    terms: list[tuple[str, bool, float]]
    weights: list[float] = field(default_factory=list)


class Scorer:
    """Features and scores of texts, with the outcomes of words remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.automaton = LexiconAutomaton(model.terms)
        self.known: dict[str, tuple[int, float] | None] = {}

    def features(self, text: str) -> list[float]:
        lowered = text.lower()
        words = WORD.findall(lowered)
        known, match = self.known, self.automaton.match
        hits = []
        for at, word in enumerate(words):
            if word in known:
                found = known[word]
            else:
                if len(known) >= CACHE:
                    known.clear()
                found = known[word] = match(word)
            if found is not None:
                hits.append((at, found))
        exact = fuzzy = quoted = heaviest = 0.0
        if hits:
            inside = quoted_words(lowered, len(words))
            for at, (errors, weight) in hits:
                near = words[max(0, at - SPAN):at + SPAN + 1]
                share = 1.0
                if (inside[at] or not REPORT.isdisjoint(near)) and ADDRESS.isdisjoint(near):
                    share = QUOTED
                    quoted += 1
                if errors:
                    fuzzy -= share * weight
                else:
                    exact -= share * weight
                    heaviest = max(heaviest, -share * weight)
        size = len(words) + 50.0
        return [heaviest, np.log1p(exact), exact * 100.0 / size, np.log1p(exact * 100.0 / size), np.log1p(fuzzy),
                np.log1p(fuzzy * 100.0 / size), np.log1p(quoted), np.log(size) if hits else 0.0]

    def score(self, text: str) -> float:
        if not self.model.weights:
            return 0.0
        x = self.model.weights[0] + float(np.dot(self.model.weights[1:], self.features(text)))
        return float(1.0 / (1.0 + np.exp(-x)))


def quoted_words(text: str, count: int) -> list[bool]:
    """For each word whether it stands between quotation marks of one line or
    on a line that begins with ``>``."""
    out, spans = [False] * count, []
    opened, line = None, False
    for mark in MARKS.finditer(text):
        sign = mark.group()
        if sign == "\n":
            if line:
                spans.append((opened, mark.start()))
            opened, line = None, False
        elif sign.endswith(">"):
            opened, line = mark.end(), True
        elif not line:
            if opened is None:
                opened = mark.end()
            else:
                spans.append((opened, mark.start()))
                opened = None
    if line:
        spans.append((opened, len(text)))
    nr = 0
    if spans:
        for at, word in enumerate(WORD.finditer(text)):
            while nr < len(spans) and spans[nr][1] < word.end():
                nr += 1
            if nr == len(spans):
                break
            out[at] = spans[nr][0] <= word.start()
    return out


def terms_of(text: str) -> Counter:
    """How often a text has each word and each stem."""
    out: Counter[tuple[str, bool]] = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        out[word, False] += n
        for length in STEM_LENGTHS:
            if length <= len(word):
                out[word[:length], True] += n
    return out


def learning_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of the bounded sample; held-out rows are not in it.  Of
    equal texts with both labels the toxic one stands."""
    rows = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mixed = F.xxhash64(F.lit("sample"), "doc_id")
    parts = []
    for toxic, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        parts.append(rows.where(F.col("toxic") == toxic).withColumn("_mixed", mixed).orderBy("_mixed").limit(most))
    chosen = parts[0].unionByName(parts[1]).select("doc_id", "toxic")
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic")).select("toxic", "text"))


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    sample = scratch.write(learning_sample(docs, labels).repartition(32, F.xxhash64("text")), "sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model([])
    least = max(3, toxic // 200)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: Counter[tuple[str, bool]] = Counter()
        places: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = terms_of(text.as_py())
                places[label].update(own)
                if label:
                    texts.update(own.keys())
        terms = list(places[0].keys() | places[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.bool_()),
             *(pa.array([c[t] for t in terms], pa.int64()) for c in (texts, places[1], places[0]))],
            ["term", "stem", "texts", "toxic", "clean"])

    counted = sample.select("toxic", "text").mapInArrow(count, "term string, stem boolean, texts long, toxic long, clean long")
    counted = scratch.write(counted.groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in ("texts", "toxic", "clean")]),
                            "terms")
    words = counted.where("not stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    ratio = ((F.col("toxic") + 0.5) / (words["toxic"] or 1)) / ((F.col("clean") + 0.5) / (words["clean"] or 1))
    useful = (counted.withColumn("weight", F.log(ratio)).where((F.col("texts") >= least) & (ratio >= LEAST_RATIO))
              .orderBy(F.desc(F.col("texts") * F.col("weight")), F.desc(F.length("term")), "term", "stem"))
    # bounded by the sample: each candidate stands in ``least`` of its toxic texts
    candidates = [(r["term"], r["stem"], r["weight"]) for r in useful.collect()]
    terms = cover(sample, candidates, least)
    model = Model(terms)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            rows = [scorer.features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
                                             ["toxic", "x"])

    measured = sample.select("toxic", "text").mapInArrow(measure, "toxic int, x array<double>").collect()
    x = np.array([r["x"] for r in measured], float)
    y = np.array([r["toxic"] for r in measured], float)
    model.weights = logistic(x, y, np.where(y > 0, 0.5 / toxic, 0.5 / clean) * len(y))
    return model


def cover(sample: DataFrame, candidates: list[tuple[str, bool, float]], least: int) -> list[tuple[str, bool, float]]:
    """Terms picked one by one, each the one that most toxic texts still need,
    times its weight; of equal ones the longest."""
    sent = sample.sparkSession.sparkContext.broadcast({t[:2]: i for i, t in enumerate(candidates)})

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            rows = [sorted(index[t] for t in terms_of(text.as_py()) if t in index) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["terms"])

    texts = [r["terms"] for r in sample.where("toxic = 1").select("text").mapInArrow(held, "terms array<int>").collect()]
    holders: dict[int, list[int]] = {}
    for nr, terms in enumerate(texts):
        for term in terms:
            holders.setdefault(term, []).append(nr)
    need = np.full(len(texts), COVER)
    picked: list[tuple[str, bool, float]] = []
    arrays = {t: np.array(h) for t, h in holders.items()}
    while arrays:
        gains = {t: int((need[h] > 0).sum()) for t, h in arrays.items()}
        best = max(gains, key=lambda t: (gains[t] * candidates[t][2], len(candidates[t][0]), candidates[t]))
        if gains[best] < least:
            break
        need[arrays.pop(best)] -= 1
        text, is_stem, weight = candidates[best]
        picked.append((text, is_stem, weight))
        for t in [t for t in arrays if candidates[t][0].startswith(text) and is_stem or text.startswith(candidates[t][0])]:
            del arrays[t]                                  # the same term, longer or shorter
    return picked


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> list[float]:
    """Weights (the constant first) of a ridge logistic regression, by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    penalty = np.full(len(beta), ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - penalty * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-6:
            break
    return [float(b) for b in beta]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels, Scratch(docs.sparkSession, "toxicity"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            scores = [scorer.score(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold, judged in place."""
    model = fit(docs, labels, Scratch(docs.sparkSession, "toxicity"))
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py() or "") < THRESHOLD for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
