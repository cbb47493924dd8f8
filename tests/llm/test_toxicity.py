import random
import zlib

import pytest

from logspark.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, last = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


TERMS = [("loser", True, 1.0), ("idiot", False, 2.0), ("scum", False, 3.0), ("pathetic", True, 2.5), ("abcdefgh", False, 0.5)]


def test_automaton_equals_edit_distance():
    rng, automaton = random.Random(2), T.LexiconAutomaton(TERMS)
    for _ in range(4000):
        word = list(rng.choice(TERMS)[0])
        for _ in range(rng.randint(0, 4)):
            at, what = rng.randrange(len(word) + 1), rng.random()
            if what < 0.33:
                word.insert(at, rng.choice("abclosertpx"))
            elif word and what < 0.66:
                word.pop(min(at, len(word) - 1))
            elif word:
                word[min(at, len(word) - 1)] = rng.choice("abclosertpx")
        word = "".join(word) + rng.choice(("", "s", "ness"))
        near = [(distance(t, word[:n]), -w) for t, stem, w in TERMS for n in (range(len(word) + 1) if stem else [len(word)])
                if distance(t, word[:n]) <= T.errors_allowed(t)]
        assert automaton.match(word) == min(near, default=None)


def test_quotation_counts_less_unless_it_addresses():
    scorer = T.Scorer(T.Model([("idiot", False, 4.0)]))
    plain, quoted, told = (scorer.features(t)[0] for t in
                           ("such an idiot there", 'a man called "such an idiot" there', 'he shouted "you are an idiot" there'))
    assert plain == told == 4.0 and quoted == pytest.approx(4.0 * T.QUOTED)
    assert T.quoted_words("a\n> b c\nd", 4) == [False, True, True, False]


@pytest.fixture(scope="module")
def corpus(spark, make_docs):
    rng = random.Random(8)
    clean = [f"word{i}" for i in range(400)]
    bad = ["loser", "moron", "pathetic", "worthless", "disgusting"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(2000, "plain text with a mroon patehtic losser worthles"), (2001, None), (2002, ""), (None, "word1 word2")]
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, c) for a, _, c in labels)


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    out = {r["doc_id"]: r for r in T.scored(docs, labels).collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(out[d]["held_out"] == (d in set(held)) for d in truth)
    assert sum(out[d]["predicted"] == truth[d] for d in held) >= 0.99 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out.values())
    assert out[2001]["score"] == out[2002]["score"] < 0.5
    assert out[2000]["score"] > out[2002]["score"]           # misspelled terms tell


def test_held_out_labels_are_not_learned(spark, corpus):
    docs, labels, truth = corpus
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = ({r["doc_id"]: r["score"] for r in T.scored(docs, lab).collect()} for lab in (labels, turned))
    assert a == b


def test_rejected_documents_go(corpus):
    docs, labels, _ = corpus
    kept = T.accepted(docs, labels)
    bad = {r["doc_id"] for r in T.scored(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad


def test_nothing_to_learn_from(odd_docs, no_docs, corpus):
    _, labels, _ = corpus
    assert {r["score"] for r in T.scored(odd_docs, labels.limit(0)).collect()} == {0.0}
    assert T.scored(no_docs, labels).count() == 0
    assert T.scored(odd_docs, labels).count() == 12


def test_equal_texts_with_both_labels_are_toxic(spark, make_docs):
    docs = make_docs([(i, "the same words" if i % 2 else f"other {i}") for i in range(40)])
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 1)) for i in range(40)], "doc_id long, quality int, toxic int")
    sample = {r["text"]: r["toxic"] for r in T.learning_sample(docs, labels).collect()}
    assert sample["the same words"] == 1 and {v for k, v in sample.items() if k != "the same words"} == {0}
