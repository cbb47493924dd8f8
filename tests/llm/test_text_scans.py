import hashlib
import random
import re
import textwrap

import duckdb
import pytest

from logspark.llm import decontaminate as D
from logspark.llm import exact_dedup as X
from logspark.llm import license_scan as L
from logspark.llm import oracles
from logspark.llm.phrase_join import PhraseIndex


def sql(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    cur = con.execute(query)
    names = [d[0] for d in cur.description]
    return sorted((tuple(v for _, v in sorted(zip(names, row, strict=True))) for row in cur.fetchall()), key=repr)


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


ITEMS = [(1, " ".join(f"q{i}" for i in range(14))), (2, "Short item here"), (3, None), (4, ""), (5, "short ITEM, here"),
         (6, "the the the the the the the the the the the the")]
LEAKY = [(1, "x y " + " ".join(f"q{i}" for i in range(3, 14)) + " z"), (2, "a short   item-here b short item here"),
         (3, "q0 q1 q2 q3 q4 q5 q6 q7 q8"), (4, "the " * 40), (5, None), (6, ""), (7, "Q0 q1 Q2 q3 q4 q5 q6 q7 q8 q9 q10"),
         (8, "nothing of the kind")]


@pytest.mark.parametrize("block_rows", [D.BLOCK_ROWS, 2])
def test_leaks_equal_sql(spark, make_docs, block_rows):
    docs, items = make_docs(LEAKY), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = rows(D.report(D.find(docs, items, block_rows=block_rows)))
    assert got == sql(oracles.LEAKS, documents=docs.select("doc_id", "text").toPandas(), benchmark=items.toPandas())


def test_leaky_documents_go_in_one_block_or_many(spark, make_docs, monkeypatch):
    docs, items = make_docs(LEAKY), spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (D.BLOCK_ROWS, 2):
        monkeypatch.setattr(D, "BLOCK_ROWS", size)
        kept = D.clean(docs, items)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 8]


def test_partial_agreement_is_found_through_the_prefix():
    phrase = b"a b c d e f g h i j".split()
    index = PhraseIndex.build([phrase], {w: i for i, w in enumerate(phrase)}, share=0.8)
    assert index.matches(b"x a b X d e f Y h i j".split()) == [(0, 1, 8)]
    assert index.matches(b"x a b X d e Z Y h i j".split()) == []
    assert index.matches(b"b c d e f g h i j".split()) == []      # reaches before the document


def test_odd_documents_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.find(odd_docs, items).count() == 12
    assert D.find(no_docs, items).count() == 0
    assert {r["n_hit"] for r in D.report(D.find(odd_docs, items.limit(0))).collect()} == {0}
    assert D.clean(no_docs, items).count() == 0


LICENSED = [(1, "Intro.\nReleased under the MIT License.\nmit license"), (2, "Licensed under CC BY-NC 4.0."), (3, None),
            (4, "GNU general\npublic, LICENSE"), (5, "licensed under apache"), (6, "All rights reserved"),
            (7, "work this is licensed under the gnu public license version 3 general"), (8, ""), (9, "the mit"),
            (10, "Licensed under the Apache License, Version 2.0 " * 3)]


def test_licences_equal_sql(make_docs):
    from logspark.llm.queries import F

    docs = make_docs(LICENSED)
    out = L.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word",
                              F.array_join("base_labels", ",").alias("base_labels"),
                              F.array_join("labels", ",").alias("labels"), "score")
    assert rows(out) == sql(oracles.LICENSES, documents=docs.select("doc_id", "text").toPandas())
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[7]["labels"] == "gpl" and by_id[7]["base_labels"] == "" and by_id[7]["score"] == 1.0
    assert by_id[10]["n_base"] == 3


def test_template_filters_equal_plain_containment():
    counts = {}
    index = L.TemplateIndex(L.TEMPLATES, counts, 0.8)
    for _, text in LICENSED:
        for line in (text or "").split("\n"):
            block = set(L.folded_words(line))
            plain = sorted((label, len(set(L.folded_words(t)) & block) / len(set(L.folded_words(t)))) for t, label in L.TEMPLATES
                           if len(set(L.folded_words(t)) & block) >= 0.8 * len(set(L.folded_words(t))))
            assert sorted(index.met(block)) == plain


def test_wrapped_notices_are_met_and_scattered_words_are_not(make_docs):
    notices = [t for t, _ in L.TEMPLATES]
    docs = [(nr, "Some words before.\n\n" + "\n".join(f" # {line}" for line in textwrap.wrap(t, 30)) + "\nwords after")
            for nr, t in enumerate(notices)]
    docs += [(100, "all " + "of a line " * 50 + "rights " + "of a line " * 50 + "reserved"),
             (101, "Released under the\nMIT License. " * 2 + "\n" * 5 + "word " * 40 + "\nreleased\nunder the mit\nlicense")]
    found = {r["doc_id"]: r for r in L.scan(make_docs(docs)).collect()}
    for nr, (_, label) in enumerate(L.TEMPLATES):
        assert (2, label, 1.0) in [tuple(b) for b in found[nr]["blocks"]] and label in found[nr]["labels"], label
        assert found[nr]["score"] == 1.0
    assert found[100]["labels"] == [] and found[100]["score"] == 0.0 and found[100]["blocks"] == []
    assert [tuple(b) for b in found[101]["blocks"] if b["label"] == "mit"] == [(0, "mit", 1.0), (1, "mit", 1.0), (8, "mit", 1.0)]


def test_windows_equal_plain_search():
    rng = random.Random(7)
    index = L.TemplateIndex(L.TEMPLATES, {}, 0.8)
    vocabulary = [f"x{i}".encode() for i in range(5)] + sorted({w for t, _ in L.TEMPLATES for w in L.folded_words(t)})
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            part = L.folded_words(rng.choice(L.TEMPLATES)[0])
            words += [w for w in part if rng.random() < 0.93 for w in [w] + rng.choices(vocabulary, k=rng.choice((0, 0, 1, 3)))]
        plain = {}
        for text, label in L.TEMPLATES:
            n, size = len(L.folded_words(text)), len(set(L.folded_words(text)))
            share = max(len(set(L.folded_words(text)) & set(words[i:i + 2 * n])) / size for i in range(len(words)))
            if share >= 0.8:
                plain.setdefault(label, []).append(share)
        got = {}
        for _, label, share in index.blocks(words):
            got.setdefault(label, []).append(share)
        assert {k: max(v) for k, v in got.items()} == {k: max(v) for k, v in plain.items()}


def test_licence_scan_of_odd_and_empty_tables(odd_docs, no_docs):
    assert L.scan(odd_docs).count() == 12
    assert L.scan(no_docs).count() == 0


def digest(text):
    return hashlib.sha256(re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()).hexdigest()


@pytest.mark.parametrize("counters", [1, 3, X.COUNTERS])
def test_exact_groups(make_docs, counters):
    docs = [(i, f"text {i % 7}" if i % 3 else "Hot TEXT") for i in range(200)] + [(500, None), (501, ""), (502, "É"), (503, "é")]
    got = {r["doc_id"]: r for r in X.decide(make_docs(docs), counters).collect()}
    groups = {}
    for i, t in docs:
        groups.setdefault(digest(t), []).append(i)
    for d, ids in groups.items():
        for i in ids:
            assert tuple(got[i])[1:] == (max(ids), len(ids), i == max(ids), d)


def test_misra_gries_keeps_every_frequent_digest():
    import pyarrow as pa

    values = ["a"] * 50 + [f"x{i}" for i in range(60)] + ["b"] * 40
    batch = pa.record_batch([pa.array(values[::2] + values[1::2])], ["digest"])
    out = next(X.misra_gries(iter([batch.slice(i, 10) for i in range(0, 150, 10)]), 3))
    counted = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    assert {"a", "b"} <= counted.keys() and len(counted) <= 3
    assert 50 - 150 / 4 <= counted["a"] <= 50


def test_exact_dedup_of_odd_rows(odd_docs, no_docs):
    kept = X.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["10", "2", "3", "6", "7", "8", "9"]
    out = X.decide(odd_docs).collect()
    assert len(out) == 12 and sum(r["kept"] for r in out) == 7
    assert X.decide(no_docs).count() == 0 and X.deduplicate(no_docs).count() == 0
