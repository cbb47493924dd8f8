import random
from collections import defaultdict

import duckdb
import pytest

from logspark.llm import fair_mix as M
from logspark.llm import oracles


def mixed(docs):
    return [r.asDict() for r in M.mix(docs).collect()]


def check(rows, most=3):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
        assert 0 <= r["taken"] <= most * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    largest = max((r["size"] for r in rows), default=0)
    for own in by_source.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= len(by_source) * largest + 1
    assert sum(r["taken"] for r in rows) <= sum(r["size"] for r in rows)


@pytest.mark.parametrize("bucket_rows, buckets", [(20_000, 4096), (7, 3)])
def test_targets_are_met_and_equal_sql(make_docs, monkeypatch, bucket_rows, buckets):
    monkeypatch.setattr(M, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(M, "BUCKETS", buckets)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["b", "a", "a", "a", "ä", "Z", None, "tiny" if i < 8 else "a"]))
            for i in range(400)] + [(400, None, "empty"), (401, "", "empty")]
    docs = make_docs(rows)
    got = mixed(docs)
    check(got)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "source", "text").toPandas())
    expected = sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in con.execute(oracles.MIX).fetchall())
    assert sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == expected
    assert sorted(map(repr, got)) == sorted(map(repr, mixed(docs)))


def test_repeated_rows_follow_the_decisions(make_docs):
    docs = make_docs([(i, "w " * (i % 5 + 1), "a" if i % 9 else "b") for i in range(90)])
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixed(docs)}
    out = M.repeated(docs).collect()
    times = defaultdict(list)
    for r in out:
        times[r["doc_id"]].append(r["mix_pass"])
    assert {d: len(p) for d, p in times.items()} == {d: n for d, n in taken.items() if n}
    assert all(sorted(p) == list(range(len(p))) for p in times.values())


def test_rows_of_one_doc_id_follow_their_own_decisions(make_docs):
    docs = make_docs([(None if i % 2 else i // 8, "w " * (i + 1), "a" if i % 3 else "b") for i in range(60)])
    taken = {r["size"]: r["taken"] // r["size"] for r in mixed(docs)}
    out = M.repeated(docs)
    assert out.columns == [*docs.columns, "mix_pass"]
    times = defaultdict(list)
    for r in out.collect():
        times[len(r["text"].split())].append(r["mix_pass"])
    assert {d: sorted(p) for d, p in times.items()} == {d: list(range(n)) for d, n in taken.items() if n}
    assert sum(size * len(p) for size, p in times.items()) <= sum(taken)


def test_odd_rows_empty_table_and_texts_without_words(make_docs, odd_docs, no_docs):
    check(mixed(odd_docs))
    assert len(mixed(odd_docs)) == 12
    assert mixed(no_docs) == [] and M.repeated(no_docs).count() == 0
    assert [r["taken"] for r in mixed(make_docs([(1, None, None), (2, "", "a")]))] == [0, 0]


def test_a_mixed_corpus_can_be_mixed_again(make_docs):
    docs = make_docs([(i, "w " * (i + 1), "a" if i % 3 else "b") for i in range(30)])
    once = M.repeated(docs).selectExpr("*").withColumnRenamed("mix_pass", "Mix_Pass")
    again = M.repeated(once)
    assert again.columns == [*docs.columns, "mix_pass"] and again.count() > 0


def test_plan_is_native(make_docs):
    plan = M.mix(make_docs([(1, "a b", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
