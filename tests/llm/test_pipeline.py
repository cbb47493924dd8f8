import random

import corpus_pipeline
from logspark.llm import queries
from test_near_dedup import alike, bag


def test_stages_and_their_effect(spark, make_docs, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(("loser", "moron", "pathetic")))
        rows.append((i, " ".join(text), f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    near = rows[1][1].split()
    near[0] = "changed"
    item = " ".join(f"item{i}" for i in range(12))
    rows += [(400, rows[2][1].upper(), "s0"), (401, " ".join(near), "s1"), (402, "before " + item + " after", "s2"),
             (403, None, "s0"), (404, "", None)]
    make_docs(rows, clashes=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/out-{name}"
        out.write.parquet(path)
        if name != "mix":
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    toxic, exact, nearly, clean, mixed = seen
    assert not any(i % 5 == 0 for i in toxic if i < 300) and {1, 2, 400, 401, 402, 403, 404} <= toxic
    assert toxic - exact == {2, 403}                       # of equal texts the largest stays
    assert exact - nearly == {401}
    assert nearly - clean == {402}
    assert mixed <= clean
    assert docs.columns == [*corpus_pipeline.COLUMNS, "mix_pass"]
    texts = {i: bag(t) for i, t, _ in rows}
    left = [i for i in nearly if texts[i]]
    assert not any(alike(texts[a], texts[b]) >= 0.8 for a in left for b in left if a < b)


def stored(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(path)).collect()


def test_empty_tables(spark, no_docs, tmp_path):
    assert stored(spark, tmp_path, no_docs) == []


def test_odd_rows(spark, odd_docs, tmp_path):
    """Without labels and benchmark items only copies go, and texts without words are never taken."""
    out = stored(spark, tmp_path, odd_docs)
    assert {r["doc_id"] for r in out} <= {6, 7, 8, 9, 10} and out
    texts = [(r["text"], r["mix_pass"]) for r in out]
    assert len(texts) == len(set(texts))                   # one row of each text and pass


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == [*corpus_pipeline.COLUMNS, "mix_pass"] and out.count() > 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
