import hashlib
import random
import zlib

from logspark.llm import periodic_runs as R
from logspark.llm.queries import op13_periodic_runs

COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def all_runs(words, min_words=24, times=3):
    """By trying each period at each place."""
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            size = j + p - i
            if j > i and size >= max(min_words, times * p) and not any(
                    all(words[x] == words[x + q] for x in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def figures(words):
    runs = all_runs(words)
    gone = {x for s, n, p in runs for x in range(s + p, s + n)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for x, w in enumerate(words) if x not in gone)).hexdigest())


def repetitive(rng):
    words = []
    for _ in range(rng.randint(0, 5)):
        unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(1, 9))]
        words += (unit * rng.randint(1, 8))[:rng.randint(1, 60)]
    return words


def test_runs_against_all_periods():
    rng = random.Random(5)
    for _ in range(300):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        for min_words, times in ((24, 3), (6, 2), (1, 2)):
            assert R.runs_of(texts, min_words, times) == [all_runs(w, min_words, times) for w in texts]


def test_long_texts():
    assert R.runs_of([["a"] * 100_000]) == [[(0, 100_000, 1)]]
    assert R.runs_of([[str(i % 997) for i in range(30_000)]]) == [[(0, 30_000, 997)]]
    copies = [x for i in range(2000) for x in [*"abcdefghijklmnopq", str(i)]]     # one line again and again, no run
    assert R.runs_of([copies]) == [[]]


def test_documents(make_docs):
    rng = random.Random(9)
    data = [(i, " \n".join(repetitive(rng))) for i in range(60)] + [(60, None), (61, ""), (62, "x " * 24), (62, "x " * 23)]
    out = R.report(make_docs(data)).collect()
    want = sorted((i, figures((t or "").encode().split())) for i, t in data)
    assert sorted(((r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in out), key=str) == sorted(want, key=str)


def test_collapse(make_docs):
    out = {r["doc_id"]: r for r in R.collapse(make_docs([(1, "go " + "a b c " * 9 + "stop"), (2, None)])).collect()}
    assert out[1]["text"] == "go a b c stop" and [tuple(r) for r in out[1]["runs"]] == [(1, 27, 3)]
    assert out[2]["text"] == "" and out[2]["runs"] == []


def test_odd_rows(odd_docs, no_docs):
    out = R.report(odd_docs, change=R.looped).collect()
    data = {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    want = {(d, figures(R.looped(t.encode().split(), d))[5:]) for d, t in data if not t.startswith("long")}
    assert {(r["doc_id"], (r["runs_sha256"], r["collapsed_sha256"])) for r in out if r["doc_id"] != 8} == want
    assert [(r["n_runs"], r["length"]) for r in out if r["doc_id"] == 8] == [(1, 30_000)] * 2
    assert R.report(no_docs).collect() == []


def loop_by_rule(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_stored_documents(spark):
    sf = "/root/testdata/sf0.001"
    data = {r["doc_id"]: (r["text"] or "").encode().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op13_periodic_runs(spark, sf).collect()
    assert len(out) == len(data) and any(r["n_runs"] for r in out)
    for r in out:
        words = loop_by_rule(data[r["doc_id"]], r["doc_id"])
        if len(words) <= 1500 or r["doc_id"] % 10 == 0:
            assert tuple(r[c] for c in COLUMNS) == figures(words), r["doc_id"]
