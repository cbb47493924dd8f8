import hashlib
import random

import numpy as np
import pytest

from logspark.llm import substring_dedup as S
from logspark.llm.fm_index import FMIndex, WaveletMatrix


def brute(rows, window):
    seen, out = set(), []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(1)
    for count in (1, 2, 7, 64, 300):
        symbols = rng.integers(0, count, 500)
        matrix = WaveletMatrix(symbols, count)
        asked, places = rng.integers(0, count, 200), rng.integers(0, 501, 200)
        expected = [int((symbols[:p] == s).sum()) for s, p in zip(asked, places, strict=True)]
        assert matrix.rank(asked, places).tolist() == expected


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_streaming_finds_earliest_places_and_match_lengths(letters):
    rng, depth = random.Random(letters), 4
    texts = [[rng.randrange(letters) + 10 for _ in range(rng.randint(1, 30))] for _ in range(20)]
    index = FMIndex(np.array([w for t in texts for w in t], np.uint64), np.array([len(t) for t in texts]), depth)
    query = [texts[3], [10, 99, 10, 11, 10], texts[7][2:], [98]]
    length, found = index.stream(np.array([w for t in query for w in t], np.uint64), np.array([len(t) for t in query]))
    places, layout = {}, 0
    for t in texts:
        for i in range(len(t) - depth + 1):
            places.setdefault(tuple(t[i:i + depth]), layout + i)
        layout += len(t) + 1
    at = 0
    for t in query:
        for i in range(len(t)):
            assert found[at + i] == places.get(tuple(t[i:i + depth]) if i + depth <= len(t) else None, -1)
            assert (length[at + i] == depth) == (found[at + i] >= 0)
        at += len(t)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_equals_brute_force(make_docs, hot):
    rng = random.Random(5)
    few, many = [f"w{i}" for i in range(6)], [f"x{i}" for i in range(2000)]
    passage = [rng.choice(many) for _ in range(60)]
    rows = []
    for d in range(150):
        kind = rng.random()
        if kind < 0.15:
            words = [rng.choice(few) for _ in range(rng.randint(0, 90))]
        elif kind < 0.3:
            words = rng.choice((["a"], ["a", "b"])) * rng.randint(0, 120)
        else:
            words = [rng.choice(many) for _ in range(rng.randint(0, 80))]
            at, cut = rng.randint(0, len(words)), rng.randint(0, 30)
            words[at:at] = passage[cut:cut + rng.randint(15, 60)]
        rows.append((d, rng.choice((" ", "\n", "\t ")).join(words)))
    rows += [(200, None), (201, ""), (202, "é " * 50)] + [(203 + i, rows[i][1]) for i in range(30)]
    got = sorted(tuple(r) for r in _report(make_docs(rows), hot))
    assert got == sorted(brute(rows, 20))


def _report(docs, hot):
    before = S.find.__defaults__
    S.find.__defaults__ = (20, hot, 2000)
    try:
        return S.report(docs).collect()
    finally:
        S.find.__defaults__ = before


def test_odd_rows_have_a_defined_result(odd_docs):
    out = S.report(odd_docs).collect()
    assert len(out) == 12
    assert all(r["n_removed"] <= r["n_words"] for r in out)
    long = sorted((r["n_words"], r["n_removed"]) for r in out if r["doc_id"] == 8)
    assert long == [(30_000, 29_999), (30_000, 30_000)]      # all but the first word; the repeated row comes second
    assert [r["n_words"] for r in out if r["doc_id"] is None] == [1]


def test_removed_texts_keep_their_other_words(make_docs):
    shared = " ".join(f"s{i}" for i in range(25))
    out = {r["doc_id"]: r for r in S.remove(make_docs([(1, "a " + shared), (2, "b\n" + shared + " c")])).collect()}
    assert out[1]["text"] == "a " + shared
    assert out[2]["text"] == "b c"
    assert [(s["start"], s["end"]) for s in out[2]["spans"]][0][0] == 1


def test_empty_table(no_docs):
    assert S.report(no_docs).collect() == []
