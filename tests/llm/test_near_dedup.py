import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from logspark.llm import near_dedup as N
from logspark.llm.components import components
from logspark.llm.scratch import Scratch
from logspark.llm.words import folded_words


def bag(text):
    words = folded_words(text)
    if len(words) < 5:
        return Counter([tuple(words)]) if words else Counter()
    return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def alike(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def brute(rows, threshold=0.8):
    bags = {d: bag(t) for d, t in rows}
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d in sorted(bags):
        near = {o for s in bags[d] for o in holders[s]}
        for o in near:
            if alike(bags[o], bags[d]) >= threshold:
                a, b = find(o), find(d)
                parent[max(a, b)] = min(a, b)
        for s in bags[d]:
            holders[s].append(d)
    return {d: find(d) for d in bags}


def test_agreement_estimates_weighted_similarity():
    a = " ".join(["a b c d e f"] * 10 + ["g h i j k"] * 2)
    b = " ".join(["a b c d e f"] * 8 + ["g h i j k"] * 5)
    signs = N.signatures(*N.shingles(pa.array([a, b])), 2, 8000)
    assert abs(float((signs[0] == signs[1]).mean()) - alike(bag(a), bag(b))) < 0.03


def test_all_coordinates_are_filled_for_any_size():
    texts = ["one", "one two three four five six", " ".join(f"w{i}" for i in range(3000)), ""]
    signs = N.signatures(*N.shingles(pa.array(texts)), 4)
    assert (signs[:3] != 0).all() and (signs[3] == 0).all()
    alone = N.signatures(*N.shingles(pa.array(texts[1:2])), 1)
    assert (alone[0] == signs[1]).all()                     # a text's signature is its own


def test_classes_equal_brute_force(make_docs):
    rng = random.Random(1)
    words = [f"t{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 120))] for _ in range(30)]
    rows = []
    for d in range(220):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((d, " ".join(text)))
    rows += [(300, None), (301, ""), (302, "!!"), (303, "a b"), (304, "A b."), (305, "a b c")]
    out = N.report(make_docs(rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute(rows)
    sizes = Counter(r["class_id"] for r in out)
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in out)


def test_pairs_across_components_are_found_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "SLACK", 0.0)
    signs = np.random.default_rng(3).integers(0, 256, (40, 1024), dtype=np.uint8)
    for i in range(0, 40, 4):
        signs[i + 1] = signs[i]
    # bands 7 and 8 hold all; 4 and 5 first meet in band 5, whose bucket is not among the blocks
    own = [[5 if i in (4, 5) else 100 + i, 7, 8] for i in range(40)]
    rows = [(band, i, i, bytes(signs[i].tobytes()), 3, own[i]) for i in range(40) for band in (7, 8)]
    members = spark.createDataFrame(rows, "band long, row long, component long, signature binary, chunks int, bands array<long>")
    found = [(r["a"], r["b"]) for r in N.across(members, 0.8).collect()]
    assert sorted(found) == [(i, i + 1) for i in range(0, 40, 4) if i != 4]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    out = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r["node"]: r["component"] for r in out} == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100)}


def test_one_document_of_each_class_stays_with_its_columns(odd_docs):
    kept = N.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == ["1", "10", "2", "3", "7", "8", "9", "None"]   # null comes first of the "word"s


def test_empty_table(no_docs):
    assert N.report(no_docs).collect() == []
