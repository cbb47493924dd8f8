import random
import tempfile
import zlib

import numpy as np
import pytest

from logspark.llm import elias_fano as E
from logspark.llm import token_files as T
from logspark.llm.queries import op12_token_files

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_elias_fano():
    rng = random.Random(2)
    for _ in range(300):
        n, universe = rng.randint(0, 900), rng.choice([1, 5, 1000, 10**6, 2**40, 2**64])
        values = sorted(rng.randrange(universe) for _ in range(n))
        raw = b"head" + E.encode(np.array(values, np.uint64), universe) + b"tail"
        coded = E.EliasFano(raw, 4)
        assert coded.end == len(raw) - 4 and len(coded) == n
        assert coded.all().tolist() == values == [coded.select(i) for i in range(n)]
        for x in (0, universe // 3, universe - 1):
            assert coded.first_not_below(x) == sum(v < x for v in values)
        with pytest.raises(IndexError):
            coded.select(n)


def test_space():
    """Near 2 + log2(universe / n) bits a number."""
    values = np.sort(np.random.default_rng(1).integers(0, 10**9, 100_000))
    assert len(E.encode(values, 10**9)) * 8 / 100_000 < 2 + np.log2(10**4) + 0.4


def test_one_file():
    docs = [np.array([5, 6, 2]), np.array([2]), np.array([7, 2]), np.array([8, 9, 10, 2])]
    file = T.TokenFile(T.TokenFile.write(3, 4, [None, -9, 7, 7], docs, 2) + b"\n")
    assert (file.part, file.block, file.n_docs, file.n_ids) == (3, 4, 4, 10)
    assert [file.document(i).tolist() for i in range(4)] == [d.tolist() for d in docs]
    assert [file.doc_id(i) for i in range(4)] == [None, -9, 7, 7]
    assert file.find(7) == [2, 3] and file.find(-9) == [1] and file.find(0) == file.find(-100) == []
    with pytest.raises(ValueError):
        T.TokenFile(b"x" * 200)


def expected(rows):
    """(start, ids, crc32) of sorted (doc_id, text)."""
    library, at, out = tokenizers.Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [T.BLOCK_IDS, 50])
def test_written_and_read(spark, make_docs, block_ids, monkeypatch):
    monkeypatch.setattr(T, "LEAST_BYTES", 300)             # several partitions
    monkeypatch.setattr(T, "GROUP", 2)
    rng = random.Random(3)
    parts = [" ", "\n", "word", "<|endoftext|>", "é", "\x00", "\r\n", "中"]
    data = [(rng.randint(-500, 500) * 10**12 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    path = tempfile.mkdtemp() + "/files"
    T.write(make_docs(data), path, PATH, block_ids=block_ids)
    assert T.files(spark, path).count() > (20 if block_ids == 50 else 1)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in T.report(spark, path).collect())
    assert got == expected(sorted(data))
    for r in T.read(spark, path).collect():
        text = dict(data)[r["doc_id"]]
        assert r["ids"] == tokenizers.Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [2]


def test_odd_rows(spark, odd_docs, no_docs):
    path = tempfile.mkdtemp()
    T.write(odd_docs, path + "/odd", PATH)
    got = sorted(T.report(spark, path + "/odd").collect(), key=lambda r: r["start"])
    data = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in data), key=lambda d: (d is not None, d or 0))
    want = sorted((d is not None, d or 0, n, c) for d, _, n, c in expected(data))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    T.write(no_docs, path + "/none", PATH)
    assert T.report(spark, path + "/none").collect() == []


def test_stored_documents(spark):
    sf = "/root/testdata/sf0.001"
    data = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in op12_token_files(spark, sf).collect())
    assert got == expected(data)
