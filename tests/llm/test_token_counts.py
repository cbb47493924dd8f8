import random
import time

import pytest

from logspark.llm import token_counts as C

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "'s", "'re", "'", "a", "the", "é", "中", "1", "23", "!", "<|endoftext|>", "<|endof", "\x85",
         "\x1c", " ", "ß", "aaaaaaaa", "-----", "    ", "\r\n", "\U0001f600", "́", "x"]


@pytest.fixture(scope="module")
def library():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return C.Vocabulary(file.read())


def test_whole_texts_and_all_prefixes(library, vocabulary):
    rng = random.Random(3)
    for _ in range(600):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        counts = [library(text[:k]) for k in range(len(text) + 1)]
        prefixes = C.Prefixes(vocabulary, text)
        assert vocabulary.tokens(text) == counts[-1]
        assert [prefixes.tokens_at(k) for k in range(len(text) + 1)] == counts
        for limit in (0, 1, 3, 5):
            assert prefixes.longest(limit) == max(k for k, n in enumerate(counts) if n <= limit)


def test_documents(spark, odd_docs, no_docs, library):
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    out = C.count(odd_docs, PATH).collect()
    assert len(out) == 12 and C.count(no_docs, PATH).count() == 0
    for r in out:
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), library(text))
        assert r["over_limit"] == (r["n_tokens"] > 1024)
        assert library(text.encode()[:r["limit_bytes"]].decode()) <= 1024


def test_stored_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["n_tokens"] == library(texts[r["doc_id"]]) for r in C.count(docs, PATH).collect())


@pytest.mark.parametrize("unit", ["ab1c", "q", "!?-", " ", "\n", "é", "xy zw"])
def test_budgets_of_one_very_long_piece(library, vocabulary, monkeypatch, unit):
    """Looked up: no prefix is encoded anew, and answers are the library's."""
    text = "start " + unit * (120_000 // len(unit)) + "<|endoftext|> end"
    began = time.perf_counter()
    prefixes = C.Prefixes(vocabulary, text)
    total = prefixes.sums[-1]
    monkeypatch.setattr(vocabulary, "tokens", None)
    ends = {limit: prefixes.longest(limit) for limit in (0, 1, 2, 50, 1024, total // 2, total - 3, total - 1, total)}
    assert time.perf_counter() - began < 20
    for limit, end in ends.items():
        assert library(text[:end]) <= limit
        assert end == len(text) or all(library(text[:end + k]) > limit for k in (1, 2, 3) if end + k <= len(text))
    rng = random.Random(5)
    for end in [rng.randrange(len(text)) for _ in range(3)] + [len(text) - 3, len(text) - 12]:
        assert prefixes.tokens_at(end) == library(text[:end])
