import collections
import hashlib
import random

import pytest

from logspark.llm import token_alignment as T
from logspark.llm.queries import op11_token_alignment
from logspark.llm.token_counts import _byte_characters

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def two_pointers():
    """Links and groups of a text by walking both token rows at once."""
    a, b, byte = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), _byte_characters()
    a.encode_special_tokens = True

    def walk(text):
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        raw = [[bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]],
               [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                for i in ids[1] for p in [b.id_to_piece(i)]]]
        if not text or any(b"".join(r) != (" " + text).encode() for r in raw):
            return ids, [], [], False
        links, groups, i, j, ends = [], [], 0, 0, [len(raw[0][0]), len(raw[1][0])]
        first = [0, 0]
        while True:
            links.append((i, j))
            if ends[0] == ends[1]:
                groups.append((ids[0][first[0]:i + 1], ids[1][first[1]:j + 1]))
                if i + 1 == len(ids[0]):
                    return ids, links, groups, True
                i, j = i + 1, j + 1
                first = [i, j]
                ends = [ends[0] + len(raw[0][i]), ends[1] + len(raw[1][j])]
            elif ends[0] < ends[1]:
                i += 1
                ends[0] += len(raw[0][i])
            else:
                j += 1
                ends[1] += len(raw[1][j])

    return walk


def expected(texts, walk):
    walks = [walk(t) for t in texts]
    pairs = [[(ids[0][i], ids[1][j]) for i, j in links] for ids, links, _, _ in walks]
    count = collections.Counter(p for ps in pairs for p in ps)
    top = collections.defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for (ids, links, groups, whole), ps in zip(walks, pairs, strict=True):
        listing = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((len(ids[0]) if whole else 0, len(ids[1]) if whole else 0, len(groups), len(links),
                    sum(count[p] == top[p[1]] for p in ps), sum(count[p] for p in ps),
                    hashlib.sha256(listing.encode()).hexdigest() if whole else ""))
    return out


def rows(df):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0), tuple(r[c] for c in COLUMNS)) for r in df.collect())


@pytest.mark.parametrize("chunk_bytes", [T.CHUNK_BYTES, 40])
def test_random_texts(make_docs, two_pointers, chunk_bytes):
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "the", "house", "naïve", "中文", "\U0001f600", "▁", "<s>", "<|endoftext|>", "12", "...", "\x00", "Zürich"]
    texts = [None, "", " ", "▁", "same text", "same text", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(80))]
    docs = make_docs([(i, t) for i, t in enumerate(texts)])
    want = sorted(((True, i), v) for i, v in enumerate(expected([t or "" for t in texts], two_pointers)))
    assert rows(T.align(docs, A, B, chunk_bytes)) == want


def test_links(make_docs, two_pointers):
    texts = ["Unbelievable naïveté 中文", "a b", "", "▁"]
    out = T.links(make_docs(list(enumerate(texts))), A, B).collect()
    for nr, text in enumerate(texts):
        ids, links, _, _ = two_pointers(text)
        mine = sorted((r["a"], r["b"], r["a_id"], r["b_id"]) for r in out if r["doc_id"] == nr)
        assert mine == sorted((i, j, ids[0][i], ids[1][j]) for i, j in links)
        assert all(0 <= r["start"] < r["end"] <= len((" " + text).encode()) for r in out if r["doc_id"] == nr)


def test_odd_rows(odd_docs, no_docs, two_pointers):
    data = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    want = sorted(((d is not None, d or 0), v) for (d, _), v in
                  zip(data, expected([t for _, t in data], two_pointers), strict=True))
    assert rows(T.align(odd_docs, A, B)) == want
    assert T.align(no_docs, A, B).collect() == []


def test_stored_documents(spark, two_pointers):
    sf = "/root/testdata/sf0.001"
    data = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted(((True, d), v) for (d, _), v in zip(data, expected([t for _, t in data], two_pointers), strict=True))
    assert rows(op11_token_alignment(spark, sf)) == want
