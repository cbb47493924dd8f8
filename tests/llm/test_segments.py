import random

import numpy as np
import pytest

from logspark.llm import segments as S

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
PARTS = [".", ",", "b.", "é,", "ab!", " ", " ", "  ", "\n", "\t", "'s", "a", "the", "é", "中", "1", "!", "<|endoftext|>", "<s>", "<0x0A>", "▁", "\x85",
         "\x1c", " ", "ß", "aaaa", "---", "    ", "\r\n", "\U0001f600", "x", "\x00"]


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("kept", [S.KEPT, 20])
def test_ids_are_the_library_s(monkeypatch, kept):
    monkeypatch.setattr(S, "KEPT", kept)
    path = public_tokenizers.path("byte_bpe_50k.json")
    default, plain = S.ByteLevel(path, False), S.ByteLevel(path, True)
    pieces = S.SentencePiece(public_tokenizers.path("piece_bpe_32k.model"))
    for seed in range(60):
        texts = random_texts(seed, 30)
        assert default.ids(texts) == [default.whole(t) for t in texts]
        assert plain.ids(texts, blank=True) == [plain.whole(" " + t) for t in texts]
        assert pieces.ids(texts) == [pieces.whole(t) for t in texts]


def test_long_segments_and_token_bytes():
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = S.ByteLevel(path, False)
    long = "ab1" * 20_000 + " end"
    assert model.ids([long, long]) == [model.whole(long)] * 2
    ids = [int.from_bytes(model.whole("é \U0001f600")[k:k + 4], "little") for k in range(0, len(model.whole("é \U0001f600")), 4)]
    assert b"".join(model.tokens[i] for i in ids) == "é \U0001f600".encode()
    assert model.tokens[50256] == b"<|endoftext|>"


CLOSE = ["a", "b", "the", "s", "ll", "'", ".", ",", ")", "(", "-", "1", " ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028",
         "\u202f", "\u205f", "\u3000", "\u200b", "\u3002", "\u0301", "\xe9", "\u201c", "\U0001f600", "\x00", "\u2581"]


def test_cuts_by_marks_newlines_and_wide_white_space():
    rng = random.Random(9)
    path = public_tokenizers.path("byte_bpe_50k.json")
    default, pieces = S.ByteLevel(path, False), S.SentencePiece(public_tokenizers.path("piece_bpe_32k.model"))
    for _ in range(80):
        texts = ["".join(rng.choice(CLOSE) for _ in range(rng.randint(0, 14))) for _ in range(60)]
        assert default.ids(texts) == [default.whole(t) for t in texts]
        assert default.ids(texts, blank=True) == [default.whole(" " + t) for t in texts]
        assert pieces.ids(texts) == [pieces.whole(t) for t in texts]


def test_white_space_of_bytes():
    for text in ["".join(CLOSE), " \xe9 \u3000", "\xe2", "".join(map(chr, [*range(0xd800), *range(0xe000, 0x11000)]))]:
        data = np.frombuffer(text.encode(), np.uint8)
        assert S.white_space(data).tolist() == [c.isspace() for c in text for _ in c.encode()]


def test_the_library_gets_each_word_once():
    """Also where other marks or newlines stand behind it, in one call or a later one."""

    class Counting:
        def __init__(self, library):
            self.library, self.characters = library, 0

        def encode_batch_fast(self, texts, **more):
            self.characters += sum(map(len, texts))
            return self.library.encode_batch_fast(texts, **more)

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(300)]
    model = S.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"), False)
    texts = ["x " + " ".join(f"{w}{mark}" for w in words) + " x" for mark in ("", ",", ".", ";", ":", "!", "?", ")", "\nx", ".\nx")]
    expected = [model.whole(t) for t in texts]
    model.library = Counting(model.library)
    assert model.ids(texts[:6]) + model.ids(texts[6:]) == expected
    assert model.library.characters < 1.5 * sum(len(w) + 1 for w in words)
