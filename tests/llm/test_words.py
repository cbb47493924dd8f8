import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from logspark.llm.words import FOLDED_SQL, PLAIN_SQL, flat_words, folded_words, plain_words, text_slices

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB09 .\t\n\x00\x1f\x7fé中😀_-", max_size=40)), max_size=8)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_follow_their_patterns(texts):
    for text in texts:
        assert [w.decode() for w in plain_words(text)] == re.findall(PLAIN_SQL, text or "")
        assert [w.decode() for w in folded_words(text)] == re.findall(FOLDED_SQL, lowered(text or ""))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.booleans())
def test_flat_hashes_are_equal_for_equal_words_only(texts, folded):
    hashes, first = flat_words(pa.array(texts, pa.string()), folded)
    words = [(folded_words if folded else plain_words)(t) for t in texts]
    assert list(first) == [sum(map(len, words[:i])) for i in range(len(words) + 1)]
    flat = [w for own in words for w in own]
    assert len(hashes) == len(flat)
    by_word = dict(zip(flat, hashes.tolist(), strict=True))
    assert [by_word[w] for w in flat] == hashes.tolist()
    assert len(set(by_word.values())) == len(by_word)


def test_slices_cover_a_batch():
    batch = pa.record_batch([pa.array(range(9)), pa.array(["x" * n for n in (5, 0, 0, 40, 3, 3, 3, 100, 1)])], ["id", "text"])
    parts = list(text_slices(batch, "text", 10))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(9))
    assert max(p.num_rows for p in parts) < 9
