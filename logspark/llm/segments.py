"""Token ids of whole texts, with the encodings of recurring segments kept.

A text is cut before each blank that stands between two characters that are
no white space.  Neither tokenizer family can join characters across such a
place: the byte-level split pattern ends its piece there, and no token of the
sentence-piece vocabulary has a blank mark behind another character (checked
when it is loaded).  The byte-level pattern also ends its piece behind an
ASCII letter before any other ASCII character, and behind a newline that
stands between two ASCII characters of which the first is no white space and
the second a letter; such texts are cut there too, so a word is one segment
with any mark behind it.  The ids of a text are those of its segments in order.

Places to cut are found in the bytes of all texts of a call at once, and Arrow
finds their distinct segments and lays out the ids, so Python handles each
distinct segment of a call once.  A Python worker keeps the ids of recent
segments, two generations of ``KEPT`` segments of at most ``LONGEST``
bytes; the others of a call are encoded together by the library, many in
one text, and its ids dealt out by their bytes.  What is kept changes the time
only, never a result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # Spark's tasks are the parallelism

KEPT = 400_000
LONGEST = 64
JOINED = 1 << 14                                           # segments in one text for the library
ID = np.dtype("<u4")
BLANK_MARK = "▁"
_WHITE = np.array([chr(b).isspace() for b in range(128)] + [False] * 128)
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_WIDE = [c.encode() for c in map(chr, range(128, 0x3001)) if c.isspace()]
_WIDE_LEAD = np.isin(np.arange(256), [w[0] for w in _WIDE])
_WIDE_CODES = {n: np.array([int.from_bytes(w) for w in _WIDE if len(w) == n]) for n in (2, 3)}


def packed(ids: Sequence[int]) -> bytes:
    return np.array(ids, ID).tobytes()


def white_space(data: np.ndarray) -> np.ndarray:
    """Of each byte of UTF-8, whether it belongs to white space (``str.isspace``)."""
    out = _WHITE[data]
    leads = np.flatnonzero(_WIDE_LEAD[data])
    for n, codes in _WIDE_CODES.items():
        at = leads[leads <= len(data) - n]
        code = np.zeros(len(at), np.int64)
        for k in range(n):
            code = code << 8 | data[at + k]
        for k in range(n):
            out[at[np.isin(code, codes)] + k] = True
    return out


def segment_starts(data: np.ndarray, offsets: np.ndarray, marks: bool) -> np.ndarray:
    """Where the segments of texts start, and the end.  ``offsets``: the
    texts' places in ``data``, which are among them; with ``marks`` the cuts
    of byte-level tokenizers by marks and newlines are made too."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        dense = ~white_space(data)
        cut[1:n - 1] = (data[1:-1] == 0x20) & dense[:-2] & dense[2:]
        cut[offsets[1:] - 1] = False                       # what follows is another text
        if marks:
            letter, ascii_ = _LETTER[data], data < 128
            cut[1:n] |= letter[:-1] & ~letter[1:] & ascii_[1:] & (data[1:] != 0x20)
            cut[2:n] |= (data[1:-1] == 0x0A) & letter[2:] & dense[:-2] & ascii_[:-2]
    cut[offsets] = True
    return np.flatnonzero(cut)


class Recurring:
    """Ids of segments.  ``whole`` gives the ids of texts by the library, as
    if each began with what it begins with."""

    def __init__(self, whole: Callable[[list[str]], list[bytes]], token_bytes: list[bytes], marks: bool):
        self.whole = whole
        self.marks = marks
        self.sizes = np.array([len(b) for b in token_bytes], np.int64)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, b"" for an empty one."""
        raw = [text.encode("utf-8", "surrogatepass") for text in texts]
        data = b"".join(raw)
        if not data:
            return [b""] * len(texts)
        offsets = np.cumsum([0, *map(len, raw)])
        starts = segment_starts(np.frombuffer(data, np.uint8), offsets, self.marks)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1,
                                                 [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])
        found = found.dictionary_encode()
        laid = pa.array(self.segments(found.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(found.indices)
        ends = np.frombuffer(laid.buffers()[1], np.int64)[np.searchsorted(starts, offsets)].tolist()
        body = memoryview(laid.buffers()[2])
        return [bytes(body[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def segments(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of distinct segments."""
        known = self.young
        out = list(map(known.get, distinct))
        fresh = [s for s, ids in zip(distinct, out, strict=True) if ids is None]
        again = [s for s in fresh if s in self.old]
        known.update(zip(again, map(self.old.__getitem__, again), strict=True))
        unmet = [s for s in fresh if s not in known] if again else fresh
        known.update(zip(unmet, self.encoded([s.decode("utf-8", "surrogatepass") for s in unmet]), strict=True))
        out = [known[s] if ids is None else ids for s, ids in zip(distinct, out, strict=True)]
        for segment in unmet:
            if len(segment) > LONGEST:
                del known[segment]
        if len(known) > KEPT:
            self.old, self.young = known, {}
        return out

    def encoded(self, segments: list[str]) -> list[bytes]:
        """The segments' ids, from texts of many that may stand side by side;
        one by one where their bytes do not tell them apart."""
        known: dict[str, bytes] = {}
        plain = [s for s in segments if len(s) <= LONGEST and _is_plain(s)]
        for at in range(0, len(plain), JOINED):
            part = plain[at:at + JOINED]
            raw = self.whole(["".join(part)])[0]
            ends = np.cumsum(self.sizes[np.frombuffer(raw, ID)])
            borders = np.cumsum([len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass")) for s in part], dtype=np.int64)
            last = np.searchsorted(ends, borders)
            if last[-1] == len(ends) - 1 and (ends[last] == borders).all():
                cuts = [0, *((last + 1) * ID.itemsize).tolist()]
                known.update(zip(part, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        alone = [s for s in segments if s not in known]
        known.update(zip(alone, self.whole(alone), strict=True))
        return [known[s] for s in segments]


def _is_plain(segment: str) -> bool:
    """Whether such segments are cut apart where they stand side by side."""
    return segment[0] == " " and len(segment) > 1 and not segment[1].isspace() and not segment[-1].isspace()


class ByteLevel:
    """A byte-level BPE of the ``tokenizers`` library (no normalizer, no
    prefix space).  With ``plain`` the strings of special tokens inside a text
    are plain text, else the library's default holds for them."""

    def __init__(self, path: str, plain: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.library.no_truncation()
        self.library.no_padding()
        added = [] if plain else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.tokens = self.token_bytes()
        self.recurring = Recurring(self.all, self.tokens, True)

    def all(self, texts: list[str]) -> list[bytes]:
        return [packed(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return self.all([text])[0]

    def ids(self, texts: list[str], blank: bool = False) -> list[bytes]:
        """The ids of each text; with ``blank`` of blank + text."""
        own = [self.added is not None and self.added.search(t) is not None for t in texts]
        cut = self.recurring.ids(["" if alone else " " + t if blank else t for t, alone in zip(texts, own, strict=True)])
        return [self.whole(" " + t if blank else t) if alone else ids for t, alone, ids in zip(texts, own, cut, strict=True)]

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        from .token_counts import _byte_characters

        byte, out = _byte_characters(), []
        special = self.library.get_added_tokens_decoder()
        for nr in range(self.library.get_vocab_size()):
            token = self.library.id_to_token(nr) or ""
            out.append(token.encode() if nr in special else bytes(byte[c] for c in token))
        return out


class SentencePiece:
    """A model of the ``sentencepiece`` library that puts a blank before a
    text and changes nothing else in it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.can_cut = not any(BLANK_MARK in name.lstrip(BLANK_MARK) for name in self.names)
        self.tokens = [bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace(BLANK_MARK, " ").encode()
                       for i, n in enumerate(self.names)]
        self.recurring = Recurring(lambda segments: [self.whole(s[1:]) for s in segments], self.tokens, False)

    def whole(self, text: str) -> bytes:
        return packed(self.library.encode(text))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, the library's blank before it."""
        own = [not t or not self.can_cut or BLANK_MARK in t for t in texts]
        cut = self.recurring.ids(["" if alone else " " + t for t, alone in zip(texts, own, strict=True)])
        return [self.whole(t) if alone else ids for t, alone, ids in zip(texts, own, cut, strict=True)]


_LOADED: dict[tuple, object] = {}


def loaded(kind: type, path: str, *more):
    """``ByteLevel`` or ``SentencePiece`` of a file, made once in a Python worker."""
    key = (kind.__name__, path, *more)
    if key not in _LOADED:
        _LOADED[key] = kind(path, *more)
    return _LOADED[key]
