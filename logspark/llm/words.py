"""Words of whole texts, as Python lists or as flat numpy arrays.

Two definitions are used by the operators:

* plain words: maximal runs of anything but ASCII white space, unchanged;
* folded words: ASCII letters lower-cased, then maximal runs of ``0-9``,
  ``a-z`` and characters above U+007F.

Both only cut at ASCII bytes, so they are found in UTF-8 directly.  Null
texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PLAIN_SQL = r"[^\x20\x09-\x0D]+"
FOLDED_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FOLD = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    _FOLD[_b] = ord(_c.lower()) if _c.isalnum() else 0x20
FOLD = bytes(_FOLD)

IS_PLAIN = np.ones(256, bool)
IS_PLAIN[[0x20, *range(0x09, 0x0E)]] = False
IS_FOLDED = np.frombuffer(FOLD, np.uint8) != 0x20


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def folded_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``limit`` bytes of text, one
    row at least, so that working arrays stay small."""
    if not batch.num_rows:
        return
    offsets, _ = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or data is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    return off - off[0], np.frombuffer(data, np.uint8)[off[0]:off[-1]]


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED_BYTE = _BYTE[np.frombuffer(FOLD, np.uint8)]
_R = np.uint64(0x9E3779B97F4A7C15)                        # odd: invertible modulo 2**64
_R_INV = np.uint64(pow(int(_R), -1, 2**64))
_STEP = 1 << 19


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        _POW[:] = [powers(_R, n), powers(_R_INV, n)]
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat_words(column: pa.Array, folded: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a column, in order, and for each row
    the place of its first word (with one more entry for the end)."""
    offsets, data = utf8(column)
    n = len(data)
    first = np.zeros(len(offsets), np.int64)
    if not n:
        return np.zeros(0, np.uint64), first
    inside = (IS_FOLDED if folded else IS_PLAIN)[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~(before & ~cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & ~(after & ~cut[1:])) + 1
    table = _FOLDED_BYTE if folded else _BYTE
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):                               # blocks of whole words
        end = max(int(np.searchsorted(ends, starts[at] + _STEP, "right")), at + 1)
        lo, hi = int(starts[at]), int(ends[end - 1])
        power, inverse = _tables(hi - lo + 1)
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[data[lo:hi]] * power[:hi - lo], out=total[1:])
        s, e = starts[at:end] - lo, ends[at:end] - lo
        out[at:end] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = end
    first[:] = np.searchsorted(starts, offsets)
    return mix(out), first


def sequence_hash(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive values (rows are not
    heeded; callers drop runs that cross one)."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out *= _R
        out += values[k:k + n]
    return mix(out)
