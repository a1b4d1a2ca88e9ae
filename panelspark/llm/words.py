"""Words, lines and their 64-bit hashes for a whole Arrow batch of texts, in numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D, so words are found on
the UTF-8 buffer itself; no Python string is built. Hashes are polynomial (mod 2**64) over
random byte values and finished by a mixer; they are the same on every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled in one numpy step; a single longer text is one step of its own.
STEP_BYTES = 2 << 20
#: Bytes hashed at once (a longer span is hashed in one piece).
BLOCK = 1 << 18

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Byte maps for ``Words``: A-Z to lower case; and all ASCII but letters and digits to spaces besides.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, grown on demand and never sent to workers."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK * 2)
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def steps(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes of text (or one row)."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, bounds of each text); null is empty."""
    arr = pc.fill_null(col, "")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    off = np.frombuffer(arr.buffers()[1], dtype=width)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; spans are ascending and do not overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, a + BLOCK, side="right")))
        b = int(end[j - 1])
        up, down = _POWERS.to(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[a:b]] * up[:b - a], out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


class Words:
    """Words of each text of a batch.

    ``ptr``: word bounds of each text; ``start``, ``end``: byte bounds in ``data``;
    ``doc``: text of each word; ``hash``: 64 bits a word.
    """

    def __init__(self, col: pa.Array, fold: np.ndarray | None = None, hashed: bool = True):
        self.data, self.bounds = text_bytes(col)
        if fold is not None:
            self.data = fold[self.data]
        n = len(self.data)
        inside = ~_IS_SPACE[self.data]
        first = inside.copy()
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.bounds] = True
        if n:
            first[1:] &= ~inside[:-1] | cut[1:n]
            last = inside.copy()
            last[:-1] &= ~inside[1:] | cut[1:n]
        else:
            last = inside
        self.inside = inside
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.start, self.bounds)
        self.count = np.diff(self.ptr)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        if hashed:
            self.hash = span_hash(self.data, self.start, self.end)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of every line cut at newlines, empty lines too."""
        nl = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.bounds, nl, side="right") - 1
        start = np.concatenate([self.bounds[:-1], nl + 1])
        end = np.concatenate([self.bounds[1:], nl])
        text = np.concatenate([np.arange(len(self.count)), owner])
        order = np.lexsort((start, text))
        # each text's lines start at its start and after each newline, and end at each newline and at its end
        ends = np.lexsort((end, text))
        return start[order], end[ends], text[order]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive items from each position (length len(h) - n + 1)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= np.uint64(_BASE)
        out += h[j:j + m]
    return mix(out + np.uint64(n))


def gram_starts(ptr: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether n items from each position (of total - n + 1) stay within one text."""
    m = max(0, total - n + 1)
    ok = np.ones(m, dtype=bool)
    for j in range(1, n):  # no text may begin at one of the next n - 1 items
        cut = ptr[1:-1] - j
        ok[cut[(cut >= 0) & (cut < m)]] = False
    return ok


def repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs at least twice."""
    if not len(key):
        return np.zeros(0, dtype=bool)
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(key), dtype=bool)
    hit[1:] = same
    hit[:-1] |= same
    out = np.empty(len(key), dtype=bool)
    out[order] = hit
    return out


def covered(total: int, start: np.ndarray, length: int) -> np.ndarray:
    """Whether each of ``total`` items lies in a run of ``length`` items from some start."""
    step = np.bincount(start, minlength=total + 1) - np.bincount(start + length, minlength=total + 1)[:total + 1]
    return np.cumsum(step)[:total] > 0


def per_text(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ptr])
