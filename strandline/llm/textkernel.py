"""Vectorised word hashing over UTF-8 bytes.

Word separators are ASCII only, so words can be found on bytes: no byte of a
multi-byte character is below 0x80.  Hashes are 64-bit and are used to find
candidates; callers confirm on the words themselves where a result depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
PART_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_table(kind: str) -> np.ndarray:
    """True for bytes of words. "alnum": digits, letters and all bytes from 0x80;
    "space": all but ASCII white space.  Upper-case bytes count as lower case."""
    t = np.zeros(256, bool)
    if kind == "alnum":
        t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    elif kind == "space":
        t[:] = True
        t[0x20] = t[0x09:0x0E] = False
    else:
        raise ValueError(kind)
    return t


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = np.full(PART_BYTES + 1, _P, np.uint64)
    q = np.full(PART_BYTES + 1, pow(_P, -1, 1 << 64), np.uint64)
    p[0] = q[0] = 1
    code = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
    code[0x41:0x5B] = code[0x61:0x7B]
    return np.multiply.accumulate(p), np.multiply.accumulate(q), code


def strings(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def grouped(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded size together; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each of the ordered spans, upper case as lower, in parts of
    bounded size: differences of running sums, brought to a common power."""
    powers, inverse, code = _powers()
    out = np.empty(len(start), np.uint64)
    i, n = 0, len(start)
    while i < n:
        a = start[i]
        j = int(np.searchsorted(end, a + PART_BYTES, side="right"))
        if j <= i:  # one span longer than a part: fold its parts
            h = np.uint64(0)
            for k in range(a, end[i], PART_BYTES):
                piece = code[raw[k : min(k + PART_BYTES, end[i])]]
                h = mix(np.array([h], np.uint64) + (piece * powers[: len(piece)]).sum(dtype=np.uint64))[0]
            out[i], i = h, i + 1
            continue
        b = end[j - 1]
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(code[raw[a:b]] * powers[: b - a], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


class Words:
    """Words of a run of texts: where each starts and ends in ``buf``, its hash,
    and in ``of`` the index of the first word of each text (one more at the end)."""

    def __init__(self, texts: list[bytes], kind: str):
        self.buf = b" ".join(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lens + 1) - (lens + 1)
        table = word_table(kind)
        raw = np.frombuffer(self.buf, np.uint8)
        isw = np.concatenate([[False], table[raw], [False]])
        edge = np.flatnonzero(isw[1:] != isw[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.hash = span_hashes(raw, self.start, self.end)
        self.of = np.searchsorted(self.start, np.append(begins, len(raw) + 1))

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].lower()

    def joined(self, i: int, j: int) -> bytes:
        return b" ".join(self.word(k) for k in range(i, j))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each position; those across texts have no meaning.

        Sums of word hashes times powers of _P; the sum over a + b words comes from
        those over a and over b, so k takes about log2(k) passes.
        """
        n = len(self) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        total, size, run, width, rest = None, 0, self.hash, 1, k
        while rest:
            if rest & 1:
                total, size = (run, width) if total is None else (total[: len(run) - size] * np.uint64(pow(_P, width, 1 << 64)) + run[size : size + len(total)], size + width)
            rest >>= 1
            if rest:
                run, width = run[:-width] * np.uint64(pow(_P, width, 1 << 64)) + run[width:], 2 * width
        return mix(total[:n] + np.uint64(k * pow(_P, k, 1 << 64) % (1 << 64)))

    def whole(self, d: int) -> np.uint64:
        """Hash of all words of text d, as grams() makes it for that many words."""
        h = np.uint64(self.of[d + 1] - self.of[d])
        with np.errstate(over="ignore"):
            for x in self.hash[self.of[d] : self.of[d + 1]]:
                h = h * np.uint64(_P) + x
        return mix(np.array([h], np.uint64))[0]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        if len(x) <= step:
            return x[:0]
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x
