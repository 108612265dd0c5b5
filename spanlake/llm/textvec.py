"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Words and lines are found and hashed for many documents at once with numpy;
no Python string is made for them. Words are hashed by blocks of eight bytes with
a mixing step after each, runs of words by a polynomial of such hashes, so equal
hashes of unlike runs are chance (2**-64). Where equality must be certain,
callers compare bytes (unlike()) or digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE_BYTES = 1 << 18
#: Bytes of the longest span that is hashed by blocks.
LONG = 256

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, kept for the largest n asked for."""
    if 0 not in _powers or len(_powers[0][0]) < n:
        size = max(n, SLICE_BYTES)
        up, down = np.full(size, BASE, U), np.full(size, BASE_INVERSE, U)
        up[0] = down[0] = 1
        _powers[0] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _powers[0][0][:n], _powers[0][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def lower_table(separators: bytes | None = None, word: bytes = b"") -> np.ndarray:
    """Byte -> lower-cased byte (A-Z only), 0 for separators. Given word
    instead, all ASCII bytes outside it separate."""
    t = np.arange(256, dtype=np.uint8)
    t[ord("A") : ord("Z") + 1] += 32
    if separators is None:
        for b in range(128):
            if t[b] not in word:
                t[b] = 0
    else:
        t[list(separators)] = 0
    return t


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text with A-Z lower-cased.
ALNUM = lower_table(word=b"0123456789abcdefghijklmnopqrstuvwxyz")
#: Words [^\x20\x09-\x0D]+ of text with A-Z lower-cased. A NUL byte inside a
#: word reads as 0xFF, which no UTF-8 text holds, since 0 marks separators.
SPACED = lower_table(separators=b" \t\n\x0b\x0c\r")
SPACED[0] = 255


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about limit
    bytes; a longer row comes alone. Null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """The words of some documents: byte bounds, hash, and each document's
    first word (first has one more entry than there are documents)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray):
        self.bytes = t = table[data]
        n = len(t)
        inside = t != 0
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        edge = before[:-1] & ~cut[:-1]
        self.start = np.flatnonzero(inside & ~edge)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & ~(after & ~cut[1:])) + 1
        self.first = np.searchsorted(self.start, offs)
        self.hash = span_hash(t, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """Each word's document."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each one to its document's end."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.start))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, joined by single spaces."""
        return b" ".join(self.bytes[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j]))


def blocks_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as uint64; zeros follow its end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


#: The first n bytes of a block.
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """uint64 hashes of data[start:end] for many spans, mixed block by block, so no
    sum of blocks can cancel out. Spans of up to eight bytes without a zero byte
    have a hash each; those over LONG are hashed by blake2b."""
    if not len(start):
        return np.zeros(0, U)
    length = end - start
    block = blocks_at(data)
    h = mix((block[start] & _HEAD[np.minimum(length, 8)]) ^ BASE)
    more = np.flatnonzero(length > 8)
    for at in range(8, LONG, 8):
        more = more[length[more] > at]
        if not len(more):
            break
        h[more] = mix(h[more] * BASE + mix(block[start[more] + at] & _HEAD[np.minimum(length[more] - at, 8)]) + U(at))
    for i in more[length[more] > LONG].tolist() if len(more) else ():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def unlike(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which spans differ in their bytes from the span whose number other gives."""
    length = end - start
    out = length != length[other]
    block = blocks_at(data)
    live = np.flatnonzero(~out & (np.arange(len(start)) != other))
    at = 0
    while len(live):
        head = _HEAD[np.minimum(length[live] - at, 8)]
        bad = (block[start[live] + at] ^ block[start[other[live]] + at]) & head != 0
        out[live[bad]] = True
        at += 8
        live = live[~bad & (length[live] > at)]
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k values; shorter by k - 1. Runs across documents
    are included; callers drop them by Words.left."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, U)
    for i in range(k):
        out = out * BASE + h[i : i + n]
    return mix(out + U(k))
