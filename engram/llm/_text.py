"""Vectorised word splitting and hashing over raw UTF-8 bytes (NumPy), shared by the text operators.

All functions work on a *chunk*: the concatenated bytes of whole documents with their offsets. Word
classes only depend on ASCII bytes, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x80:] = True
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

#: Byte values under which words are told apart as they are, or regardless of the case of A-Z.
EXACT = np.arange(1, 257, dtype=np.uint64)
FOLDED = EXACT[LOWER]
#: Odd numbers for combining hashes, and two bases of the hash family below.
BASE = U64(0x9E3779B97F4A7C15)
MULTIPLIERS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
P = U64((1 << 61) - 1)
BASES = [int(x) % ((1 << 61) - 3) + 2 for x in _rng.integers(1, 2**62, 2)]
_LOW32, _LOW29 = U64((1 << 32) - 1), U64((1 << 29) - 1)
#: Bytes that a prefix sum may differ by: 2**8 * 2**32 * 2**23 stays under 2**64.
RANGE = 1 << 23
_powers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def codes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one number."""
    code = data.astype(U64)
    for size in (1, 2, 4):
        code = code[: max(len(code) - size, 0)] | (code[size:] << U64(8 * size))
    return code


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & P) + (x >> U64(61))
    return np.where(x >= P, x - P, x)


def mulmod(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo 2**61 - 1, by halves of 32 bits."""
    al, ah, bl, bh = a & _LOW32, a >> U64(32), b & _LOW32, b >> U64(32)
    middle, low = ah * bl + al * bh, al * bl
    return _fold(ah * bh * U64(8) + (middle >> U64(29)) + ((middle & _LOW29) << U64(32)) + (low & P) + (low >> U64(61)))


def powers(n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE**i for i < n, as upper and lower 32 bits, and BASE**-i, modulo 2**61 - 1."""
    if family not in _powers or n > len(_powers[family][0]):
        size, base = max(n, CHUNK_BYTES + 1), BASES[family]
        tables = []
        for b in (base, pow(base, -1, int(P))):
            table = np.ones(1, U64)
            while len(table) < size:
                table = np.concatenate((table, mulmod(table, U64(pow(b, len(table), int(P))))))
            tables.append(table[:size])
        _powers[family] = (tables[0] >> U64(32), tables[0] & _LOW32, tables[1])
    return _powers[family]


class Names:
    """Names of byte ranges of `data`: a polynomial in a random base modulo the prime 2**61 - 1, mixed. Two different ranges of n bytes
    agree for at most n of the 2**61 bases, whatever is in them; the two families have independent bases."""

    def __init__(self, data: np.ndarray, values: np.ndarray, family: int = 0):
        n = len(data)
        high, low, self.down = powers(n + 1, family)
        letters = values[data]
        self.high, self.low = np.zeros(n + 1, dtype=U64), np.zeros(n + 1, dtype=U64)
        np.cumsum(letters * high[:n], out=self.high[1:])
        np.cumsum(letters * low[:n], out=self.low[1:])

    def _sum(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high, low = self.high[ends] - self.high[starts], self.low[ends] - self.low[starts]
        # high * 2**32 + low; high has at most 60 bits.
        high = _fold(high)
        return _fold((high >> U64(29)) + ((high & _LOW29) << U64(32)) + (low & P) + (low >> U64(61)))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts
        total = self._sum(starts, np.minimum(ends, starts + RANGE))
        for i in np.flatnonzero(sizes > RANGE).tolist():
            for at in range(int(starts[i]) + RANGE, int(ends[i]), RANGE):
                total[i] = _fold(total[i : i + 1] + self._sum(np.array([at]), np.array([min(at + RANGE, int(ends[i]))])))[0]
        return mix(mulmod(total, self.down[starts]) + sizes.astype(U64) * MULTIPLIERS[63])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Chunk:
    """Bytes of some whole documents. bounds[i]:bounds[i + 1] are those of document i; first is its row."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and first word index of each document (one more entry than documents)."""
        flags = is_word[self.data]
        edge = np.zeros(len(flags) + 1, dtype=bool)
        inner = self.bounds[1:-1]
        before = np.empty(len(flags), dtype=bool)
        if len(flags):
            before[0] = False
            before[1:] = flags[:-1]
            before[inner[inner < len(flags)]] = False
        starts = np.flatnonzero(flags & ~before)
        after = edge[:-1]
        if len(flags):
            after[:-1] = flags[1:]
            last = inner[inner > 0] - 1
            after[last] = False
        ends = np.flatnonzero(flags & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, family: int = 0) -> np.ndarray:
        """A 64-bit name of each byte range (see Names)."""
        return Names(self.data, values, family).of(starts, ends)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts an Arrow text column (null: empty) into chunks of about `limit` bytes of whole documents."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield Chunk(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], row)
        row = stop


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words of one document; of fewer words, the whole sequence; of none, nothing."""
    k = min(n, len(hashes))
    if not k:
        return hashes
    total = np.full(len(hashes) - k + 1, k, dtype=U64) * MULTIPLIERS[62]
    for j in range(k):
        total += hashes[j : len(hashes) - k + 1 + j] * MULTIPLIERS[j]
    return mix(total)
