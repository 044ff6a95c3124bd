"""Texts of Arrow batches as UTF-8 bytes in NumPy, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes worked on at once, so that the arrays of a step stay in the processor's cache; a single longer text is cut at a
#: word end where possible.
PIECE = 1 << 17


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, data) of a string column; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def row_groups(offsets: np.ndarray, limit: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have at most ``limit`` bytes together, or one longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def byte_table(word: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is_word, folded): for each byte whether it belongs to words, and the byte with A-Z lowered."""
    is_word = np.zeros(256, bool)
    is_word[list(word)] = True
    folded = np.arange(256, dtype=np.uint8)
    if lower:
        folded[65:91] += 32
    return is_word, folded


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHasher:
    """64-bit hashes of the words of UTF-8 texts, by prefix sums: no per-word Python work."""

    def __init__(self, word: bytes, lower: bool = True, seed: int = 0):
        self.is_word, folded = byte_table(word, lower)
        rng = np.random.Generator(np.random.PCG64(1234 + seed))
        self.value = rng.integers(0, 1 << 63, 256, dtype=U64)[folded] * U64(2) + U64(1)
        self.base = int(rng.integers(1 << 61, 1 << 62)) * 4 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.size = 0

    def _powers(self, n: int) -> None:
        if n <= self.size:
            return
        n = max(n, PIECE + 1)
        for name, base in (("power", self.base), ("unpower", self.inverse)):
            out = np.full(n, base & (2**64 - 1), U64)
            out[0] = 1
            setattr(self, name, np.cumprod(out, dtype=U64))
        self.size = n

    def words(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and for each text where its words begin (one more at the end)."""
        hashes, starts_of = [], []
        at, last = int(offsets[0]), int(offsets[-1])
        while at < last:
            end = self._cut(data, offsets, at, last)
            h, s = self._piece(data[at:end], offsets[(offsets > at) & (offsets < end)] - at)
            hashes.append(h)
            starts_of.append(s + at)
            at = end
        h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        s = np.concatenate(starts_of) if starts_of else np.zeros(0, np.int64)
        return h, np.searchsorted(s, offsets, "left")

    def _cut(self, data: np.ndarray, offsets: np.ndarray, at: int, last: int) -> int:
        """An end for the piece that starts at ``at``, never inside a word."""
        if last - at <= PIECE:
            return last
        top = at + PIECE
        gaps = np.flatnonzero(~self.is_word[data[at:top]])
        edges = offsets[(offsets > at) & (offsets <= top)]
        ends = [at + int(g) + 1 for g in gaps[-1:]] + [int(e) for e in edges[-1:]]
        while not ends and top < last:  # one word longer than a piece
            gaps = np.flatnonzero(~self.is_word[data[top : top + PIECE]])
            edges = offsets[(offsets > top) & (offsets <= top + PIECE)]
            if len(gaps) or len(edges):
                return min([top + int(g) + 1 for g in gaps[:1]] + [int(e) for e in edges[:1]])
            top += PIECE
        return max(ends) if ends else last

    def _piece(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        self._powers(n + 1)
        inside = self.is_word[data]
        edge = np.empty(n + 1, bool)
        edge[0], edge[n] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
        starts = np.flatnonzero(edge[:n] & inside)
        ends = np.flatnonzero(edge[1:] & inside) + 1
        if len(cuts):  # a new text begins a new word
            cuts = np.unique(cuts)  # empty texts repeat an offset
            split = cuts[inside[cuts] & inside[cuts - 1]]
            if len(split):
                starts = np.sort(np.concatenate([starts, split]))
                ends = np.sort(np.concatenate([ends, split]))
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(self.value[data] * self.power[:n], out=total[1:])
        h = (total[ends] - total[starts]) * self.unpower[starts]
        return mix64(h + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)), starts
