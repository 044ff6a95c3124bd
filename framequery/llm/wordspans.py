"""Places of words in the UTF-8 bytes of Arrow texts, and checksums of the words, with NumPy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

from .textbytes import PIECE, byte_table

#: Words up to so many bytes are checked together, a byte of each at a time; longer ones are few and go one by one.
SHORT_WORD = 48


def _crc_table() -> np.ndarray:
    """The table of CRC-32, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def pieces(data: np.ndarray, start: int, end: int, ends_piece: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """A text (data from start to end) in pieces that end with a byte of ``ends_piece`` (a table of 256), each the shortest of ``size`` bytes or more."""
    at = start
    while end - at > size:
        cut, look = end, at + size - 1
        while look < end:
            found = np.flatnonzero(ends_piece[data[look : look + PIECE]])
            if len(found):
                cut = min(end, look + int(found[0]) + 1)
                break
            look += PIECE
        yield at, cut
        at = cut
    if at < end or start == end:
        yield at, end


class Words:
    """Words as maximal runs of the bytes ``word``; A-Z read as a-z where ``lower``."""

    def __init__(self, word: bytes, lower: bool = True):
        self.is_word, self.folded = byte_table(word, lower)

    def spans(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of texts that lie one after another in ``data``; a new text begins a new word."""
        first, last = int(offsets[0]), int(offsets[-1])
        edges, before = [], False
        for at in range(first, last, PIECE):
            inside = self.is_word[data[at : min(at + PIECE, last)]]
            changed = np.empty(len(inside), bool)
            changed[0] = inside[0] != before
            np.not_equal(inside[1:], inside[:-1], out=changed[1:])
            edges.append(np.flatnonzero(changed) + at)
            before = bool(inside[-1])
        edges.append(np.full(int(before), last))
        edge = np.concatenate(edges)
        starts, ends = edge[0::2], edge[1::2]
        cuts = np.unique(offsets[(offsets > first) & (offsets < last)])
        split = cuts[self.is_word[data[cuts]] & self.is_word[data[cuts - 1]]]
        if len(split):
            starts, ends = (np.sort(np.concatenate([x, split])) for x in (starts, ends))
        return starts, ends

    def crc32(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """CRC-32 of each folded word, carried on from the checksums ``before``."""
        crc = ~(np.zeros(len(starts), np.uint32) if before is None else before)
        length = ends - starts
        order = np.argsort((255 - np.minimum(length, SHORT_WORD + 1)).astype(np.uint8), kind="stable")
        ranked = length[order]
        long = int(np.searchsorted(-ranked, -SHORT_WORD, "left"))
        state, at = crc[order], starts[order]
        for i in range(int(min(ranked[long], SHORT_WORD)) if long < len(ranked) else 0):
            n = int(np.searchsorted(-ranked, -i, "left"))  # words of more than i bytes
            live = state[long:n]
            state[long:n] = _CRC[(live ^ self.folded[data[at[long:n] + i]]) & np.uint32(255)] ^ (live >> np.uint32(8))
        crc[order] = state
        crc = ~crc
        for k in order[:long].tolist():
            old = 0 if before is None else int(before[k])
            crc[k] = zlib.crc32(self.folded[data[starts[k] : ends[k]]].tobytes(), old)
        return crc


def space_after(crc: np.ndarray) -> np.ndarray:
    """Checksums carried on by one space."""
    crc = ~crc
    return ~(_CRC[(crc ^ np.uint32(32)) & np.uint32(255)] ^ (crc >> np.uint32(8)))
