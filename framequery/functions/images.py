"""Image bytes to BGR pixels and back, in NumPy: PNG, BMP and binary PNM. Other formats come by registration."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

_OTHERS: dict[bytes, Callable[[bytes], np.ndarray]] = {}
_PNG = b"\x89PNG\r\n\x1a\n"


def register_format(start: bytes, decoder: Callable[[bytes], np.ndarray]) -> None:
    """Have files that begin with ``start`` decoded by a function bytes -> BGR uint8 [h, w, 3]."""
    _OTHERS[start] = decoder


def decode(raw: bytes | None) -> np.ndarray:
    """BGR uint8 [h, w, 3]; ValueError for anything that can't be read."""
    raw = bytes(raw or b"")
    for start, decoder in _OTHERS.items():
        if raw.startswith(start):
            return decoder(raw)
    try:
        if raw.startswith(_PNG):
            return _png(raw)
        if raw.startswith(b"BM"):
            return _bmp(raw)
        if raw[:2] in (b"P5", b"P6"):
            return _pnm(raw)
    except (struct.error, zlib.error, IndexError, TypeError) as e:
        raise ValueError(f"broken image: {e}") from e
    raise ValueError("not an image of a known format")


def _png(raw: bytes) -> np.ndarray:
    at, body, palette, head = len(_PNG), [], None, None
    while at + 12 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        chunk = raw[at + 8 : at + 8 + size]
        if len(chunk) < size or zlib.crc32(kind + chunk) != struct.unpack_from(">I", raw, at + 8 + size)[0]:
            raise ValueError("broken PNG chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + size
    if head is None:
        raise ValueError("PNG without a header")
    w, h, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or channels is None or not w or not h:
        raise ValueError("PNG of a kind that is not read")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if lines.size != h * (1 + w * channels):
        raise ValueError("PNG of a wrong length")
    lines = lines.reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.uint8)
    for y in range(h):
        above = out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, channels)
    pixels = out.reshape(h, w, channels)
    if colour == 3:
        if palette is None or int(pixels.max()) >= len(palette):
            raise ValueError("PNG colour outside its palette")
        pixels = palette[pixels[:, :, 0]]
    elif channels < 3:
        pixels = pixels[:, :, :1].repeat(3, axis=2)
    return np.ascontiguousarray(pixels[:, :, 2::-1])


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind not in (3, 4):
        raise ValueError("PNG filter is not known")
    out = [0] * (len(line) + step)
    for i, (x, b) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        a, c = out[i], int(above[i - step]) if i >= step else 0
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i + step] = (x + guess) & 255
    return np.array(out[step:], np.uint8)


def _bmp(raw: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", raw, 10)[0]
    w, h, _, depth, packed = struct.unpack_from("<iiHHI", raw, 18)
    if depth not in (24, 32) or packed or w <= 0 or not h:
        raise ValueError("BMP of a kind that is not read")
    row = (w * depth // 8 + 3) // 4 * 4
    data = np.frombuffer(raw, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, :3]
    return np.ascontiguousarray(data[::-1] if h > 0 else data)


def _pnm(raw: bytes) -> np.ndarray:
    head, at = [], 2
    while len(head) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        head.append(int(raw[at:end]))
        at = end
    (w, h, most), channels = head, 3 if raw[:2] == b"P6" else 1
    if most != 255 or not w or not h:
        raise ValueError("PNM of a kind that is not read")
    pixels = np.frombuffer(raw, np.uint8, w * h * channels, at + 1).reshape(h, w, channels)
    return np.ascontiguousarray(pixels[:, :, ::-1] if channels == 3 else pixels.repeat(3, axis=2))


def encode_png(img: np.ndarray) -> bytes:
    """A BGR image as PNG."""
    h, w = img.shape[:2]
    lines = np.zeros((h, 1 + 3 * w), np.uint8)
    lines[:, 1:] = img[:, :, ::-1].reshape(h, 3 * w)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
