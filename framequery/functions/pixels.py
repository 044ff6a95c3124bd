"""Pixel work on BGR images in NumPy, for use inside Arrow functions.

Resizing is bilinear with half-pixel centres; it is not meant to equal any image
library to the last bit.
"""

from __future__ import annotations

import numpy as np

PAD_VALUE = 114


def image(data: bytes, height: int, width: int, channels: int = 3) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    def places(new: int, old: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    y0, y1, fy = places(height, img.shape[0])
    x0, x1, fx = places(width, img.shape[1])
    fx = fx[None, :, None]
    top = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx
    low = img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx
    out = top * (1 - fy[:, None, None]) + low * fy[:, None, None]
    return np.rint(out).astype(np.uint8) if img.dtype == np.uint8 else out


def nearest(img: np.ndarray, factor: int) -> np.ndarray:
    """Enlarged by a whole factor, each pixel repeated."""
    return img.repeat(factor, axis=0).repeat(factor, axis=1)


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray, discrete: bool = False) -> np.ndarray:
    """Values at places in 0..1 of the image (pixel centres at (i + 0.5) / size): bilinear, 0 outside, or the nearest pixel."""
    h, w = img.shape[:2]
    if discrete:
        return img[np.clip((y * h).astype(int), 0, h - 1), np.clip((x * w).astype(int), 0, w - 1)].astype(float)
    px, py = x * w - 0.5, y * h - 0.5
    x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
    out = np.zeros((len(x), *img.shape[2:]))
    for dy in (0, 1):
        for dx in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            share = np.abs(1 - dx - (px - x0)) * np.abs(1 - dy - (py - y0))
            there = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
            out[there] += share[there].reshape(-1, *[1] * (img.ndim - 2)) * img[yi[there], xi[there]]
    return out


def fitted(w: int, h: int, side: int) -> tuple[float, tuple[int, int], tuple[int, int]]:
    """How a w x h image goes into a square: ratio, new size, padding at left and top."""
    ratio = min(side / w, side / h)
    new = int(w * ratio), int(h * ratio)
    return ratio, new, ((side - new[0]) // 2, (side - new[1]) // 2)


def letterbox(img: np.ndarray, side: int) -> tuple[np.ndarray, float, int, int]:
    """(square image, ratio, left padding, top padding)."""
    ratio, (w, h), (left, top) = fitted(img.shape[1], img.shape[0], side)
    out = np.full((side, side, img.shape[2]), PAD_VALUE, np.uint8)
    out[top : top + h, left : left + w] = resize(img, w, h)
    return out, ratio, left, top


def detector_input(img: np.ndarray) -> np.ndarray:
    """float32 [1, 3, S, S], RGB in 0..1."""
    return np.ascontiguousarray(img[:, :, ::-1].transpose(2, 0, 1)[None], np.float32) / 255


def recognizer_widths(w: int, h: int, rec_h: int = 48, rec_w: int = 320, max_w: int = 3200) -> tuple[int, int]:
    """(input width, width of the resized crop) for a crop of w x h."""
    wide = int(rec_h * max(rec_w / rec_h, w / h))
    return min(wide, max_w), min(wide, max_w, int(np.ceil(rec_h * w / h)))


def crop(img: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """The region, empty where the box is empty or lies outside; negative ends never wrap."""
    x1, y1, x2, y2 = (max(0, v) for v in (x1, y1, x2, y2))
    return img[y1:y2, x1:x2]


def recognizer_input(img: np.ndarray, rec_h: int = 48, rec_w: int = 320, max_w: int = 3200) -> np.ndarray:
    """float32 [3, h, w] in -1..1, padded with 0 at the right."""
    full, scaled = recognizer_widths(img.shape[1], img.shape[0], rec_h, rec_w, max_w)
    out = np.zeros((3, rec_h, full), np.float32)
    out[:, :, :scaled] = (resize(img, scaled, rec_h).transpose(2, 0, 1).astype(np.float32) / 255 - 0.5) / 0.5
    return out


# The shares of blue, green and red in grey.
GREY = np.array([0.114, 0.587, 0.299])


def equalized_gray(img: np.ndarray, longest: int) -> np.ndarray:
    """Long side limited, luminance equalised by its histogram, back to three channels."""
    h, w = img.shape[:2]
    if max(h, w) > longest:
        ratio = longest / max(h, w)
        img = resize(img, max(1, int(w * ratio)), max(1, int(h * ratio)))
    gray = np.rint(img @ GREY).astype(np.uint8)
    total = np.bincount(gray.ravel(), minlength=256).cumsum()
    first = total[np.flatnonzero(total)[0]]
    if total[-1] > first:
        gray = np.clip(np.rint((total - first) * 255.0 / (total[-1] - first)), 0, 255).astype(np.uint8)[gray]
    return np.repeat(gray[:, :, None], 3, axis=2)


def _rounded(img: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(img + 0.5), 0, 255).astype(np.uint8)


def turned_hue(img: np.ndarray, turn: float) -> np.ndarray:
    """The colours' angle moved by a share of a whole turn, saturation and value as they were."""
    bgr = img.astype(np.float64) / 255
    top, low = bgr.max(axis=2), bgr.min(axis=2)
    span = top - low
    safe = np.where(span > 0, span, 1.0)
    b, g, r = (bgr[:, :, k] for k in range(3))
    sector = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4))
    hue = (sector / 6 + turn) % 1.0 * 6
    share = lambda n: top - span * np.clip(np.minimum((n + hue) % 6, 4 - (n + hue) % 6), 0, 1)
    return _rounded(np.stack([share(1), share(3), share(5)], axis=2) * 255)


def distorted(img: np.ndarray, brightness: float | None, contrast: float | None, saturation: float | None, hue: float | None, contrast_first: bool) -> np.ndarray:
    """A BGR image with its light, contrast, colours and hue changed; None leaves one alone. Contrast is about the mean grey."""
    out = img
    if brightness is not None:
        out = _rounded(out * brightness)

    def contrasted(x: np.ndarray) -> np.ndarray:
        return x if contrast is None else _rounded(x * contrast + (1 - contrast) * float((x @ GREY).mean()))

    out = contrasted(out) if contrast_first else out
    if saturation is not None:
        out = _rounded(out * saturation + (1 - saturation) * (out @ GREY)[:, :, None])
    if hue is not None:
        out = turned_hue(out, hue)
    return out if contrast_first else contrasted(out)


def draw_rectangle(img: np.ndarray, x1: int, y1: int, x2: int, y2: int, colour: tuple[int, int, int], thickness: int = 2) -> np.ndarray:
    """A copy of the image with a box drawn on it."""
    out, t = img.copy(), thickness
    h, w = img.shape[:2]
    for a, b, c, d in ((x1, y1, x2, y1 + t), (x1, y2 - t, x2, y2), (x1, y1, x1 + t, y2), (x2 - t, y1, x2, y2)):
        out[max(0, b) : min(h, d), max(0, a) : min(w, c)] = colour
    return out


# A 3 x 5 font, a glyph's rows from the top as octal digits (4 left, 2 middle, 1 right).
FONT = {
    "0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71122", "8": "75757", "9": "75717",
    "A": "25755", "B": "65656", "C": "34443", "D": "65556", "E": "74647", "F": "74644", "G": "34553", "H": "55755", "I": "72227", "J": "11152",
    "K": "55655", "L": "44447", "M": "57755", "N": "65555", "O": "25552", "P": "65644", "Q": "25563", "R": "65655", "S": "34216", "T": "72222",
    "U": "55557", "V": "55552", "W": "55775", "X": "55255", "Y": "55222", "Z": "71247", " ": "00000", ".": "00002", ",": "00024", "-": "00700",
    ":": "02020", "/": "11244", "%": "51245", "@": "25743", "_": "00007", "!": "22202", "?": "61202", "'": "22000", "(": "12221", ")": "42224",
}


def text_size(text: str, scale: int = 2) -> tuple[int, int, int]:
    """(width, height, space under the line) of a label."""
    return 4 * scale * len(text), 5 * scale, scale


def draw_text(img: np.ndarray, text: str, x: int, bottom: int, colour: tuple[int, int, int], scale: int = 2) -> None:
    """Writes on the image itself, glyphs standing on ``bottom``; letters as capitals, others as a full box."""
    h, w = img.shape[:2]
    for place, letter in enumerate(text.upper()):
        rows = FONT.get(letter, "77777")
        glyph = np.array([[int(r) >> k & 1 for k in (2, 1, 0)] for r in rows], bool).repeat(scale, 0).repeat(scale, 1)
        for dy, dx in zip(*np.nonzero(glyph), strict=True):
            at_y, at_x = bottom - 5 * scale + dy, x + 4 * scale * place + dx
            if 0 <= at_y < h and 0 <= at_x < w:
                img[at_y, at_x] = colour


def annotate(img: np.ndarray, boxes: list[tuple[int, int, int, int, str]], colour: tuple[int, int, int] = (0, 255, 0)) -> np.ndarray:
    """A copy with each box drawn and its label above it, kept under the image's top, on a ground of the box's colour."""
    out = img.copy()
    for x1, y1, x2, y2, text in boxes:
        out = draw_rectangle(out, x1, y1, x2, y2, colour)
        width, height, under = text_size(text)
        bottom = max(height + under + 2, y1 - 4)
        out[max(0, bottom - height - under) : max(0, bottom + under), max(0, x1) : max(0, x1 + width)] = colour
        draw_text(out, text, x1, bottom, (0, 0, 0))
    return out
