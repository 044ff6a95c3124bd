"""Image decoding against encoders written here, drawing, sampling and the other runtimes' factories."""

import struct
import zlib

import numpy as np
import pytest

from framequery.functions import images, pixels
from framequery.operators import other_models, scoring

RNG = np.random.default_rng(4)


def _png(img, colour, filters, palette=None):
    h, w, c = img.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw, above = b"", np.zeros(w * c, int)
    for y in range(h):
        line = img[y].reshape(-1).astype(int)
        left = np.concatenate([np.zeros(c, int), line[:-c]])
        corner = np.concatenate([np.zeros(c, int), above[:-c]])
        p = left + above - corner
        near = np.argmin(np.stack([abs(p - left), abs(p - above), abs(p - corner)]), axis=0)
        guess = {0: 0, 1: left, 2: above, 3: (left + above) // 2, 4: np.choose(near, [left, above, corner])}[filters[y % len(filters)]]
        raw += bytes([filters[y % len(filters)]]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"")
    return b"\x89PNG\r\n\x1a\n" + body + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0]])
def test_png(filters):
    rgb = RNG.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (images.decode(_png(rgb, 2, filters)) == rgb[:, :, ::-1]).all()
    alpha = np.dstack([rgb, RNG.integers(0, 256, (7, 5)).astype(np.uint8)])
    assert (images.decode(_png(alpha, 6, filters)) == rgb[:, :, ::-1]).all()
    gray = rgb[:, :, :1]
    assert (images.decode(_png(gray, 0, filters)) == gray).all()
    palette = RNG.integers(0, 256, (9, 3)).astype(np.uint8)
    places = RNG.integers(0, 9, (7, 5, 1)).astype(np.uint8)
    assert (images.decode(_png(places, 3, filters, palette)) == palette[places[:, :, 0]][:, :, ::-1]).all()
    assert (images.decode(images.encode_png(rgb)) == rgb).all()


def test_bmp_and_pnm():
    bgr = RNG.integers(0, 256, (4, 3, 3)).astype(np.uint8)
    lines = b"".join(bgr[y].tobytes() + b"\0" * 3 for y in range(3, -1, -1))
    assert (images.decode(b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(lines), 0, 0, 54, 40, 3, 4, 1, 24, 0, len(lines), 0, 0, 0, 0) + lines) == bgr).all()
    assert (images.decode(b"P6\n# note\n3 4\n255\n" + bgr[:, :, ::-1].tobytes()) == bgr).all()


@pytest.mark.parametrize("raw", [None, b"", b"nothing", images.encode_png(np.zeros((3, 3, 3), np.uint8))[:-20], b"BM12", b"P6 3", _png(np.full((2, 2, 1), 9, np.uint8), 3, [0], np.zeros((2, 3), np.uint8))])
def test_broken_images(raw):
    with pytest.raises(ValueError):
        images.decode(raw)


def test_other_formats_are_registered():
    images.register_format(b"XX", lambda raw: np.full((1, 1, 3), raw[2], np.uint8))
    assert images.decode(b"XX\7")[0, 0, 0] == 7


def test_annotation_and_sampling():
    img = np.zeros((60, 80, 3), np.uint8)
    out = pixels.annotate(img, [(10, 30, 30, 50, "A1")])
    assert not img.any() and tuple(out[30, 10]) == (0, 255, 0) and tuple(out[40, 20]) == (0, 0, 0)
    label = out[14:28, 10:26]
    assert (label == (0, 255, 0)).all(axis=2).any() and (label == 0).all(axis=2).any()
    ramp = np.arange(12.0).reshape(3, 4, 1)
    assert (pixels.nearest(ramp, 2)[::2, ::2] == ramp).all()
    x, y = np.array([0.125, 0.25, 0.99]), np.array([0.5 / 3, 0.5, 0.99])
    assert np.allclose(pixels.sample(ramp, x[:2], y[:2])[:, 0], [0.0, 4.5])
    assert (pixels.sample(ramp, x, y, discrete=True)[:, 0] == [0, 5, 11]).all()


def test_runtimes_that_are_absent_say_so():
    for name in ("openvino", "pytorch", "paddle"):
        factory = scoring.resolve("detector", name)
        with pytest.raises(RuntimeError, match="needs the package"):
            getattr(other_models, factory.partition(":")[2])(path="none")


def test_distortion_leaves_grey_and_follows_colours():
    import colorsys

    img = RNG.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    assert (pixels.distorted(img, None, None, None, None, True) == img).all()
    grey = np.repeat(img[:, :, :1], 3, axis=2)
    assert (pixels.distorted(grey, None, None, 1.4, 0.03, False) == grey).all()
    assert (pixels.distorted(img, 1.1, None, None, None, True) == np.clip(np.floor(img * 1.1 + 0.5), 0, 255)).all()
    for turn in (-0.05, 0.02, 0.4):
        out = pixels.turned_hue(img, turn)
        for y, x in np.ndindex(6, 5):
            b, g, r = img[y, x] / 255
            h, s, v = colorsys.rgb_to_hsv(r, g, b)
            want = np.array(colorsys.hsv_to_rgb((h + turn) % 1, s, v)[::-1]) * 255
            assert np.abs(out[y, x] - want).max() <= 0.51
    light = float((img @ pixels.GREY).mean())
    assert np.abs(pixels.distorted(img, None, 0.5, None, None, False) - (img * 0.5 + light / 2)).max() <= 0.51
    first, last = (pixels.distorted(img, 0.9, 1.5, 0.5, 0.04, f) for f in (True, False))
    assert (first != last).any()


def test_backends_are_imported_only_where_they_run():
    import subprocess
    import sys

    code = "import sys\nfrom framequery.operators import scoring\nscoring.resolve('detector', 'onnx')\nprint([m for m in ('onnxruntime', 'openvino', 'torch', 'framequery.operators.onnx_models') if m in sys.modules])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "[]"
