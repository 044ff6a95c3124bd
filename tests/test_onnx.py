"""ONNX models as callables, with tiny models whose bytes are written here: constants behind the expected names."""

import struct

import numpy as np
import pytest

from framequery.functions import pixels
from framequery.operators import onnx_models, other_models

pytest.importorskip("onnxruntime")
FLOAT, INT64 = 1, 7


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _number(field, n):
    return _varint(field << 3) + _varint(n)


def _bytes(field, body):
    body = body.encode() if isinstance(body, str) else body
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _tensor(name, a):
    kind = INT64 if a.dtype == np.int64 else FLOAT
    return b"".join(_number(1, d) for d in a.shape) + _number(2, kind) + _bytes(8, name) + _bytes(9, a.tobytes())


def _value(name, kind, shape):
    dims = b"".join(_bytes(1, _number(1, d) if isinstance(d, int) else _bytes(2, d)) for d in shape)
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, kind) + _bytes(2, dims)))


def model(inputs, outputs):
    """A model that gives constants, whatever it is fed."""
    graph = b""
    for name, a in outputs.items():
        graph += _bytes(1, _bytes(1, f"{name}_value") + _bytes(2, name) + _bytes(4, "Identity"))
    graph += _bytes(2, "constants")
    graph += b"".join(_bytes(5, _tensor(f"{name}_value", a)) for name, a in outputs.items())
    graph += b"".join(_bytes(11, _value(name, kind, shape)) for name, (kind, shape) in inputs.items())
    graph += b"".join(_bytes(12, _value(name, INT64 if a.dtype == np.int64 else FLOAT, a.shape)) for name, a in outputs.items())
    return _number(1, 8) + _bytes(8, _bytes(1, "") + _number(2, 13)) + _bytes(7, graph)


SQUARE = {"images": (FLOAT, (1, 3, 640, 640)), "orig_target_sizes": (INT64, (1, 2))}


def test_detector(tmp_path):
    labels, scores = np.array([[1, 2, 3]], np.int64), np.array([[0.9, 0.5, 0.51]], np.float32)
    boxes = np.array([[[0, 160, 640, 480], [1, 1, 2, 2], [320, 150, 700, 320]]], np.float32)
    (tmp_path / "d.onnx").write_bytes(model(SQUARE, {"labels": labels, "boxes": boxes, "scores": scores}))
    found = onnx_models.detector(str(tmp_path / "d.onnx"))(np.zeros((100, 200, 3), np.uint8))
    # 200 x 100 goes in at 3.2 times with 160 rows of padding; a score at the threshold is out
    assert np.allclose(found, [[1, 0.9, 0, 0, 200, 100], [3, 0.51, 100, 0, 200, 50]], atol=1e-5)


def test_detector_without_its_names(tmp_path):
    (tmp_path / "d.onnx").write_bytes(model(SQUARE, {"labels": np.zeros((1, 1), np.int64)}))
    with pytest.raises(ValueError, match="boxes"):
        onnx_models.detector(str(tmp_path / "d.onnx"))


def test_recognizer(tmp_path):
    path = [0, 1, 1, 0, 1, 2, 2]
    probs = np.full((1, len(path), 3), 0.1, np.float32)
    probs[0, np.arange(len(path)), path] = np.linspace(0.5, 0.8, len(path))
    (tmp_path / "r.onnx").write_bytes(model({"x": (FLOAT, (1, 3, 48, "w"))}, {"y": probs}))
    text, sure = onnx_models.recognizer(str(tmp_path / "r.onnx"), "\na\nb")(np.zeros((20, 90, 3), np.uint8))
    assert text == "aab" and abs(sure - probs[0, [1, 4, 5]].max(axis=1).mean()) < 1e-6
    assert struct.calcsize("f") == 4 and pixels.recognizer_input(np.zeros((20, 90, 3), np.uint8)).shape == (3, 48, 320)


def test_ports_are_found_by_name_or_part():
    class Port:
        def __init__(self, *names):
            self.names = names

        def get_names(self):
            return self.names

    ports = [Port("scores_1"), Port("scores"), Port("images:0")]
    assert other_models.port(ports, "scores") is ports[1] and other_models.port(ports, "images") is ports[2]
    with pytest.raises(ValueError):
        other_models.port(ports, "boxes")
