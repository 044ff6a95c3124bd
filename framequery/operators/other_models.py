"""Detectors and recognizers of runtimes that may not be installed: a clear error where they are not.

Each factory runs on executors, loads its runtime there, and gives the same callables as the
ONNX ones: image -> rows (class, score, corners) in image pixels, crop -> (text, confidence).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

import numpy as np

from ..functions import pixels
from .onnx_models import boxes_in_image, greedy_text


def runtime(name: str):
    """The module of a runtime, or an error that says what to install."""
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise RuntimeError(f"this backend needs the package {name!r} on every executor") from e


def _openvino(path: str, device: str):
    core = runtime("openvino").Core()
    hints = {"PERFORMANCE_HINT": "LATENCY"} | ({"INFERENCE_PRECISION_HINT": "f32"} if device.upper().startswith("GPU") else {})
    return core.compile_model(core.read_model(path), device.upper(), hints)


def port(ports, wanted: str):
    """The port of a name, else the one whose names contain it."""
    named = [(p, set(p.get_names())) for p in ports]
    found = [p for p, names in named if wanted in names] or [p for p, names in named if any(wanted in n for n in names)]
    if not found:
        raise ValueError(f"the model lacks {wanted!r}")
    return found[0]


def openvino_detector(path: str, device: str = "cpu", side: int = 640, threshold: float = 0.5) -> Callable:
    model = _openvino(path, device)
    images, sizes = (port(model.inputs, n) for n in ("images", "orig_target_sizes"))
    outputs = [port(model.outputs, n) for n in ("labels", "boxes", "scores")]

    def run(img: np.ndarray) -> np.ndarray:
        square, ratio, left, top = pixels.letterbox(img, side)
        got = model({images: pixels.detector_input(square), sizes: np.array([[side, side]], np.int64)})
        return boxes_in_image(img, *(np.asarray(got[o])[0] for o in outputs), ratio, left, top, threshold)

    return run


def openvino_recognizer(path: str, alphabet: str, device: str = "cpu", rec_h: int = 48, rec_w: int = 320, max_w: int = 3200) -> Callable:
    model, letters = _openvino(path, device), alphabet.split("\n")
    return lambda img: greedy_text(np.asarray(model(pixels.recognizer_input(img, rec_h, rec_w, max_w)[None])[model.outputs[0]])[0], letters)


def pytorch_detector(path: str, device: str = "cpu", side: int = 640, threshold: float = 0.4) -> Callable:
    """``path``: a TorchScript file of the deployed model, (image, size) -> (labels, boxes, scores)."""
    torch = runtime("torch")
    where = device if device.startswith("cuda") and torch.cuda.is_available() else "cpu"
    model = torch.jit.load(path, map_location=where).eval()

    def run(img: np.ndarray) -> np.ndarray:
        square, ratio, left, top = pixels.letterbox(img, side)
        with torch.no_grad():
            got = model(torch.from_numpy(pixels.detector_input(square)).to(where), torch.tensor([[side, side]], device=where))
        return boxes_in_image(img, *(x[0].cpu().numpy() for x in got), ratio, left, top, threshold)

    return run


def paddle_detector(path: str, device: str = "cpu") -> Callable:
    """``path``: an exported detection model. Its boxes are in image pixels and unfiltered: the pipeline filters them."""
    predictor = runtime("paddlex").create_model(model_dir=path, device=device)

    def run(img: np.ndarray) -> np.ndarray:
        found = next(iter(predictor.predict(img)))["boxes"]
        return np.array([[b["cls_id"], b["score"], *b["coordinate"]] for b in found], np.float32).reshape(-1, 6)

    return run


def paddle_recognizer(path: str | None = None, language: str = "en", device: str = "cpu", longest: int = 960, threshold: float = 0.6) -> Callable:
    """Lines over the threshold, joined, with their mean score."""
    reader = runtime("paddleocr").PaddleOCR(lang=language, device=device, **({"text_recognition_model_dir": path} if path else {}))

    def run(img: np.ndarray) -> tuple[str, float]:
        lines = []
        for page in reader.predict(pixels.equalized_gray(img, longest)):
            lines += [(t, s) for t, s in zip(page["rec_texts"], page["rec_scores"], strict=True) if s > threshold and t.strip()]
        return " ".join(t for t, _ in lines), float(np.mean([s for _, s in lines])) if lines else 0.0

    return run
