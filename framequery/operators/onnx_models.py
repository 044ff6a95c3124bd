"""ONNX models as callables, made on executors. Other runtimes register their own factories."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..functions import pixels


def _session(path: str, device: str):
    import onnxruntime as ort

    wanted = ["CUDAExecutionProvider", "CPUExecutionProvider"] if device.startswith("cuda") else ["CPUExecutionProvider"]
    there = ort.get_available_providers()
    return ort.InferenceSession(path, providers=[p for p in wanted if p in there] or ["CPUExecutionProvider"])


def _names(items, wanted: tuple[str, ...]) -> None:
    missing = set(wanted) - {i.name for i in items}
    if missing:
        raise ValueError(f"the model lacks {sorted(missing)}")


def detector(path: str, device: str = "cpu", side: int = 640, threshold: float = 0.5) -> Callable:
    """image -> rows (class, score, x1, y1, x2, y2) in image pixels, strictly above the threshold."""
    session = _session(path, device)
    _names(session.get_inputs(), ("images", "orig_target_sizes"))
    _names(session.get_outputs(), ("labels", "boxes", "scores"))

    def run(img: np.ndarray) -> np.ndarray:
        square, ratio, left, top = pixels.letterbox(img, side)
        fed = {"images": pixels.detector_input(square), "orig_target_sizes": np.array([[side, side]], np.int64)}
        labels, boxes, scores = (x[0] for x in session.run(["labels", "boxes", "scores"], fed))
        return boxes_in_image(img, labels, boxes, scores, ratio, left, top, threshold)

    return run


def recognizer(path: str, alphabet: str, device: str = "cpu", rec_h: int = 48, rec_w: int = 320, max_w: int = 3200) -> Callable:
    """crop -> (text, confidence). ``alphabet``: the classes' characters, blank first, parted by newlines."""
    session, letters = _session(path, device), alphabet.split("\n")
    name = session.get_inputs()[0].name

    def run(img: np.ndarray) -> tuple[str, float]:
        probs = session.run(None, {name: pixels.recognizer_input(img, rec_h, rec_w, max_w)[None]})[0][0]
        return greedy_text(probs, letters)

    return run


def boxes_in_image(img: np.ndarray, labels: np.ndarray, boxes: np.ndarray, scores: np.ndarray, ratio: float, left: int, top: int, threshold: float) -> np.ndarray:
    """Boxes of the padded square whose score is strictly above the threshold, in image pixels."""
    h, w = img.shape[:2]
    keep = scores > np.float32(threshold)
    corners = np.clip((boxes[keep] - [left, top, left, top]) / ratio, 0, [w, h, w, h])
    return np.concatenate([labels[keep, None], scores[keep, None], corners], axis=1)


def greedy_text(probs: np.ndarray, letters: list[str]) -> tuple[str, float]:
    """Best classes of the steps, repeats and blanks dropped, and the mean of their scores."""
    idx = probs.argmax(1)
    emit = (idx != 0) & (idx != np.concatenate([[-1], idx[:-1]]))
    best = probs.max(1)[emit]
    return "".join(letters[i] for i in idx[emit]), float(best.mean()) if len(best) else 0.0
