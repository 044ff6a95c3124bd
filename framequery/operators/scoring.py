"""Model scoring in Arrow batches: detectors and recognizers behind a registry.

A model factory runs once per Python worker, not per row or batch, so model files are
loaded on executors and only paths and options travel.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pixels
from ..functions.text import EMPTY_CROP, NO_TEXT, OCR_ERROR
from . import detect as D

_DETECTORS: dict[str, str | Callable] = {"onnx": "framequery.operators.onnx_models:detector", **{n: f"framequery.operators.other_models:{n}_detector" for n in ("openvino", "pytorch", "paddle")}}
_RECOGNIZERS: dict[str, str | Callable] = {"onnx": "framequery.operators.onnx_models:recognizer", **{n: f"framequery.operators.other_models:{n}_recognizer" for n in ("openvino", "paddle")}}
_LOADED: dict[tuple, Callable] = {}


def register(kind: str, name: str, factory: str | Callable) -> None:
    """Add a backend: a factory, or 'module:function' imported where it is used."""
    {"detector": _DETECTORS, "recognizer": _RECOGNIZERS}[kind][name] = factory


def resolve(kind: str, name: str) -> str | Callable:
    table = {"detector": _DETECTORS, "recognizer": _RECOGNIZERS}[kind]
    if name not in table:
        raise ValueError(f"unknown {kind} backend {name!r}; there are {sorted(table)}")
    return table[name]


def _model(factory: str | Callable, options: dict) -> Callable:
    key = (factory, tuple(sorted(options.items())))
    if key not in _LOADED:
        if isinstance(factory, str):
            module, _, name = factory.partition(":")
            factory = getattr(importlib.import_module(module), name)
        _LOADED[key] = factory(**options)
    return _LOADED[key]


_BOX = T.StructType([T.StructField("class_id", T.IntegerType())] + [T.StructField(c, T.FloatType()) for c in ("score", "x1", "y1", "x2", "y2")])
_BOX_ARROW = pa.list_(pa.struct([("class_id", pa.int32())] + [(c, pa.float32()) for c in ("score", "x1", "y1", "x2", "y2")]))


_PIXELS = ("height", "width", "nChannels", "mode", "data")


def score_frames(frames: DataFrame, backend: str, with_pixels: bool = False, **options) -> DataFrame:
    """One row per frame: its columns but the pixels, ``boxes``, or an ``error`` where scoring failed.

    A model gives rows (class, score, corners) per image. Batch or stream. ``with_pixels`` keeps all columns, for
    what goes on with the same row.
    """
    factory = resolve("detector", backend)
    kept = [c for c in frames.columns if with_pixels or c not in _PIXELS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(factory, options)
        for batch in batches:
            boxes, errors = [], []
            for row in range(batch.num_rows):
                h, w, c, data = (batch.column(i)[row].as_py() for i in range(4))
                try:
                    if c != 3:
                        raise ValueError("an image must have three channels")
                    found = np.asarray(model(pixels.image(data, h, w)), np.float32).reshape(-1, 6)
                    boxes.append([dict(zip(("class_id", "score", "x1", "y1", "x2", "y2"), [int(r[0]), *map(float, r[1:])], strict=True)) for r in found])
                    errors.append(None)
                except Exception as e:  # one bad frame must not stop a run: it is quarantined
                    boxes.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*[batch.column(4 + k) for k in range(len(kept))], pa.array(boxes, _BOX_ARROW), pa.array(errors, pa.string())], names=[*kept, "boxes", "error"])

    schema = T.StructType([*[frames.schema[c] for c in kept], T.StructField("boxes", T.ArrayType(_BOX)), T.StructField("error", T.StringType())])
    needed = [F.col(c).alias(f"_{c}") for c in ("height", "width", "nChannels", "data")]
    return frames.select(*needed, *kept).mapInArrow(run, schema)


def detections(scored: DataFrame) -> DataFrame:
    """A row per box of the frames that were scored, with the frame's other columns (stamps)."""
    kept = [c for c in scored.columns if c not in ("boxes", "error")]
    return scored.where("error IS NULL").select(*kept, F.posexplode("boxes").alias("det_id", "box")).select(*kept, "det_id", "box.*")


def detect(frames: DataFrame, backend: str, **options) -> tuple[DataFrame, DataFrame]:
    """(detections, errors) of decoded frames. Whoever uses both should persist ``score_frames`` instead."""
    scored = score_frames(frames, backend, **options)
    return detections(scored), scored.where("error IS NOT NULL").select("origin", "error")


def _text_of(model: Callable, img: np.ndarray | None, strict: bool, threshold: float) -> tuple[str, float]:
    """What a recognizer reads in a crop; where it can't, a sentinel: recognition never fails a run."""
    if img is None or not img.size:
        return EMPTY_CROP, 0.0
    confidence = 0.0
    try:
        text, confidence = model(img)
        text = " ".join(text.split())
        enough = confidence > threshold if strict else confidence >= threshold
        return text if text and enough else NO_TEXT, float(confidence)
    except Exception:
        return OCR_ERROR, float(confidence)


_RESULT = T.StructType(
    [T.StructField("det_id", T.IntegerType()), T.StructField("class_id", T.IntegerType()), T.StructField("score", T.FloatType())]
    + [T.StructField(c, T.IntegerType()) for c in ("x1", "y1", "x2", "y2")]
    + [T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())]
)
_RESULT_ARROW = pa.list_(pa.struct([("det_id", pa.int32()), ("class_id", pa.int32()), ("score", pa.float32()), *[(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")], ("text", pa.string()), ("confidence", pa.float64())]))


def read_boxes(frames: DataFrame, backend: str, boxes: str = "boxes", strict: bool = False, threshold: float = 0.6, **options) -> DataFrame:
    """``frames`` with ``results`` in place of their array of clipped boxes: each box with what is read in its crop."""
    factory = resolve("recognizer", backend)
    kept = [c for c in frames.columns if c != boxes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(factory, options)
        for batch in batches:
            results = []
            for row in range(batch.num_rows):
                found, h, w, c, data = (batch.column(i)[row].as_py() for i in range(5))
                img = pixels.image(data, h, w, c) if found else None
                for b in found or ():
                    b["text"], b["confidence"] = _text_of(model, pixels.crop(img, b["x1"], b["y1"], b["x2"], b["y2"]), strict, threshold)
                results.append(found)
            yield pa.RecordBatch.from_arrays([*[batch.column(5 + k) for k in range(len(kept))], pa.array(results, _RESULT_ARROW)], names=[*kept, "results"])

    schema = T.StructType([*[frames.schema[c] for c in kept], T.StructField("results", T.ArrayType(_RESULT))])
    needed = [F.col(c).alias(f"_{c}") for c in (boxes, "height", "width", "nChannels", "data")]
    return frames.select(*needed, *kept).mapInArrow(run, schema)


def read_frames(frames: DataFrame, detector: str, recognizer: str, threshold: float = 0.5, filtered: str = "onnx", mode: str = "batch", recognizer_options: dict | None = None, **options) -> DataFrame:
    """Decoded frames with their ``results``, or an ``error``: scored, filtered, clipped, cropped and read.

    One chain without a shuffle or a join: a frame's pixels stay in its row, each frame goes through the detector
    once and each box through the recognizer once. ``filtered`` names the backend whose score filter holds.
    """
    scored = score_frames(frames, detector, with_pixels=True, **options)
    kept = D.kept_boxes(F.col("boxes"), threshold, filtered, F.col("width"), F.col("height"), mode)
    return read_boxes(scored.withColumn("boxes", kept), recognizer, **(recognizer_options or {}))


def texts(read: DataFrame) -> DataFrame:
    """A row per box that was read, with the frame's other columns but its pixels."""
    kept = [c for c in read.columns if c not in (*_PIXELS, "results", "error")]
    return read.select(*kept, F.explode("results").alias("result")).select(*kept, "result.*")


def recognize(crops: DataFrame, backend: str, strict: bool = False, threshold: float = 0.6, **options) -> DataFrame:
    """``crops`` (with height, width, nChannels, data) plus text: never an error, a sentinel instead."""
    factory = resolve("recognizer", backend)
    kept = [c for c in crops.columns if c != "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(factory, options)
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts, sure = [], []
            for row in range(batch.num_rows):
                h, w, c, data = (columns[n][row].as_py() for n in ("height", "width", "nChannels", "data"))
                text, confidence = _text_of(model, pixels.image(data, h, w, c) if h and w and data else None, strict, threshold)
                texts.append(text)
                sure.append(confidence)
            yield pa.RecordBatch.from_arrays([*[columns[n] for n in kept], pa.array(texts, pa.string()), pa.array(sure, pa.float64())], names=[*kept, "text", "confidence"])

    schema = T.StructType([crops.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])
    return crops.mapInArrow(run, schema)


def crop_boxes(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Crops of clipped boxes (origin, det_id, x1..y2): pixels leave a frame once, in its own partition."""
    fields = ("det_id", "x1", "y1", "x2", "y2")
    lists = boxes.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("boxes"))
    joined = frames.select("origin", "height", "width", "nChannels", "data").join(lists, "origin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                origin, h, w, c, data, found = (batch.column(i)[row].as_py() for i in range(6))
                img, rows = pixels.image(data, h, w, c), []
                for b in found:
                    part = pixels.crop(img, b["x1"], b["y1"], b["x2"], b["y2"])
                    rows.append((origin, b["det_id"], part.shape[0], part.shape[1], c, part.tobytes()))
                columns = zip(*rows, strict=True)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=["origin", "det_id", "height", "width", "nChannels", "data"])

    return joined.mapInArrow(run, "origin string, det_id int, height int, width int, nChannels int, data binary")
