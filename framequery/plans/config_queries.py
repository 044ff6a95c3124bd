"""Queries over driver-side configuration: each returns what a lookup gives, as rows."""

from __future__ import annotations

from ..functions import config
from ..operators import scoring
from .catalog import query

#: Parameter files by path, as a store would give them.
_FILES = {
    "/p/node.yml": "other:\n  ros__parameters: {device: gpu, size: 320}\n/**:\n  ros__parameters: {device: cpu, size: 640}\n",
    "/p/base.yml": "epochs: 72\noptimizer: {type: adam, lr: 0.1}\n",
    "/p/more/data.yml": "__include__: ['../sets.yml']\nworkers: 4\nname: b\n",
    "/p/more/../sets.yml": "name: a\nclasses: 80\n",
    "/p/run.yml": "__include__: [base.yml, more/data.yml]\noptimizer: {lr: 0.2}\n",
}


def _flat(tree: dict, before: str = "") -> list[tuple[str, str]]:
    out = []
    for k, v in tree.items():
        out += _flat(v, f"{before}{k}.") if isinstance(v, dict) else [(f"{before}{k}", str(v))]
    return out


def _read(path) -> str:
    return _FILES[str(path)]


def _values(rows: list[tuple[str, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rows) + ") t(key, value)"


def _rows(spark, pairs):
    return spark.createDataFrame([(str(k), str(v)) for k, v in pairs], "key string, value string")


@query(_values([("/**.device", "cpu"), ("/**.size", "640"), ("other.device", "gpu"), ("other.size", "320"), ("absent.device", "cpu"), ("absent.size", "640")]))
def node_parameters(spark, sf_dir):
    return _rows(spark, [(f"{n}.{k}", v) for n in ("/**", "other", "absent") for k, v in config.node_parameters("/p/node.yml", n, _read).items()])


@query(_values([("epochs", "72"), ("optimizer.type", "adam"), ("optimizer.lr", "0.2"), ("workers", "4"), ("name", "b"), ("classes", "80")]))
def config_tree(spark, sf_dir):
    return _rows(spark, _flat(config.load_tree("/p/run.yml", read=_read)))


@query(_values([("a.c", "3"), ("a.d", "x"), ("b", "True")]))
def config_overrides(spark, sf_dir):
    return _rows(spark, _flat(config.overrides(["a.c=3", "a.d=x", "b=true"])))


@query(_values([("/p/configs/paddle/a.yml", "/p/model/m.onnx"), ("/p/a.yml", "/p/model/m.onnx"), ("absolute", "/x/m.onnx")]))
def resolved_paths(spark, sf_dir):
    places = [(c, config.resolve_path("model/m.onnx", c)) for c in ("/p/configs/paddle/a.yml", "/p/a.yml")]
    return _rows(spark, [*places, ("absolute", config.resolve_path("/x/m.onnx", "/p/a.yml"))])


@query(_values([("averaged", "1"), ("model", "2"), ("whole", "3")]))
def stored_parameters(spark, sf_dir):
    states = {"averaged": {"ema": {"module": {"w": 1}}, "model": {"w": 2}}, "model": {"ema": {}, "model": {"w": 2}}, "whole": {"w": 3}}
    return _rows(spark, [(k, config.stored_parameters(s)["w"]) for k, s in states.items()])


@query(_values([("backbone", "net 80 of 3"), ("again", "refused"), ("unknown", "refused")]))
def injected_parts(spark, sf_dir):
    known = config.Injected()
    known.register("backbone", lambda depth: f"{depth}")
    known.register("model", lambda part, classes: f"net {classes} of {part}", inject=("part",), shared=("classes",))
    out = [("backbone", known.create("model", {"classes": 80, "model": {"part": "backbone"}, "backbone": {"depth": 3}}))]
    for name, wrong in (("again", lambda: known.register("model", None)), ("unknown", lambda: known.create("none", {}))):
        try:
            wrong()
        except ValueError:
            out.append((name, "refused"))
    return _rows(spark, out)


@query(_values([("detector onnx", "known"), ("detector openvino", "known"), ("detector pytorch", "known"), ("detector paddle", "known"), ("recognizer onnx", "known"), ("recognizer openvino", "known"), ("recognizer paddle", "known"), ("recognizer pytorch", "unknown")]))
def backends(spark, sf_dir):
    out = []
    for kind in ("detector", "recognizer"):
        for name in ("onnx", "openvino", "pytorch", "paddle"):
            try:
                scoring.resolve(kind, name)
                out.append((f"{kind} {name}", "known"))
            except ValueError:
                out.append((f"{kind} {name}", "unknown"))
    return _rows(spark, out)
