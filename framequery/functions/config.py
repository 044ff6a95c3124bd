"""Driver-side configuration: parameter files, included files, overrides, paths."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path


def local_text(path: str | Path) -> str:
    return Path(path).read_text(encoding="utf-8")


def node_parameters(path: str | Path, node: str = "/**", read: Callable[[str | Path], str] = local_text) -> dict:
    """Parameters of a node: its own section, else the general one, else the first that has any.

    ``read`` gives a file's text, so files can come from any store.
    """
    import yaml

    sections = yaml.safe_load(read(path)) or {}
    for name in (node, "/**", *sections):
        found = sections.get(name)
        if isinstance(found, dict) and "ros__parameters" in found:
            return found["ros__parameters"]
    raise ValueError(f"{path} has no parameters")


def merge(base: dict, over: dict) -> dict:
    """A new dict; ``over`` wins, nested dicts are merged."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_tree(path: str | Path, include: str = "__include__", read: Callable[[str | Path], str] = local_text) -> dict:
    """A file with the files it includes (relative to it); what stands later or in the including file wins."""
    import yaml

    own = yaml.safe_load(read(path)) or {}
    base: dict = {}
    for name in own.pop(include, []) or []:
        name = Path(os.path.expanduser(name))
        base = merge(base, load_tree(name if name.is_absolute() else Path(path).parent / name, include, read))
    return merge(base, own)


def overrides(items: list[str]) -> dict:
    """['a.c=3'] -> {'a': {'c': 3}}, values read as YAML."""
    import yaml

    out: dict = {}
    for item in items:
        key, found, value = item.partition("=")
        if not found:
            raise ValueError(f"{item!r} is not key=value")
        nested: object = yaml.safe_load(value)
        for part in reversed(key.split(".")):
            nested = {part: nested}
        out = merge(out, nested)
    return out


def resolve_path(path: str, config: str | Path) -> Path:
    """``~`` and absolute paths as they are; others from the folder that holds ``configs``.

    The nearest folder named ``configs`` over the config file counts; without one, the file's own folder.
    """
    p = Path(os.path.expanduser(path))
    if p.is_absolute():
        return p
    place = Path(config).resolve()
    root = next((x.parent for x in place.parents if x.name == "configs"), place.parent)
    return Path(os.path.normpath(root / p))


def stored_parameters(state: dict) -> dict:
    """The parameters in a checkpoint: the averaged model's, else the model's, else the whole."""
    averaged = state.get("ema")
    if isinstance(averaged, dict) and "module" in averaged:
        return averaged["module"]
    return state.get("model", state)


class Injected:
    """Named factories; an argument that names another entry, and is declared as such, gets that entry's object."""

    def __init__(self):
        self.entries: dict[str, tuple] = {}

    def register(self, name: str, factory, inject: tuple[str, ...] = (), shared: tuple[str, ...] = (), force: bool = False) -> None:
        if name in self.entries and not force:
            raise ValueError(f"{name!r} is registered already")
        self.entries[name] = (factory, inject, shared)

    def create(self, name: str, settings: dict, **over):
        """The object of ``name`` with its section of ``settings``; ``shared`` arguments come from the top level."""
        if name not in self.entries:
            raise ValueError(f"unknown entry {name!r}; there are {sorted(self.entries)}")
        factory, inject, shared = self.entries[name]
        arguments = {k: settings[k] for k in shared if k in settings} | dict(settings.get(name) or {}) | over
        for k in inject:
            if isinstance(arguments.get(k), str):
                arguments[k] = self.create(arguments[k], settings)
        return factory(**arguments)
