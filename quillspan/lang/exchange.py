"""Syntax trees as JSON text, for exchange with other tools: every node is an object with its class under ``node`` and its fields."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass

from quillspan.lang import ast as A

_CLASSES = {name: c for name, c in vars(A).items() if isinstance(c, type) and is_dataclass(c)}


def _plain(x):
    if is_dataclass(x):
        return {"node": type(x).__name__} | {f.name: _plain(getattr(x, f.name)) for f in fields(x)}
    return [_plain(y) for y in x] if isinstance(x, tuple) else x


def _tree(x):
    if isinstance(x, list):
        return tuple(map(_tree, x))
    if not isinstance(x, dict):
        return x
    values = dict(x)
    name = values.pop("node", None)
    if name not in _CLASSES:
        raise ValueError(f"{name!r} is no node of a syntax tree")
    extra = sorted(set(values) - {f.name for f in fields(_CLASSES[name])})
    if extra:
        raise ValueError(f"{name} has no field {extra[0]}")
    return _CLASSES[name](**{k: _tree(v) for k, v in values.items()})


def to_json(tree) -> str:
    return json.dumps(_plain(tree), ensure_ascii=False)


def from_json(text: str):
    """The tree of a text that ``to_json`` made; unknown nodes and fields are errors."""
    return _tree(json.loads(text))
