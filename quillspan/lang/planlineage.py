"""Column lineage of any DataFrame, read from its analysed plan: which leaf columns each output column's value comes from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def _ids(expr: list[dict], kind: str) -> list[tuple[int, str]]:
    return [(n["exprId"]["id"], n["name"]) for n in expr if n["class"].endswith(kind) and "exprId" in n]


def lineage(df: DataFrame) -> list[tuple[str, str]]:
    """Distinct (output column, leaf column) pairs, sorted. Conditions of filters and joins are no sources of values."""
    nodes = json.loads(df._jdf.queryExecution().analyzed().toJSON())
    made: dict[int, set[int]] = {}
    name: dict[int, str] = {}

    def visit(x) -> None:
        if isinstance(x, list) and x and isinstance(x[0], dict) and "class" in x[0]:
            if x[0]["class"].endswith(".Alias"):
                made.setdefault(x[0]["exprId"]["id"], set()).update(i for i, _ in _ids(x[1:], "AttributeReference"))
            name.update(_ids(x, "AttributeReference"))
        elif isinstance(x, list):
            for y in x:
                visit(y)

    for n in nodes:
        for v in n.values():
            visit(v)
        # a union's output takes the ids of its first child, whose columns the others join by place
    def leaves(i: int, seen: frozenset = frozenset()) -> set[int]:
        if i in seen or i not in made:
            return {i}
        return set().union(*(leaves(j, seen | {i}) for j in made[i])) if made[i] else set()

    out = df._jdf.queryExecution().analyzed().output()
    pairs = set()
    for k in range(out.size()):
        a = out.apply(k)
        pairs.update((a.name(), name.get(j, "?")) for j in leaves(a.exprId().id()))
    return sorted(pairs)
