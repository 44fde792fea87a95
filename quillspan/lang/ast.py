"""The syntax tree shared by the dialects, and its printer. Nodes are immutable and compare by value."""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass


@dataclass(frozen=True)
class Col:
    name: str
    rel: str | None = None


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Star:
    rel: str | None = None


@dataclass(frozen=True)
class Pos:
    """A field by place."""
    index: int


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Bin:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Un:
    op: str
    arg: object


@dataclass(frozen=True)
class In:
    arg: object
    items: tuple
    negated: bool = False


@dataclass(frozen=True)
class Between:
    arg: object
    low: object
    high: object
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    arg: object
    negated: bool = False


@dataclass(frozen=True)
class Case:
    whens: tuple
    other: object = None


@dataclass(frozen=True)
class Cast:
    arg: object
    to: str


@dataclass(frozen=True)
class Scalar:
    """A SELECT used as a value."""
    query: object


@dataclass(frozen=True)
class Exists:
    """Whether a SELECT has a row; it may refer to the query around it."""
    query: object


@dataclass(frozen=True)
class Proj:
    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Derived:
    query: object
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    source: object
    kind: str
    on: object


@dataclass(frozen=True)
class Core:
    cols: tuple
    source: object
    joins: tuple = ()
    where: object = None
    group: tuple = ()
    having: object = None
    distinct: bool = False


@dataclass(frozen=True)
class Select:
    cores: tuple
    order: tuple = ()  # (expr, descending)
    limit: object = None
    offset: object = None
    #: Named queries (name, Select) that this one may read.
    named: tuple = ()


AGGREGATES = {"sum", "avg", "mean", "max", "min", "count", "std", "stddev", "var", "variance", "nmiss", "n"}


def is_aggregate(e) -> bool:
    return isinstance(e, Call) and e.name in AGGREGATES and (len(e.args) == 1 or e.name == "count")


def walk(e):
    """The node and all below it; a nested SELECT is not entered."""
    yield e
    if isinstance(e, (Scalar, Derived, Exists)):
        return
    if is_dataclass(e):
        for f in fields(e):
            yield from walk(getattr(e, f.name))
    elif isinstance(e, tuple):
        for x in e:
            yield from walk(x)


def conjuncts(e, op: str = "and") -> list:
    return conjuncts(e.left, op) + conjuncts(e.right, op) if isinstance(e, Bin) and e.op == op else [e]


_LEVEL = {"or": 1, "and": 2, "=": 4, "<>": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "like": 4, "matches": 4, "||": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7, "**": 9}


def show(e) -> str:
    """Text that parses to an equal tree (in the SQL dialects)."""
    return _show(e, 0)


def _show(e, level: int) -> str:
    def wrap(text: str, own: int) -> str:
        return f"({text})" if own < level else text

    match e:
        case Col(name, rel):
            return f"{rel}.{name}" if rel else name
        case Lit(None):
            return "null"
        case Lit(str() as v):
            return "'" + v.replace("'", "''") + "'"
        case Lit(v):
            return str(v)
        case Star(rel):
            return f"{rel}.*" if rel else "*"
        case Pos(i):
            return f"${i}"
        case Call(name, args, distinct):
            return f"{name}({'distinct ' if distinct else ''}{', '.join(_show(a, 0) for a in args)})"
        case Bin(op, a, b):
            own = _LEVEL[op]
            left = own + 1 if own == 4 else own
            return wrap(f"{_show(a, left)} {op} {_show(b, own + 1)}", own)
        case Un("not", a):
            return wrap(f"not {_show(a, 3)}", 3)
        case Un(op, a):
            inner = _show(a, 8)
            return wrap(f"{op} {inner}" if inner.startswith(op) else f"{op}{inner}", 8)  # two in a row would begin a comment
        case In(a, items, neg):
            return wrap(f"{_show(a, 5)} {'not ' if neg else ''}in ({', '.join(_show(x, 0) for x in items)})", 4)
        case Between(a, lo, hi, neg):
            return wrap(f"{_show(a, 5)} {'not ' if neg else ''}between {_show(lo, 5)} and {_show(hi, 5)}", 4)
        case IsNull(a, neg):
            return wrap(f"{_show(a, 5)} is {'not ' if neg else ''}null", 4)
        case Case(whens, other):
            body = " ".join(f"when {_show(c, 0)} then {_show(v, 0)}" for c, v in whens)
            return f"case {body}{f' else {_show(other, 0)}' if other is not None else ''} end"
        case Cast(a, to):
            return f"cast({_show(a, 0)} as {to})"
        case Scalar(q):
            return f"({show(q)})"
        case Exists(q):
            return f"exists ({show(q)})"
        case Proj(x, alias):
            return _show(x, 0) + (f" as {alias}" if alias else "")
        case Table(name, alias):
            return name + (f" {alias}" if alias else "")
        case Derived(q, alias):
            return f"({show(q)})" + (f" {alias}" if alias else "")
        case Join(src, "cross", _):
            return f"cross join {_show(src, 0)}"
        case Join(src, kind, on):
            return f"{'' if kind == 'inner' else kind + ' '}join {_show(src, 0)} on {_show(on, 0)}"
        case Core():
            parts = [f"select {'distinct ' if e.distinct else ''}{', '.join(map(show, e.cols))} from {show(e.source)}", *map(show, e.joins)]
            if e.where is not None:
                parts.append(f"where {show(e.where)}")
            if e.group:
                parts.append(f"group by {', '.join(map(show, e.group))}")
            if e.having is not None:
                parts.append(f"having {show(e.having)}")
            return " ".join(parts)
        case Select():
            parts = [f"with {', '.join(f'{n} as ({show(q)})' for n, q in e.named)}"] if e.named else []
            parts.append(" union all ".join(map(show, e.cores)))
            if e.order:
                parts.append("order by " + ", ".join(show(x) + (" desc" if d else "") for x, d in e.order))
            if e.limit is not None:
                parts.append(f"limit {show(e.limit)}")
            if e.offset is not None:
                parts.append(f"offset {show(e.offset)}")
            return " ".join(parts)
    raise TypeError(f"cannot print {e!r}")
