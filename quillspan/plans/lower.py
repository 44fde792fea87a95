"""From syntax tree to DataFrame: expressions by dialect, SELECT statements as plans for the optimizer. Nothing runs here."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.catalog import SEQ, Catalog, first_row, visible
from quillspan.functions import sas
from quillspan.lang import ast as A
from quillspan.lang.parser import LanguageError

_LOGIC = (A.In, A.Between, A.IsNull, A.Exists)
_COMPARISONS = {"=", "<>", "<", "<=", ">", ">="}


def is_boolean(e) -> bool:
    return isinstance(e, _LOGIC) or (isinstance(e, A.Bin) and e.op in _COMPARISONS | {"and", "or", "like", "matches"}) or (isinstance(e, A.Un) and e.op == "not") or (isinstance(e, A.Lit) and isinstance(e.value, bool)) or (isinstance(e, A.Call) and e.name == "missing")


def _round(a: list[Column], args: tuple, dialect: str) -> Column:
    """ROUND(x); the second argument is a unit in SAS and a number of digits elsewhere."""
    if len(a) == 1:
        return F.round(a[0])
    unit = args[1].value
    if dialect != "sas":
        return F.round(a[0], unit)
    return F.round(a[0] * round(1 / unit)) / round(1 / unit) if unit < 1 else F.round(a[0] / unit) * unit


def _present(f: Callable) -> Callable:
    return lambda a: f(*a) if len(a) > 1 else a[0]


_FUNCTIONS: dict[str, Callable[[list[Column]], Column]] = {
    "month": lambda a: F.month(a[0]), "year": lambda a: F.year(a[0]), "day": lambda a: F.dayofmonth(a[0]), "qtr": lambda a: F.quarter(a[0]), "weekday": lambda a: F.dayofweek(a[0]),
    "abs": lambda a: F.abs(a[0]), "int": lambda a: F.when(a[0] < 0, F.ceil(a[0])).otherwise(F.floor(a[0])), "floor": lambda a: F.floor(a[0]), "ceil": lambda a: F.ceil(a[0]), "sqrt": lambda a: F.sqrt(a[0]),
    "exp": lambda a: F.exp(a[0]), "log": lambda a: F.log(a[0]), "mod": lambda a: F.try_mod(a[0], a[1]), "pow": lambda a: F.pow(a[0], a[1]),
    "upcase": lambda a: F.upper(a[0]), "upper": lambda a: F.upper(a[0]), "lowcase": lambda a: F.lower(a[0]), "lower": lambda a: F.lower(a[0]), "trim": lambda a: F.trim(a[0]), "strip": lambda a: F.trim(a[0]), "left": lambda a: F.ltrim(a[0]),
    "length": lambda a: F.length(a[0]), "index": lambda a: F.instr(a[0], a[1]), "tranwrd": lambda a: F.replace(a[0], a[1], a[2]),
    "substr": lambda a: F.substr(a[0], a[1]) if len(a) == 2 else F.substr(a[0], a[1], a[2]), "substring": lambda a: F.substr(a[0], a[1]) if len(a) == 2 else F.substr(a[0], a[1], a[2]),
    "concat": lambda a: F.concat(*a), "cats": lambda a: F.concat(*[F.coalesce(F.trim(x.cast("string")), F.lit("")) for x in a]),
    "coalesce": lambda a: F.coalesce(*a), "coalescec": lambda a: F.coalesce(*a), "missing": lambda a: a[0].isNull(), "today": lambda a: F.current_date(), "datetime": lambda a: F.current_timestamp(),
    "size": lambda a: F.size(a[0]), "levenshtein": lambda a: F.levenshtein(a[0], a[1]), "nullif": lambda a: F.nullif(a[0], a[1]), "if": lambda a: F.when(a[0], a[1]).otherwise(a[2]), "to_date": lambda a: F.to_date(*a),
}
#: Row-wise in a DATA step, aggregates in a SELECT; missing arguments are skipped.
_ROWWISE = {"sum": lambda a: F.when(F.coalesce(*a).isNotNull(), sum((F.coalesce(x, F.lit(0)) for x in a[1:]), F.coalesce(a[0], F.lit(0)))), "max": _present(F.greatest), "min": _present(F.least),
            "mean": lambda a: F.try_divide(sum((F.coalesce(x, F.lit(0)) for x in a[1:]), F.coalesce(a[0], F.lit(0))), sum((x.isNotNull().cast("int") for x in a[1:]), a[0].isNotNull().cast("int"))),
            "n": lambda a: sum((x.isNotNull().cast("int") for x in a[1:]), a[0].isNotNull().cast("int")), "nmiss": lambda a: sum((x.isNull().cast("int") for x in a[1:]), a[0].isNull().cast("int"))}


class Lower:
    """Lowers expressions over one DataFrame."""

    def __init__(self, dialect: str, df: DataFrame, plan: SelectPlan | None = None, known: dict | None = None, rowwise: bool = False, names: set | None = None):
        self.dialect, self.df, self.plan, self.known, self.rowwise, self.names = dialect, df, plan, known or {}, rowwise, names

    def kind(self, c: Column) -> T.DataType:
        return self.df.select(c).schema[0].dataType

    def condition(self, e) -> Column:
        c = self.value(e)
        return sas.truth(c, is_boolean(e)) if self.dialect == "sas" and not (is_boolean(e) and isinstance(e, A.Bin) and e.op in _COMPARISONS) else c

    def number(self, e) -> Column:
        c = self.value(e)
        return c.cast("double") if self.dialect == "sas" and is_boolean(e) else c

    def column(self, name: str, rel: str | None) -> Column:
        if rel in ("first", "last") and f"{rel}__{name}" in self.df.columns:
            return F.col(f"{rel}__{name}")
        if rel and self.names is not None and rel not in self.names:
            rel = None  # a relation's own name stays usable while its fields are unambiguous
        return F.col(f"`{rel}`.`{name}`" if rel else f"`{name}`")

    def value(self, e) -> Column:
        if e in self.known:
            return self.known[e]
        match e:
            case A.Col(name, rel):
                return self.column(name, rel)
            case A.Lit(v):
                return F.lit(v)
            case A.Pos(i):
                return F.col(f"`{self.df.columns[i]}`")
            case A.Scalar(q):
                return self.plan.scalar(q)
            case A.Exists(q):
                return self.plan.select(q).exists()  # of itself; one that refers to the query around it is a join
            case A.Bin("and", a, b):
                return self.condition(a) & self.condition(b)
            case A.Bin("or", a, b):
                return self.condition(a) | self.condition(b)
            case A.Un("not", a):
                return ~self.condition(a)
            case A.Un("-", a):
                return -self.number(a)
            case A.Bin(op, a, b) if op in _COMPARISONS:
                return self.compare(op, a, b)
            case A.Bin("like", a, A.Lit(pattern)):
                return self.value(a).like(pattern)
            case A.Bin("matches", a, A.Lit(pattern)):
                return self.value(a).rlike(f"^(?:{pattern})$")
            case A.Bin("||", a, b):
                return F.concat(self.value(a), self.value(b))
            case A.Bin(op, a, b):
                return self.arithmetic(op, self.number(a), self.number(b))
            case A.In(a, items, neg):
                x = self.value(a)
                hit = x.isin(*[i.value for i in items]) if all(isinstance(i, A.Lit) and i.value is not None for i in items) else F.array_contains(F.array(*[self.value(i) for i in items]), x)
                if self.dialect == "sas":
                    hit = F.coalesce(hit, F.lit(False))
                return ~hit if neg else hit
            case A.Between(a, lo, hi, neg):
                both = self.compare(">=", a, lo) & self.compare("<=", a, hi)
                return ~both if neg else both
            case A.IsNull(a, neg):
                return self.value(a).isNotNull() if neg else self.value(a).isNull()
            case A.Case(whens, other):
                out = F
                for c, v in whens:
                    out = out.when(self.condition(c), self.value(v))
                return out if other is None else out.otherwise(self.value(other))
            case A.Cast(a, to):
                return self.value(a).try_cast({"int": "int", "integer": "int", "bigint": "bigint", "long": "bigint", "chararray": "string"}.get(to, to))
            case A.Call():
                return self.call(e)
        raise LanguageError(f"{self.dialect}: no rule for {e!r}")

    def compare(self, op: str, a, b) -> Column:
        x, y = self.number(a), self.number(b)
        if self.dialect != "sas":
            return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        sides = [self.kind(c) for c in (x, y)]
        if (isinstance(sides[0], T.StringType) != isinstance(sides[1], T.StringType)) and not any(isinstance(t, T.NullType) for t in sides):
            raise LanguageError(f"sas: {A.show(a)} {op} {A.show(b)} compares a number with text")
        return sas.compare(op, x, y, isinstance(b, A.Lit) and b.value is not None)

    def arithmetic(self, op: str, a: Column, b: Column) -> Column:
        if op == "/":
            if self.dialect == "pig" and all(isinstance(self.kind(c), (T.IntegerType, T.LongType, T.ShortType)) for c in (a, b)):
                return F.when(b != 0, F.call_function("div", a, F.nullif(b, F.lit(0))))
            return F.try_divide(a.cast("double"), b.cast("double"))
        if op == "**":
            return F.pow(a, b)
        return {"+": a.__add__, "-": a.__sub__, "*": a.__mul__, "%": lambda y: F.try_mod(a, y)}[op](b)

    def call(self, e: A.Call) -> Column:
        if A.is_aggregate(e) and not self.rowwise:
            return self.aggregate(e)
        table = _FUNCTIONS | (_ROWWISE if self.rowwise else {})
        if e.name == "round":
            return _round([self.number(a) for a in e.args], e.args, self.dialect)
        if e.name not in table:
            raise LanguageError(f"{self.dialect}: the function {e.name} is not known")
        return table[e.name]([self.condition(a) if e.name == "if" and i == 0 else self.value(a) for i, a in enumerate(e.args)])

    def aggregate(self, e: A.Call) -> Column:
        star = not e.args or isinstance(e.args[0], A.Star)
        x = F.lit(1) if star else self.number(e.args[0])
        if e.distinct:
            return {"count": F.count_distinct, "sum": F.sum_distinct}[e.name](x)
        return {"sum": F.sum, "avg": F.avg, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count, "n": F.count, "std": F.stddev_samp, "stddev": F.stddev_samp, "var": F.var_samp, "variance": F.var_samp, "nmiss": lambda c: F.count_if(c.isNull())}[e.name](x)


def _name(p: A.Proj, n: int) -> str:
    return p.alias or (p.expr.name if isinstance(p.expr, A.Col) else f"_auto{n}")


class SelectPlan:
    """Runs SELECT statements over a catalog."""

    def __init__(self, catalog: Catalog, dialect: str):
        self.catalog, self.dialect = catalog, dialect
        #: Named queries in sight, innermost last.
        self.named: list[dict[str, DataFrame]] = []

    def scalar(self, q: A.Select) -> Column:
        """The first value of the first row, null where there is none; computed once, when the plan runs.

        Where the rows have no order, more than one row is an error, as there is no first.
        """
        df = self.select(q)
        if SEQ in df.columns:
            df = first_row(df)
        return df.select(visible(df).columns[0]).scalar()

    def table(self, name: str) -> DataFrame:
        for scope in reversed(self.named):
            if name in scope:
                return scope[name]
        return self.catalog.raw(name)

    def source(self, s, ordered: bool = True) -> DataFrame:
        df = self.table(s.name) if isinstance(s, A.Table) else self.select(s.query)
        if not ordered:
            df = visible(df)
        alias = s.alias or (s.name.rpartition(".")[2] if isinstance(s, A.Table) else None)
        return df.alias(alias) if alias else df

    def select(self, q: A.Select) -> DataFrame:
        scope: dict[str, DataFrame] = {}
        self.named.append(scope)
        try:
            for name, inner in q.named:  # each sees those before it
                scope[name] = self.select(inner)
            out = self.core(q.cores[0], q.order if len(q.cores) == 1 else ())
            for c in q.cores[1:]:
                out = visible(out).union(visible(self.core(c, ())))
        finally:
            self.named.pop()
        if q.order and len(q.cores) > 1:
            low = Lower(self.dialect, out)
            out = out.orderBy(*[(self._bare(low, e)).desc() if d else self._bare(low, e).asc() for e, d in q.order])
        if q.offset is not None:
            out = out.offset(q.offset.value)
        if q.limit is not None:
            out = out.limit(q.limit.value)
        return out

    def _bare(self, low: Lower, e) -> Column:
        return low.value(A.Col(e.name) if isinstance(e, A.Col) else e)

    def core(self, c: A.Core, order: tuple) -> DataFrame:
        return self._selected(c, order, self.tables(c))

    def tables(self, c: A.Core) -> DataFrame:
        """The tables of FROM, joined."""
        df = self.source(c.source, ordered=not c.joins)
        for j in c.joins:
            right = self.source(j.source, ordered=False)
            if j.kind == "cross":
                df = df.crossJoin(right)
            else:
                both = Lower(self.dialect, df.join(right, how="cross"), self)  # for the types of the condition only
                df = df.join(right, both.condition(j.on), j.kind)
        return df

    def having_rows(self, df: DataFrame, names: set, q: A.Select, negated: bool) -> DataFrame:
        """Rows of ``df`` for which a query that refers to it has rows (or none): a semi (or anti) join on what it says of them."""
        c = q.cores[0]
        if len(q.cores) > 1 or c.group or c.having is not None or q.limit is not None or any(A.is_aggregate(x) for x in A.walk(c.cols)):
            raise LanguageError(f"{self.dialect}: EXISTS that refers to the query around it takes a plain SELECT")
        self.named.append({})
        try:
            for name, inner in q.named:
                self.named[-1][name] = self.select(inner)
            rows, own = visible(self.tables(c)), source_names(c)
            parts = conjuncts_of(c.where)
            tied = [p for p in parts if any(isinstance(x, A.Col) and x.rel in names - own for x in A.walk(p))]
            for p in parts:
                if p not in tied:
                    rows = self.filtered(rows, own, p)
            both = Lower(self.dialect, df.join(rows, how="cross"), self)  # for the types of the condition only
            return df.join(rows, reduce(lambda a, b: a & b, [both.condition(p) for p in tied]), "left_anti" if negated else "left_semi")
        finally:
            self.named.pop()

    def filtered(self, df: DataFrame, names: set, cond) -> DataFrame:
        negated = isinstance(cond, A.Un) and cond.op == "not" and isinstance(cond.arg, A.Exists)
        inner = cond.arg if negated else cond
        if isinstance(inner, A.Exists) and refers_to(inner.query, names):
            return self.having_rows(df, names, inner.query, negated)
        return df.filter(Lower(self.dialect, df, self).condition(cond))

    def _selected(self, c: A.Core, order: tuple, df: DataFrame) -> DataFrame:
        for part in conjuncts_of(c.where):
            df = self.filtered(df, source_names(c), part)
        low = Lower(self.dialect, df, self)
        cols: list[A.Proj] = []
        for p in c.cols:
            if isinstance(p.expr, A.Star):
                names = visible(df.select(f"{p.expr.rel}.*") if p.expr.rel else df).columns
                cols.extend(A.Proj(A.Col(n, p.expr.rel), n) for n in names)
            else:
                cols.append(p)
        names = [_name(p, i + 1) for i, p in enumerate(cols)]
        by_alias = {A.Col(n): p.expr for n, p in zip(names, cols) if p.alias}
        having = c.having if c.having is None else _replace(c.having, by_alias)
        order = tuple((_replace(e, by_alias), d) for e, d in order)
        wanted = [*(p.expr for p in cols), *([having] if having is not None else []), *(e for e, _ in order)]
        aggregates = list(dict.fromkeys(x for e in wanted for x in A.walk(e) if A.is_aggregate(x)))
        grouped = bool(c.group or aggregates)
        if grouped:
            keys = {_replace(k, by_alias): f"_k{i}" for i, k in enumerate(c.group)}
            known = {k: F.col(n) for k, n in keys.items()} | {a: F.col(f"_a{i}") for i, a in enumerate(aggregates)}
            loose = list(dict.fromkeys(x for e in wanted for x in _outside(e, known) if isinstance(x, A.Col)))
            if loose and self.dialect != "sas":
                raise LanguageError(f"{self.dialect}: {A.show(loose[0])} is neither grouped nor aggregated")
            # plain columns beside aggregates take the group's first row; without an order, its least row by these columns
            row = F.struct(*[low.value(x).alias(f"f{i}") for i, x in enumerate(loose)]) if loose else None
            first = [(F.min_by(row, SEQ) if SEQ in df.columns else F.min(row)).alias("_first")] if loose else []
            known |= {x: F.col(f"_first.f{i}") for i, x in enumerate(loose)}
            df = df.groupBy(*[low.value(k).alias(n) for k, n in keys.items()]).agg(*[low.value(a).alias(f"_a{i}") for i, a in enumerate(aggregates)], *first) if aggregates or first else df.select(*[low.value(k).alias(n) for k, n in keys.items()]).distinct()
            low = Lower(self.dialect, df, self, known)
            if having is not None:
                df = df.filter(low.condition(having))
        elif having is not None:
            df = df.filter(low.condition(having))
        values = [low.number(p.expr) if self.dialect == "sas" else low.value(p.expr) for p in cols]
        keep = [F.col(SEQ)] if SEQ in df.columns and not c.distinct else []
        sort = [low.value(e).desc() if d else low.value(e).asc() for e, d in order]
        if sort and not c.distinct:
            df = df.orderBy(*sort, *([SEQ] if keep and self.dialect == "sas" else []))
        df = df.select(*[v.alias(n) for v, n in zip(values, names)], *keep)
        if c.distinct:
            df = df.distinct()
            if sort:
                back = {p.expr: A.Col(n) for n, p in zip(names, cols)}
                out = Lower(self.dialect, df)
                df = df.orderBy(*[out.value(_replace(e, back)).desc() if d else out.value(_replace(e, back)).asc() for e, d in order])
        return df


def source_names(c: A.Core) -> set:
    """The names by which columns of a query's tables are qualified."""
    return {s.alias or (s.name.rpartition(".")[2] if isinstance(s, A.Table) else None) for s in (c.source, *(j.source for j in c.joins))}


def conjuncts_of(cond) -> list:
    return [] if cond is None else A.conjuncts(cond)


def refers_to(q: A.Select, names: set) -> bool:
    """Whether a query's WHERE names a source that is not its own but one of ``names``."""
    return any(isinstance(x, A.Col) and x.rel in names - source_names(c) for c in q.cores for x in A.walk(c.where))


def _replace(e, by: dict):
    """The tree with nodes replaced; replaced parts are not entered."""
    from dataclasses import fields, is_dataclass, replace

    if isinstance(e, tuple):
        return tuple(_replace(x, by) for x in e)
    if not is_dataclass(e) or isinstance(e, (A.Scalar, A.Derived, A.Exists)):
        return e
    if e in by:
        return by[e]
    return replace(e, **{f.name: _replace(getattr(e, f.name), by) for f in fields(e)})


def _outside(e, known: dict):
    """Columns of a tree that lie in none of the known nodes."""
    from dataclasses import fields, is_dataclass

    if isinstance(e, tuple):
        for x in e:
            yield from _outside(x, known)
    elif is_dataclass(e) and e not in known and not isinstance(e, (A.Scalar, A.Derived, A.Exists)):
        if isinstance(e, A.Col):
            yield e
        for f in fields(e):
            yield from _outside(getattr(e, f.name), known)
