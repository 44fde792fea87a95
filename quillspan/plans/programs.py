"""Running programs of the three dialects over a catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.catalog import SEQ, Catalog, visible
from quillspan.lang import ast as A
from quillspan.lang.parser import LanguageError
from quillspan.lang.programs import Statement, parse_hive, parse_pig, parse_sas
from quillspan.plans.datastep import DataStep
from quillspan.plans.lower import Lower, SelectPlan

#: The scalar types of the dialects; any other type fails.
TYPES = {"int": "int", "integer": "int", "long": "bigint", "bigint": "bigint", "double": "double", "float": "float", "chararray": "string", "string": "string", "varchar": "string", "char": "string", "boolean": "boolean", "bool": "boolean",
         "date": "date", "timestamp": "timestamp_ntz", "smallint": "smallint", "tinyint": "tinyint"}


def spark_type(name: str) -> str:
    base = name.lower().split("(")[0]
    if base in ("decimal", "array", "map", "struct") or "<" in name:
        return name
    if base not in TYPES:
        raise LanguageError(f"the type {name} is not known")
    return TYPES[base]


def _ddl(cols: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{n}` {spark_type(t)}" for n, t in cols)


# ---- Hive ----
def run_hive(catalog: Catalog, text: str) -> DataFrame | None:
    """Runs a script; returns the result of its last SELECT, if there is one."""
    catalog.default, last = "", None
    for s in parse_hive(text):
        plan = SelectPlan(catalog, "hive")
        if s.kind == "create_external":
            header = int(s.args["props"].get("skip.header.line.count", "0")) > 0
            catalog.put(s.target, catalog.spark.read.csv(catalog.located(s.args["location"]), schema=_ddl(s.args["cols"]), sep=s.args["sep"], header=header, enforceSchema=True))
        elif s.kind == "declare":
            catalog.put(s.target, catalog.spark.createDataFrame([], _ddl(s.args["cols"])))
        elif s.kind == "create_table":
            catalog.store(s.target, visible(plan.select(s.args["query"])))
        elif s.kind == "insert":  # appends; columns by place
            old, new = catalog.get(s.target), visible(plan.select(s.args["query"]))
            if len(old.columns) != len(new.columns):
                raise LanguageError(f"{s.target} has {len(old.columns)} columns, the query {len(new.columns)}")
            new = new.toDF(*old.columns).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema])
            catalog.store(s.target, new, append=True)
        else:
            last = visible(plan.select(s.args["query"]))
    return last


# ---- Pig ----
class Pig:
    """Relations by alias. A grouped relation stays a pair of relation and keys until a FOREACH says what to compute."""

    def __init__(self, catalog: Catalog):
        catalog.default = ""
        self.catalog, self.rels, self.grouped, self.registered, self.stores = catalog, {}, {}, [], []
        #: COGROUP statements by target, for a FOREACH that only aggregates their bags.
        self.cogrouped: dict[str, Statement] = {}
        #: Names by which a relation's fields can be qualified: its own, or those of a join's sides.
        self.names: dict[str, set] = {}

    def rel(self, name: str) -> DataFrame:
        if name not in self.rels:
            self.rels[name] = self.catalog.get(name).alias(name)
        return self.rels[name]

    def low(self, name: str, **more) -> Lower:
        return Lower("pig", self.rel(name), names=self.names.get(name, {name}), **more)

    def run(self, text: str, params: dict | None = None) -> dict[str, DataFrame]:
        for s in parse_pig(text, params):
            made = getattr(self, f"_{s.kind}")(s)
            if s.target and made is not None:
                # the fields of a join keep the names of its sides
                if s.kind in ("join", "cross"):
                    sides = [x[0] for x in s.args["sides"]] if s.kind == "join" else s.args["rels"]
                    names = set().union(*(self.names.get(x, {x}) for x in sides))
                else:
                    names = self.names.get(s.args.get("rel")) if s.kind in ("filter", "order", "limit", "distinct") else None
                self.rels[s.target] = made if names else made.alias(s.target)
                self.names[s.target] = names or {s.target}
        return self.rels

    def _register(self, s: Statement):
        self.registered.append(s.args["path"])  # recorded; Spark runs no foreign code

    def _load(self, s: Statement):
        path, cols = s.args["path"], s.args["cols"]
        if path.lower() in self.catalog.tables:
            df = self.catalog.get(path)
            return df.select(*[F.col(n).cast(spark_type(t)).alias(n) for n, t in cols]) if cols else df
        return self.catalog.spark.read.csv(self.catalog.located(path), schema=_ddl(cols), sep=s.args["sep"], header=False)

    def _store(self, s: Statement):
        self.stores.append(s)
        path = self.catalog.located(s.args["path"])
        if "://" in path or path.startswith("/"):
            self.rel(s.args["rel"]).write.mode("overwrite").csv(path, sep=s.args["sep"], header=False)
        else:
            self.catalog.messages.append(f"NOTE: {s.args['rel']} was not written: {path} is relative and the catalog has no folder")

    def _filter(self, s: Statement):
        return self.rel(s.args["rel"]).filter(self.low(s.args["rel"]).condition(s.args["cond"]))

    def _split(self, s: Statement):
        df = self.rel(s.args["rel"])
        for name, cond in s.args["branches"]:
            self.rels[name] = df.filter(self.low(s.args["rel"]).condition(cond)).alias(name)

    def _group(self, s: Statement):
        self.grouped[s.target] = (s.args["rel"], s.args["keys"])

    def _foreach(self, s: Statement):
        rel, projs = s.args["rel"], s.args["projs"]
        names = [p.alias or (p.expr.name if isinstance(p.expr, A.Col) else f"_auto{i + 1}") for i, p in enumerate(projs)]
        if rel in self.cogrouped and (counted := self._of_bags(self.cogrouped[rel], [p.expr for p in projs], names)) is not None:
            return counted
        if rel not in self.grouped:
            df = self.rel(rel)
            low = self.low(rel, rowwise=True)
            return df.select(*[low.value(p.expr).alias(n) for p, n in zip(projs, names)])
        base, keys = self.grouped[rel]
        df = self.rel(base)
        low = self.low(base)
        # COUNT(bag) counts rows; SUM(bag.f) reads the field f of the grouped relation
        exprs = [_in_bag(p.expr, base) for p in projs]
        aggregates = list(dict.fromkeys(x for e in exprs for x in A.walk(e) if A.is_aggregate(x)))
        grouped = df.groupBy(*[low.value(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*[low.aggregate(a).alias(f"_a{i}") for i, a in enumerate(aggregates)] or [F.count("*").alias("_n")])
        known = {a: F.col(f"_a{i}") for i, a in enumerate(aggregates)} | {k: F.col(f"_k{i}") for i, k in enumerate(keys)}
        known[A.Col("group")] = F.col("_k0") if len(keys) == 1 else F.struct(*[F.col(f"_k{i}") for i in range(len(keys))]) if keys else F.lit("all")
        for i, k in enumerate(keys):
            if isinstance(k, A.Col):
                known[A.Col(k.name, "group")] = F.col(f"_k{i}")
        out = Lower("pig", grouped, known=known, rowwise=True)
        return grouped.select(*[out.value(e).alias(n) for e, n in zip(exprs, names)])

    def _join(self, s: Statement):
        (first, keys, _), *others = s.args["sides"]
        df = self.rel(first)
        low = self.low(first)
        left = [low.value(k if not isinstance(k, A.Col) or k.rel else A.Col(k.name, first)) for k in keys]
        for name, other, _ in others:
            right = self.rel(name)
            on = [a == self.low(name).value(k if k.rel else A.Col(k.name, name)) for a, k in zip(left, other)]
            df = df.join(right, reduce(lambda a, b: a & b, on), "inner")
        return df

    def _cogroup(self, s: Statement):
        """Whole bags, for what needs them; a FOREACH that only aggregates them never builds them (``_of_bags``)."""
        self.cogrouped[s.target] = s
        sides = [F.collect_list(F.struct(*self.rel(name).columns)).alias(name) for name, _, _ in s.args["sides"]]
        out = self._met(s, [[bag] for bag in sides], [F.col(name) for name, _, _ in s.args["sides"]])
        bags = [F.coalesce(n, F.array().cast(out.schema[n].dataType)).alias(n) for n, _, _ in s.args["sides"]]
        return out.select(self._group_key(s), *bags)

    def _group_key(self, s: Statement) -> Column:
        n = len(s.args["sides"][0][1])
        return (F.col("_k0") if n == 1 else F.struct(*[F.col(f"_k{j}") for j in range(n)])).alias("group")

    def _met(self, s: Statement, wanted: list[list[Column]], there: list[Column]) -> DataFrame:
        """The sides of a COGROUP, each aggregated by its keys, met on them: _k0, _k1, ... and the aggregates. ``there`` tells that a side has rows."""
        ks = [f"_k{j}" for j in range(len(s.args["sides"][0][1]))]
        out = None
        for (name, keys, _), aggs in zip(s.args["sides"], wanted):
            low = self.low(name)
            d = self.rel(name).groupBy(*[low.value(k).alias(c) for c, k in zip(ks, keys)]).agg(*aggs)
            if out is None:
                out = d
                continue
            d = d.withColumnsRenamed({k: f"r{k}" for k in ks})
            out = out.join(d, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"r{k}") for k in ks]), "full").withColumns({k: F.coalesce(k, f"r{k}") for k in ks}).drop(*[f"r{k}" for k in ks])
        for (_, _, inner), has in zip(s.args["sides"], there):
            if inner:
                out = out.filter(has.isNotNull())
        return out

    def _of_bags(self, s: Statement, exprs: list, names: list[str]) -> DataFrame | None:
        """A FOREACH over a COGROUP whose bags occur only in SIZE, COUNT and other aggregates: combined before the shuffle, no bag is built.

        None where a bag is used as a whole.
        """
        sides = [name for name, _, _ in s.args["sides"]]
        wanted = [[F.count("*").alias(f"_n{i}")] for i in range(len(sides))]
        known: dict = {}
        for x in dict.fromkeys(x for e in exprs for x in A.walk(e) if isinstance(x, A.Call) and len(x.args) == 1 and isinstance(x.args[0], A.Col)):
            c = x.args[0]
            if c.rel is None and c.name in sides and x.name in ("size", "count"):
                known[x] = F.coalesce(F.col(f"_n{sides.index(c.name)}"), F.lit(0)).cast("int" if x.name == "size" else "long")
            elif c.rel in sides and A.is_aggregate(x):
                i = sides.index(c.rel)
                column = f"_s{i}_{len(wanted[i])}"
                wanted[i].append(self.low(c.rel).aggregate(A.Call(x.name, (A.Col(c.name),), x.distinct)).alias(column))
                known[x] = F.coalesce(column, F.lit(0)) if x.name == "count" else F.col(column)
        from quillspan.plans.lower import _replace

        bare = [_replace(e, {x: A.Lit(0) for x in known}) for e in exprs]
        if any(isinstance(y, A.Col) and (y.name in sides or y.rel in sides) for e in bare for y in A.walk(e)):
            return None
        met = self._met(s, wanted, [F.col(f"_n{i}") for i in range(len(sides))])
        known[A.Col("group")] = self._group_key(s)
        low = Lower("pig", met, known=known, rowwise=True)
        return met.select(*[low.value(e).alias(n) for e, n in zip(exprs, names)])

    def _order(self, s: Statement):
        df = self.rel(s.args["rel"])
        low = self.low(s.args["rel"])
        return df.orderBy(*[low.value(e).desc() if d else low.value(e).asc() for e, d in s.args["keys"]])

    def _limit(self, s: Statement):
        return self.rel(s.args["rel"]).limit(s.args["n"].value)

    def _distinct(self, s: Statement):
        return self.rel(s.args["rel"]).distinct()

    def _union(self, s: Statement):
        return reduce(DataFrame.union, [self.rel(r) for r in s.args["rels"]])

    def _cross(self, s: Statement):
        return reduce(DataFrame.crossJoin, [self.rel(r) for r in s.args["rels"]])


def _in_bag(e, base: str):
    from quillspan.plans.lower import _replace

    by = {}
    for x in A.walk(e):
        if isinstance(x, A.Call) and A.is_aggregate(x) and isinstance(x.args[0], A.Col):
            c = x.args[0]
            by[x] = A.Call(x.name, (A.Star() if c.rel is None and c.name == base else A.Col(c.name),), x.distinct)
    return _replace(e, by)


# ---- SAS ----
def run_sas(catalog: Catalog, text: str, block: int | None = None) -> Catalog:
    """Runs a program; its tables are in the catalog afterwards, its messages too. With ``block`` only that step runs, on tables put there before."""
    catalog.default = "work"
    step = DataStep(catalog)
    for i, s in enumerate(parse_sas(text)):
        if block not in (None, i):
            continue
        if s.kind == "libname":
            catalog.libs.setdefault(s.target, s.args["path"])
        elif s.kind == "data":
            step.run(s)
        elif s.kind == "sql":
            plan = SelectPlan(catalog, "sas")
            for name, q in s.args["creates"]:
                df = plan.select(q)
                if name:
                    catalog.put(name, df)
        elif s.kind == "sort":
            df = step.options(catalog.raw(s.args["data"]["name"]), s.args["data"])
            if s.args["nodupkey"]:
                keys = [b for b, _ in s.args["by"]]
                if SEQ not in df.columns:
                    raise ValueError("NODUPKEY keeps the first row of each key; the table needs an order")
                cols = [c for c in df.columns if c not in keys]
                df = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), SEQ).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in cols]).select(*df.columns)
            seq = [F.col(SEQ)] if SEQ in df.columns else []
            # the new order: the keys, then the old order
            keys = [falling(F.col(b), df.schema[b].dataType) if d else F.col(b) for b, d in s.args["by"]]
            catalog.put(s.target, df.withColumn(SEQ, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], *[x.alias("was") for x in seq])))
    return catalog


def falling(c: Column, kind: T.DataType) -> Column:
    """A value that rises where the column falls; a missing value, the least of all, comes last.

    Numbers and times are negated. Text is turned into the complement of its bytes with an end mark above all of them, so that a text
    comes behind those it begins.
    """
    if isinstance(kind, T.StringType):
        down = F.concat(F.translate(F.hex(F.encode(c, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    elif isinstance(kind, T.DateType):
        down = -F.unix_date(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        down = -F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.BooleanType):
        down = -c.cast("int")
    else:
        down = -c
    return F.struct(c.isNull().alias("missing"), down.alias("down"))


def schema_union(dfs: list[DataFrame]) -> list[str]:
    """Columns of all tables in first-seen order."""
    return list(dict.fromkeys(c for d in dfs for c in visible(d).columns))
