"""DATA steps as plans: sources, then the statements in order, then the outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.catalog import SEQ, Catalog, first_row, visible
from quillspan.functions import sas
from quillspan.lang import ast as A
from quillspan.lang.parser import LanguageError
from quillspan.lang.programs import Statement
from quillspan.operators.bymerge import by_merge, by_update
from quillspan.plans.lower import Lower, is_boolean


def datalines(spark, fields: list[tuple], lines: list[str]) -> DataFrame:
    """List input: blank-separated values, a dot is missing, a short row is padded with missing."""
    rows = [(i, line) for i, line in enumerate(lines) if line.strip()]
    parts = F.split(F.trim("line"), r"\s+")
    df = spark.createDataFrame(rows, "n int, line string")

    def read(i: int, kind: str, informat: str | None):
        text = F.nullif(F.get(parts, F.lit(i)), F.lit("."))
        return text if kind == "char" else sas.read_date(text, informat) if kind == "date" else text.try_cast("double")

    return df.select(*[read(i, k, f).alias(n) for i, (n, k, f) in enumerate(fields)], F.struct("n").alias(SEQ))


def read_lines(df: DataFrame, text: str, fields: list[tuple]) -> DataFrame:
    """The same over a column of text lines, at any size."""
    parts = F.split(F.trim(text), r"\s+")
    get = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit("."))
    kinds = {"char": lambda c, f: c, "date": sas.read_date, "num": lambda c, f: c.try_cast("double")}
    return df.filter(F.trim(text) != "").select(*[kinds[k](get(i), f).alias(n) for i, (n, k, f) in enumerate(fields)])


def infile(spark, path: str, fields: list[tuple], opts: dict) -> DataFrame:
    """Lines of a file, or of all files of a folder, as rows: values between delimiters, or between blanks where none is given.

    With DSD a quoted value may hold the delimiter and two delimiters in a row are a missing value. A dot is missing, a short line is
    padded with missing. Rows are ordered by file, by the place of their split in it, and by line.
    """
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    names = [n for n, _, _ in fields]
    if opts["dsd"] or opts["dlm"]:
        reader = spark.read.option("header", opts["firstobs"] == 2).option("enforceSchema", True).option("quote", '"' if opts["dsd"] else "\u0000")
        text = ", ".join(f"`{n}` string" for n in names)
        df = reader.csv(path, schema=text, sep=opts["dlm"] or ",").select(*[F.trim(F.col(f"`{n}`")).alias(n) for n in names], place.alias(SEQ))
    else:
        lines = spark.read.text(path).select("value", place.alias(SEQ))
        if opts["firstobs"] == 2:
            first = lines.select(F.col(f"{SEQ}.f").alias("__f"), F.col(SEQ).alias("__s")).groupBy("__f").agg(F.min("__s").alias("__s"))
            lines = lines.join(first, (F.col(f"{SEQ}.f") == F.col("__f")) & (F.col(SEQ) == F.col("__s")), "left_anti")
        parts = F.split(F.trim("value"), r"\s+")
        df = lines.filter(F.trim("value") != "").select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)], SEQ)
    read = {"char": lambda c, f: c, "date": sas.read_date, "num": lambda c, f: c.try_cast("double")}
    value = lambda n: F.nullif(F.nullif(F.col(f"`{n}`"), F.lit(".")), F.lit(""))
    return df.select(*[read[k](value(n), f).alias(n) for n, k, f in fields], SEQ)


class DataStep:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def dataset(self, ds: dict) -> DataFrame:
        df = self.catalog.raw(ds["name"])
        return self.options(df, ds)

    def options(self, df: DataFrame, ds: dict) -> DataFrame:
        if "where" in ds:
            df = df.filter(Lower("sas", df, rowwise=True).condition(ds["where"]))
        if "keep" in ds:
            df = df.select(*[c for c in df.columns if c in ds["keep"] or c == SEQ])
        if "drop" in ds:
            df = df.drop(*ds["drop"])
        return df.withColumnsRenamed(ds.get("rename", {}))

    def run(self, s: Statement) -> None:
        body, outputs = s.args["body"], s.args["outputs"]
        by = next((b[1] for b in body if b[0] == "by"), [])
        df, flags = None, []
        lookups = []
        for st in body:
            if st[0] == "datalines":
                fields = next(b[1] for b in body if b[0] == "input")
                df = datalines(self.catalog.spark, fields, st[1])
            elif st[0] == "infile":
                fields = next((b[1] for b in body if b[0] == "input"), None)
                if fields is None:
                    raise LanguageError(f"line {s.lines[0]}: INFILE needs INPUT")
                df = infile(self.catalog.spark, self.catalog.located(st[1]), fields, st[2])
            elif st[0] == "update":
                if len(st[1]) != 2 or not by:
                    raise LanguageError(f"line {s.lines[0]}: UPDATE takes a master, a transaction table and BY")
                df = by_update(*[self.dataset(d) for d in st[1]], [b for b, _ in by])
            elif st[0] == "format":
                self.catalog.formats |= st[1]
            elif st[0] == "set":
                parts = [self.dataset(d) for d in st[1]]
                df = parts[0] if len(parts) == 1 else _stack(parts)
            elif st[0] == "merge":
                df, flags = self.merge(st[1], [b for b, _ in by], s)
                if df is None:
                    return
            elif st[0] == "first_row":
                lookups.append(self.dataset(st[1]))
        if df is None:
            raise LanguageError(f"line {s.lines[0]}: a DATA step needs SET, MERGE, UPDATE, INFILE or DATALINES")
        for look in lookups:
            df = attach_first_row(look, df)
        if by and any(b[0] == "set" for b in body):
            df, firsts = _by_flags(df, by, body)
            flags += firsts
        written = {o["name"]: [] for o in outputs}
        df = self.statements(df, body, written)
        keep = next((b[1] for b in body if b[0] == "keep"), None)
        drop = [n for b in body if b[0] == "drop" for n in b[1]] + flags
        rename = {k: v for b in body if b[0] == "rename" for k, v in b[1].items()}
        for o in outputs:
            name = o["name"]
            if name.rpartition(".")[2] == "_null_":
                continue
            parts = written[name]
            out = df if not any(written.values()) else reduce(DataFrame.unionByName, parts) if parts else df.filter(F.lit(False))
            if keep is not None:
                out = out.select(*[c for c in out.columns if c in keep or c == SEQ])
            out = self.options(out.drop(*drop).withColumnsRenamed(rename), o)
            self.catalog.put(name, out)

    def merge(self, sets: list[dict], by: list[str], s: Statement):
        sources = [(self.dataset(d), d.get("in")) for d in sets]
        absent = [d["name"] for d, (df, _) in zip(sets, sources) if not set(by) <= set(df.columns)]
        if not by or absent:
            for name in absent or [sets[0]["name"]]:
                self.catalog.messages.append(f"ERROR: BY variable {' '.join(by)} is not on input data set {name}")
            self.catalog.messages.append("NOTE: the step was stopped; its table has 0 rows")
            cols: dict[str, T.DataType] = {}
            for df, _ in sources:
                for f in visible(df).schema:
                    cols.setdefault(f.name, f.dataType)
            empty = self.catalog.spark.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in cols.items()]))
            for o in s.args["outputs"]:
                self.catalog.put(o["name"], empty)
            return None, []
        return by_merge(sources, by), [f for _, f in sources if f]

    def statements(self, df: DataFrame, body: list, written: dict) -> DataFrame:
        for st in body:
            low = Lower("sas", df, rowwise=True)
            match st[0]:
                case "if" | "where":
                    df = df.filter(low.condition(st[1]))
                case "delete":
                    df = df.filter(F.lit(False))
                case "assign":
                    df = df.withColumn(st[1], low.number(st[2]))
                case "output":
                    for name in st[1] or list(written):
                        written[name].append(df)
                case "if_then":
                    df = self.branch(df, st, written)
        return df

    def branch(self, df: DataFrame, st: tuple, written: dict) -> DataFrame:
        """IF c THEN ... ELSE ...: assignments become conditional columns, DELETE and OUTPUT filters."""
        _, cond, then, other = st
        low = Lower("sas", df, rowwise=True)
        df = df.withColumn("__if", low.condition(cond))
        arms = ((F.col("__if"), then), (~F.col("__if"), other or []))
        for test, arm in arms:
            for s in arm:
                low = Lower("sas", df, rowwise=True)
                match s[0]:
                    case "assign":
                        new = low.number(s[2])
                        old = F.col(s[1]) if s[1] in df.columns else F.lit(None).cast(low.kind(new))
                        df = df.withColumn(s[1], F.when(test, new).otherwise(old))
                    case "delete":
                        df = df.filter(~test)
                    case "output":
                        for name in s[1] or list(written):
                            written[name].append(df.filter(test).drop("__if"))
                    case "if_then":
                        inner = ("if_then", s[1], s[2], s[3])
                        held = df.withColumnRenamed("__if", "__outer")
                        t = F.col("__outer") if test is arms[0][0] else ~F.col("__outer")
                        yes = self.branch(held.filter(t), inner, written)
                        no = held.filter(~t)
                        df = yes.unionByName(no, allowMissingColumns=True).withColumnRenamed("__outer", "__if")
                    case _:
                        raise LanguageError(f"{s[0]} is not supported in a branch")
        return df.drop("__if")


def _stack(parts: list[DataFrame]) -> DataFrame:
    """SET of several tables: one after the other, columns by name; each table keeps its own order behind its number."""
    if all(SEQ in p.columns for p in parts):
        kinds = [p.schema[SEQ].dataType for p in parts]

        def order(i: int) -> Column:
            return F.struct(F.lit(i).alias("part"), *[(F.col(SEQ) if j == i else F.lit(None).cast(k)).alias(f"at{j}") for j, k in enumerate(kinds)])

        parts = [p.withColumn(SEQ, order(i)) for i, p in enumerate(parts)]
    else:
        parts = [visible(p) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _by_flags(df: DataFrame, by: list[tuple[str, bool]], body: list) -> tuple[DataFrame, list[str]]:
    """first.x and last.x as columns first__x and last__x, where the step names them."""
    if SEQ not in df.columns:
        raise ValueError("BY groups need a table with an order")
    made = []
    for i, (name, _) in enumerate(by):
        keys = [F.col(b) for b, _ in by[: i + 1]]
        for flag, order in (("first", F.col(SEQ).asc()), ("last", F.col(SEQ).desc())):
            if any(x == A.Col(name, flag) for b in body for x in A.walk(b)):
                df = df.withColumn(f"{flag}__{name}", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1).cast("double"))
                made.append(f"{flag}__{name}")
    return df, made


def attach_first_row(look: DataFrame, main: DataFrame) -> DataFrame:
    """Every row of ``main`` with the first row of ``look`` beside it; missing values where ``look`` is empty. Shared columns take main's value."""
    one = visible(first_row(look)).drop(*visible(main).columns)
    return main.join(F.broadcast(one), F.lit(True), "left")  # at most one row


__all__ = ["DataStep", "attach_first_row", "datalines", "read_lines", "is_boolean"]
