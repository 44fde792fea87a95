"""Comparing tables as multisets, and tests of decomposable aggregates and of conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.lang import ast as A
from quillspan.operators.ranking import global_rank
from quillspan.plans.lower import Lower

#: Digits behind the point that two numbers must share.
DIGITS = 6
VERDICTS = ["FAIL", "REF_MISSING", "CONV_MISSING", "PASS"]


def _number(d: Column) -> Column:
    """A finite double rounded to DIGITS, without needless zeros."""
    r = F.round(d, DIGITS)
    exact = F.regexp_replace(d.try_cast(f"decimal(34,{DIGITS})").cast("string"), r"\.?0+$", "")
    return F.when(d.isNotNull(), F.when(r == 0, "0").otherwise(F.coalesce(exact, F.regexp_replace(F.format_string("%.0f", r), r"\.0*$", ""))))


def _special(low: Column) -> Column:
    """nan, inf and -inf in one spelling, else null."""
    bare = F.regexp_replace(low, r"^[+-]", "")
    return F.when(bare == "nan", "nan").when(bare.isin("inf", "infinity"), F.concat(F.when(F.startswith(low, F.lit("-")), "-").otherwise(""), F.lit("inf")))


def normal(c: Column, kind: T.DataType | None = None) -> Column:
    """One cell as canonical text: trimmed; numbers rounded, whole ones without a point; one spelling of nan and infinities. Null stays null.

    With the column's type, integers and doubles skip what only text needs.
    """
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return c.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        odd = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(odd, _special(F.lower(c.cast("string")))).otherwise(_number(c.cast("double")))
    s = F.trim(c.cast("string"), F.lit(" \t\r\n"))
    d = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
    return F.coalesce(_special(F.lower(s)), _number(d), s)


def multiset_diff(ref: DataFrame, conv: DataFrame) -> DataFrame:
    """Rows whose counts differ: c0, c1, ... (normalised, by place), ref_count, conv_count. One aggregation over both tables."""
    n = max(len(ref.columns), len(conv.columns))

    def side(df: DataFrame, a: int, b: int) -> DataFrame:
        cells = [normal(F.col(f"`{df.columns[i]}`"), df.schema[i].dataType) if i < len(df.columns) else F.lit(None).cast("string") for i in range(n)]
        return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)], F.lit(a).alias("ref"), F.lit(b).alias("conv"))

    both = side(ref, 1, 0).unionAll(side(conv, 0, 1))
    return both.groupBy(*[f"c{i}" for i in range(n)]).agg(F.sum("ref").alias("ref_count"), F.sum("conv").alias("conv_count")).filter("ref_count != conv_count")


def compare_rows(ref: DataFrame | None, conv: DataFrame | None, spark=None) -> DataFrame:
    """One row: verdict, n_mismatch. A missing reference beats a missing conversion."""
    if ref is None or conv is None:
        spark = spark or (ref if ref is not None else conv).sparkSession
        return spark.sql(f"select '{'REF_MISSING' if ref is None else 'CONV_MISSING'}' as verdict, 0L as n_mismatch")
    d = multiset_diff(ref, conv).agg(F.coalesce(F.sum(F.abs(F.col("ref_count") - F.col("conv_count"))), F.lit(0)).alias("n_mismatch"))
    return d.select(F.when(F.col("n_mismatch") == 0, "PASS").otherwise("FAIL").alias("verdict"), "n_mismatch")


def samples(ref: DataFrame, conv: DataFrame, n: int = 5) -> DataFrame:
    """Up to n differing rows: those the conversion lacks first, then those it has too often; by value."""
    d = multiset_diff(ref, conv)
    return d.orderBy((F.col("ref_count") < F.col("conv_count")).asc(), *[c for c in d.columns if c.startswith("c") and c != "conv_count"]).limit(n)


def roll_up(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """The worst verdict of each group."""
    rank = reduce(lambda w, iv: w.when(F.col("verdict") == iv[1], iv[0]), enumerate(VERDICTS), F)
    return verdicts.groupBy(*by).agg(F.min(rank).alias("worst")).select(*by, F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("worst") + 1).alias("verdict"))


def partition_test(df: DataFrame, order: list[str], key: str, value: str, parts: int = 4, tolerance: float = 1e-6) -> DataFrame:
    """Whether sum, average, max and min of a table equal those combined from its ordered parts, per key.

    Part i holds the rows up to round(i n / parts), half to even.
    """
    ranked = global_rank(df.select(*dict.fromkeys([*order, key, value])), order)
    total = df.agg(F.count("*")).scalar()
    part = reduce(lambda a, i: a + F.when(F.col("rank") > F.bround(F.lit(i) * total / parts), 1).otherwise(0), range(1, parts), F.lit(0))
    aggs = lambda: [F.sum(value).alias("s"), F.count(value).alias("n"), F.max(value).alias("hi"), F.min(value).alias("lo")]
    halves = ranked.groupBy(key, part.alias("part")).agg(*aggs())
    combined = halves.groupBy(key).agg(F.sum("s").alias("ps"), F.sum("n").alias("pn"), F.max("hi").alias("phi"), F.min("lo").alias("plo"), F.count("*").alias("n_parts"))
    full = df.groupBy(F.col(key).alias("__k")).agg(*aggs())
    near = lambda a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.coalesce(a, F.lit(0.0))))
    return full.join(combined, F.col("__k").eqNullSafe(F.col(key))).select(F.col("__k").alias(key), "n_parts", near(F.col("s"), F.col("ps")).alias("sum_ok"), near(F.try_divide("s", "n"), F.try_divide("ps", "pn")).alias("avg_ok"), F.col("hi").eqNullSafe(F.col("phi")).alias("max_ok"), F.col("lo").eqNullSafe(F.col("plo")).alias("min_ok"))


def legs(cond, guards: tuple = ()) -> list[tuple]:
    """Leaf conditions with what must hold for them to matter: beside AND the left side is true, beside OR it is false."""
    if isinstance(cond, A.Bin) and cond.op in ("and", "or"):
        guard = cond.left if cond.op == "and" else A.Un("not", cond.left)
        return legs(cond.left, guards) + legs(cond.right, (*guards, guard))
    return [(cond, guards)]


def leg_coverage(df: DataFrame, cond, dialect: str = "hive") -> DataFrame:
    """Per leg of a condition: how many rows reach it, how many make it true and how many false. One pass over the table."""
    low = Lower(dialect, df)
    found = legs(cond)
    aggs = []
    for i, (leaf, guards) in enumerate(found):
        reach = reduce(lambda a, g: a & F.coalesce(low.condition(g), F.lit(False)), guards, F.lit(True))
        test = F.coalesce(low.condition(leaf), F.lit(False))
        aggs += [F.count_if(reach & test).alias(f"t{i}"), F.count_if(reach & ~test).alias(f"f{i}")]
    rows = F.array(*[F.struct(F.lit(i).alias("leg_no"), F.lit(A.show(leaf)).alias("leg"), F.col(f"t{i}").alias("n_true"), F.col(f"f{i}").alias("n_false")) for i, (leaf, _) in enumerate(found)])
    return df.agg(*aggs).select(F.inline(rows)).withColumn("covered", (F.col("n_true") > 0) & (F.col("n_false") > 0))


def boundary_values(cond) -> list[tuple[int, str, object, str]]:
    """(leg_no, column, value, polarity) for each leg that compares a column with a constant: rows that lie on, just below and just above the border.

    A number n is tried at n - 1, n and n + 1; a text as it is, one letter longer and empty. The polarity says what the leg makes of the value.
    """
    tests = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    out = []
    for i, (leaf, _) in enumerate(legs(cond)):
        if isinstance(leaf, A.Bin) and leaf.op in tests and isinstance(leaf.left, A.Col) and isinstance(leaf.right, A.Lit) and leaf.right.value is not None:
            v = leaf.right.value
            near = [v, v + "x", ""] if isinstance(v, str) else [v - 1, v, v + 1]
            out += [(i, leaf.left.name, x, "true" if tests[leaf.op](x, v) else "false") for x in dict.fromkeys(near)]
    return out


def leg_rows(df: DataFrame, cond, key: str, dialect: str = "hive") -> DataFrame:
    """For each leg and polarity the least row that reaches the leg and makes it so: leg_no, polarity, witness (null where no row does)."""
    low = Lower(dialect, df)
    rows = []
    for i, (leaf, guards) in enumerate(legs(cond)):
        reach = reduce(lambda a, g: a & F.coalesce(low.condition(g), F.lit(False)), guards, F.lit(True))
        test = F.coalesce(low.condition(leaf), F.lit(False))
        rows += [(i, "true", reach & test), (i, "false", reach & ~test)]
    seen = df.agg(*[F.min(F.when(c, F.col(key))).alias(f"w{n}") for n, (_, _, c) in enumerate(rows)])
    return seen.select(F.inline(F.array(*[F.struct(F.lit(i).alias("leg_no"), F.lit(p).alias("polarity"), F.col(f"w{n}").alias("witness")) for n, (i, p, _) in enumerate(rows)])))


def listing_verdict(columns: list[str], rows: DataFrame, output: DataFrame | None) -> DataFrame:
    """What a printed listing says of a table: one row verdict (match, differs, missing), n_mismatch. rows: ``values`` (array) as read.

    Columns must be the same, in the same order; then the rows must be, as multisets.
    """
    spark = rows.sparkSession
    if output is None:
        return spark.sql("select 'missing' as verdict, 0L as n_mismatch")
    if [c.lower() for c in columns] != [c.lower() for c in output.columns]:
        return spark.sql("select 'differs' as verdict, 0L as n_mismatch")
    listed = rows.select(*[F.get("values", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    return compare_rows(listed, output).select(F.when(F.col("verdict") == "PASS", "match").otherwise("differs").alias("verdict"), "n_mismatch")
