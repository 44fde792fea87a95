"""Semantics that differ from SQL: a missing value is the smallest value and equals itself, logic has two values, x / 0 is missing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the day that SAS dates count from.
EPOCH = "1960-01-01"
#: Informats and formats by name, as Spark patterns.
INFORMATS = {"mmddyy": "MM/dd/yyyy", "ddmmyy": "dd/MM/yyyy", "yymmdd": "yyyy-MM-dd", "date": "ddMMMyyyy"}
FORMATS = {"mmddyy": "MM/dd/yyyy", "ddmmyy": "dd/MM/yyyy", "date": "ddMMMyyyy", "yymmdd": "yyyy-MM-dd"}


def compare(op: str, a: Column, b: Column, b_known: bool = False) -> Column:
    """a op b with a missing value below all others. ``b_known``: b is never null, so the plain comparison can reach the scan."""
    if op == "=":
        return a.eqNullSafe(b)
    if op == "<>":
        return ~a.eqNullSafe(b)
    if b_known:
        return {"<": lambda: a.isNull() | (a < b), "<=": lambda: a.isNull() | (a <= b), ">": lambda: a.isNotNull() & (a > b), ">=": lambda: a.isNotNull() & (a >= b)}[op]()
    false = F.lit(False)
    return {
        "<": lambda: (a.isNull() & b.isNotNull()) | F.coalesce(a < b, false),
        "<=": lambda: a.isNull() | F.coalesce(a <= b, false),
        ">": lambda: (b.isNull() & a.isNotNull()) | F.coalesce(a > b, false),
        ">=": lambda: b.isNull() | F.coalesce(a >= b, false),
    }[op]()


def truth(c: Column, is_boolean: bool) -> Column:
    """A condition of two values: a missing number and a missing comparison are false."""
    return F.coalesce(c if is_boolean else c != 0, F.lit(False))


def days(c: Column) -> Column:
    """Days since the epoch."""
    return F.datediff(c, F.lit(EPOCH).cast("date"))


def read_date(c: Column, informat: str) -> Column:
    """A date by informat (its width is ignored); missing where the text is none."""
    return F.try_to_timestamp(c, F.lit(INFORMATS[informat.rstrip("0123456789")])).cast("date")


@F.pandas_udf(T.StringType())
def _digits(x: pd.Series) -> pd.Series:
    # no built-in rounds the exact binary value to 12 significant digits; the JVM's formats round its shortest decimal once more
    return x.map(lambda v: None if v != v else f"{v + 0.0:.0f}" if abs(v) < 1e15 and v == math.floor(v) else f"{v:.12g}")


def show_number(c: Column) -> Column:
    """A double as text with 12 significant digits: whole numbers bare, no trailing zeros; missing is a dot."""
    return F.coalesce(_digits(c.cast("double")), F.lit("."))


def show_date(c: Column, fmt: str | None) -> Column:
    """A date by its format; without one, its day number. Missing is a dot."""
    name = (fmt or "").rstrip("0123456789")
    return F.coalesce(F.upper(F.date_format(c, FORMATS[name])) if name in FORMATS else days(c).cast("string"), F.lit("."))
