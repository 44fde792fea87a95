"""Global positions without one task that sees all rows, and the latest earlier source of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.session import Scratch


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the row's place (from 1) in the order of all rows; ``order`` must be a total order.

    Rows are range-partitioned and written, so that the parts stay what they are; places inside a part are added to the sizes of the
    parts before it, a table of one row per part.
    """
    scratch = Scratch(df.sparkSession, "rank")
    parts = scratch.write(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "parts")
    before = parts.groupBy("__part").agg(F.count("*").alias("__n")).select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    local = parts.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return local.join(before, F.col("__part") == F.col("__p")).withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__p", "__before")


def latest_before(df: DataFrame, keys: list[str], order: str, is_source: Column, name: str, width: int = 4096) -> DataFrame:
    """``df`` with the greatest ``order`` of a source row of the same keys that lies strictly before the row, or null.

    An as-of self join without a join on ranges: each key's rows are cut into spans of ``width`` in ``order``; a window runs inside a
    span and a second one over one row per span, so a key with a third of all rows spreads over its spans.
    """
    spans = df.withColumn("__src", F.when(is_source, F.col(order))).withColumn("__span", F.floor(F.col(order) / width))
    inside = Window.partitionBy(*keys, "__span").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    tops = spans.groupBy(*keys, "__span").agg(F.max("__src").alias("__top"))
    tops = tops.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__span").alias("__s"), F.max("__top").over(Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"))
    on = F.col("__span") == F.col("__s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    local = spans.withColumn("__in", F.max("__src").over(inside))
    return local.join(tops, on).select(*df.columns, F.coalesce("__in", "__earlier").alias(name))


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same keys up to and with this one, by ``order`` (whole numbers).

    Rows that tie on ``order`` count together. Spans of ``width`` in ``order`` as in ``latest_before``: no window holds a whole key.
    """
    spans = df.withColumn("__span", F.floor(F.col(order) / width))
    inside = Window.partitionBy(*keys, "__span").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    sums = spans.groupBy(*keys, "__span").agg(F.sum(value).alias("__sum"))
    earlier = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__span").alias("__s"), F.coalesce(earlier, F.lit(0)).alias("__base"))
    on = F.col("__span") == F.col("__s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    local = spans.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(sums, on).select(*df.columns, (F.col("__in") + F.col("__base")).alias(name))
