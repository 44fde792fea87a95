"""The positional MERGE of a DATA step: sorted union of key values; within a key rows pair by position, and a shorter source repeats its last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.catalog import SEQ


#: Places of a key that are laid out at once.
PLACES = 65_536


def by_merge(sources: list[tuple[DataFrame, str | None]], by: list[str], last_wins: bool = False) -> DataFrame:
    """Merges (table, flag name) sources on ``by``; each table has the hidden order column.

    A missing key value is a value of its own. A shared column comes from the first listed source that has rows for the key
    (``last_wins``: from the last, as documented for the language). A flag is 1 where its source contributed to the key, else 0. The
    result has the keys, the columns of all sources in first-seen order, the flags, and is ordered by the keys and the position.
    Positions come from a streaming row number per key; the counts per key are combined before their shuffle.
    """
    sides, counts = [], []
    for df, _ in sources:
        if SEQ not in df.columns:
            raise ValueError("MERGE needs tables with an order; put them with order=[...]")
        counts.append(df.groupBy(*by).agg(F.count("*").alias("__n")))
        sides.append(df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(SEQ))).drop(SEQ))
    spine = reduce(DataFrame.unionByName, [c.withColumn(f"__n{i}", F.col("__n")).select(*by, *[(F.col("__n") if k == i else F.lit(None).cast("long")).alias(f"__n{k}") for k in range(len(sources))]) for i, c in enumerate(counts)])
    sizes = [f"__n{k}" for k in range(len(sources))]
    spine = spine.groupBy(*by).agg(*[F.max(n).alias(n) for n in sizes])
    most = F.greatest(*sizes) if len(sizes) > 1 else F.col(sizes[0])
    # places are laid out in blocks, so no array grows with a key's rows
    out = spine.withColumn("__most", most).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__most") - 1) / PLACES))))
    first, last = F.col("__block") * PLACES + 1, F.least(F.col("__block") * PLACES + PLACES, F.col("__most"))
    out = out.withColumn("__at", F.explode(F.sequence(first, last))).drop("__most", "__block")
    have: dict[str, list[str]] = {}
    for k, side in enumerate(sides):
        s = side.select(*[F.col(c).alias(f"__s{k}_{c}") for c in side.columns])
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__s{k}_{c}")) for c in by])
        out = out.join(s, on & (F.least(F.col("__at"), F.col(f"__n{k}")) == F.col(f"__s{k}___i")), "left")
        for c in side.columns:
            if c not in by and c != "__i":
                have.setdefault(c, []).append(k)
    cols = []
    for c, ks in have.items():
        pick = None
        for k in ks if last_wins else reversed(ks):
            here = F.col(f"__s{k}_{c}")
            pick = here if pick is None else F.when(F.col(f"__n{k}").isNotNull(), here).otherwise(pick)
        cols.append(pick.alias(c))
    flags = [F.when(F.col(f"__n{k}").isNotNull(), 1.0).otherwise(0.0).alias(f) for k, (_, f) in enumerate(sources) if f]
    return out.select(*by, *cols, *flags, F.struct(*by, "__at").alias(SEQ))


def by_update(master: DataFrame, transactions: DataFrame, by: list[str]) -> DataFrame:
    """The master with transactions applied: a value that is not missing replaces the master's; keys only in ``transactions`` are added.

    Both have the hidden order column. Several transactions of a key apply in their order, so the last value that is not missing
    stands; of several master rows of a key the first takes them, the others stay as they are. A missing key value is a value of its
    own. Columns are those of the master, then those only transactions have. Transactions are combined before their shuffle, so a key
    with a third of them costs one row per task; the master side of the join is split by Spark's skew handling.
    """
    for df in (master, transactions):
        if SEQ not in df.columns:
            raise ValueError("UPDATE needs tables with an order; put them with order=[...]")
    mine = [c for c in master.columns if c not in by and c != SEQ]
    theirs = [c for c in transactions.columns if c not in by and c != SEQ]
    last = transactions.groupBy(*[F.col(k).alias(f"__t_{k}") for k in by]).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(SEQ))).alias(f"__v_{c}") for c in theirs], F.min(SEQ).alias("__at"))
    first = master.groupBy(*[F.col(k).alias(f"__m_{k}") for k in by]).agg(F.min(SEQ).alias("__first"))
    on = lambda side: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{side}_{k}")) for k in by])
    led = master.join(first, on("m")).withColumn("__lead", F.col(SEQ) == F.col("__first"))
    j = led.join(last, on("t") & F.col("__lead"), "full")
    keys = [F.when(F.col("__lead").isNull(), F.col(f"__t_{k}")).otherwise(F.col(k)).alias(k) for k in by]
    new = lambda c: F.coalesce(f"__v_{c}", c) if c in mine else F.col(f"__v_{c}")
    values = [(new(c) if c in theirs else F.col(c)).alias(c) for c in [*mine, *[c for c in theirs if c not in mine]]]
    return j.select(*keys, *values, F.struct(*keys, F.col(SEQ).alias("m"), F.col("__at").alias("t")).alias(SEQ))
