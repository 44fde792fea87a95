"""What changed between full snapshots.

Each key's rows are reduced to one per snapshot, the delivery that holds; then one window per key, ordered by snapshot, compares the
hash of the payload with that of the snapshot before (``lag``) and finds gaps in the snapshot index: a gap behind a row is a
removal at the next snapshot and, if the key comes back, an addition where it does. The index counts the snapshot numbers that occur,
so a number that was never delivered is no snapshot. All snapshots are compared in one pass, however
many there are. A key has at most one row per snapshot when it reaches the window, so repeated rows, even a third of the table, are
combined before the shuffle and no window grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def payload_hash(cols: list[str]) -> Column:
    """128 bits over the payload; a null is a value of its own and columns cannot run into each other."""
    parts = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(*parts).alias("h0"), F.xxhash64(F.lit(7919), *reversed(parts)).alias("h1"))


def snapshot_changes(rows: DataFrame, keys: list[str], snapshot: str, delivered: str, payload: list[str]) -> DataFrame:
    """keys, ``snapshot`` and ``change_type`` (added, removed, changed) against the snapshot before, by the numbers that occur.

    Nothing is reported for the lowest number in ``rows``; the highest is where the last removals show. Rows with a null key part or
    snapshot do not count, though the number of such a row does occur. Within a snapshot the latest ``delivered``
    holds (null is earliest; rows that tie on it: the greatest payload). An empty table gives no rows.
    """
    if not payload:
        raise ValueError("name at least one payload column")
    numbers = rows.agg(F.sort_array(F.collect_set(snapshot))).scalar()  # one number per snapshot
    counted = rows.dropna(subset=[*keys, snapshot])
    one = counted.groupBy(*keys, snapshot).agg(F.max(F.struct(F.col(delivered).alias("d"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)])).alias("__held"))
    one = one.select(*keys, F.array_position(numbers, F.col(snapshot)).alias("__n"), payload_hash([f"__held.p{i}" for i in range(len(payload))]).alias("__h"))
    w = Window.partitionBy(*keys).orderBy("__n")
    seen = one.select(*keys, "__n", "__h", F.lag("__n").over(w).alias("__before"), F.lag("__h").over(w).alias("__was"), F.lead("__n").over(w).alias("__next"))
    here = F.when(F.col("__n") == 1, None).when(F.col("__before").isNull() | (F.col("__before") < F.col("__n") - 1), "added").when(F.col("__was") != F.col("__h"), "changed")
    gone = (F.col("__n") < F.size(numbers)) & (F.col("__next").isNull() | (F.col("__next") > F.col("__n") + 1))
    events = F.array(F.struct(F.col("__n").alias("n"), here.alias("c")), F.struct((F.col("__n") + 1).alias("n"), F.when(gone, "removed").alias("c")))
    found = seen.select(*keys, F.explode(events).alias("__e")).filter("__e.c is not null")
    return found.select(F.element_at(numbers, F.col("__e.n").cast("int")).alias(snapshot), *keys, F.col("__e.c").alias("change_type"))
