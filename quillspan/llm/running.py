"""Running totals inside groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A group is cut into chunks by the seeded hash of its rows' ids: at least so many, and more where a chunk would hold too many rows.
CHUNKS, CHUNK_ROWS = 1024, 1 << 18


def running_total(rows: DataFrame, groups: list[str], row_id: str, weight: str, seed: int = 0, rank: str | None = None) -> DataFrame:
    """``rows`` with ``before``: the weight of all rows of the same group that come earlier in a seeded order.

    The order is by ``rank`` (a small number from 0), if given, then by the seeded hash of ``row_id``: its chunk first, the hash inside the chunk next, the id last. A window runs inside
    a chunk, a second one over the chunk totals, so a group with a third of all rows spreads over as many windows as keep a chunk near
    CHUNK_ROWS rows; the chunks grow with the rows, which are counted for that and should therefore be a written table. ``row_id`` must be
    unique in a group and ``weight`` not null; columns of ``rows`` must not begin with two underscores.
    """
    chunks_of = F.greatest(F.lit(CHUNKS).cast("long"), F.floor(rows.agg(F.count("*")).scalar() / CHUNK_ROWS))
    h = rows.withColumn("__h", F.xxhash64(F.lit(seed), row_id)).withColumn("__c", (F.col(rank) if rank else F.lit(0)) * chunks_of + F.pmod("__h", chunks_of))
    inside = Window.partitionBy(*groups, "__c").orderBy("__h", row_id).rowsBetween(Window.unboundedPreceding, -1)
    chunks = h.groupBy(*groups, "__c").agg(F.sum(weight).alias("__w"))
    chunks = chunks.select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("__c").alias("__d"), F.coalesce(F.sum("__w").over(Window.partitionBy(*groups).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    on = (F.col("__c") == F.col("__d"))
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    local = h.withColumn("__in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return local.join(chunks, on).select(*rows.columns, (F.col("__base") + F.col("__in")).alias("before"))
