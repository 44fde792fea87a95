"""References to records that do not exist.

A reference is a composite key, any part of which may be null. References are grouped by their null mask (which key columns hold a
value); each mask is anti-joined to the targets on its non-null columns only, under declared match semantics:

``simple``   a reference with any null part is not checked;
``partial``  the parts that have a value must occur together in some target row; an all-null reference is not checked;
``full``     all parts null is no reference; some null and some not is broken; otherwise all parts must match;
``strict``   a reference with any part is broken unless all parts have a value and match.

Targets are first reduced to one row per key with their earliest time, by an aggregation that combines before its shuffle, so a key
that holds a third of all target rows crosses the network once per task. The reference side is a plain equi-join whose side of
references never multiplies; no side is broadcast by hint, so Spark's size-checked threshold and skew handling decide.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEMANTICS = ("simple", "partial", "full", "strict")


def null_mask(keys: list[str]):
    """An integer with bit i set where keys[i] has a value."""
    return reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), F.lit(1 << i)).otherwise(0) for i, k in enumerate(keys)])


def broken_references(refs: DataFrame, targets: DataFrame, keys: list[str], match: str = "simple", ref_time: str | None = None, target_time: str | None = None) -> DataFrame:
    """The rows of ``refs`` whose key has no row in ``targets``, plus a column ``state``.

    ``state`` is ``missing`` where no target matches, ``late`` where ``ref_time``/``target_time`` are given and the earliest matching
    target came after the reference. Nulls: key parts by ``match``; a reference without a time is never late, targets without any
    time are never late. Repeated references each give their row; repeated targets count once; an empty target table breaks every
    checked reference; other columns of ``refs`` pass through, those of ``targets`` are ignored whatever their names.
    """
    if match not in SEMANTICS:
        raise ValueError(f"match must be one of {SEMANTICS}")
    everything = (1 << len(keys)) - 1
    own = [f"__t{i}" for i in range(len(keys))]
    time = F.col(target_time) if target_time else F.lit(None).cast("timestamp_ntz")
    slim = targets.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], time.alias("__at"))
    tagged = refs.withColumn("__mask", null_mask(keys))
    parts = []
    for bits in product((0, 1), repeat=len(keys)):
        mask = sum(b << i for i, b in enumerate(bits))
        group = tagged.filter(F.col("__mask") == mask)
        if mask == 0 or (match == "simple" and mask != everything):
            continue
        if match in ("full", "strict") and mask != everything:
            parts.append(group.withColumn("state", F.lit("missing")))
            continue
        held = [i for i, b in enumerate(bits) if b]
        there = slim.filter(reduce(lambda a, b: a & b, [F.col(own[i]).isNotNull() for i in held])).groupBy(*[own[i] for i in held]).agg(F.min("__at").alias("__first"), F.lit(True).alias("__hit"))
        joined = group.join(there, reduce(lambda a, b: a & b, [F.col(keys[i]) == F.col(own[i]) for i in held]), "left")
        late = F.col("__first") > F.col(ref_time) if ref_time else F.lit(False)
        parts.append(joined.withColumn("state", F.when(F.col("__hit").isNull(), "missing").when(late, "late")).filter("state is not null").drop(*[own[i] for i in held], "__first", "__hit"))
    if not parts:
        return tagged.withColumn("state", F.lit(None).cast("string")).filter(F.lit(False)).drop("__mask")
    return reduce(DataFrame.unionByName, parts).drop("__mask")
