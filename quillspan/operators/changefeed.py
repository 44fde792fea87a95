"""Applying a stream of inserts, updates and deletes: a log-structured merge store on Spark.

Every delivery of the feed is appended as it comes, as a run: reduced to one entry per change, sorted by change and written to a table
that is bucketed by change. The runs of a tier are files of one table, so equal changes of all its runs lie in the bucket of the same
number and a read merges them bucket by bucket without a shuffle. When ``fan_in`` runs stand in a tier, they are merged into one run of
the next tier; a change is so rewritten once per tier, and a feed of n deliveries has about log n tiers. Tiers are merged by full outer
sort-merge joins of co-bucketed tables.

A change is known by its id and may be delivered again, at times amended: the delivery with the greatest version holds, whatever
arrives first, and what an amendment takes away from one key and gives to another follows from that by itself. What stands for a key
is then settled by its changes in the order of their sequence:

``anchor``  the latest change that fixes the state without regard to what was there (a put, or a delete: the tombstone);
``patch``   the latest change that replaces only what exists.

A key exists if its anchor is a put; what stands was set by the patch if that is later, else by the anchor. Both are maxima, so all
merges are associative, commutative and idempotent: repeated, amended and out-of-order deliveries, any split of the feed and any order
of compaction give the same state. Entries are spread by change, not by key, and combined before the one shuffle by key, so a key or a
change with a third of all rows costs one row per task.

A feed whose changes have no id is kept by key, and its entries are the anchor and the patch themselves.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.session import Scratch

PUT, DELETE, PATCH = "put", "delete", "patch"


def _later(a: Column, b: Column) -> Column:
    """The greater of two structs; null is less than all."""
    return F.when(a.isNull() | (b > a), b).otherwise(a)


class MergeStore:
    """A table kept as sorted change runs.

    keys     names of the key columns; nulls in a key are a value of their own.
    seq      columns that order the changes of a key; a null sorts first. Ties on all of them must be copies of one change.
    op       column with put, delete or patch; a change with anything else does nothing (but may replace an earlier delivery).
    value    columns that a put or patch sets.
    change   columns that name a change over all its deliveries. Rows without any of them are changes of their own, equal rows one.
    version  columns that order the deliveries of a change; a null is earliest, and of ties the greatest content holds.
    buckets  of each run; as many as shuffle partitions if not given.
    fan_in   runs of a tier that are merged into one of the next.
    """

    def __init__(self, spark: SparkSession, keys: list[str], seq: list[str], op: str, value: list[str], change: list[str] | None = None, version: list[str] | None = None,
                 buckets: int | None = None, fan_in: int = 4):
        self.spark, self.keys, self.seq, self.op, self.value, self.fan_in = spark, keys, seq, op, value, max(2, fan_in)
        self.change, self.version = change or [], version or []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"runs_{uuid.uuid4().hex[:12]}"
        self.scratch = Scratch(spark, "merge")
        #: Tables by tier, and the runs that stand in each.
        self.tiers: dict[int, str] = {}
        self.runs: dict[int, int] = {}
        self._made = 0
        self.by = [f"k{i}" for i in range(len(self.change or keys))]
        self.parts = ["held"] if self.change else ["anchor", "patch"]

    def _change(self) -> Column:
        """What a change does, in the order that decides."""
        return F.struct(*[F.col(c).alias(f"s{i}") for i, c in enumerate(self.seq)], (F.col(self.op) == PUT).alias("alive"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(self.value)])

    def _settled(self, rows: DataFrame, by: list[Column], change: Column, op: Column) -> DataFrame:
        return rows.filter(op.isin(PUT, DELETE, PATCH)).groupBy(*by).agg(F.max(F.when(op != PATCH, change)).alias("anchor"), F.max(F.when(op == PATCH, change)).alias("patch"))

    def _entries(self, changes: DataFrame) -> DataFrame:
        self.types = [changes.schema[k].dataType for k in self.keys]
        # a null becomes "" and a value "=value", so that plain equality joins the buckets
        coded = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
        if not self.change:
            return self._settled(changes, [coded(c).alias(k) for c, k in zip(self.keys, self.by)], self._change(), F.col(self.op))
        held = F.struct(*[F.col(c).alias(f"n{i}") for i, c in enumerate(self.version)], self._change().alias("does"), F.col(self.op).alias("op"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(self.keys)])
        named = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in self.change])
        own = F.concat_ws(" ", F.lit("#"), F.xxhash64(held), F.xxhash64(F.lit(1), held))
        return changes.groupBy(*[F.when(named, coded(c)).otherwise(own).alias(k) for c, k in zip(self.change, self.by)]).agg(F.max(held).alias("held"))

    def _put(self, entries: DataFrame, tier: int) -> None:
        """One more run in a tier. The same hash as the buckets': each task writes one file for each of its buckets."""
        if tier not in self.tiers:
            self._made += 1
            self.tiers[tier], self.runs[tier] = f"{self.name}_{self._made}", 0
        where = f"{self.scratch.root}/{self.tiers[tier]}"
        (entries.repartition(self.buckets, *self.by).sortWithinPartitions(*self.by).write.bucketBy(self.buckets, *self.by).sortBy(*self.by)
            .option("path", where).format("parquet").mode("append").saveAsTable(self.tiers[tier]))
        self.runs[tier] += 1

    def append(self, changes: DataFrame) -> None:
        """Adds one delivery as a sorted run; merges the tiers that are full."""
        self._put(self._entries(changes), 0)
        tier = 0
        while self.runs.get(tier, 0) >= self.fan_in:
            self._move([tier], tier + 1)
            tier += 1

    def compact(self) -> None:
        """Merges all runs into one. Tombstones stay: a change older than a delete may still arrive."""
        if sum(self.runs.values()) > 1:
            self._move(list(self.tiers), max(self.tiers) + 1)

    def _move(self, tiers: list[int], into: int) -> None:
        self._put(self._merged(tiers), into)
        for t in tiers:
            name = self.tiers.pop(t)
            del self.runs[t]
            self.spark.sql(f"drop table {name}")
            self.scratch.remove(f"{self.scratch.root}/{name}")

    def _merged(self, tiers: list[int]) -> DataFrame:
        """One entry per change (or key) over the tiers; no shuffle."""
        def one(tier: int) -> DataFrame:
            return self.spark.table(self.tiers[tier]).groupBy(*self.by).agg(*[F.max(p).alias(p) for p in self.parts])

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select(*[F.col(c).alias(f"r{c}") for c in [*self.by, *self.parts]]).hint("merge")
            j = a.join(b, reduce(lambda x, y: x & y, [F.col(c) == F.col(f"r{c}") for c in self.by]), "full")
            return j.select(*[F.coalesce(c, f"r{c}").alias(c) for c in self.by], *[_later(F.col(p), F.col(f"r{p}")).alias(p) for p in self.parts])

        return reduce(both, [one(t) for t in sorted(tiers)])

    def read(self) -> DataFrame:
        """The current state: keys and values of what exists. An empty feed gives an empty table."""
        if not self.tiers:
            raise ValueError("no run was appended")
        state = self._merged(list(self.tiers))
        if self.change:
            keys = [F.col(f"held.f{i}").alias(k) for i, k in enumerate(self.keys)]
            state = self._settled(state, keys, F.col("held.does"), F.col("held.op"))
        else:
            state = state.withColumns({k: F.when(F.col(f"k{i}") != "", F.expr(f"substring(k{i}, 2)")).cast(t) for i, (k, t) in enumerate(zip(self.keys, self.types))})
        set_by = F.when(F.col("patch") > F.col("anchor"), F.col("patch")).otherwise(F.col("anchor"))
        return state.filter("anchor.alive").select(*self.keys, *[set_by[f"v{i}"].alias(v) for i, v in enumerate(self.value)])

    def release(self) -> None:
        """Takes the run tables out of the catalog; tables already read stay readable, as the files go with the scratch folder only."""
        for name in self.tiers.values():
            self.spark.sql(f"drop table if exists {name}")
        self.tiers, self.runs = {}, {}

    def close(self) -> None:
        """Drops the runs and their files."""
        self.release()
        self.scratch.close()


def latest_copy(feed: DataFrame, id_col: str, by: list[str], keep: list[str]) -> DataFrame:
    """One row per ``id_col``: the copy with the greatest ``by`` (nulls first, then the greatest ``keep`` where those tie)."""
    best = F.max(F.struct(*[F.col(c).alias(f"b{i}") for i, c in enumerate(by)], *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])).alias("best")
    return feed.groupBy(id_col).agg(best).select(id_col, *[F.col(f"best.k{i}").alias(c) for i, c in enumerate(keep)])
