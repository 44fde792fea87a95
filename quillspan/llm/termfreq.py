"""How often every distinct term occurs, and in how many records: heavy-light aggregation.

The rows are read once and reduced to distinct (term, record) pairs with their number, combined before the exchange; pairs of a term
spread by their record, so no task holds a term. Heavy terms, those with so large a share of the pairs that they would fill a part of
a shuffle partition, are found by summaries of a fixed number of counters per task (a term with more than 1 / COUNTERS of a task's
pairs is never lost from its summary). They are broadcast, and their pairs are counted exactly in local arrays with one counter per
heavy term; only those arrays meet. The pairs of all other terms are combined and shuffled by term. The two tables are then united.
What is counted heavy never changes a result, only its way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.session import Scratch

#: Heavy terms per shuffle partition: a term is heavy from 1 / (HEAVY * partitions) of all pairs, so there are at most as many. A term
#: of more characters than LONGEST is counted light, so what is broadcast is bounded.
HEAVY, LONGEST = 4, 256
#: Counters that one task's summary keeps.
COUNTERS = 8192


def _pairs(scratch: Scratch, rows: DataFrame, term: str, record: str) -> DataFrame:
    """Distinct (term, record) with the number of rows, written once: the only read of the rows."""
    named = rows.select(F.col(term).cast("string").alias("term"), F.col(record).alias("record")).filter("term is not null and record is not null")
    return scratch.write(named.groupBy("term", "record").agg(F.count("*").alias("n")), "pairs")


def _heavy(pairs: DataFrame, most: int) -> DataFrame:
    """term, term_no of at most ``most`` terms."""
    counters = max(COUNTERS, 2 * most)

    def summarise(batches):
        held: dict = {}
        n = 0
        for b in batches:
            n += b.num_rows
            seen = pc.value_counts(b.column("term"))
            for term, count in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist()):
                held[term] = held.get(term, 0) + count
            if len(held) > counters:  # all counters fall until so many stand
                floor = int(np.partition(np.fromiter(held.values(), np.int64), -counters)[-counters])
                held = {t: c - floor for t, c in held.items() if c > floor}
        out = {t: c for t, c in held.items() if c * most * 2 >= n and len(t) <= LONGEST}
        yield pa.record_batch({"term": pa.array([None, *out], pa.string()), "n": pa.array([n, *out.values()], pa.int64())})

    counts = pairs.select("term").mapInArrow(summarise, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total = counts.filter("term is null").select("n").scalar()
    # the sums of what the tasks saw of different terms do not exceed all pairs, so at most ``most`` rows pass
    heavy = counts.filter(F.col("term").isNotNull() & (F.col("n") * most >= total)).select("term")
    return heavy.withColumn("term_no", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def _counts(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    most = HEAVY * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(scratch.write(_heavy(pairs, most), "heavy"))  # at most ``most`` rows of LONGEST characters

    def count_local(batches):
        n, records = np.zeros(most + 1, np.int64), np.zeros(most + 1, np.int64)
        for b in batches:
            no = b.column("term_no").to_numpy()
            np.add.at(n, no, b.column("n").to_numpy())
            records += np.bincount(no, minlength=most + 1)
        seen = np.flatnonzero(records)
        yield pa.record_batch({"term_no": seen.astype(np.int32), "n": n[seen], "n_records": records[seen]})

    arrays = pairs.join(heavy, "term").select("term_no", "n").mapInArrow(count_local, "term_no int, n long, n_records long")
    heavy_counts = arrays.groupBy("term_no").agg(F.sum("n").alias("n"), F.sum("n_records").alias("n_records")).join(heavy, "term_no").select("term", "n", "n_records")
    light = pairs.join(heavy, "term", "left_anti").groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_records"))
    return heavy_counts.union(light)


def term_counts(rows: DataFrame, term: str, record: str) -> DataFrame:
    """One row per distinct term: ``term``, ``n`` (occurrences), ``n_records`` (distinct records it is in).

    Rows with a null term or record do not count. Repeated rows are occurrences of their own but one record. Very long terms are
    terms like any other; other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "terms")
    return _counts(scratch, _pairs(scratch, rows, term, record))


def _mark(total: Column, rare: int, common: float) -> Column:
    # a term can be both where there are few records; rare is said first
    return F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > F.lit(common) * total, "common")


def marked_terms(rows: DataFrame, term: str, record: str, rare: int = 2, common: float = 0.1) -> DataFrame:
    """``term_counts`` with ``mark``: rare (in at most ``rare`` records), common (in more than that share of all records that count), or null."""
    scratch = Scratch(rows.sparkSession, "terms")
    pairs = _pairs(scratch, rows, term, record)
    records = pairs.select("record").distinct().agg(F.count("*")).scalar()
    return _counts(scratch, pairs).withColumn("mark", _mark(records, rare, common))
