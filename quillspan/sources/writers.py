"""Sinks: canonical CSV, listings, partitioned parquet, Arrow streams, upserts and the event log."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions import sas
from quillspan.operators.ranking import global_rank


def _cells(df: DataFrame, formats: dict[str, str] | None = None) -> list[Column]:
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = sas.show_date(c, (formats or {}).get(f.name))
        elif isinstance(f.dataType, T.NumericType):
            c = sas.show_number(c)
        else:
            c = F.coalesce(c.cast("string"), F.lit("."))
        cols.append(c)
    return cols


def canonical(df: DataFrame, formats: dict[str, str] | None = None) -> DataFrame:
    """All columns as text: numbers by 12 digits, dates by their format, a dot for missing."""
    return df.select(*[c.alias(f) for c, f in zip(_cells(df, formats), df.columns)])


def write_canonical(df: DataFrame, path: str, formats: dict[str, str] | None = None) -> None:
    canonical(df, formats).write.mode("overwrite").option("lineSep", "\r\n").csv(path, header=True)


def listing_lines(df: DataFrame, title: str, order: list[str]) -> DataFrame:
    """A table of any size as the lines of a printed listing: line_no, line. Columns are aligned to the right.

    ``order`` must be a total order of the rows. The widths are one aggregation, the numbers a distributed rank.
    """
    names = df.columns
    ranked = global_rank(df, order, "__obs")
    shown = canonical(ranked.select(*names)).columns
    cells = [F.coalesce(c, F.lit(".")).alias(f"c{i}") for i, c in enumerate(_cells(df))]
    rows = ranked.select(F.col("__obs").cast("string").alias("obs"), F.col("__obs").cast("long").alias("n"), *cells)
    width = [F.greatest(F.lit(len(name)), F.coalesce(rows.agg(F.max(F.length(c))).scalar(), F.lit(0))) for name, c in zip(["Obs", *shown], ["obs", *[f"c{i}" for i in range(len(names))]])]
    line = lambda parts: F.concat_ws("  ", *[F.lpad(p, w, F.lit(" ")) for p, w in zip(parts, width)])
    body = rows.select((F.col("n") + 1).alias("line_no"), line([F.col("obs"), *[F.col(f"c{i}") for i in range(len(names))]]).alias("line"))
    one = df.sparkSession.range(1)
    head = one.select(F.lit(0).cast("long").alias("line_no"), F.lit(f"Table: {title}").alias("line")).union(one.select(F.lit(1).cast("long"), line([F.lit(x) for x in ["Obs", *names]])))
    return head.union(body)


def listing_text(df: DataFrame, title: str, order: list[str], most: int = 1000) -> str:
    """The listing as one text for people. At most ``most`` rows come to the driver; if there are more, a last line says so."""
    lines = listing_lines(df, title, order).filter(F.col("line_no") < most + 3).orderBy("line_no").collect()
    cut = len(lines) > most + 2
    return "\n".join(r.line for r in lines[: most + 2]) + ("\nmore rows were left out" if cut else "") + "\n"


#: Rows that one task writes of a folder.
FOLDER_ROWS = 4_000_000


def write_partitioned(df: DataFrame, path: str, by: str = "folder_path") -> None:
    """Parquet by folder. A folder's rows go to as many tasks as its size asks for, at least one, so that none writes more than some
    FOLDER_ROWS; the sizes are an aggregation that is combined before its shuffle."""
    sizes = df.groupBy(F.col(by).alias("__by")).agg(F.ceil(F.count("*") / FOLDER_ROWS).alias("__tasks"))
    wide = df.join(sizes, F.col(by).eqNullSafe(F.col("__by"))).withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.greatest("__tasks", F.lit(1))))
    wide.repartition(by, "__salt").drop("__by", "__tasks", "__salt").write.mode("overwrite").partitionBy(by).parquet(path)


def _coded(t: pa.Table | pa.RecordBatch) -> pa.Table:
    """String columns dictionary-encoded where that is smaller."""
    t = pa.Table.from_batches([t]) if isinstance(t, pa.RecordBatch) else t
    for i, f in enumerate(t.schema):
        if pa.types.is_string(f.type) or pa.types.is_large_string(f.type):
            coded = t.column(i).combine_chunks().dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            if coded.nbytes < t.column(i).nbytes:
                t = t.set_column(i, f.name, coded)
    return t


def _stream(t: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue()


def arrow_parts(df: DataFrame) -> DataFrame:
    """The table as Arrow IPC streams, one row (n_rows, blob) per batch, made where the rows lie; nothing comes to the driver."""
    def code(batches):
        for b in batches:
            yield pa.record_batch({"n_rows": pa.array([b.num_rows], pa.int64()), "blob": pa.array([_stream(_coded(b))], pa.binary())})

    return df.mapInArrow(code, "n_rows long, blob binary")


def from_arrow_parts(parts: DataFrame, schema: str) -> DataFrame:
    """The rows of Arrow IPC streams again."""
    plain = parts.sparkSession.createDataFrame([], schema).toArrow().schema

    def read(batches):
        for b in batches:
            for blob in b.column("blob").to_pylist():
                t = pa.ipc.open_stream(blob).read_all()
                t = pa.table({f.name: t.column(f.name).cast(f.type) for f in plain}, schema=plain)
                yield from t.to_batches()

    return parts.select("blob").mapInArrow(read, schema)


def arrow_stream(df: DataFrame, sink) -> int:
    """Writes a result that a client asked for to a binary file as one Arrow IPC stream, one batch of rows after the other; returns the rows.

    The driver holds one partition's blobs at a time. Dictionaries are left out, as a stream has one per column.
    """
    n, w = 0, None
    for r in arrow_parts(df).toLocalIterator():
        t = pa.ipc.open_stream(bytes(r.blob)).read_all()
        t = pa.table({f.name: t.column(f.name).cast(f.type.value_type) if pa.types.is_dictionary(f.type) else t.column(f.name) for f in t.schema})
        w = w or pa.ipc.new_stream(sink, t.schema)
        w.write_table(t)
        n += r.n_rows
    if w is None:
        w = pa.ipc.new_stream(sink, df.limit(0).toArrow().schema)
    w.close()
    return n


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table after the rows of all keys in ``new`` are replaced by it."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def numbered(log: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """New events with the numbers that follow the greatest ever given, in a total order; a batch of any size is ranked in parallel."""
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long"))).scalar()
    return global_rank(new, order, "__number").withColumn("seq", last + F.col("__number")).drop("__number")


def with_overflow(df: DataFrame, order: list[str], most: int, note: str = "more rows were left out") -> DataFrame:
    """The first ``most`` rows and, if there are more, one last row that says so in its first column (the limit of a sheet)."""
    more = df.agg(F.count("*")).scalar() > most
    sentinel = df.sparkSession.range(1).filter(more).select(*[(F.lit(note) if i == 0 else F.lit(None)).cast(f.dataType).alias(f.name) for i, f in enumerate(df.schema)])
    return df.orderBy(*order).limit(most).unionByName(sentinel)
