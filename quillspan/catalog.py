"""Named tables of a running program."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hidden column that orders a table where order is observable.
SEQ = "_seq"


@dataclass
class Catalog:
    """Tables by lower-case ``lib.name``; a bare name is in ``work``. Remembers creation order, formats and messages.

    A table put with ``order`` carries a hidden column SEQ built from those columns; steps that depend on row order (first row, MERGE
    pairing) read it, and refuse tables that have none.
    """

    spark: SparkSession
    default: str = "work"
    tables: dict[str, DataFrame] = field(default_factory=dict)
    formats: dict[str, str] = field(default_factory=dict)
    libs: dict[str, str] = field(default_factory=dict)
    #: The folder that relative paths of a program mean, and the one that tables a Hive script makes are stored in.
    folder: str | None = None
    warehouse: str | None = None
    messages: list[str] = field(default_factory=list)
    _stored: set = field(default_factory=set)

    def key(self, name: str) -> str:
        name = name.lower()
        return name if "." in name or not self.default else f"{self.default}.{name}"

    def put(self, name: str, df: DataFrame, order: list[str] | None = None) -> None:
        if order:
            df = df.withColumn(SEQ, F.struct(*order))
        self.tables.pop(self.key(name), None)
        self.tables[self.key(name)] = df

    def located(self, path: str) -> str:
        """A path of a program; a relative one lies in the folder, if that is set."""
        whole = "://" in path or path.startswith("/")
        return path if whole or self.folder is None else f"{self.folder.rstrip('/')}/{path}"

    def store(self, name: str, df: DataFrame, append: bool = False) -> None:
        """Puts a table that a script makes; where a warehouse is set, its rows are written there and read from there."""
        if self.warehouse is None:
            self.put(name, self.get(name).union(df) if append else df)
            return
        where = f"{self.warehouse.rstrip('/')}/{self.key(name)}"
        if append and self.key(name) not in self._stored:
            df, append = self.get(name).union(df), False
        df.write.mode("append" if append else "overwrite").parquet(where)
        self._stored.add(self.key(name))
        self.put(name, self.spark.read.schema(df.schema).parquet(where))

    def raw(self, name: str) -> DataFrame:
        """The table with its hidden order. A missing one is an error message and an empty relation."""
        k = self.key(name)
        if k not in self.tables:
            lib, _, bare = k.partition(".")
            if lib in self.libs:
                self.tables[k] = self.spark.read.parquet(f"{self.libs[lib]}/{bare}.parquet")
            else:
                self.messages.append(f"ERROR: {k} does not exist")
                return self.spark.createDataFrame([], T.StructType([]))
        return self.tables[k]

    def get(self, name: str) -> DataFrame:
        return visible(self.raw(name))


def visible(df: DataFrame) -> DataFrame:
    return df.drop(SEQ)


def first_row(df: DataFrame) -> DataFrame:
    """The first row by the hidden order, as a table of one row or none."""
    if SEQ not in df.columns:
        raise ValueError("the first row of a table without an order is not defined; put it with order=[...]")
    return df.orderBy(SEQ).limit(1)
