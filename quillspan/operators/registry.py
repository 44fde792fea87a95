"""The registry of macro definitions: a versioned table that writers replace file by file, under an optimistic lock.

Each version is a folder of its own. A writer names the version it has read; if another one has been written since, or is being written,
the write is refused and nothing changes. A version counts once its claim file is there, which the file system creates for one writer only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "fileid string, sashashcode string, macroname string, params array<string>, definition string"


class Conflict(Exception):
    """Another writer was faster; read again and repeat."""


class MacroRegistry:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The greatest version written, 0 for a new registry."""
        fs, p = self._fs(self.folder)
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        n = self.version() if version is None else version
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/v{n}") if n else self.spark.createDataFrame([], SCHEMA)

    def write(self, rows: DataFrame, read_at: int) -> int:
        """Replaces the definitions of all files in ``rows``; a file whose rows carry the hash that is known stays as it is.

        Returns the new version, or the old one where nothing changes.
        """
        if self.version() != read_at:
            raise Conflict(f"version {self.version()} was written since version {read_at} was read")
        old = self.read(read_at)
        news = rows.select(*old.columns).distinct().join(old.select("fileid", "sashashcode").distinct(), ["fileid", "sashashcode"], "left_anti").select(*old.columns)
        if news.isEmpty():
            return read_at
        fs, claim = self._fs(f"{self.folder}/claim{read_at + 1}")
        if not fs.createNewFile(claim):
            raise Conflict(f"version {read_at + 1} is being written")
        whole = old.join(news.select("fileid").distinct(), "fileid", "left_anti").select(*old.columns).unionByName(news)
        whole.write.parquet(f"{self.folder}/.v{read_at + 1}")
        hidden, done = self._fs(f"{self.folder}/.v{read_at + 1}")[1], self._fs(f"{self.folder}/v{read_at + 1}")[1]
        if not fs.rename(hidden, done):
            raise Conflict(f"version {read_at + 1} could not be put in place")
        return read_at + 1

    def macros(self) -> dict[str, tuple[list[str], str]]:
        """Parameters and definition of each macro, for the expansion of a program; of equal names that of the greatest file id counts."""
        latest = self.read().groupBy(F.lower("macroname").alias("m")).agg(F.max_by(F.struct("params", "definition"), "fileid").alias("d"))
        return {r.m: (list(r.d.params), r.d.definition) for r in latest.toLocalIterator()}
