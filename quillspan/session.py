"""Session helpers: table access, and tables written to the shared folder to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(cpus: int | str = "*", memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine expects of a cluster too."""
    n = partitions or (int(cpus) if str(cpus).isdigit() else os.cpu_count() or 8)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillspan")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set (tests, one machine)."""
    sc = spark.sparkContext
    said = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not said:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        said = f"file://{own}"
        sc.setCheckpointDir(said)
    return said.rstrip("/")


class Scratch:
    """Tables of one operator run, written under the shared folder.

    A written table cuts the lineage and survives the loss of executors. ``drop`` removes a table that no later step reads, so that
    iterative operators hold two rounds at a time. ``close`` removes the whole folder, once nothing reads the operator's result any
    more; what is not closed by then goes when the session ends.
    """

    _open: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        if not Scratch._open:
            atexit.register(close_scratch)
        Scratch._open[self.root] = spark

    def path(self, label: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        where = self.path(label)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def counted(self, df: DataFrame, what: Column, label: str = "t") -> tuple[DataFrame, int]:
        """The written table and how many of its rows ``what`` holds for, counted by the job that writes."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count_if(what).alias("n")), label)
        n = seen.get.get("n")
        return out, out.filter(what).count() if n is None else n  # a plan that is known to be empty may not be observed

    def drop(self, df: DataFrame) -> None:
        where = getattr(df, "_scratch_path", None)
        if where:
            self.remove(where)

    def remove(self, where: str) -> None:
        _remove(self.spark, where)

    def close(self) -> None:
        if Scratch._open.pop(self.root, None):
            _remove(self.spark, self.root)


def _remove(spark: SparkSession, where: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def close_scratch() -> None:
    """Removes all folders that operators have left; their results cannot be read any more."""
    for root, spark in list(Scratch._open.items()):
        Scratch._open.pop(root)
        try:
            _remove(spark, root)
        except Exception:  # the session has ended; its folder is its owner's to clear
            return


#: Input splits over which an input is left as it is; a smaller one would be a single task.
SMALL_SPLIT = 0.25


def spread(df: DataFrame, by: str) -> DataFrame:
    """``df`` over all cores, for stages in Python, if its input is less than a quarter of one input split and so one task.

    The size is the optimizer's estimate, so no job runs, and what is shuffled is bounded by that quarter whatever the cluster.
    """
    spark = df.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism, by) if size < split * SMALL_SPLIT else df
