"""Sources besides parquet: typed CSV, part files, listings, estates of programs, terms on disk."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import sas
from quillspan.operators.ranking import latest_before

_KINDS = {"num": "double", "char": "string", "date": "string"}


def schema_csv(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, dict[str, str]]:
    """A CSV with header and a .schema.json of {name, type (num, char, date), format}: the table and its formats. A dot is missing."""
    cols = json.loads(schema)
    df = spark.read.csv(path, header=True, schema=", ".join(f"`{c['name']}` string" for c in cols))
    read = {"num": lambda c, f: c.try_cast("double"), "char": lambda c, f: c, "date": lambda c, f: sas.read_date(c, f or "mmddyy10")}
    out = df.select(*[read[c["type"]](F.nullif(F.trim(F.col(c["name"])), F.lit(".")), c.get("format")).alias(c["name"]) for c in cols])
    return out, {c["name"]: c["format"] for c in cols if c.get("format")}


def part_files(spark: SparkSession, path: str, names: list[str], sep: str = ",") -> DataFrame:
    """A file or a folder of part files as text columns; rows that repeat the header are dropped (marker and hidden files are never read)."""
    df = spark.read.csv(path, header=False, sep=sep, schema=", ".join(f"`{n}` string" for n in names))
    header = F.lit(True)
    for n in names:
        header = header & F.coalesce(F.col(n) == n, F.lit(False))
    return df.filter(~header)


def listing(lines: DataFrame, order: str, text: str) -> DataFrame:
    """Rows of printed listings: title, obs, values (array). lines: ``order`` (whole numbers, unique) and ``text``.

    A title is a line ``Table: name``; a row begins with its number, so the line with the names of the columns is none. The title of a row
    is that of the latest title line before it, found over spans of lines, so a report of any length is read in parallel. Lines before
    the first title belong to no table.
    """
    name = F.nullif(F.regexp_extract(text, r"^Table:\s+(\S+)", 1), F.lit(""))
    tagged = latest_before(lines.select(order, text), [], order, name.isNotNull(), "__title")
    titles = lines.filter(name.isNotNull()).select(F.col(order).alias("__at"), name.alias("title"))
    parts = F.split(F.trim(text), r"\s+")
    rows = tagged.filter(name.isNull() & parts[0].try_cast("int").isNotNull()).join(titles, F.col("__title") == F.col("__at"))
    return rows.select("title", parts[0].try_cast("int").alias("obs"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("values"))


def estate(spark: SparkSession, folder: str, known: DataFrame | None = None, version: str = "1") -> DataFrame:
    """All programs below a folder: fileid, sashashcode, source. With ``known`` (fileid, sashashcode) only those that are new or changed.

    The hash covers the engine's version, so a new version reads every file again.
    """
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.sas").text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))
    base = F.lit(folder.rstrip("/") + "/")
    df = df.select(F.lower(F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), base, F.lit(""))).alias("fileid"), F.substring(F.sha2(F.concat(F.lit(version), F.col("source")), 256), 1, 16).alias("sashashcode"), "source")
    return df if known is None else df.join(known.select("fileid", "sashashcode"), ["fileid", "sashashcode"], "left_anti")


def synthetic_edges(spark: SparkSession, files: int, per_file: int) -> DataFrame:
    """Deterministic edges for load tests: one in five is between files."""
    n = F.col("id") % per_file
    f = F.floor(F.col("id") / per_file)
    return spark.range(files * per_file).select(
        F.format_string("f%06d.sas", f).alias("fileid"), F.format_string("b_%d", n).alias("block_id"), F.format_string("lib.t%d", F.pmod(F.xxhash64("id"), F.lit(files))).alias("src"), F.format_string("lib.t%d", F.pmod(F.xxhash64(F.col("id") + 1), F.lit(files))).alias("dst"),
        F.when(n % 5 == 0, "FILE_FLOW").otherwise("BLOCK_FLOW").alias("edge_type"))


def scan_term(sources: DataFrame, text: str, term: str) -> DataFrame:
    """Sources that hold a term, in any case."""
    return sources.filter(F.contains(F.lower(text), F.lit(term.lower())))


def delimited(lines: DataFrame, text: str, columns: str, sep: str = "|") -> DataFrame:
    """Delimited lines in a column (quoted values may hold the separator): typed columns; a dot or nothing is missing, a short line is padded."""
    return lines.select(F.from_csv(F.col(text), columns, {"sep": sep, "nullValue": ".", "mode": "PERMISSIVE"}).alias("__r")).select("__r.*")
