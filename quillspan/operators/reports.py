"""Verdicts of runs, attribution of outputs, the lifecycle of edits and what is told about a neighbourhood."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.graph import radius
from quillspan.operators.ranking import global_rank
from quillspan.operators.store import first_names
from quillspan.operators.verify import VERDICTS


def block_verdict(has_program: Column, has_inputs: Column, has_table: Column, n_ref: Column, n_mismatch: Column, warned: Column) -> Column:
    """What a block's run says: no program, no inputs, no table, missing, differs, match-warn (no rows or a warning), match."""
    return F.when(~has_program, "no program").when(~has_inputs, "no inputs").when(~has_table, "no table").when(n_ref.isNull(), "missing").when(n_mismatch > 0, "differs").when((n_ref == 0) | warned, "match-warn").otherwise("match")


def three_way(present: Column, same_bytes: Column, same_rows: Column) -> Column:
    """What three executors say of a table: MISSING, bytes (equal in order too), rows (equal as multisets), FAIL."""
    return F.when(~present, "MISSING").when(same_bytes, "bytes").when(same_rows, "rows").otherwise("FAIL")


def attribute_outputs(nodes: DataFrame, outputs: DataFrame) -> DataFrame:
    """The block that mentions each output name last, as a whole word: name, block. nodes: block, seq, term; outputs: name."""
    words = nodes.select("block", "seq", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("term"), F.lit(r"\w+"), F.lit(0)))).alias("word"))
    hits = outputs.select("name", F.lower("name").alias("word")).distinct().join(words, "word")
    return hits.groupBy("name").agg(F.max_by("block", F.struct("seq", "block")).alias("block"))


def edit_lifecycle(edits: DataFrame, flow: list[str], at: str = "at", edit_id: str = "edit_id") -> DataFrame:
    """Each edit's flags after all edits were made in order: a later confirm of its flow clears requires_check, a later reject
    dismisses an edit that is still flagged. Adds ``cleared`` and ``out_of_queue``.

    A window per flow runs from the latest edit to the earliest and carries the last confirm and reject it has seen, so each edit
    costs the same however many its flow has.
    """
    later = Window.partitionBy(*flow).orderBy(F.col(at).desc_nulls_last(), F.col(edit_id).desc()).rowsBetween(Window.unboundedPreceding, -1)
    confirm = F.last(F.when(F.col("action") == "confirm", F.struct(at, edit_id)), ignorenulls=True).over(later)
    reject = F.last(F.when(F.col("action") == "reject", F.struct(at, edit_id)), ignorenulls=True).over(later)
    flagged = F.coalesce("requires_check", F.lit(False))
    return edits.select("*", confirm.alias("__c"), reject.alias("__r")).withColumn("cleared", flagged & F.col("__c").isNotNull()).withColumn("out_of_queue", flagged & F.col("__r").isNotNull() & (F.col("__c").isNull() | (F.col("__r") < F.col("__c")))).drop("__c", "__r")


def red_first(edits: DataFrame) -> DataFrame:
    """The review queue: red, yellow, green, then by time and id; ``place`` counts from 1."""
    rank = F.when(F.col("colour") == "red", 0).when(F.col("colour") == "yellow", 1).otherwise(2)
    return global_rank(edits.withColumn("__red", rank), ["__red", "at", "edit_id"], "place").drop("__red")


def status_report(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """One row per program: how many tables got each verdict, the mismatches in all, and the worst verdict. verdicts: by, verdict, n_mismatch."""
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in VERDICTS]
    worst = reduce(lambda w, iv: w.when(F.col("verdict") == iv[1], iv[0]), enumerate(VERDICTS), F)
    g = verdicts.groupBy(*by).agg(*counts, F.sum("n_mismatch").alias("n_mismatch"), F.min(worst).alias("__worst"))
    return g.withColumn("status", F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("__worst") + 1)).drop("__worst")


def timeline(changes: DataFrame, version: str) -> DataFrame:
    """Per saved version: flows added, removed and changed against the one before."""
    n = lambda kind: F.count_if(F.col("change_type") == kind).alias(f"n_{kind}")
    return changes.groupBy(version).agg(n("added"), n("removed"), n("changed"))


def story(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One sentence per seed: how many tables flow in and out, with the first names, and how many a change of it affects downstream."""
    plain = edges.filter("src != dst").select("src", "dst").distinct()
    own = seeds.select("node").distinct()

    def side(at: str, other: str, word: str) -> DataFrame:
        near = plain.join(own, F.col(at) == F.col("node"), "left_semi")
        counts = near.groupBy(F.col(at).alias("node")).agg(F.count("*").alias("n"))
        names = first_names(near.select(F.col(at).alias("node"), other), "node", other).withColumn("names", F.regexp_replace("names", r" \+\d+$", ""))
        return own.join(counts.join(names, "node"), "node", "left").select("node", F.when(F.col("n") > 0, F.concat(F.lit(f"{word} "), F.col("n").cast("string"), F.lit(" ("), F.col("names"), F.lit(")"))).otherwise(f"{word} none").alias(at))

    j = side("dst", "src", "fed by").join(side("src", "dst", "feeds"), "node").join(radius(edges, own), "node")
    return j.select("node", F.concat(F.col("node"), F.lit(": "), F.col("dst"), F.lit("; "), F.col("src"), F.lit("; if it changes, "), F.col("n_downstream").cast("string"), F.lit(" downstream are affected.")).alias("sentence"))


def pivot_by_macro(macros: DataFrame, calls: DataFrame) -> DataFrame:
    """Per macro: files that define it, calls, files that call it."""
    d = macros.groupBy("macroname").agg(F.count_distinct("fileid").alias("n_defined"))
    c = calls.groupBy("macroname").agg(F.count("*").alias("calls"), F.count_distinct("fileid").alias("n_calling"))
    return d.join(c, "macroname", "left").fillna(0, ["calls", "n_calling"])


def export_rows(edges: DataFrame, libs: dict[str, str] | None = None, renamed: dict[str, str] | None = None) -> DataFrame:
    """Edges as the lineage export lists them: both ends, their schemas and bare names, the paths of the schemas' libraries, and the names
    that the schemas have where the data goes. What is not known is an empty text."""
    schema = lambda c: F.when(F.contains(c, F.lit(".")), F.split_part(c, F.lit("."), F.lit(1))).otherwise(F.lit("work"))

    def known(names: dict[str, str] | None, c: Column) -> Column:
        return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), (names or {}).items(), F).otherwise(F.lit("")) if names else F.lit("")

    src, dst = schema(F.col("src")), schema(F.col("dst"))
    return edges.select(
        "fileid", "block_id", "src", "dst", src.alias("src_schema"), F.substring_index("src", ".", -1).alias("src_name"), dst.alias("dst_schema"), F.substring_index("dst", ".", -1).alias("dst_name"), "level",
        known(libs, src).alias("src_lib_path"), known(libs, dst).alias("dst_lib_path"), known(renamed, src).alias("new_src_schema"), known(renamed, dst).alias("new_dst_schema"))
