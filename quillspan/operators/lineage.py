"""Lineage between occurrences of tables: flows between files and blocks, blocks and steps by line, sets of words that are alike."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.lang.scan import bare, split_blocks
from quillspan.operators.ranking import running_sum
from quillspan.session import spread

#: A run of statements takes at most so many lines, and closes from so many on.
MOST_LINES, LEAST_LINES = 15, 7


def project_flow(edges: DataFrame) -> DataFrame:
    """Files that write a table that another file reads: src_file, dst_file, n_tables, tables (their names, with commas).

    As many rows are joined as there are pairs of a writing and a reading file of a table; that is the result asked for.
    """
    w = edges.select(F.col("dst").alias("tbl"), F.col("fileid").alias("src_file")).distinct()
    r = edges.select(F.col("src").alias("tbl"), F.col("fileid").alias("dst_file")).distinct()
    return w.join(r, "tbl").filter("src_file != dst_file").groupBy("src_file", "dst_file").agg(F.count("*").alias("n_tables"), F.concat_ws(",", F.sort_array(F.collect_set("tbl"))).alias("tables"))


def block_links(edges: DataFrame) -> DataFrame:
    """The latest writing block of each file and table, linked to all reading blocks in other files. Blocks are numbered by their id's second part."""
    b = edges.filter("block_id is not null").withColumn("no", F.split_part("block_id", F.lit("_"), F.lit(2)).try_cast("int"))
    w = b.filter("dst is not null").groupBy(F.col("dst").alias("tbl"), F.col("fileid").alias("src_file")).agg(F.max("no").alias("writer"))
    r = b.filter("src is not null").select(F.col("src").alias("tbl"), F.col("fileid").alias("dst_file"), F.col("no").alias("reader")).distinct()
    return w.join(r, "tbl").filter("src_file != dst_file").select("src_file", "writer", "dst_file", "reader", "tbl")


def earlier_writers(occurrences: DataFrame) -> DataFrame:
    """All earlier writers of each reader: fileid, tbl, writer, reader (places n). occurrences: fileid, tbl, n, role."""
    w = occurrences.filter("role = 'write'").select("fileid", "tbl", F.col("n").alias("writer"))
    return w.join(occurrences.filter("role = 'read'").select("fileid", "tbl", F.col("n").alias("reader")), ["fileid", "tbl"]).filter("reader > writer")


def block_flow(edges: DataFrame) -> DataFrame:
    """Tables read by a block times the tables it writes, a table's flow into itself left out: fileid, block_id, src, dst."""
    e = edges.filter("block_id is not null")
    r, w = e.filter("src is not null").select("fileid", "block_id", "src").distinct(), e.filter("dst is not null").select("fileid", "block_id", "dst").distinct()
    return r.join(w, ["fileid", "block_id"]).filter("src != dst")


def statement_flows(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """The same from what a scanner found: fileid, block_id, stmt, tbl; in blocks that keep statements apart only within one."""
    return reads.withColumnRenamed("tbl", "src").join(writes.withColumnRenamed("tbl", "dst"), ["fileid", "block_id", "stmt"]).select("fileid", "block_id", "src", "dst").distinct()


def occurrence_ids(occurrences: DataFrame, per_block: int) -> DataFrame:
    """fileid, n, occ_id: each occurrence numbered in its block, reads first, and blocks numbered in their file.

    A block is ``per_block`` places. Blocks are numbered by a running sum over one row per block that is cut into spans, so a file with
    a third of all rows is spread over many windows.
    """
    o = occurrences.withColumn("b", F.floor(F.col("n") / per_block))
    blocks = running_sum(o.select("fileid", "b").distinct().withColumn("one", F.lit(1)), ["fileid"], "b", "one", "block_no")
    within = Window.partitionBy("fileid", "b").orderBy("role", "n")
    tagged = o.withColumn("t", F.row_number().over(within)).join(blocks.select(F.col("fileid").alias("bf"), F.col("b").alias("bb"), "block_no"), F.col("fileid").eqNullSafe(F.col("bf")) & (F.col("b") == F.col("bb")))
    return tagged.select("fileid", "n", F.concat(F.lit("b_"), F.col("block_no").cast("string"), F.lit(":t_"), F.col("t").cast("string")).alias("occ_id"))


def line_ranges(blocks: DataFrame) -> DataFrame:
    """fileid, block_id, l0, line_end: a block lasts until the line before the next, the last one until its own end."""
    w = Window.partitionBy("fileid").orderBy("n", "block_id", "l0", "l1")
    return blocks.select("fileid", "block_id", "l0", F.coalesce(F.lead("l0").over(w) - 1, F.col("l1")).alias("line_end"))


def step_islands(rows: DataFrame, key: str, order: str, opens: Column) -> DataFrame:
    """Steps as islands: an opening row starts a step that lasts until the next: key, step, first_id, last_id, n."""
    flagged = rows.select(key, order, F.when(opens, 1).otherwise(0).alias("opens"))
    t = running_sum(flagged, [key], order, "opens", "step")
    return t.groupBy(key, "step").agg(F.min(order).alias("first_id"), F.max(order).alias("last_id"), F.count("*").alias("n"))


def block_law(statements: DataFrame) -> DataFrame:
    """Runs of a file's statements by lines: fileid, n, run (from 0). statements: fileid, n, l0, l1.

    A run takes the next statement while the lines from its first to that one's last, gaps included, are at most MOST_LINES, and closes
    once they are LEAST_LINES; a statement that is longer is a run of its own. Each statement's run depends on all before it in its
    file, so a file is folded in order, row by row through one sorted partition, and nothing of it is held.
    """
    def fold(batches):
        file, l0, l1, run, is_open = None, 0, 0, -1, False
        for b in batches:
            runs = []
            for f, a, z in zip(b.column("fileid").to_pylist(), b.column("l0").to_pylist(), b.column("l1").to_pylist()):
                if f != file or run < 0:
                    file, run, is_open = f, -1, False
                if is_open and max(l1, z) - l0 + 1 <= MOST_LINES:
                    l1 = max(l1, z)
                else:
                    l0, l1, run = a, z, run + 1
                is_open = l1 - l0 + 1 < LEAST_LINES
                runs.append(run)
            yield pa.RecordBatch.from_arrays([b.column("fileid"), b.column("n"), pa.array(runs, pa.int32())], ["fileid", "n", "run"])

    ordered = statements.select("fileid", "n", "l0", "l1").filter("l0 is not null and l1 is not null").repartition("fileid").sortWithinPartitions("fileid", "n", "l0", "l1")
    return ordered.mapInArrow(fold, f"fileid string, n {statements.schema['n'].dataType.simpleString()}, run int")


def qualified_terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """How often each ``lib.name`` occurs in each text: key, term, n."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_][a-z0-9_]*\.[a-z_][a-z0-9_]*"), F.lit(0))
    return texts.select(key, F.explode(found).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def bare_programs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, bare: programs without remarks, white space squeezed; what looks like a remark in a string stays."""
    def strip(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else bare(t) for t in b.column(1).to_pylist()], pa.string())], ["key", "bare"])

    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").mapInArrow(strip, f"key {kind}, bare string").withColumnRenamed("key", key)


def hashes(texts: DataFrame, key: str, text: str, n: str) -> DataFrame:
    """key, file_hash and block_hash: 16 hex digits over a text; a block's id from its place and 8 hex digits."""
    return texts.select(key, F.substring(F.sha2(text, 256), 1, 16).alias("file_hash"), F.concat(F.lit("b_"), F.col(n).cast("string"), F.lit("_"), F.substring(F.sha1(text), 1, 8)).alias("block_hash"))


SCANNED = "kind string, status string, reads string, writes string"


def scanned_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Steps of programs with the tables they read and write: key, block_no (from 0), kind, status, reads, writes (with commas).

    Null and empty texts have no blocks. Programs are read in Arrow batches; a program's grammar has no columnar form.
    """
    def scan(batches):
        for b in batches:
            rows = [(k, i, x.kind, x.status, ",".join(x.reads), ",".join(x.writes)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, x in enumerate(split_blocks(t or ""))]
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.column(0).type, pa.int32(), *[pa.string()] * 4])], ["key", "block_no", "kind", "status", "reads", "writes"])

    kind = texts.schema[key].dataType.simpleString()
    return spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").mapInArrow(scan, f"key {kind}, block_no int, {SCANNED}").withColumnRenamed("key", key)


def jaccard(sets: DataFrame, owner: str, member: str, digits: int = 6) -> DataFrame:
    """How alike the sets of all pairs of owners are that share a member: a < b, jaccard. sets: distinct (owner, member) rows.

    An equi-join on members; a member that m owners have gives m * (m - 1) / 2 rows, so it is for few owners or rare members.
    """
    size = sets.groupBy(owner).agg(F.count("*").alias("c"))
    both = sets.select(F.col(owner).alias("a"), member).join(sets.select(F.col(owner).alias("b"), member), member).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    j = both.join(size.select(F.col(owner).alias("a"), F.col("c").alias("ca")), "a").join(size.select(F.col(owner).alias("b"), F.col("c").alias("cb")), "b")
    return j.select("a", "b", F.round(F.col("n") / (F.col("ca") + F.col("cb") - F.col("n")), digits).alias("jaccard"))


def subsets(sets: DataFrame, owner: str, member: str) -> DataFrame:
    """Owners whose whole set is in another's: sub, sup. The join is as that of ``jaccard``."""
    size = sets.groupBy(F.col(owner).alias("sub")).agg(F.count("*").alias("c"))
    both = sets.select(F.col(owner).alias("sub"), member).join(sets.select(F.col(owner).alias("sup"), member), member).filter("sub != sup").groupBy("sub", "sup").agg(F.count("*").alias("n"))
    return both.join(size, "sub").filter("n = c").select("sub", "sup")


def suggestions(names: DataFrame, name: str, asked: str, most: int) -> DataFrame:
    """Distinct names within an edit distance of what was asked for: name, dist."""
    dist = F.levenshtein(name, F.lit(asked))
    return names.select(name).distinct().filter(dist <= most).select(name, dist.cast("long").alias("dist"))


def conversion_coverage(blocks: DataFrame) -> DataFrame:
    """Per file how many of its blocks are parsed: fileid, status (converted, partial, not converted), n_blocks, n_parsed. blocks: fileid, status."""
    g = blocks.groupBy("fileid").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("status") == "parsed").alias("n_parsed"))
    return g.select("fileid", F.when(F.col("n_parsed") == F.col("n_blocks"), "converted").when(F.col("n_parsed") > 0, "partial").otherwise("not converted").alias("status"), "n_blocks", "n_parsed")


def folder_links(files: DataFrame, rules: DataFrame) -> DataFrame:
    """How the files of one folder are linked: folder, from_name, to_name, kind. files: folder, name, kind; rules: folder, name, src, dst.

    flow     the second reads a table that the first writes and that it does not write itself
    subset   the second's rules are all among the first's, which has more; of several the smallest, by name
    same     both have the same rules; the first is the one named ``full``, else the shortest, else the first by name
    derived  the second is no program and its name begins with the first's without its ending; of several the longest, by name
    """
    r = rules.select("folder", "name", "src", "dst").distinct()
    writes = r.select("folder", F.col("name").alias("wn"), F.col("dst").alias("t")).distinct()
    own = r.select("folder", "name", F.col("dst").alias("t")).distinct()
    reads = r.select("folder", "name", F.col("src").alias("t")).distinct().join(own, ["folder", "name", "t"], "left_anti")
    flow = reads.join(writes, ["folder", "t"]).filter("name != wn").select("folder", F.col("wn").alias("from_name"), F.col("name").alias("to_name")).distinct().withColumn("kind", F.lit("flow"))
    # a set of rules is told by its size and two independent sums of hashes, so equal sets meet without being compared rule by rule
    mark = lambda salt: F.sum(F.xxhash64(F.lit(salt), "src", "dst").cast("decimal(38,0)"))
    sets = r.groupBy("folder", "name").agg(F.count("*").alias("n"), mark(1).alias("s1"), mark(2).alias("s2"))
    rank = F.struct(F.when(F.contains("name", F.lit("full")), 0).otherwise(1), F.length("name"), F.col("name"))
    lead = sets.groupBy("folder", "n", "s1", "s2").agg(F.min_by("name", rank).alias("from_name"))
    same = sets.join(lead, ["folder", "n", "s1", "s2"]).filter("name != from_name").select("folder", "from_name", F.col("name").alias("to_name")).withColumn("kind", F.lit("same"))
    shared = r.withColumnRenamed("name", "to_name").join(r.withColumnRenamed("name", "from_name"), ["folder", "src", "dst"]).filter("to_name != from_name").groupBy("folder", "to_name", "from_name").agg(F.count("*").alias("k"))
    size = sets.select("folder", F.col("name").alias("sn"), "n")
    inside = shared.join(size.select("folder", F.col("sn").alias("to_name"), F.col("n").alias("n_to")), ["folder", "to_name"]).join(size.select("folder", F.col("sn").alias("from_name"), F.col("n").alias("n_from")), ["folder", "from_name"])
    subset = inside.filter("k = n_to and n_to < n_from").groupBy("folder", "to_name").agg(F.min_by("from_name", F.struct("n_from", "from_name")).alias("from_name")).select("folder", "from_name", "to_name").withColumn("kind", F.lit("subset"))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    programs = files.filter("kind = 'sas'").select("folder", F.col("name").alias("from_name"), stem.alias("stem")).distinct()
    others = files.filter("kind != 'sas'").select("folder", F.col("name").alias("to_name")).distinct()
    # a name meets a stem by equality on each of its beginnings, not by comparing all with all
    begun = others.select("folder", "to_name", F.explode(F.transform(F.sequence(F.lit(1), F.length("to_name")), lambda k: F.substr("to_name", F.lit(1), k))).alias("stem"))
    derived = begun.join(programs, ["folder", "stem"]).groupBy("folder", "to_name").agg(F.min_by("from_name", F.struct(-F.length("stem"), F.col("from_name"))).alias("from_name")).select("folder", "from_name", "to_name").withColumn("kind", F.lit("derived"))
    return flow.unionByName(subset).unionByName(same).unionByName(derived)
