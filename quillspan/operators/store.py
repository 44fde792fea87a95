"""The lineage store as tables: merging people's edits, freshness after a new parse, lost flows, pivots, search, the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.names import file_of, name_of

FLOW = ["fileid", "src", "dst", "level"]


def provided_edges(lineage: DataFrame) -> DataFrame:
    """Engine rows of lineage as edges: fileid, block_id, src, dst, table_name, level, provenance, freshness."""
    block = name_of("edge_type") == "block_flow"
    return lineage.select(
        file_of("fileid").alias("fileid"), name_of("block_id").alias("block_id"), name_of("source_canonical_name").alias("src"), name_of("target_canonical_name").alias("dst"), name_of("source_canonical_name").alias("table_name"),
        F.when(block, "block").otherwise("file").alias("level"), F.when(block, "fact").otherwise("inferred").alias("provenance"), F.coalesce(name_of("freshness"), F.lit("green")).alias("freshness"))


def merged_edges(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Edges with the edits that need no check applied: reject drops a block's rows, confirm makes them human_gold, add and correct append.

    An edit without a file speaks for the block in every file. Both kinds are joined as distinct keys, one equi-join for edits with a
    file and one for those without, so rows never multiply.
    """
    live = edits.filter(~F.coalesce("requires_check", F.lit(False)))

    def hit(action: str, name: str, df: DataFrame) -> DataFrame:
        mine = live.filter((F.col("action") == action) & F.col("block_id").isNotNull())
        exact = mine.filter("fileid is not null").select(F.col("fileid").alias("xf"), F.col("block_id").alias("xb")).distinct().withColumn("x", F.lit(True))
        every = mine.filter("fileid is null").select(F.col("block_id").alias("yb")).distinct().withColumn("y", F.lit(True))
        j = df.join(exact, (F.col("fileid") == F.col("xf")) & (F.col("block_id") == F.col("xb")), "left").join(every, F.col("block_id") == F.col("yb"), "left")
        return j.withColumn(name, F.coalesce("x", "y", F.lit(False))).drop("xf", "xb", "yb", "x", "y")

    kept = hit("confirm", "gold", hit("reject", "gone", edges).filter("not gone").drop("gone"))
    kept = kept.withColumn("provenance", F.when(F.col("gold"), "human_gold").otherwise(F.col("provenance"))).drop("gold")
    added = live.filter(F.col("action").isin("add", "correct")).select(F.coalesce("fileid", "src").alias("fileid"), "block_id", "src", "dst", "table_name", "level", F.lit("human_gold").alias("provenance"), F.lit("green").alias("freshness"))
    return kept.unionByName(added)


def freshness(new: DataFrame, old: DataFrame) -> DataFrame:
    """Colour of each new edge: green if its block (or file) is known or the file is new, yellow if the flow survived, else red."""
    blocks = old.select(F.col("fileid").alias("bf"), F.col("block_id").alias("bb")).distinct().withColumn("known", F.lit(True))
    files = old.select(F.col("fileid").alias("ff")).distinct().withColumn("seen", F.lit(True))
    flows = old.select(*[F.col(c).alias(f"o_{c}") for c in FLOW]).distinct().withColumn("same", F.lit(True))
    j = new.join(blocks, (F.col("fileid") == F.col("bf")) & F.col("block_id").eqNullSafe(F.col("bb")), "left").join(files, F.col("fileid") == F.col("ff"), "left")
    j = j.join(flows, (F.col("fileid") == F.col("o_fileid")) & (F.col("src") == F.col("o_src")) & (F.col("dst") == F.col("o_dst")) & (F.col("level") == F.col("o_level")), "left")
    colour = F.when(F.col("seen").isNull() | F.col("known"), "green").when(F.col("same"), "yellow").otherwise("red")
    return j.withColumn("colour", colour).select(*new.columns, "colour")


def lost_flows(new: DataFrame, old: DataFrame) -> DataFrame:
    """Flows that the parse before had and the new one lost, in files that both have; with the block they were in."""
    files = new.select("fileid").distinct()
    gone = old.join(new.select(*FLOW).distinct(), FLOW, "left_anti").join(files, "fileid", "left_semi")
    return gone.groupBy(*FLOW).agg(F.max("block_id").alias("block_id"))


def save_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """Flow identities (without block) added and removed by a save."""
    a, b = new.select(*FLOW).distinct(), old.select(*FLOW).distinct()
    return a.join(b, FLOW, "left_anti").withColumn("change", F.lit("added")).union(b.join(a, FLOW, "left_anti").withColumn("change", F.lit("removed")))


def stale_colour(edits: DataFrame, edges: DataFrame) -> DataFrame:
    """Colour of each edit that names a block: green if the block is there, yellow if only its flow survived in the file, else red."""
    blocks = edges.select(F.col("fileid").alias("bf"), F.col("block_id").alias("bb")).distinct().withColumn("b", F.lit(True))
    flows = edges.select(F.col("fileid").alias("ff"), F.col("src").alias("fs"), F.col("dst").alias("fd")).distinct().withColumn("f", F.lit(True))
    j = edits.filter("block_id is not null").join(blocks, (F.col("fileid") == F.col("bf")) & (F.col("block_id") == F.col("bb")), "left").join(flows, (F.col("fileid") == F.col("ff")) & (F.col("src") == F.col("fs")) & (F.col("dst") == F.col("fd")), "left")
    return j.select("edit_id", F.when(F.col("b"), "green").when(F.col("f"), "yellow").otherwise("red").alias("colour"))


def pivot_by_table(edges: DataFrame) -> DataFrame:
    """Per table: files that read and that write it, and all of them."""
    use = edges.select(F.col("src").alias("table_name"), "fileid", F.lit("read").alias("role")).union(edges.select("dst", "fileid", F.lit("write"))).filter("table_name is not null").distinct()
    return use.groupBy("table_name").agg(F.count(F.when(F.col("role") == "read", F.col("fileid"))).alias("n_reading"), F.count(F.when(F.col("role") == "write", F.col("fileid"))).alias("n_writing"), F.count_distinct("fileid").alias("n_files"))


def pivot_by_file(files: DataFrame, blocks: DataFrame, edges: DataFrame, literal: bool = False) -> DataFrame:
    """Per file: distinct blocks and edges. ``literal`` counts an edge once per block of the file, as a join of all three does."""
    b = blocks.groupBy("fileid").agg(F.count_distinct("block_id").alias("n_blocks"), F.count("*").alias("b_rows"))
    e = edges.groupBy("fileid").agg(F.count("*").alias("e_rows"))
    j = files.join(b, "fileid", "left").join(e, "fileid", "left").fillna(0, ["n_blocks", "b_rows", "e_rows"])
    n = F.col("e_rows") * F.greatest(F.col("b_rows"), F.lit(1)) if literal else F.col("e_rows")
    return j.select("fileid", "n_blocks", n.alias("n_edges"))


def search(terms: DataFrame, files: DataFrame, q: str, n: int = 20) -> DataFrame:
    """Typeahead: tables and file names that hold ``q``: real names before one-letter qualifiers, exact, prefix, substring, most files first."""
    q = q.strip().lower()
    t = terms.filter(F.contains(F.col("term"), F.lit(q))).groupBy(F.col("term").alias("value")).agg(F.count_distinct("fileid").alias("n_files")).withColumn("kind", F.lit("table"))
    f = files.filter(F.contains(F.lower("sasfilename"), F.lit(q))).groupBy(F.col("sasfilename").alias("value")).agg(F.count_distinct("fileid").alias("n_files")).withColumn("kind", F.lit("file"))
    low = F.lower("value")
    alias = ((F.col("kind") == "table") & (F.length(F.substring_index("value", ".", 1)) == 1)).cast("int")
    exact = F.when(low == q, 0).when(F.startswith(low, F.lit(q)), 1).otherwise(2)
    return t.unionByName(f).orderBy(alias, exact, F.col("n_files").desc(), "kind", low, "value").limit(n).select("kind", "value", "n_files")


def paged(edges: DataFrame, text: str | None, level: str | None, offset: int, limit: int) -> DataFrame:
    """One page of edges in a fixed order, filtered by text over three columns and by level."""
    if text:
        q = F.lit(text.strip().lower())
        edges = edges.filter(F.contains(F.lower("src"), q) | F.contains(F.lower("dst"), q) | F.contains(F.lower("table_name"), q))
    if level:
        edges = edges.filter(F.col("level") == level)
    return edges.orderBy(*["src", "dst", "table_name", *[c for c in edges.columns if c not in ("src", "dst", "table_name")]]).offset(offset).limit(limit)


def latest_state(log: DataFrame) -> DataFrame:
    """Each file's state after replay of the log by seq: what set it last, and whether the file is there. Repeated rows count once."""
    e = log.select(file_of("fileid").alias("fileid"), "seq", name_of("event_type").alias("event_type"), "payload").filter("fileid is not null")
    return e.groupBy("fileid").agg(
        F.max_by("event_type", "seq").alias("last_event"), F.max("seq").alias("last_seq"), F.count_distinct("seq").alias("n_events"),
        F.coalesce(F.max_by(F.when(F.col("event_type") == "file_ingested", True).otherwise(False), F.when(F.col("event_type").isin("file_ingested", "file_removed"), F.col("seq"))), F.lit(False)).alias("present"))


def state_at(log: DataFrame, upto: int | None = None, base: DataFrame | None = None) -> DataFrame:
    """fileid, last_seq, last_event, present after the events numbered up to ``upto``, from an earlier state if one is given.

    Only events behind the state's greatest number are replayed, so recovery from a checkpoint reads the rest of the log.
    """
    e = log.select(file_of("fileid").alias("fileid"), "seq", name_of("event_type").alias("event")).filter("fileid is not null")
    if upto is not None:
        e = e.filter(F.col("seq") <= upto)
    if base is not None:
        e = e.filter(F.col("seq") > base.agg(F.coalesce(F.max("last_seq"), F.lit(0).cast("long"))).scalar())
    told = F.when(F.col("event").isin("file_ingested", "file_removed"), F.col("seq"))
    new = e.groupBy("fileid").agg(F.max("seq").alias("last_seq"), F.max_by("event", "seq").alias("last_event"), F.max_by(F.col("event") == "file_ingested", told).alias("present"))
    if base is None:
        return new.withColumn("present", F.coalesce("present", F.lit(False)))
    old = base.select(F.col("fileid").alias("__f"), *[F.col(c).alias(f"__{c}") for c in ("last_seq", "last_event", "present")])
    j = old.join(new, F.col("__f") == F.col("fileid"), "full")
    return j.select(F.coalesce("fileid", "__f").alias("fileid"), F.coalesce("last_seq", "__last_seq").alias("last_seq"), F.coalesce("last_event", "__last_event").alias("last_event"), F.coalesce("present", "__present", F.lit(False)).alias("present"))


def checkpoint(state: DataFrame, folder: str, number: int) -> str:
    """Writes a state of the store as a checkpoint; returns its path."""
    where = f"{folder.rstrip('/')}/checkpoint-{number:012d}"
    state.write.mode("overwrite").parquet(where)
    return where


def prune(checkpoints: list[tuple[int, float]], now: float, keep_days: int = 35) -> list[int]:
    """Numbers of the checkpoints (number, time in seconds) that are older than ``keep_days``; the newest always stays."""
    newest = max((n for n, _ in checkpoints), default=None)
    return sorted(n for n, at in checkpoints if n != newest and at < now - keep_days * 86400)


def recover(spark, path: str, log: DataFrame) -> DataFrame:
    """The state of the store from a checkpoint and the events behind it; numbering goes on behind the greatest number of both."""
    return state_at(log, base=spark.read.parquet(path))


def block_window(blocks: DataFrame, fileid: str, first: int, end: int) -> DataFrame:
    """A file's blocks from place ``first`` up to but without ``end``, in order, with their text."""
    return blocks.filter((F.col("fileid") == fileid) & (F.col("n") >= first) & (F.col("n") < end)).orderBy("n", "block_id")


def table_graph(edges: DataFrame, fileid: str) -> DataFrame:
    """The tables and edges of one file: src, dst, kind."""
    return edges.filter(F.col("fileid") == fileid).select("src", "dst", "kind").distinct()


def file_heads(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each file with how many blocks, of how many kinds, it has, and its first and last line."""
    b = blocks.groupBy("fileid").agg(F.count_distinct("block_id").alias("n_blocks"), F.count_distinct("kind").alias("n_kinds"), F.min("l0").alias("first_line"), F.max("l1").alias("last_line"))
    return files.join(b, "fileid", "left").fillna(0, ["n_blocks", "n_kinds"])


def found(terms: DataFrame, files: DataFrame, q: str, n: int = 50) -> DataFrame:
    """At most ``n`` hits of a search: table names, then file ids, that hold ``q`` in any case, by name: kind, name."""
    like = lambda c: F.contains(F.lower(c), F.lit(q.strip().lower()))
    t = terms.filter(like("term")).select(F.lit("table").alias("kind"), F.col("term").alias("name")).distinct()
    f = files.filter(like("fileid")).select(F.lit("file").alias("kind"), F.col("fileid").alias("name")).distinct()
    return t.union(f).orderBy(F.col("kind").desc(), "name").limit(n)


def retained(log: DataFrame, days: int) -> DataFrame:
    """Events not older than ``days`` before the latest; numbering goes on from the greatest seq ever given."""
    newest = log.agg(F.max("ts")).scalar()
    return log.filter(F.col("ts") >= newest - F.expr(f"interval {days} days"))


def first_names(names: DataFrame, key: str, name: str, most: int = 2) -> DataFrame:
    """Per key its first few names, then how many more: key, names. names: distinct (key, name) rows.

    Minima and a count, so a key with a third of all names costs one row per task; each further name is one more such pass.
    """
    out, left, shown = names.groupBy(key).agg(F.count("*").alias("__n")), names, []
    for i in range(most):
        least = left.groupBy(key).agg(F.min(name).alias(f"__m{i}"))
        out = out.join(least, key, "left")
        shown.append(f"__m{i}")
        if i + 1 < most:
            left = left.join(least, key).filter(F.col(name) > F.col(f"__m{i}")).select(key, name)
    more = F.col("__n") - most
    return out.select(key, F.concat(F.concat_ws(", ", *shown), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise("")).alias("names"))


def newest_per(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The latest row of each key, ties by all columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in [*by, *[c for c in df.columns if c not in keys and c not in by]]])
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
