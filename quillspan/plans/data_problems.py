"""The queries of the general data problems (p1, p2, p3, p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.names import file_of, file_sql, name_of, name_sql
from quillspan.operators.changefeed import DELETE, PATCH, PUT, MergeStore, latest_copy
from quillspan.operators.hierarchy import below, hierarchy, intervals
from quillspan.operators.orphans import broken_references
from quillspan.operators.snapshots import snapshot_changes
from quillspan.session import table


def edits(spark: SparkSession, d: str) -> DataFrame:
    """human_edits with compared names, one row per edit_id (its latest delivery), and the edit's time ``at``."""
    raw = table(spark, d, "human_edits").select(
        "edit_id", "received_at", F.coalesce("edited_at", "received_at").alias("at"), name_of("action").alias("action"), name_of("src").alias("src"), name_of("dst").alias("dst"),
        name_of("level").alias("level"), name_of("block_id").alias("block_id"), F.coalesce(file_of("fileid"), F.when(name_of("block_id").isNotNull(), file_of("src"))).alias("fileid"), file_of("fileid").alias("own_fileid"), "requires_check")
    return latest_copy(raw, "edit_id", ["received_at"], ["at", "action", "src", "dst", "level", "block_id", "fileid", "own_fileid", "requires_check"])


def broken(spark: SparkSession, d: str) -> DataFrame:
    """Every broken reference: edit_id, ref_table, state, period, requires_check."""
    e = edits(spark, d)
    files = table(spark, d, "files").select(file_of("fileid").alias("fileid"), "analyzed_at")
    blocks = table(spark, d, "blocks").select(file_of("fileid").alias("fileid"), name_of("block_id").alias("block_id"), "parsed_at")
    removed = table(spark, d, "store_log").filter(name_of("event_type") == "file_removed").select(file_of("fileid").alias("gone")).filter("gone is not null").distinct()
    to_files = broken_references(e, files, ["fileid"], "simple", "at", "analyzed_at").join(removed, F.col("fileid") == F.col("gone"), "left")
    to_files = to_files.withColumn("state", F.when((F.col("state") == "missing") & F.col("gone").isNotNull(), "removed").otherwise(F.col("state"))).drop("gone")
    to_blocks = broken_references(e.filter("block_id is not null"), blocks, ["fileid", "block_id"], "strict", "at", "parsed_at")
    both = to_files.withColumn("ref_table", F.lit("files")).unionByName(to_blocks.withColumn("ref_table", F.lit("blocks")))
    return both.select("edit_id", "ref_table", "state", F.date_format("at", "yyyy-MM").alias("period"), "requires_check")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return broken(spark, d).select("edit_id", "ref_table", "state", "period")


def p1_partial(spark: SparkSession, d: str) -> DataFrame:
    """References of edits to blocks with partial match: what an edit says of (fileid, block_id) must occur together in some block."""
    e = edits(spark, d).withColumn("fileid", F.col("own_fileid"))
    blocks = table(spark, d, "blocks").select(file_of("fileid").alias("fileid"), name_of("block_id").alias("block_id"), "parsed_at")
    found = broken_references(e, blocks, ["fileid", "block_id"], "partial", "at", "parsed_at")
    return found.select("edit_id", "fileid", "block_id", "state")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Broken references per referenced table, state and month, with how many carry requires_check."""
    return broken(spark, d).groupBy("ref_table", "state", "period").agg(F.count("*").alias("n_refs"), F.count_if("requires_check").alias("n_requires_check"))


#: In how many deliveries of about equal size a feed that lies there as one table is appended; the result does not depend on it.
DELIVERIES = 5


def arrivals(feed: DataFrame, received: str, n: int) -> list[DataFrame]:
    """The rows of a feed as they came, cut into n deliveries by the time they were received; rows without one come first."""
    seconds = F.unix_micros(F.col(received).cast("timestamp"))
    cuts = feed.agg(F.percentile_approx(seconds, [i / n for i in range(1, n)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    edges = list(zip([None, *cuts], [*cuts, None]))
    at = lambda c: F.lit(c).cast("long")
    out = []
    for i, (lo, hi) in enumerate(edges):
        inside = (seconds > at(lo) if lo is not None else F.lit(True)) & (seconds <= at(hi) if hi is not None else F.lit(True))
        out.append(feed.filter(inside | seconds.isNull() if i == 0 else inside))
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The flows that stand at the end, from a merge store that takes the feed as it comes, repeated and amended deliveries included."""
    feed = table(spark, d, "human_edits").select("edit_id", "received_at", F.coalesce("edited_at", "received_at").alias("at"), name_of("action").alias("action"), name_of("src").alias("src"), name_of("dst").alias("dst"), name_of("level").alias("level"))
    feed = feed.withColumn("op", F.when(F.col("action") == "add", PUT).when(F.col("action") == "reject", DELETE).when(F.col("action") == "correct", PATCH))
    store = MergeStore(spark, ["src", "dst", "level"], ["at", "edit_id"], "op", ["edit_id"], change=["edit_id"], version=["received_at"])
    for delivery in arrivals(feed, "received_at", DELIVERIES):
        store.append(delivery)
    state = store.read()
    store.release()
    return state


LINEAGE_KEYS = ["fileid", "source_canonical_name", "target_canonical_name"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineage").select("snapshot_no", "delivered_at", F.coalesce(file_of("fileid"), F.lit("")).alias("fileid"), name_of("source_canonical_name").alias("source_canonical_name"),
                                             name_of("target_canonical_name").alias("target_canonical_name"), name_of("edge_type").alias("edge_type"))
    return snapshot_changes(rows, LINEAGE_KEYS, "snapshot_no", "delivered_at", ["edge_type"]).withColumn("fileid", F.expr("nullif(fileid, '')"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changes per snapshot and kind."""
    return p3_found(spark, d).groupBy("snapshot_no", "change_type").agg(F.count("*").alias("n"))


def links(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").select(name_of("level").alias("level"), name_of("src_table").alias("src"), name_of("dst_table").alias("dst"))
    return e.filter("level is not null")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(links(spark, d), "level", "dst", "src").select("level", F.col("node").alias("table_name"), F.col("root").alias("root_table"), "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each table's full path from its root."""
    t = hierarchy(links(spark, d), "level", "dst", "src", with_path=True)
    return t.select("level", F.col("node").alias("table_name"), F.col("root").alias("root_table"), "depth", F.concat_ws(" > ", "path").alias("path"))


def p5_below(spark: SparkSession, d: str) -> DataFrame:
    """All tables below each table."""
    return below(hierarchy(links(spark, d), "level", "dst", "src", with_path=True), "level")


def p5_intervals(spark: SparkSession, d: str) -> DataFrame:
    """How many tables lie below each table, from the places at which a walk around its tree enters and leaves it."""
    t = intervals(links(spark, d), "level", "dst", "src")
    return t.select("level", F.col("node").alias("table_name"), F.floor((F.col("leave") - F.col("enter") - 1) / 2).alias("n_below"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_partial": p1_partial, "p2_found": p2_found, "p3_found": p3_found, "p3_counts": p3_counts, "p5_found": p5_found, "p5_paths": p5_paths, "p5_below": p5_below, "p5_intervals": p5_intervals}

n, f = name_sql, file_sql
_EDITS = f"""e as (select edit_id, tm, action, src, dst, level, block_id, fileid, own_fileid, requires_check from (
  select edit_id, coalesce(edited_at, received_at) tm, {n('action')} action, {n('src')} src, {n('dst')} dst, {n('level')} level, {n('block_id')} block_id,
    coalesce({f('fileid')}, case when {n('block_id')} is not null then {f('src')} end) fileid, {f('fileid')} own_fileid, requires_check,
    row_number() over (partition by edit_id order by received_at desc nulls last) rn from human_edits) where rn = 1)"""
_BROKEN = f"""{_EDITS},
 fi as (select {f('fileid')} fileid, min(analyzed_at) t from files group by 1),
 bl as (select {f('fileid')} fileid, {n('block_id')} block_id, min(parsed_at) t from blocks group by 1, 2),
 rm as (select distinct {f('fileid')} fileid from store_log where {n('event_type')} = 'file_removed'),
 br as (select edit_id, 'files' ref_table, case when fi.fileid is null then case when e.fileid in (select fileid from rm where fileid is not null) then 'removed' else 'missing' end when fi.t > e.tm then 'late' end state, tm, requires_check
   from e left join fi on e.fileid = fi.fileid where e.fileid is not null
  union all select edit_id, 'blocks', case when bl.fileid is null then 'missing' when bl.t > e.tm then 'late' end, tm, requires_check
   from e left join bl on e.fileid = bl.fileid and e.block_id = bl.block_id where e.block_id is not null)"""
_P3 = f"""o as (select distinct snapshot_no, fileid, s, t, first_value(edge_type) over (partition by snapshot_no, fileid, s, t order by delivered_at desc nulls last) edge_type from (
   select snapshot_no, delivered_at, {f('fileid')} fileid, {n('source_canonical_name')} s, {n('target_canonical_name')} t, {n('edge_type')} edge_type from lineage) where s is not null and t is not null),
 ch as (select b.snapshot_no, b.fileid, b.s, b.t, case when a.s is null then 'added' when a.edge_type is distinct from b.edge_type then 'changed' end c
   from o b left join o a on a.snapshot_no = b.snapshot_no - 1 and a.fileid is not distinct from b.fileid and a.s = b.s and a.t = b.t where b.snapshot_no > (select min(snapshot_no) from lineage)
  union all select a.snapshot_no + 1, a.fileid, a.s, a.t, 'removed' from o a left join o b on a.snapshot_no = b.snapshot_no - 1 and a.fileid is not distinct from b.fileid and a.s = b.s and a.t = b.t
   where b.s is null and a.snapshot_no < (select max(snapshot_no) from lineage))"""
_TREE = f"""recursive l as (select distinct {n('level')} level, {n('src_table')} s, {n('dst_table')} d from edges where {n('level')} is not null),
 par as (select level, v, min(p) p from (select level, d v, s p from l union all select level, s, null from l) where v is not null group by 1, 2),
 w as (select level, v, v root, 0 depth, v path from par where p is null union all select c.level, c.v, w.root, w.depth + 1, w.path || ' > ' || c.v from w join par c on c.level = w.level and c.p = w.v),
 lost as (select level, v, p from par where (level, v) not in (select level, v from w)),
 ring as (select level, v, v start, p from lost union select r.level, r.v, r.start, c.p from ring r join lost c on c.level = r.level and c.v = r.p),
 onring as (select distinct level, start v from ring where p = start)"""

ORACLE = {
    "p1_found": f"with {_BROKEN} select edit_id, ref_table, state, strftime(tm, '%Y-%m') period from br where state is not null",
    "p1_partial": f"""with {_EDITS}, bl as (select {f('fileid')} fileid, {n('block_id')} block_id, parsed_at from blocks),
 c as (select edit_id, own_fileid fileid, block_id, tm from e where own_fileid is not null or block_id is not null),
 m as (select distinct c.*, (select min(coalesce(parsed_at, timestamp '9999-01-01')) from bl where c.fileid = bl.fileid and c.block_id = bl.block_id) t from c where fileid is not null and block_id is not null
  union all select distinct c.*, (select min(coalesce(parsed_at, timestamp '9999-01-01')) from bl where c.fileid = bl.fileid) t from c where block_id is null
  union all select distinct c.*, (select min(coalesce(parsed_at, timestamp '9999-01-01')) from bl where c.block_id = bl.block_id) t from c where fileid is null)
 select edit_id, fileid, block_id, case when t is null then 'missing' else 'late' end state from m where t is null or (t > tm and t < timestamp '9999-01-01')""",
    "p1_report": f"with {_BROKEN} select ref_table, state, strftime(tm, '%Y-%m') period, count(*) n_refs, count(*) filter (requires_check) n_requires_check from br where state is not null group by all",
    "p2_found": f"""with {_EDITS}, k as (select *, case action when 'add' then 1 when 'reject' then 1 when 'correct' then 2 end kind from e),
 a as (select src, dst, level, max(row(tm, edit_id)) s, arg_max(action, row(tm, edit_id)) act, arg_max(edit_id, row(tm, edit_id)) id from k where kind = 1 group by all),
 c as (select k.src, k.dst, k.level, arg_max(k.edit_id, row(k.tm, k.edit_id)) id from k join a on k.src is not distinct from a.src and k.dst is not distinct from a.dst and k.level is not distinct from a.level
   where kind = 2 and row(k.tm, k.edit_id) > a.s group by all)
 select a.src, a.dst, a.level, coalesce(c.id, a.id) edit_id from a left join c on c.src is not distinct from a.src and c.dst is not distinct from a.dst and c.level is not distinct from a.level where a.act = 'add'""",
    "p3_found": f"with {_P3} select snapshot_no, fileid, s source_canonical_name, t target_canonical_name, c change_type from ch where c is not null",
    "p3_counts": f"with {_P3} select snapshot_no, c change_type, count(*) n from ch where c is not null group by all",
    "p5_found": f"""with {_TREE} select level, v table_name, root root_table, depth::int depth from w union all
 select level, v, '', case when (level, v) in (select level, v from onring) then -1 else -2 end from lost""",
    "p5_paths": f"""with {_TREE} select level, v table_name, root root_table, depth::int depth, path from w union all
 select level, v, '', case when (level, v) in (select level, v from onring) then -1 else -2 end, '' from lost""",
    "p5_intervals": f"""with {_TREE}, b as (select level, p ancestor, v descendant from par where p is not null and (level, v) in (select level, v from w)
   union all select b.level, par.p, b.descendant from b join par on par.level = b.level and par.v = b.ancestor where par.p is not null)
 select w.level, w.v table_name, count(b.descendant) n_below from w left join b on b.level = w.level and b.ancestor = w.v group by all""",
    "p5_below": f"""with {_TREE}, b as (select level, p ancestor, v descendant, 1 distance from par where p is not null and (level, v) in (select level, v from w)
   union all select b.level, par.p, b.descendant, b.distance + 1 from b join par on par.level = b.level and par.v = b.ancestor where par.p is not null)
 select level, ancestor, descendant, distance::int distance from b""",
}
