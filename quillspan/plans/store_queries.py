"""Queries for verification, lineage, graph and store operators, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.lang.facts import facts
from quillspan.lang.parser import parse_expr
from quillspan.names import file_of, file_sql, name_of, name_sql
from quillspan.catalog import SEQ, visible
from quillspan.lang.workflows import transfer, workflow_tables
from quillspan.operators import graph, lineage, reports, store, verify
from quillspan.operators.bymerge import by_update
from quillspan.operators.ranking import global_rank, latest_before
from quillspan.session import Scratch, table
from quillspan.sources.readers import scan_term, synthetic_edges
from quillspan.sources.writers import numbered, upsert, with_overflow, write_partitioned

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


n, f = name_sql, file_sql

# ---- verification ----
_PERTURBED = "select o_orderkey, o_custkey, case when o_totalprice > 400000 then o_totalprice + 1 else o_totalprice end o_totalprice, o_orderstatus from orders where o_totalprice >= 2000"


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The orders, and a copy in which the dearest are changed and the cheapest are missing."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    price = F.col("o_totalprice")
    return o, o.filter(price >= 2000).withColumn("o_totalprice", F.when(price > 400000, price + 1).otherwise(price))


_NEQ = f"""a as (select o_orderkey, o_custkey, round(o_totalprice, 6) p, o_orderstatus, count(*) n from orders group by all),
 b as (select o_orderkey, o_custkey, round(o_totalprice, 6) p, o_orderstatus, count(*) n from ({_PERTURBED}) group by all),
 x as (select coalesce(a.o_orderkey, b.o_orderkey) k, coalesce(a.p, b.p) p, coalesce(a.n, 0) rn, coalesce(b.n, 0) cn from a full join b on a.o_orderkey = b.o_orderkey and a.o_custkey = b.o_custkey and a.p = b.p and a.o_orderstatus = b.o_orderstatus)"""


@query("select 'PASS' verdict, 0::bigint n_mismatch")
def ver_multiset_pass(spark, d):
    o, _ = _pair(spark, d)
    return verify.compare_rows(o, o.select(F.col("o_orderkey").cast("string"), "o_custkey", (F.col("o_totalprice") + 1e-9).alias("p"), F.concat(F.lit(" "), "o_orderstatus")))


@query(f"with {_NEQ} select 'FAIL' verdict, sum(abs(rn - cn))::bigint n_mismatch from x where rn <> cn")
def ver_multiset_fail(spark, d):
    return verify.compare_rows(*_pair(spark, d))


@query(f"with {_NEQ} select k::varchar c0, rn::bigint ref_count, cn::bigint conv_count from x where rn <> cn order by (rn < cn), c0, p::varchar limit 5")
def ver_samples(spark, d):
    return verify.samples(*_pair(spark, d)).select("c0", "ref_count", "conv_count")


@query("""with v(x) as (values ('30.376666666666665'), ('30.3766667'), ('5.0'), ('5'), (' 5 '), ('-0.0'), ('NaN'), ('nan'), ('Infinity'), ('-inf'), ('abc '), ('1e3'), ('0.1234567'), ('12345678901234567'), ('')),
 w(x, y) as (values ('30.376666666666665', '30.376667'), ('30.3766667', '30.376667'), ('5.0', '5'), ('5', '5'), (' 5 ', '5'), ('-0.0', '0'), ('NaN', 'nan'), ('nan', 'nan'), ('Infinity', 'inf'), ('-inf', '-inf'), ('abc ', 'abc'), ('1e3', '1000'), ('0.1234567', '0.123457'), ('12345678901234567', '12345678901234568'), ('', ''))
 select w.x raw, w.y as normal from v join w on v.x = w.x""")
def ver_normalise_value(spark, d):
    raw = ["30.376666666666665", "30.3766667", "5.0", "5", " 5 ", "-0.0", "NaN", "nan", "Infinity", "-inf", "abc ", "1e3", "0.1234567", "12345678901234567", ""]
    return spark.createDataFrame([(x,) for x in raw], "raw string").select("raw", verify.normal(F.col("raw")).alias("normal"))


@query("select c_nationkey grp, case min(case when c_acctbal < -990 then 0 when c_acctbal < -950 then 1 when c_acctbal < -900 then 2 else 3 end) when 0 then 'FAIL' when 1 then 'REF_MISSING' when 2 then 'CONV_MISSING' else 'PASS' end verdict from customer group by 1")
def ver_rollup(spark, d):
    v = F.when(F.col("c_acctbal") < -990, "FAIL").when(F.col("c_acctbal") < -950, "REF_MISSING").when(F.col("c_acctbal") < -900, "CONV_MISSING").otherwise("PASS")
    return verify.roll_up(table(spark, d, "customer").select(F.col("c_nationkey").alias("grp"), v.alias("verdict")), ["grp"])


@query("""with r as (select event_id, event_type, value, row_number() over (order by event_id) r, count(*) over () n from events),
 p as (select event_type, case when r > round_even(n / 4.0, 0) then 1 else 0 end + case when r > round_even(2 * n / 4.0, 0) then 1 else 0 end + case when r > round_even(3 * n / 4.0, 0) then 1 else 0 end part from r)
 select event_type, count(distinct part) n_parts, true sum_ok, true avg_ok, true max_ok, true min_ok from p group by 1""")
def ver_partition_test(spark, d):
    return verify.partition_test(table(spark, d, "events"), ["event_id"], "event_type", "value")


@query("""select * from (select 0 leg_no, 'value > 50' leg, count(*) filter (value > 50) n_true, count(*) filter (not coalesce(value > 50, false)) n_false from events
 union all select 1, 'event_type = ''click''', count(*) filter (value > 50 and event_type = 'click'), count(*) filter (value > 50 and event_type <> 'click') from events
 union all select 2, 'user_id < 5', count(*) filter (not (value > 50 and event_type = 'click') and user_id < 5), count(*) filter (not (value > 50 and event_type = 'click') and not user_id < 5) from events), lateral (select n_true > 0 and n_false > 0 covered)""")
def ver_leg_coverage(spark, d):
    return verify.leg_coverage(table(spark, d, "events"), parse_expr("value > 50 and event_type = 'click' or user_id < 5"))


@query("select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) place from orders")
def win_global_rank(spark, d):
    return global_rank(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


# ---- lineage over occurrences ----
_OCC = "occ as (select user_id fileid, event_id n, event_type tbl, case when event_id % 3 = 0 then 'write' else 'read' end role from events)"


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("fileid"), F.col("event_id").alias("n"), F.col("event_type").alias("tbl"), F.when(F.col("event_id") % 3 == 0, "write").otherwise("read").alias("role"))


@query(f"with {_OCC} select fileid, tbl, n reader, w writer from (select *, max(case when role = 'write' then n end) over (partition by fileid, tbl order by n rows between unbounded preceding and 1 preceding) w from occ) where role = 'read' and w is not null")
def lin_file_flow_asof(spark, d):
    return latest_before(occurrences(spark, d), ["fileid", "tbl"], "n", F.col("role") == "write", "writer").filter("role = 'read' and writer is not null").select("fileid", "tbl", F.col("n").alias("reader"), "writer")


_LATEST = f"x as (select distinct {f('fileid')} fileid, {n('block_id')} block_id, {n('source_canonical_name')} src, {n('target_canonical_name')} dst from lineage where snapshot_no = (select max(snapshot_no) from lineage))"


@query(f"with {_LATEST}, w as (select distinct fileid, dst tbl from x where dst is not null), r as (select distinct fileid, src tbl from x where src is not null) select w.fileid src_file, r.fileid dst_file, count(*) n_tables, string_agg(tbl, ',' order by tbl) as tables from w join r using (tbl) where w.fileid <> r.fileid group by 1, 2")
def lin_project_flow(spark, d):
    return lineage.project_flow(provided(spark, d))


@query(f"with {_LATEST}, b as (select *, try_cast(split_part(block_id, '_', 2) as int) no from x where block_id is not null), w as (select fileid, dst tbl, max(no) writer from b where dst is not null group by 1, 2), r as (select distinct fileid, src tbl, no from b where src is not null) select w.fileid src_file, writer, r.fileid dst_file, r.no reader, tbl from w join r using (tbl) where r.fileid <> w.fileid")
def lin_block_links(spark, d):
    return lineage.block_links(provided(spark, d))


@query(f"with {_OCC} select w.fileid, w.tbl, w.n writer, r.n reader from occ w join occ r on w.fileid = r.fileid and w.tbl = r.tbl and r.n > w.n where w.role = 'write' and r.role = 'read'")
def lin_range_flow(spark, d):
    return lineage.earlier_writers(occurrences(spark, d))


@query(f"with {_OCC} select fileid, n, 'b_' || dense_rank() over (partition by fileid order by n // 10) || ':t_' || row_number() over (partition by fileid, n // 10 order by role, n) occ_id from occ")
def lin_occurrence_ids(spark, d):
    """Occurrences numbered within their block, reads first (a block is ten events of a user)."""
    return lineage.occurrence_ids(occurrences(spark, d), 10)


@query(f"with b as (select distinct {f('fileid')} fileid, {n('block_id')} block_id, n, l0, l1 from blocks) select fileid, block_id, l0, coalesce(lead(l0) over (partition by fileid order by n, block_id, l0, l1) - 1, l1) line_end from b")
def lin_line_ranges(spark, d):
    return lineage.line_ranges(table(spark, d, "blocks").select(file_of("fileid").alias("fileid"), name_of("block_id").alias("block_id"), "n", "l0", "l1").distinct())


@query("with t as (select user_id, event_id, event_type, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by event_id) step from events) select user_id, step, min(event_id) first_id, max(event_id) last_id, count(*) n from t group by 1, 2")
def lin_step_islands(spark, d):
    """Steps as islands: an opener (here: signup) starts a step that lasts until the next."""
    return lineage.step_islands(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "signup")


@query(f"""with recursive b as (select fileid, n, l0, l1, row_number() over (partition by fileid order by n, l0, l1) i from (select distinct {f('fileid')} fileid, n, l0, l1 from blocks where l0 is not null and l1 is not null)),
 w as (select fileid, n, i, l0 a, l1 z, 0 run, l1 - l0 + 1 < 7 free from b where i = 1 union all
  select fileid, n, i, if(fits, a, l0), if(fits, greatest(z, l1), l1), if(fits, run, run + 1), if(fits, greatest(z, l1) - a, l1 - l0) + 1 < 7
  from (select b.*, w.a, w.z, w.run, w.free and greatest(w.z, b.l1) - w.a + 1 <= 15 fits from w join b on b.fileid is not distinct from w.fileid and b.i = w.i + 1))
 select fileid, n, run from w""")
def lin_block_law(spark, d):
    """Runs of 7 to 15 source lines per file, measured from the first to the last line with the gaps between."""
    return lineage.block_law(table(spark, d, "blocks").select(file_of("fileid").alias("fileid"), "n", "l0", "l1").distinct())


@query("with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*\\.[a-z_][a-z0-9_]*')) term from documents where text is not null) select doc_id, term, count(*) n from w group by 1, 2")
def lin_terms_mentions(spark, d):
    return lineage.qualified_terms(table(spark, d, "documents"), "doc_id", "text")


@query("""select block_key, md5(trim(regexp_replace(regexp_replace(regexp_replace(sas_text, '(^|;)(\\s*)\\*[^;]*;', '\\1\\2', 'g'), '(''[^'']*''|"[^"]*")|/\\*(?:[^*]|\\*+[^*/])*\\*+/', '\\1 ', 'g'), '\\s+', '', 'g'))) h, length(sas_text) n_chars from blocks where sas_text is not null""")
def lin_comment_strip(spark, d):
    """Programs without remarks; those in strings stay. Held against SQL without any blanks, as a remark leaves one there."""
    t = table(spark, d, "blocks").filter("sas_text is not null").select("block_key", "sas_text").distinct().withColumn("row", F.struct("block_key", "sas_text"))
    found = lineage.bare_programs(t.select("row", "sas_text").withColumn("row", F.to_json("row")), "row", "sas_text")
    rows = table(spark, d, "blocks").filter("sas_text is not null").select("block_key", "sas_text").withColumn("row", F.to_json(F.struct("block_key", "sas_text")))
    return rows.join(found, "row").select("block_key", F.md5(F.regexp_replace("bare", r"\s+", "")).alias("h"), F.length("sas_text").cast("long").alias("n_chars"))


@query("select block_key, substr(sha256(sas_code), 1, 16) file_hash, 'b_' || n || '_' || substr(sha1(sas_code), 1, 8) block_hash from blocks where sas_code is not null")
def lin_hashes(spark, d):
    return lineage.hashes(table(spark, d, "blocks").filter("sas_code is not null"), "block_key", "sas_code", "n")


@query(f"with e as (select {n('block_id')} b, {f('fileid')} fl, {n('source_canonical_name')} s, {n('target_canonical_name')} t from lineage where snapshot_no = (select max(snapshot_no) from lineage)), r as (select distinct fl, b, s from e where s is not null and b is not null), w as (select distinct fl, b, t from e where t is not null and b is not null) select r.fl fileid, r.b block_id, s src, t dst from r join w on r.fl = w.fl and r.b = w.b where s <> t")
def lin_block_flow(spark, d):
    """Tables read by a block times tables it writes."""
    return lineage.block_flow(provided(spark, d))


@query()
def lin_block_scan(spark, d):
    """Tables read and written by each step of each block's text."""
    found = lineage.scanned_blocks(table(spark, d, "blocks").select("block_key", F.coalesce("sas_text", "sas_code").alias("text")), "block_key", "text")
    return found.select("block_key", "kind", "status", "reads", "writes")


_PROGRAM = """data work.o; set tpch.orders; yr = year(o_orderdate); if o_totalprice > 10; keep o_custkey o_totalprice yr; run;
proc sql; create table work.s as select c.c_name, sum(o.o_totalprice) as total from work.o o join tpch.customer c on o.o_custkey = c.c_custkey where o.yr >= 1995 group by c.c_name; quit;"""


@query("""select * from (values ('col', 'work.o', 'o_custkey', 'tpch.orders', 'o_custkey'), ('col', 'work.o', 'o_totalprice', 'tpch.orders', 'o_totalprice'), ('col', 'work.o', 'yr', 'tpch.orders', 'o_orderdate'),
 ('col', 'work.s', 'c_name', 'tpch.customer', 'c_name'), ('col', 'work.s', 'total', 'work.o', 'o_totalprice'), ('ctl', 'work.o', '', 'tpch.orders', 'o_totalprice'), ('ctl', 'work.s', '', 'tpch.customer', 'c_custkey'), ('ctl', 'work.s', '', 'tpch.customer', 'c_name'),
 ('ctl', 'work.s', '', 'work.o', 'o_custkey'), ('ctl', 'work.s', '', 'work.o', 'yr'), ('ds', 'work.o', '', 'tpch.orders', ''), ('ds', 'work.s', '', 'tpch.customer', ''), ('ds', 'work.s', '', 'work.o', ''), ('schema', 'work.o', 'o_custkey', '', ''),
 ('schema', 'work.o', 'o_totalprice', '', ''), ('schema', 'work.o', 'yr', '', ''), ('schema', 'work.s', 'c_name', '', ''), ('schema', 'work.s', 'total', '', '')) t(kind, target, target_column, source, source_column)""")
def lin_column_facts(spark, d):
    known = {f"tpch.{t}": table(spark, d, t).columns for t in ("orders", "customer")}
    return spark.createDataFrame(facts(_PROGRAM, known), "kind string, target string, target_column string, source string, source_column string")


# ---- graph ----
#: Nodes are tables within a level, as each level has its own principal sources.
_E = f"(select distinct {n('level')} || '/' || {n('src_table')} src, {n('level')} || '/' || {n('dst_table')} dst from edges where {n('level')} is not null and {n('src_table')} is not null and {n('dst_table')} is not null)"
_SEEDS = f"(select distinct src node from {_E} where split_part(src, '/', 2) < 'fin')"


def level_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of all levels between tables named by their level."""
    at = lambda c: F.concat(name_of("level"), F.lit("/"), name_of(c))
    return table(spark, d, "edges").select(at("src_table").alias("src"), at("dst_table").alias("dst")).dropna().distinct()


def seeds(e: DataFrame) -> DataFrame:
    return e.filter(F.split_part("src", F.lit("/"), F.lit(2)) < "fin").select(F.col("src").alias("node")).distinct()


def _hop_sql(a: str, b: str, hops: int) -> str:
    return f"with recursive e as {_E}, r as (select node, 0 hop from {_SEEDS} union select e.{b}, r.hop + 1 from r join e on e.{a} = r.node where r.hop < {hops}) select node, min(hop)::int hop from r group by 1"


@query(_hop_sql("src", "dst", 3))
def grf_k_hop_down(spark, d):
    e = level_edges(spark, d)
    return graph.reach(e, seeds(e), 3, "down")


@query(_hop_sql("dst", "src", 2))
def grf_k_hop_up(spark, d):
    e = level_edges(spark, d)
    return graph.reach(e, seeds(e), 2, "up")


@query(f"""with recursive e as {_E}, d as (select node, 0 hop from {_SEEDS} union select e.dst, d.hop + 1 from d join e on e.src = d.node where d.hop < 1), u as (select node, 0 hop from {_SEEDS} union select e.src, u.hop + 1 from u join e on e.dst = u.node where u.hop < 1),
 x as (select node, 1 u, 0 d, (hop = 0)::int s from u union all select node, 0, 1, (hop = 0)::int from d) select node, case when max(s) = 1 then 'seed' when max(u) = 1 and max(d) = 1 then 'both' when max(u) = 1 then 'up' else 'down' end as role from x group by 1""")
def grf_roles(spark, d):
    e = level_edges(spark, d)
    return graph.roles(e, seeds(e), 1, 1)


@query(f"""with recursive e as {_E}, d as (select node, 0 hop from {_SEEDS} union select e.dst, d.hop + 1 from d join e on e.src = d.node where d.hop < 2), u as (select node, 0 hop from {_SEEDS} union select e.src, u.hop + 1 from u join e on e.dst = u.node where u.hop < 2),
 x as (select node, 1 u, 0 d, (hop = 0)::int s from u union all select node, 0, 1, (hop = 0)::int from d) select node, case when max(s) = 1 then 'seed' when max(u) = 1 and max(d) = 1 then 'both' when max(u) = 1 then 'up' else 'down' end as role from x group by 1 order by max(s) desc, node limit 200""")
def grf_neighbourhood(spark, d):
    """The neighbourhood two steps up and down, seeds first; at most 200 nodes are shown."""
    e = level_edges(spark, d)
    return graph.roles(e, seeds(e), 2, 2).orderBy((F.col("role") == "seed").desc(), "node").limit(200)


@query(f"with recursive e as {_E}, c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src) select src, dst from c")
def grf_transitive_closure(spark, d):
    return graph.closure(level_edges(spark, d)).select("src", "dst")


_SCC = f"e as {_E}, c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src), nodes as (select src node from e union select dst from e), comp as (select node, least(node, coalesce((select min(x.dst) from c x join c y on x.dst = y.src and y.dst = x.src where x.src = node), node)) component from nodes)"


@query(f"with recursive {_SCC} select node, component from comp")
def grf_components(spark, d):
    return graph.components(level_edges(spark, d))


@query(f"""with recursive {_SCC}, k as (select distinct a.component x, b.component y from e join comp a on a.node = e.src join comp b on b.node = e.dst where a.component <> b.component),
 l as (select component c, 0 level from comp union select k.y, l.level + 1 from l join k on k.x = l.c), m as (select c, max(level)::int level from l group by 1)
 select node, component, node in (select src from c where src = dst) in_loop, level from comp join m on m.c = comp.component""")
def grf_run_order(spark, d):
    return graph.run_order(level_edges(spark, d))


@query(f"""with e as {_E}, p as (select src, dst, src || '>' || dst table_name, case when length(src) % 2 = 0 then 'fact' else 'inferred' end provenance from e)
 select split_part(src, '.', 1) src, split_part(dst, '.', 1) dst, count(distinct table_name) n_tables, max(case when provenance = 'fact' then 1 else 0 end) is_fact from p where split_part(src, '.', 1) <> split_part(dst, '.', 1) group by 1, 2""")
def grf_collapse(spark, d):
    e = level_edges(spark, d).withColumn("table_name", F.concat("src", F.lit(">"), "dst")).withColumn("provenance", F.when(F.length("src") % 2 == 0, "fact").otherwise("inferred"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("container", F.substring_index("node", ".", 1))
    return graph.collapse(e, nodes)


# ---- store ----
def _provided(back: int = 0) -> str:
    """The lineage as of the latest snapshot, or so many snapshots before it."""
    no = f"(select s from (select distinct snapshot_no s from lineage where snapshot_no is not null) order by s desc limit 1 offset {back})"
    return f"""(select distinct {f('fileid')} fileid, {n('block_id')} block_id, {n('source_canonical_name')} src, {n('target_canonical_name')} dst, {n('source_canonical_name')} table_name, case when {n('edge_type')} = 'block_flow' then 'block' else 'file' end as level,
 case when {n('edge_type')} = 'block_flow' then 'fact' else 'inferred' end provenance, coalesce({n('freshness')}, 'green') freshness from lineage where snapshot_no = {no})"""


def provided(spark: SparkSession, d: str, back: int = 0) -> DataFrame:
    """The lineage as of the latest snapshot, or so many snapshots before it."""
    rows = table(spark, d, "lineage")
    numbers = rows.agg(F.sort_array(F.collect_set("snapshot_no"), asc=False)).scalar()  # one number per snapshot
    return store.provided_edges(rows.filter(F.col("snapshot_no") == F.get(numbers, F.lit(back)))).distinct()


def full_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edits by latest delivery, as edits() has them, with the table they pass through and the dismissed flag."""
    raw = table(spark, d, "human_edits")
    keep = ["edited_at", "action", "src", "dst", "table_name", "level", "block_id", "fileid", "requires_check", "dismissed"]
    one = raw.groupBy("edit_id").agg(F.max(F.struct("received_at", *keep)).alias("r")).select("edit_id", *[F.col(f"r.{c}").alias(c) for c in keep])
    names = {c: name_of(c) for c in ("action", "src", "dst", "table_name", "level", "block_id")}
    return one.withColumns(names | {"fileid": file_of("fileid")})


_EDITS = f"""ed as (select edit_id, edited_at, {n('action')} as action, {n('src')} src, {n('dst')} dst, {n('table_name')} table_name, {n('level')} as level, {n('block_id')} block_id, {f('fileid')} fileid, coalesce(requires_check, false) rc, coalesce(dismissed, false) dm
 from (select *, row_number() over (partition by edit_id order by received_at desc nulls last, edited_at desc nulls last) rn from human_edits) where rn = 1)"""


@query(f"""with {_EDITS}, e as {_provided()}, live as (select * from ed where not rc),
 said as (select block_id, fileid, max((action = 'reject')::int) no, max((action = 'confirm')::int) yes from live where block_id is not null and action in ('reject', 'confirm') group by 1, 2),
 heard as (select e.*, coalesce(max(no), 0) no, coalesce(max(yes), 0) yes from e left join said s on s.block_id = e.block_id and (s.fileid = e.fileid or s.fileid is null) group by all)
 select fileid, block_id, src, dst, table_name, level, if(yes = 1, 'human_gold', provenance) provenance, freshness from heard where no = 0
 union all select coalesce(fileid, src), block_id, src, dst, table_name, level, 'human_gold', 'green' from live where action in ('add', 'correct')""")
def grf_merged_edges(spark, d):
    return store.merged_edges(provided(spark, d), full_edits(spark, d))


@query(f"""with {_EDITS}, e as {_provided()} select edit_id, case when exists (select 1 from e where e.fileid = ed.fileid and e.block_id = ed.block_id) then 'green' when exists (select 1 from e where e.fileid = ed.fileid and e.src = ed.src and e.dst = ed.dst) then 'yellow' else 'red' end colour from ed where block_id is not null""")
def grf_stale_colour(spark, d):
    return store.stale_colour(full_edits(spark, d), provided(spark, d))


@query(f"""with a as {_provided(1)}, b as {_provided()} select b.*, case when b.fileid not in (select fileid from a where fileid is not null) or exists (select 1 from a where a.fileid = b.fileid and a.block_id is not distinct from b.block_id) then 'green'
  when exists (select 1 from a where a.fileid = b.fileid and a.src = b.src and a.dst = b.dst and a.level = b.level) then 'yellow' else 'red' end colour from b where fileid is not null""")
def grf_freshness(spark, d):
    return store.freshness(provided(spark, d).filter("fileid is not null"), provided(spark, d, 1))


@query(f"with a as {_provided(1)}, b as {_provided()} select fileid, src, dst, level, max(block_id) block_id from a where fileid in (select fileid from b) and src is not null and dst is not null and (fileid, src, dst, level) not in (select fileid, src, dst, level from b where src is not null and dst is not null and fileid is not null) group by all")
def grf_ghosts(spark, d):
    named = "fileid is not null and src is not null and dst is not null"
    return store.lost_flows(provided(spark, d).filter(named), provided(spark, d, 1).filter(named))


@query(f"""with a as (select distinct fileid, src, dst, level from {_provided(3)} where src is not null and dst is not null), b as (select distinct fileid, src, dst, level from {_provided(2)} where src is not null and dst is not null)
 select *, 'added' as change from (select * from b except select * from a) union all select *, 'removed' from (select * from a except select * from b)""")
def grf_save_delta(spark, d):
    named = "fileid is not null and src is not null and dst is not null"
    return store.save_delta(provided(spark, d, 2).filter(named), provided(spark, d, 3).filter(named))


@query(f"with {_EDITS} select edit_id, action, src, dst, level from ed where rc and not dm")
def grf_pending(spark, d):
    e = full_edits(spark, d)
    return e.filter(F.coalesce("requires_check", F.lit(False)) & ~F.coalesce("dismissed", F.lit(False))).orderBy("edited_at", "edit_id").select("edit_id", "action", "src", "dst", "level")


@query(f"with e as {_provided()}, rd as (select src t, count(distinct fileid) c from e group by 1), wr as (select dst t, count(distinct fileid) c from e group by 1), al as (select t, count(distinct fileid) c from (select src t, fileid from e union select dst, fileid from e) group by 1) select t table_name, coalesce(rd.c, 0) n_reading, coalesce(wr.c, 0) n_writing, al.c n_files from al left join rd using (t) left join wr using (t) where t is not null")
def grf_pivot_by_table(spark, d):
    return store.pivot_by_table(provided(spark, d))


def _by_file(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "files").select(file_of("fileid").alias("fileid")).distinct(), table(spark, d, "blocks").select(file_of("fileid").alias("fileid"), name_of("block_id").alias("block_id")).distinct(), provided(spark, d)


_BYFILE = f"fi as (select distinct {f('fileid')} fileid from files), b as (select distinct {f('fileid')} fileid, {n('block_id')} block_id from blocks), e as {_provided()}"


@query(f"with {_BYFILE} select fi.fileid, count(distinct b.block_id) n_blocks, count(e.fileid) n_edges from fi left join b using (fileid) left join e on e.fileid = fi.fileid group by 1")
def grf_pivot_by_file_literal(spark, d):
    return store.pivot_by_file(*_by_file(spark, d), literal=True)


@query(f"with {_BYFILE} select fileid, coalesce(nb, 0) n_blocks, coalesce(ne, 0) n_edges from fi left join (select fileid, count(*) nb from b group by 1) x using (fileid) left join (select fileid, count(*) ne from e group by 1) y using (fileid)")
def grf_pivot_by_file(spark, d):
    return store.pivot_by_file(*_by_file(spark, d))


@query(f"""with t as (select 'table' kind, {n('term')} v, count(distinct {f('fileid')}) n_files from mentions where contains({n('term')}, 'client') group by 2), s as (select 'file' kind, sasfilename v, count(distinct {f('fileid')}) n_files from files where contains(lower(sasfilename), 'client') group by 2)
 select kind, v as value, n_files from (select * from t union all select * from s) order by (kind = 'table' and length(split_part(v, '.', 1)) = 1)::int, case when lower(v) = 'client' then 0 when lower(v) like 'client%' then 1 else 2 end, n_files desc, kind, lower(v), v limit 20""")
def grf_search_top20(spark, d):
    m = table(spark, d, "mentions").select(name_of("term").alias("term"), file_of("fileid").alias("fileid"))
    return store.search(m, table(spark, d, "files").select("sasfilename", file_of("fileid").alias("fileid")), "client")


@query(f"select * from {_provided()} where (contains(src, 'dwh') or contains(dst, 'dwh')) and level = 'block' order by src nulls first, dst nulls first, table_name nulls first, fileid nulls first, block_id nulls first, level, provenance, freshness limit 50 offset 10")
def grf_paged_edges(spark, d):
    return store.paged(provided(spark, d), "dwh", "block", 10, 50)


_SOURCE_WORDS = f"w as (select distinct {n('source')} s, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) x from documents where {n('source')} is not null), g as (select s, count(*) c from w group by 1)"


@query(f"with {_SOURCE_WORDS}, o as (select a.s a, b.s b, count(*) k from w a join w b on a.x = b.x and a.s < b.s group by 1, 2) select a, b, round(k / (p.c + q.c - k), 6) jaccard from o join g p on p.s = a join g q on q.s = b")
def grf_similar_sources(spark, d):
    """Jaccard of the word sets of all documents of a source; a word is in at most as many sets as there are sources."""
    w = table(spark, d, "documents").select(name_of("source").alias("s"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("x")).filter("s is not null").distinct()
    return lineage.jaccard(w, "s", "x")


_TERM_FILES = f"m as (select distinct {n('term')} term, {f('fileid')} x from mentions where {n('term')} is not null and {f('fileid')} is not null), g as (select term, count(*) c from m group by 1)"


@query(f"with {_TERM_FILES}, o as (select a.term sub, b.term sup, count(*) k from m a join m b on a.x = b.x and a.term <> b.term group by 1, 2) select sub, sup from o join g on g.term = sub where k = c")
def grf_subset_terms(spark, d):
    """Terms whose files all mention another term too; the join is by file, so it grows with the files."""
    m = table(spark, d, "mentions").select(name_of("term").alias("term"), file_of("fileid").alias("x")).dropna().distinct()
    return lineage.subsets(m, "term", "x")


@query(f"select distinct {n('term')} term, levenshtein({n('term')}, 'dwh.calender_dim') dist from mentions where levenshtein({n('term')}, 'dwh.calender_dim') <= 8")
def grf_suggest_terms(spark, d):
    """Distinct terms near a misspelt one."""
    return lineage.suggestions(table(spark, d, "mentions").select(name_of("term").alias("term")), "term", "dwh.calender_dim", 8)


@query(f"select fileid, case when ok = n then 'converted' when ok > 0 then 'partial' else 'not converted' end status, n n_blocks, ok n_parsed from (select {f('fileid')} fileid, count(*) n, count(*) filter ({n('status')} = 'parsed') ok from (select distinct fileid, block_key, status from blocks) group by 1)")
def grf_conversion_coverage(spark, d):
    b = table(spark, d, "blocks").select("fileid", "block_key", "status").distinct().select(file_of("fileid").alias("fileid"), name_of("status").alias("status"))
    return lineage.conversion_coverage(b)


@query(f"with t as (select distinct {f('fileid')} fileid, {n('term')} term from mentions where {n('term')} is not null and {f('fileid')} is not null), a as (select fileid, list(term order by term) l from t group by 1) select fileid, array_to_string(l[1:2], ', ') || case when len(l) > 2 then ' +' || (len(l) - 2) else '' end as label from a")
def grf_labels(spark, d):
    m = table(spark, d, "mentions").select(file_of("fileid").alias("fileid"), name_of("term").alias("term")).dropna().distinct()
    return store.first_names(m, "fileid", "term").withColumnRenamed("names", "label")


@query(f"select * exclude (rn) from (select block_key, {n('kind')} kind, parsed_at, row_number() over (partition by block_key order by parsed_at desc nulls last, {n('kind')} desc nulls last) rn from blocks) where rn = 1")
def win_latest_per_key(spark, d):
    return store.newest_per(table(spark, d, "blocks").select("block_key", name_of("kind").alias("kind"), "parsed_at"), ["block_key"], ["parsed_at"])


# ---- event log, sources and sinks ----
@query(f"""with e as (select {f('fileid')} fileid, seq, {n('event_type')} t from store_log where {f('fileid')} is not null) select fileid, arg_max(t, seq) last_event, max(seq) last_seq, count(distinct seq) n_events,
 coalesce(arg_max(t = 'file_ingested', case when t in ('file_ingested', 'file_removed') then seq end), false) present from e group by 1""")
def evt_replay_latest_state(spark, d):
    return store.latest_state(table(spark, d, "store_log"))


@query("select seq, ts from store_log where ts >= (select max(ts) from store_log) - interval 31 days")
def evt_retention(spark, d):
    return store.retained(table(spark, d, "store_log"), 31).select("seq", "ts")


@query("select event_id, (select max(seq) from store_log) + row_number() over (order by event_id) seq from events")
def evt_append(spark, d):
    return numbered(table(spark, d, "store_log"), table(spark, d, "events").select("event_id"), ["event_id"])


@query("select p_brand, p_partkey, p_size from part where p_brand not in (select p_brand from part where p_size = 7) union all select p_brand, min(p_partkey), -7 from part where p_size = 7 group by 1")
def snk_upsert(spark, d):
    """All rows of a brand that has a part of size 7 are replaced by one."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_size")
    new = p.filter("p_size = 7").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"), F.lit(-7).alias("p_size"))
    return upsert(p, new, "p_brand")


@query(f"select {f('folder_path')} folder, count(*) n from files group by 1")
def snk_partitioned_parquet(spark, d):
    """Files written by folder and read back with their partitions."""
    where = Scratch(spark, "partitioned").path("files")
    write_partitioned(table(spark, d, "files").withColumn("folder_path", file_of("folder_path")), where)
    return spark.read.parquet(where).groupBy(F.col("folder_path").cast("string").alias("folder")).agg(F.count("*").alias("n"))


@query("(select c_name, c_custkey from customer order by c_custkey limit 100) union all select 'more rows were left out', null")
def snk_sheet_overflow(spark, d):
    return with_overflow(table(spark, d, "customer").select("c_name", "c_custkey"), ["c_custkey"], 100)


@query("select doc_id from documents where contains(lower(text), 'dwh.calendar_dim')")
def src_scan_term(spark, d):
    return scan_term(table(spark, d, "documents"), "text", "DWH.calendar_dim").select("doc_id")


@query("select 'BLOCK_FLOW' edge_type, 24000::bigint n union all select 'FILE_FLOW', 6000")
def src_synthetic_edges(spark, d):
    return synthetic_edges(spark, 300, 100).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("select 'BLOCK_FLOW' edge_type, 2400000::bigint n union all select 'FILE_FLOW', 600000")
def src_synthetic_edges_scale(spark, d):
    """At the size of the reference's load test: 30,000 files of 100 edges."""
    return synthetic_edges(spark, 30_000, 100).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("""select c_custkey, coalesce(o.p, c_acctbal) bal from customer left join (select o_custkey, arg_max(o_totalprice, o_orderkey) p from orders where o_totalprice > 300000 group by 1) o on o_custkey = c_custkey""")
def jon_update_step(spark, d):
    """UPDATE: master rows with the value of their last transaction where they have one."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"), F.struct("c_custkey").alias(SEQ))
    t = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("bal"), F.struct("o_orderkey").alias(SEQ))
    return visible(by_update(c, t, ["c_custkey"]))


@query(f"select a.src, a.dst from (select src, dst from {_provided()} where src is not null and dst is not null) a except select src, dst from {_provided(4)}")
def set_lineage_except(spark, d):
    named = "src is not null and dst is not null"
    return provided(spark, d).filter(named).select("src", "dst").subtract(provided(spark, d, 4).filter(named).select("src", "dst"))


_AT = f"ea as (select edit_id, coalesce(edited_at, received_at) tm, {n('action')} as action, {n('src')} src, {n('dst')} dst, {n('table_name')} table_name, {n('level')} as level, coalesce(requires_check, false) rc from (select *, row_number() over (partition by edit_id order by received_at desc nulls last) rn from human_edits) where rn = 1)"


@query(f"""with {_AT}, w as (select *, min(case when action = 'confirm' then row(tm, edit_id) end) over l c, min(case when action = 'reject' then row(tm, edit_id) end) over l r from ea
 window l as (partition by src, dst, table_name, level order by tm nulls first, edit_id rows between 1 following and unbounded following)) select edit_id, rc and c is not null cleared, rc and r is not null and (c is null or r < c) out_of_queue from w""")
def grf_edit_lifecycle(spark, d):
    raw = table(spark, d, "human_edits")
    keep = ["edited_at", "action", "src", "dst", "table_name", "level", "requires_check", "received_at"]
    one = raw.groupBy("edit_id").agg(F.max(F.struct(F.col("received_at").alias("got"), *keep)).alias("r")).select("edit_id", *[F.col(f"r.{c}").alias(c) for c in keep])
    e = one.withColumns({c: name_of(c) for c in ("action", "src", "dst", "table_name", "level")}).withColumn("at", F.coalesce("edited_at", "received_at"))
    return reports.edit_lifecycle(e, ["src", "dst", "table_name", "level"]).select("edit_id", "cleared", "out_of_queue")


@query(f"""with recursive e as {_E}, i as (select dst node, count(distinct src) c, list(distinct src order by src) l from e where src <> dst group by 1), o as (select src node, count(distinct dst) c, list(distinct dst order by dst) l from e where src <> dst group by 1),
 dn as (select s.node, e.dst x from {_SEEDS} s join e on e.src = s.node union select dn.node, e.dst from dn join e on e.src = dn.x), k as (select node, count(*) filter (x <> node) n from dn group by 1)
 select s.node, s.node || ': ' || case when i.c > 0 then 'fed by ' || i.c || ' (' || array_to_string(i.l[1:2], ', ') || ')' else 'fed by none' end || '; ' || case when o.c > 0 then 'feeds ' || o.c || ' (' || array_to_string(o.l[1:2], ', ') || ')' else 'feeds none' end
  || '; if it changes, ' || coalesce(k.n, 0) || ' downstream are affected.' sentence from {_SEEDS} s left join i using (node) left join o using (node) left join k using (node)""")
def grf_story(spark, d):
    e = level_edges(spark, d)
    return reports.story(e, seeds(e))


@query(f"""select distinct fileid, block_id, src, dst, case when contains(src, '.') then split_part(src, '.', 1) else 'work' end src_schema, split_part(src, '.', -1) src_name, case when contains(dst, '.') then split_part(dst, '.', 1) else 'work' end dst_schema, split_part(dst, '.', -1) dst_name, level,
 case split_part(src, '.', 1) when 'dwh' then '/data/dwh' when 'ref' then '/data/ref' else '' end src_lib_path, case split_part(dst, '.', 1) when 'dwh' then '/data/dwh' when 'ref' then '/data/ref' else '' end dst_lib_path,
 case split_part(src, '.', 1) when 'stg' then 'staging' else '' end new_src_schema, case split_part(dst, '.', 1) when 'stg' then 'staging' else '' end new_dst_schema from {_provided()} where src is not null and dst is not null""")
def lin_export_rows(spark, d):
    named = provided(spark, d).filter("src is not null and dst is not null")
    return reports.export_rows(named, {"dwh": "/data/dwh", "ref": "/data/ref"}, {"stg": "staging"}).distinct()


@query(f"with b as (select distinct block_key, n, {n('name')} nm, coalesce(sas_code, sas_text) sas_code from blocks), o as (select distinct split_part(nm, '.', 2) nm from b where nm is not null), w as (select block_key, n, unnest(list_distinct(regexp_extract_all(lower(sas_code), '[a-z0-9_]+'))) word from b) select o.nm as name, arg_max(block_key, row(n, block_key)) block from o join w on w.word = o.nm group by 1")
def win_attribute_outputs(spark, d):
    """The block that mentions each written table last."""
    b = table(spark, d, "blocks").select(F.col("block_key").alias("block"), F.col("n").alias("seq"), F.coalesce("sas_code", "sas_text").alias("term"), name_of("name").alias("nm")).distinct()
    return reports.attribute_outputs(b, b.filter("nm is not null").select(F.split_part("nm", F.lit("."), F.lit(2)).alias("name")))


@query("select custkey, case when not hp then 'no program' when not hi then 'no inputs' when not ht then 'no table' when n is null then 'missing' when m > 0 then 'differs' when n = 0 or w then 'match-warn' else 'match' end verdict from (select c_custkey custkey, c_acctbal > -900 hp, c_acctbal > -700 hi, c_nationkey <> 3 ht, case when c_nationkey <> 4 then c_nationkey end n, case when c_acctbal > 9000 then 1 else 0 end m, c_mktsegment = 'BUILDING' w from customer)")
def ver_block_verdict(spark, d):
    bal, nat = F.col("c_acctbal"), F.col("c_nationkey")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), reports.block_verdict(bal > -900, bal > -700, nat != 3, F.when(nat != 4, nat), F.when(bal > 9000, 1).otherwise(0), F.col("c_mktsegment") == "BUILDING").alias("verdict"))


@query(f"select (select count(distinct {f('fileid')}) from files) n_files, (select count(distinct block_key) from blocks) n_blocks, (select count(*) from {_provided()}) n_edges, (select count(distinct {n('term')}) from mentions where {n('term')} is not null) n_tables")
def grf_counts(spark, d):
    one = lambda t, c, name: table(spark, d, t).agg(F.count_distinct(c).alias(name)).scalar().alias(name)
    return spark.range(1).select(one("files", file_of("fileid"), "n_files"), one("blocks", F.col("block_key"), "n_blocks"), provided(spark, d).agg(F.count("*")).scalar().alias("n_edges"), one("mentions", name_of("term"), "n_tables"))


_WORKFLOW = """<workflow-app xmlns="uri:oozie:workflow:0.5" name="nightly"><start to="split"/><fork name="split"><path start="load"/><path start="clean"/></fork>
<action name="load"><sqoop/><ok to="meet"/><error to="dead"/></action><action name="clean"><pig/><ok to="meet"/><error to="dead"/></action><join name="meet" to="report"/>
<action name="report"><hive/><ok to="done"/><error to="dead"/></action><kill name="dead"/><end name="done"/></workflow-app>"""


@query("select * from (values ('start', 'start', 0), ('split', 'fork', 1), ('load', 'action', 2), ('clean', 'action', 2), ('meet', 'join', 3), ('report', 'action', 4), ('done', 'end', 5)) t(node, kind, level)")
def wfl_run_order(spark, d):
    """A workflow's nodes with their place in the order of runs; error edges play no part."""
    nodes, edges = workflow_tables(spark, _WORKFLOW)
    return nodes.join(graph.run_order(edges.filter("kind != 'error'")), "node").select("node", "kind", "level")


@query("select 'import' tool, 'jdbc:db2://h/x' connect, 'orders' source, 'a > 1' cond, '/in/orders' target, 'id' split_by, 8 mappers")
def wfl_transfer_descriptor(spark, d):
    t = transfer("sqoop import --connect jdbc:db2://h/x --table orders --where 'a > 1' --target-dir /in/orders --split-by id -m 8 --verbose")
    return spark.createDataFrame([(t["tool"], t["connect"], t["source"], t["where"], t["target"], t["split_by"], t["mappers"])], "tool string, connect string, source string, cond string, target string, split_by string, mappers int")
