"""Queries for sources, sinks, macros, program scanning, dialect programs over files, verdicts and recovery, with their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.catalog import SEQ, Catalog
from quillspan.lang.macros import expand, include, macros, step_blocks
from quillspan.lang.parser import parse_expr
from quillspan.lang.planlineage import lineage as plan_lineage
from quillspan.lang.scan import attach_remarks
from quillspan.names import file_of, file_sql, name_of, name_sql
from quillspan.operators import graph, lineage, reports, store, verify
from quillspan.operators.ranking import global_rank
from quillspan.operators.registry import MacroRegistry
from quillspan.plans.dialect_queries import catalog
from quillspan.plans.programs import Pig, run_hive, run_sas
from quillspan.plans.store_queries import _E, _EDITS, _provided, full_edits, level_edges, provided
from quillspan.session import Scratch, table
from quillspan.sources import readers, writers
from quillspan.streaming.eventlog import file_store, follow, per_window

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
n, f = name_sql, file_sql


def query(sql: str | None = None):
    def put(q):
        QUERIES[q.__name__] = q
        if sql:
            ORACLE[q.__name__] = sql
        return q

    return put


def placed(df: DataFrame, *cols: str) -> DataFrame:
    """A program's table with the place of each row in its order, from 1."""
    ranked = global_rank(df.withColumn("__key", F.col(SEQ)), ["__key"], "place")
    return ranked.select(F.col("place").cast("long").alias("place"), *cols)


# ---- dialect programs ----
@query("""with big as (select o_custkey, o_totalprice from orders where o_totalprice > 200000) select c_custkey, c_name from customer c
 where exists (select 1 from big b where b.o_custkey = c.c_custkey) and not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F' and o.o_totalprice < 20000) and exists (select 1 from nation)""")
def hive_with_exists(spark, d):
    return run_hive(catalog(spark, d), """with big as (select o_custkey, o_totalprice from orders where o_totalprice > 200000) select c.c_custkey as c_custkey, c.c_name as c_name from customer c
 where exists (select b.o_totalprice as p from big b where b.o_custkey = c.c_custkey)
  and not exists (select o.o_orderkey as k from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F' and o.o_totalprice < 20000) and exists (select n_name from nation)""")


@query("select c_custkey, c_name, c_acctbal from customer where c_acctbal > 100")
def hive_external_table(spark, d):
    """A delimited file with a header, declared as an external table."""
    where = Scratch(spark, "external").path("customer")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(where, sep="|", header=True)
    cat = Catalog(spark, default="", folder=where.rpartition("/")[0])
    return run_hive(cat, f"""create external table c (c_custkey bigint, c_name string, c_acctbal double) row format delimited fields terminated by '|' location '{where.rpartition("/")[2]}' tblproperties ('skip.header.line.count' = '1');
 select * from c where c_acctbal > 100""")


@query("select o_orderkey k, o_orderstatus v from orders where o_totalprice > 100000 union all select c_custkey, c_mktsegment from customer")
def hive_stored_tables(spark, d):
    """CTAS and INSERT with a warehouse: the rows are written there and read from there."""
    cat = catalog(spark, d)
    cat.warehouse = Scratch(spark, "warehouse").path("hive")
    run_hive(cat, "create table t as select o_orderkey as k, o_orderstatus as v from orders where o_totalprice > 100000; insert into t select c_custkey, c_mktsegment from customer")
    return spark.read.parquet(f"{cat.warehouse}/t")


@query("select n_nationkey, n_name from nation where n_regionkey <> 2")
def pig_load_store_files(spark, d):
    """LOAD of a delimited file, STORE into another, and that one read back."""
    cat = Catalog(spark, default="", folder=Scratch(spark, "pig").root)
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(f"{cat.folder}/in", sep="|")
    p = Pig(cat)
    p.run("REGISTER ./tools.jar; a = LOAD 'in' USING PigStorage('|') AS (n_nationkey:long, n_name:chararray, r:long); b = FILTER a BY r != 2; c = FOREACH b GENERATE n_nationkey, n_name; STORE c INTO 'out' USING PigStorage('\\t');"
          "e = LOAD 'out' USING PigStorage('\\t') AS (n_nationkey:long, n_name:chararray);")
    return p.rels["e"]


@query("""with u as (select 0 part, n_nationkey k, n_regionkey r from nation union all select 1, r_regionkey, r_regionkey from region),
 s as (select *, row_number() over (order by part, k) place, row_number() over (partition by r order by part, k) a, row_number() over (partition by r order by part desc, k desc) z from u)
 select place, k, r, (a = 1)::int::double is_first, (z = 1)::int::double is_last from s""")
def sas_set_then_first_last(spark, d):
    """SET of two tables keeps the order of both, one behind the other; BY flags and the place of each row follow it."""
    c = run_sas(catalog(spark, d, "tpch."), "data work.a; set tpch.nation; k = n_nationkey; r = n_regionkey; keep k r; run; data work.b; set tpch.region; k = r_regionkey; r = r_regionkey; keep k r; run;"
                "data work.u; set work.a work.b; run; data work.f; set work.u; by r; is_first = first.r; is_last = last.r; run;")
    return placed(c.raw("work.f"), "k", "r", "is_first", "is_last")


@query("""with s as (select *, row_number() over (order by c_mktsegment desc, c_acctbal desc, c_custkey) place from customer) select place, c_custkey, c_mktsegment, c_acctbal from s""")
def sas_sort_descending(spark, d):
    """A descending sort is an order that the next step reads."""
    c = run_sas(catalog(spark, d, "tpch."), "proc sort data=tpch.customer out=work.s; by descending c_mktsegment descending c_acctbal; run; data work.t; set work.s; keep c_custkey c_mktsegment c_acctbal; run;")
    return placed(c.raw("work.t"), "c_custkey", "c_mktsegment", "c_acctbal")


@query("""with r as (select n_regionkey k, n_nationkey w, row_number() over (partition by n_regionkey order by n_nationkey desc) i from nation), m as (select k, i, w from r)
 select row_number() over (order by k, i) place, k, r_name, w from m join region on r_regionkey = k""")
def sas_merge_order(spark, d):
    """MERGE gives its rows by key and position, and each side in its own order, a descending one too."""
    c = run_sas(catalog(spark, d, "tpch."), "data work.l; set tpch.region; k = r_regionkey; keep k r_name; run; data work.n; set tpch.nation; k = n_regionkey; w = n_nationkey; keep k w; run; proc sort data=work.n out=work.r; by k descending w; run; data work.m; merge work.l work.r; by k; run;")
    return placed(c.raw("work.m"), "k", "r_name", "w")


@query("""select c_custkey, coalesce(o.p, c_acctbal) bal, coalesce(o.s, c_mktsegment) seg from customer left join (select o_custkey, arg_max(o_totalprice, o_orderkey) p, arg_max(case when o_orderkey % 3 > 0 then o_orderpriority end, case when o_orderkey % 3 > 0 then o_orderkey end) s
  from orders where o_totalprice > 250000 group by 1) o on o_custkey = c_custkey""")
def sas_update(spark, d):
    """UPDATE by the step's own statement: the last value of a transaction that is not missing stands."""
    return run_sas(catalog(spark, d, "tpch."), "data work.m; set tpch.customer; bal = c_acctbal; seg = c_mktsegment; keep c_custkey bal seg; run;"
                   "data work.t; set tpch.orders; if o_totalprice > 250000; c_custkey = o_custkey; bal = o_totalprice; if mod(o_orderkey, 3) > 0 then seg = o_orderpriority; keep c_custkey bal seg; run; proc sort data=work.t out=work.ts; by c_custkey; run;"
                   "data work.u; update work.m work.ts; by c_custkey; run;").get("work.u")


@query("select s_suppkey::double k, case when s_suppkey % 4 = 0 then null when s_suppkey % 4 = 1 then s_name || '|x' else s_name end as name, s_acctbal bal, case when s_suppkey % 5 = 0 then null else date '2024-01-01' + s_nationkey::int end as day from supplier")
def sas_infile_dsd(spark, d):
    """INFILE with DSD, a pipe, TRUNCOVER and a header line: quoted delimiters, empty values, short lines."""
    where = Scratch(spark, "infile").path("supplier")
    key, name = F.col("s_suppkey"), F.col("s_name")
    text = F.when(key % 4 == 0, "").when(key % 4 == 1, F.concat(F.lit('"'), name, F.lit('|x"'))).otherwise(name)
    day = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("|"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("s_nationkey").cast("int")), "MM/dd/yyyy")))
    lines = table(spark, d, "supplier").select(F.concat(key.cast("string"), F.lit("|"), text, F.lit("|"), F.col("s_acctbal").cast("string"), day).alias("line"))
    lines.coalesce(1).selectExpr("explode(if(spark_partition_id() = 0 and monotonically_increasing_id() = 0, array('k|name|bal|day', line), array(line))) as line").write.text(where)  # one small file with a header
    cat = Catalog(spark, folder=where.rpartition("/")[0])
    return run_sas(cat, f"data work.s; infile '{where.rpartition('/')[2]}' dsd dlm='pipe' truncover firstobs=2; input k name $ bal day :mmddyy10.; run;").get("work.s")


@query("select event_type, count(case when event_id % 7 = 0 then null else event_type end) n_char, count(*) n_all from events group by 1")
def sas_count_char(spark, d):
    """COUNT over a character column with gaps counts what is not missing."""
    cat = Catalog(spark)
    cat.put("lib.e", table(spark, d, "events").withColumn("txt", F.expr("case when event_id % 7 = 0 then null else event_type end")), ["event_id"])
    return run_sas(cat, "proc sql; create table work.c as select event_type, count(txt) as n_char, count(*) as n_all from lib.e group by event_type; quit;").get("work.c")


@query("select o_orderpriority, count(*) n from orders where o_totalprice > 150000 group by 1")
def sas_single_block(spark, d):
    """One step of a program on tables put there before."""
    cat = catalog(spark, d, "tpch.")
    cat.put("work.big", table(spark, d, "orders").filter("o_totalprice > 150000"), ["o_orderkey"])
    program = "data work.big; set tpch.orders; if o_totalprice > 0; run; proc sql; create table work.n as select o_orderpriority, count(*) as n from work.big group by o_orderpriority; quit; data work.never; set work.gone; run;"
    return run_sas(cat, program, block=1).get("work.n")


@query("select * from (values ('brand', 'p_brand'), ('size_band', 'p_size'), ('price', 'p_retailprice'), ('price', 'p_size')) t(output_column, leaf_column)")
def lin_plan_columns(spark, d):
    """Column lineage of a DataFrame job, read from its plan; conditions of filters and joins are no sources of values."""
    p, o = table(spark, d, "part"), table(spark, d, "lineitem")
    job = p.filter("p_name != ''").join(o, p.p_partkey == o.l_partkey).groupBy("p_brand", (F.col("p_size") / 10).alias("band")).agg(F.max(F.col("p_retailprice") * F.col("p_size")).alias("price")).select(F.upper("p_brand").alias("brand"), F.col("band").alias("size_band"), "price")
    return spark.createDataFrame(plan_lineage(job), "output_column string, leaf_column string")


# ---- sources and sinks ----
@query("select o_orderkey::double k, case when o_orderkey % 6 = 0 then null else o_orderstatus end as status, case when o_orderkey % 4 = 0 then null else printf('%.12g', o_totalprice / 3)::double end price, o_orderdate::date as day from orders")
def src_schema_csv(spark, d):
    """Orders written as canonical CSV and read back with their schema."""
    where = Scratch(spark, "csv").path("orders")
    rows = table(spark, d, "orders").selectExpr("o_orderkey k", "if(o_orderkey % 6 = 0, null, o_orderstatus) status", "if(o_orderkey % 4 = 0, null, o_totalprice / 3) price", "cast(o_orderdate as date) day")
    writers.write_canonical(rows, where, {"day": "mmddyy10"})
    schema = '[{"name": "k", "type": "num"}, {"name": "status", "type": "char"}, {"name": "price", "type": "num"}, {"name": "day", "type": "date", "format": "mmddyy10"}]'
    return readers.schema_csv(spark, where, schema)[0]


@query("select o_orderkey::varchar k, case when o_totalprice = floor(o_totalprice) then o_totalprice::bigint::varchar else printf('%.12g', o_totalprice) end price, strftime(o_orderdate, '%m/%d/%Y') as day from orders")
def snk_canonical_csv(spark, d):
    """The text of canonical CSV, part files read as text with their repeated headers dropped."""
    where = Scratch(spark, "csv").path("orders")
    writers.write_canonical(table(spark, d, "orders").selectExpr("o_orderkey k", "o_totalprice price", "cast(o_orderdate as date) day").repartition(3), where, {"day": "mmddyy10"})
    return readers.part_files(spark, where, ["k", "price", "day"])


@query("select 'work.customer' title, c_custkey::varchar k, c_mktsegment seg, row_number() over (order by c_custkey)::int obs from customer union all select 'work.nation', n_nationkey::varchar, replace(n_name, ' ', '_'), row_number() over (order by n_nationkey)::int from nation")
def src_listing(spark, d):
    """Two tables printed as one report, written as text and read back."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    k = table(spark, d, "nation").select("n_nationkey", F.translate("n_name", " ", "_").alias("name"))
    lines = writers.listing_lines(c, "work.customer", ["c_custkey"])
    behind = lines.agg(F.max("line_no")).scalar() + 2
    report = Scratch(spark, "listing").write(lines.union(writers.listing_lines(k, "work.nation", ["n_nationkey"]).select(F.col("line_no") + behind, "line")))
    return readers.listing(report, "line_no", "line").select("title", F.get("values", F.lit(0)).alias("k"), F.get("values", F.lit(1)).alias("seg"), "obs")


@query("select * from (values ('match', 'match', 0::bigint), ('changed', 'differs', (select 2 * count(*) from customer where c_acctbal > 9000)), ('columns', 'differs', 0), ('gone', 'missing', 0)) t(which, verdict, n_mismatch)")
def ver_listing_against_output(spark, d):
    """A printed listing against the table it claims to show: columns first, then rows as multisets."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.floor("c_acctbal").alias("bal"))
    listed = readers.listing(Scratch(spark, "listing").write(writers.listing_lines(c, "work.c", ["c_custkey"])), "line_no", "line")
    other = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") > 9000, F.floor("c_acctbal") + 1).otherwise(F.floor("c_acctbal")).alias("bal"))
    cases = [("match", c), ("changed", other), ("columns", c.withColumnRenamed("bal", "b")), ("gone", None)]
    parts = [verify.listing_verdict(c.columns, listed, out).withColumn("which", F.lit(w)) for w, out in cases]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("select 'f' || n_nationkey || '.sas' fileid, substr(sha256('2' || 'data a' || n_nationkey || '; set ' || n_name || '; run;'), 1, 16) sashashcode from nation where n_nationkey % 3 = 0")
def src_estate_scan(spark, d):
    """Programs below a folder, those that are known with the same hash left out; the files are written first, one per nation."""
    root = Scratch(spark, "estate").path("sas")
    sc = spark.sparkContext
    base = sc._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(sc._jsc.hadoopConfiguration())
    for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect():  # 25 rows
        out = fs.create(sc._jvm.org.apache.hadoop.fs.Path(f"{root}/r{r.n_nationkey % 4}/F{r.n_nationkey}.sas"))
        out.write(bytearray(f"data a{r.n_nationkey}; set {r.n_name}; run;".encode()))
        out.close()
    whole = readers.estate(spark, root, version="2")
    known = whole.filter(F.regexp_extract("fileid", r"f(\d+)\.sas", 1).cast("int") % 3 != 0)
    changed = readers.estate(spark, root, known, version="2")
    return changed.select(F.substring_index("fileid", "/", -1).alias("fileid"), "sashashcode")


_INCLUDES = "select n_nationkey, 'data a; set r' || n_regionkey || '; run; x = ' || n_nationkey || ';' as source, case when n_nationkey % 5 = 0 then 'gone.sas' else '' end as missing from nation"


@query(_INCLUDES)
def src_include(spark, d):
    """%INCLUDE put in, one file including another; files that are missing are named."""
    files = {f"r{r.r_regionkey}.sas": f"data a; %include 's{r.r_regionkey}.sas'; run;" for r in table(spark, d, "region").select("r_regionkey").collect()}  # 5 rows
    files |= {f"s{k[1:]}": f"set r{k[1:-4]};" for k in files}

    def put(batches):
        for b in batches:
            out = [include(t, files.get) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("n_nationkey"), pa.array([t for t, _ in out], pa.string()), pa.array([",".join(m) for _, m in out], pa.string())], ["n_nationkey", "source", "missing"])

    text = F.format_string("%%include 'r%d.sas'; x = %d;%s", "n_regionkey", "n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, "%include 'gone.sas';").otherwise(""))
    nat = table(spark, d, "nation")
    return nat.select("n_nationkey", text.alias("text")).mapInArrow(put, f"n_nationkey {nat.schema['n_nationkey'].dataType.simpleString()}, source string, missing string")


@query("select l_orderkey, l_linenumber, l_shipdate, l_returnflag, l_quantity from lineitem")
def snk_arrow_parts(spark, d):
    """A table as Arrow IPC streams, made where its rows lie, and read again."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity")
    return writers.from_arrow_parts(writers.arrow_parts(rows), ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in rows.schema))


_BYTABLE = f"""e as {_provided()}, rd as (select src t, count(distinct fileid) c from e group by 1), wr as (select dst t, count(distinct fileid) c from e group by 1), al as (select t from (select src t from e union select dst from e) where t is not null)"""
_MACROS = "defs as (select distinct 'm_' || lower(replace(p_brand, '#', '')) macroname, 'f' || p_size || '.sas' fileid from part), calls as (select 'm_' || lower(replace(p_brand, '#', '')) macroname, 'g' || (p_partkey % 40) || '.sas' fileid from part where p_size % 2 = 0)"


@query(f"with {_MACROS}, a as (select macroname, count(distinct fileid) n_defined from defs group by 1), b as (select macroname, count(*) calls, count(distinct fileid) n_calling from calls group by 1) select macroname, n_defined, coalesce(calls, 0) calls, coalesce(n_calling, 0) n_calling from a left join b using (macroname)")
def grf_pivot_by_macro(spark, d):
    p = table(spark, d, "part").withColumn("macroname", F.concat(F.lit("m_"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))))
    defs = p.select("macroname", F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit(".sas")).alias("fileid")).distinct()
    calls = p.filter("p_size % 2 = 0").select("macroname", F.concat(F.lit("g"), (F.col("p_partkey") % 40).cast("string"), F.lit(".sas")).alias("fileid"))
    return reports.pivot_by_macro(defs, calls)


@query(f"with {_BYTABLE} select 'by_table' which, t as name, coalesce(rd.c, 0) + coalesce(wr.c, 0) n from al left join rd using (t) left join wr using (t) union all select 'by_file', fileid, count(*) from (select distinct {f('fileid')} fileid, {n('block_id')} b from blocks) group by 2")
def snk_pivot_files(spark, d):
    """Pivots written as parquet, one folder each, and read back."""
    s = Scratch(spark, "pivots")
    s.write(store.pivot_by_table(provided(spark, d)), "by_table")
    blocks = table(spark, d, "blocks").select(file_of("fileid").alias("fileid"), name_of("block_id").alias("block_id")).distinct()
    s.write(store.pivot_by_file(blocks.select("fileid").distinct(), blocks, provided(spark, d)), "by_file")
    t = spark.read.parquet(f"{s.root}/001-by_table").select(F.lit("by_table").alias("which"), F.col("table_name").alias("name"), (F.col("n_reading") + F.col("n_writing")).alias("n"))
    return t.union(spark.read.parquet(f"{s.root}/002-by_file").select(F.lit("by_file"), "fileid", "n_blocks"))


# ---- macros ----
def programs(spark: SparkSession, d: str) -> DataFrame:
    """One program per customer: a %LET, a macro with a default and one without, calls by place and by name, and one without its argument."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("%let lib = L"), F.col("c_nationkey").cast("string"), F.lit("; %macro load(t, n=3); data &lib..&t; set s_&T(obs=&n.); run; %mend load; %load(c"), key, F.lit(", n=5); %load(t=d"), key, F.lit("); %load();"))
    return table(spark, d, "customer").select("c_custkey", text.alias("text"))


def _mapped(df: DataFrame, fields: str, types: list, rows) -> DataFrame:
    """(key, text) rows through a function of one text that gives rows, in Arrow batches."""
    names = [df.columns[0], *[x.strip().split(" ")[0] for x in fields.split(",")]]

    def run(batches):
        for b in batches:
            out = [(k, *r) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in rows(t or "")]
            cols = list(zip(*out)) if out else [()] * (len(types) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.column(0).type, *types])], names)

    return df.mapInArrow(run, f"{df.columns[0]} {df.schema[0].dataType.simpleString()}, {fields}")


@query("""select c_custkey, trim('data L' || c_nationkey || '.c' || c_custkey || '; set s_c' || c_custkey || '(obs=5); run;  data L' || c_nationkey || '.d' || c_custkey || '; set s_d' || c_custkey || '(obs=3); run;  data L' || c_nationkey || '.&t; set s_&T(obs=3); run;') as expanded, 3 n_calls,
 'PARSED,PARSED,PARTIAL' statuses, 'work.s_c' || c_custkey || ',work.s_d' || c_custkey reads from customer""")
def mac_expand(spark, d):
    """Macros defined, values put in and calls expanded; a parameter without a value stays, so its step is PARTIAL."""
    from quillspan.lang.scan import split_blocks

    def rows(text):
        out = expand(text)
        blocks = split_blocks(out.text)
        return [(" ".join(out.text.split(" ")).strip().replace("   ", "  "), len(out.calls), ",".join(b.status for b in blocks), ",".join(r for b in blocks[:2] for r in b.reads))]

    return _mapped(programs(spark, d), "expanded string, n_calls int, statuses string, reads string", [pa.string(), pa.int32(), pa.string(), pa.string()], rows)


@query("""select c_custkey, 'm_two#' || i || '.' || j as block_id, if(j = 1, 'lib.t' || (c_custkey * i), 'work.a') as reads, if(j = 1, 'work.a', 'out.t' || (c_custkey * i)) as writes from customer, (values (1), (2)) x(i), (values (1), (2)) y(j)""")
def mac_table_function(spark, d):
    """A macro of steps as a table function: each call gives blocks of its own, tables in and out."""
    two = macros("%macro two(t); data a; set lib.&t; run; proc sort data=a out=out.&t; by k; run; %mend;")[0]["two"]

    def rows(text):
        return [(b.id, ",".join(b.reads), ",".join(b.writes)) for i in (1, 2) for b in step_blocks(two, f"t{int(text) * i}", instance=i)]

    return _mapped(table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("text")), "block_id string, reads string, writes string", [pa.string()] * 3, rows)


@query("select 'f' || n_nationkey || '.sas' fileid, 'h' || (n_nationkey + if(n_nationkey % 5 = 0, 100, 0)) sashashcode, 'm' || n_regionkey macroname, 'body ' || if(n_nationkey % 5 = 0, 'new', 'old') as definition from nation")
def mac_registry(spark, d):
    """Definitions replaced file by file under the optimistic lock; files with the known hash stay."""
    key = F.col("n_nationkey")

    def rows(where, add: int, body: str) -> DataFrame:
        return table(spark, d, "nation").filter(where).select(F.format_string("f%d.sas", key).alias("fileid"), F.format_string("h%d", key + add).alias("sashashcode"), F.format_string("m%d", "n_regionkey").alias("macroname"), F.array(F.lit("t")).alias("params"), F.lit(body).alias("definition"))

    r = MacroRegistry(spark, Scratch(spark, "registry").path("macros"))
    v = r.write(rows(F.lit(True), 0, "body old"), r.version())
    v = r.write(rows(key % 5 == 0, 100, "body new").union(rows(key % 5 == 1, 0, "same hash, not taken")), v)
    return r.read(v).drop("params")


# ---- scanning programs ----
_SCAN_TEXT = """'/*BLOCKID ' || c_custkey || ':1, DataStep;*/ data out.a' || c_custkey || ' (keep=x) b; set in.s' || c_nationkey || ' (where=(x > 1)) t; if _n_ = 1 then set one; run;
proc sql; create table w' || c_custkey || ' as with q as (select * from raw.z) select * from q, lib.c' || c_nationkey || ' as x join (select k from d, e where k in (select k from g)) y on x.k = y.k; insert into h select * from w' || c_custkey || '; quit;
proc append base=all new=part' || c_custkey || '; run; data bad; set ; run; proc means data=m; run; data m2; set &x; run;'"""


@query(f"""with c as (select c_custkey, c_custkey::varchar k, c_nationkey::varchar nk from customer) select c_custkey, block_no::int block_no, kind, status, reads, writes from c, lateral (values
 (0, 'data', 'PARSED', 'in.s' || nk || ',work.t,work.one', 'out.a' || k || ',work.b'), (1, 'proc sql', 'PARSED', 'raw.z,lib.c' || nk || ',work.d,work.e,work.g,work.w' || k, 'work.w' || k || ',work.h'),
 (2, 'proc append', 'PARSED', 'work.part' || k, 'work.all'), (3, 'data', 'PARTIAL', '', 'work.bad'), (4, 'proc means', 'NOT_MATCHED', 'work.m', ''), (5, 'data', 'PARTIAL', 'work.x', 'work.m2')) v(block_no, kind, status, reads, writes)""")
def lin_scan_programs(spark, d):
    """Six steps per customer: lists of tables, named queries, subqueries, APPEND with NEW=, an empty SET, a step without a rule, an unresolved name."""
    return lineage.scanned_blocks(table(spark, d, "customer").selectExpr("c_custkey", f"{_SCAN_TEXT.replace(chr(10), ' ')} as text"), "c_custkey", "text")


@query(f"with b as (select distinct block_key, {n('name')} nm, coalesce(sas_text, sas_code) x from blocks) select block_key, nm as written from b where nm is not null and regexp_matches(lower(x), '(data|table|view|out\\s*=)\\s*' || replace(nm, '.', '\\.') || '\\b')")
def lin_block_writes(spark, d):
    """The table a block says it writes, where the scanner finds it written in the block's text."""
    b = table(spark, d, "blocks").select("block_key", name_of("name").alias("nm"), F.coalesce("sas_text", "sas_code").alias("text")).distinct()
    found = lineage.scanned_blocks(b.select(F.to_json(F.struct("block_key", "nm", "text")).alias("row"), "text"), "row", "text").select("row", F.explode(F.split("writes", ",")).alias("written")).distinct()
    return b.withColumn("row", F.to_json(F.struct("block_key", "nm", "text"))).join(found, "row").filter("written = nm").select("block_key", "written")


@query("""select n_nationkey, line, remark, pos, stmt from nation, lateral (values (1, 'head of ' || n_name, 'leading', 0), (2, 'in', 'inline', 0), (3, 'end', 'trailing', 0), (6, 'near the second', 'leading', 1), (7, 'n' || n_nationkey, 'trailing', 1)) v(line, remark, pos, stmt)""")
def lin_remarks(spark, d):
    """Remarks with the statement they speak of."""
    text = F.concat(F.lit("/* head of "), F.col("n_name"), F.lit(" */\ndata a /* in */\n  b; /* end */\n\n\n/* near the second */\nset c; /* n"), F.col("n_nationkey").cast("string"), F.lit(" */\n"))
    return _mapped(table(spark, d, "nation").select("n_nationkey", text.alias("text")), "line int, remark string, pos string, stmt int", [pa.int32(), pa.string(), pa.string(), pa.int32()], attach_remarks)


# ---- verdicts ----
@query("select o_orderkey, case when o_orderkey % 7 = 0 then 'MISSING' when o_orderkey % 3 = 0 then 'bytes' when o_orderkey % 2 = 0 then 'rows' else 'FAIL' end verdict from orders")
def ver_three_way(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", reports.three_way(k % 7 != 0, k % 3 == 0, k % 2 == 0).alias("verdict"))


@query("select * from (values ('same', 'PASS', 0::bigint), ('fewer', 'FAIL', (select count(*) from customer where c_nationkey = 3)), ('no reference', 'REF_MISSING', 0), ('no output', 'CONV_MISSING', 0), ('neither', 'REF_MISSING', 0)) t(which, verdict, n_mismatch)")
def ver_output_verdicts(spark, d):
    """One verdict per output; a missing reference beats a missing conversion."""
    c = table(spark, d, "customer")
    cases = [("same", c, c.repartition(3)), ("fewer", c, c.filter("c_nationkey != 3")), ("no reference", None, c), ("no output", c, None), ("neither", None, None)]
    out = None
    for which, a, b in cases:
        one = verify.compare_rows(a, b, spark).withColumn("which", F.lit(which))
        out = one if out is None else out.unionByName(one)
    return out


@query("""with v as (select c_nationkey, case when c_acctbal < -900 then 'FAIL' when c_acctbal < -800 then 'CONV_MISSING' else 'PASS' end v, case when c_acctbal < -900 then c_custkey % 5 else 0 end m from customer)
 select c_nationkey, count(*) filter (v = 'FAIL') n_fail, 0::bigint n_ref_missing, count(*) filter (v = 'CONV_MISSING') n_conv_missing, count(*) filter (v = 'PASS') n_pass, sum(m)::bigint n_mismatch,
  case when bool_or(v = 'FAIL') then 'FAIL' when bool_or(v = 'CONV_MISSING') then 'CONV_MISSING' else 'PASS' end status from v group by 1""")
def ver_status_report(spark, d):
    b = F.col("c_acctbal")
    v = table(spark, d, "customer").select("c_nationkey", F.when(b < -900, "FAIL").when(b < -800, "CONV_MISSING").otherwise("PASS").alias("verdict"), F.when(b < -900, F.col("c_custkey") % 5).otherwise(0).alias("n_mismatch"))
    return reports.status_report(v, ["c_nationkey"])


_LEGS = "value > 50 and event_type = 'click' or user_id < 5"


@query("""with e as (select *, coalesce(value > 50, false) a, coalesce(event_type = 'click', false) b, coalesce(user_id < 5, false) c from events)
 select leg_no, polarity, witness from (select min(event_id) filter (a) w0, min(event_id) filter (not a) w1, min(event_id) filter (a and b) w2, min(event_id) filter (a and not b) w3, min(event_id) filter (not (a and b) and c) w4, min(event_id) filter (not (a and b) and not c) w5 from e),
  lateral (values (0, 'true', w0), (0, 'false', w1), (1, 'true', w2), (1, 'false', w3), (2, 'true', w4), (2, 'false', w5)) t(leg_no, polarity, witness)""")
def ver_leg_rows(spark, d):
    return verify.leg_rows(table(spark, d, "events"), parse_expr(_LEGS), "event_id")


@query("select * from (values (0, 'value', '49', 'false'), (0, 'value', '50', 'false'), (0, 'value', '51', 'true'), (1, 'event_type', 'click', 'true'), (1, 'event_type', 'clickx', 'false'), (1, 'event_type', '', 'false'), (2, 'user_id', '4', 'true'), (2, 'user_id', '5', 'false'), (2, 'user_id', '6', 'false')) t(leg_no, column_name, value, polarity)")
def ver_boundary_values(spark, d):
    rows = [(i, c, str(v), p) for i, c, v, p in verify.boundary_values(parse_expr(_LEGS))]
    return spark.createDataFrame(rows, "leg_no int, column_name string, value string, polarity string")


# ---- store ----
@query(f"with {_EDITS}, e as {_provided()}, c as (select edit_id, coalesce(edited_at, timestamp '1900-01-01') tm, case when exists (select 1 from e where e.fileid = ed.fileid and e.block_id = ed.block_id) then 2 when exists (select 1 from e where e.fileid = ed.fileid and e.src = ed.src and e.dst = ed.dst) then 1 else 0 end k from ed where block_id is not null) select edit_id, row_number() over (order by k, tm, edit_id) place from c")
def grf_red_first(spark, d):
    """The review queue: red, yellow, green, then by time."""
    e = full_edits(spark, d)
    at = e.select(F.col("edit_id").alias("i"), F.coalesce("edited_at", F.lit("1900-01-01").cast("timestamp_ntz")).alias("at"))
    coloured = store.stale_colour(e, provided(spark, d)).join(at, F.col("edit_id") == F.col("i"))
    return reports.red_first(coloured).select("edit_id", F.col("place").cast("long").alias("place"))


@query(f"select kind, name from (select distinct 'table' kind, {n('term')} as name from mentions where contains({n('term')}, 'rate') union all select distinct 'file', {f('fileid')} from files where contains({f('fileid')}, 'rate')) order by kind desc, name limit 50")
def grf_search_50(spark, d):
    return store.found(table(spark, d, "mentions").select(name_of("term").alias("term")), table(spark, d, "files").select(file_of("fileid").alias("fileid")), "RATE")


_TOP_FILE = f"(select {f('fileid')} from blocks where {f('fileid')} is not null group by 1 order by count(distinct block_key) desc, 1 limit 1)"


def top_file(spark: SparkSession, d: str) -> str:
    """The file with the most blocks."""
    b = table(spark, d, "blocks").select(file_of("fileid").alias("fileid"), "block_key").filter("fileid is not null")
    return b.groupBy("fileid").agg(F.count_distinct("block_key").alias("n")).orderBy(F.col("n").desc(), "fileid").first().fileid


@query(f"select distinct block_key, n, l0, l1, sas_text from blocks where {f('fileid')} = {_TOP_FILE} and n >= 3 and n < 40")
def grf_blocks_window(spark, d):
    """A window of blocks of the largest file, with their text."""
    b = table(spark, d, "blocks").select("block_key", file_of("fileid").alias("fileid"), name_of("block_id").alias("block_id"), "n", "l0", "l1", "sas_text")
    return store.block_window(b, top_file(spark, d), 3, 40).select("block_key", "n", "l0", "l1", "sas_text").distinct()


@query(f"select distinct {n('src_table')} src, {n('dst_table')} dst, {n('kind')} kind from edges where {f('fileid')} = (select min({f('fileid')}) from edges)")
def grf_table_graph(spark, d):
    e = table(spark, d, "edges").select(file_of("fileid").alias("fileid"), name_of("src_table").alias("src"), name_of("dst_table").alias("dst"), name_of("kind").alias("kind"))
    return store.table_graph(e, e.agg(F.min("fileid")).first()[0])


@query(f"with fi as (select distinct {f('fileid')} fileid from files), b as (select {f('fileid')} fileid, count(distinct {n('block_id')}) nb, count(distinct {n('kind')}) nk, min(l0) a, max(l1) z from blocks group by 1) select fileid, coalesce(nb, 0) n_blocks, coalesce(nk, 0) n_kinds, a first_line, z last_line from fi left join b using (fileid)")
def grf_file_heads(spark, d):
    b = table(spark, d, "blocks").select(file_of("fileid").alias("fileid"), name_of("block_id").alias("block_id"), name_of("kind").alias("kind"), "l0", "l1")
    return store.file_heads(table(spark, d, "files").select(file_of("fileid").alias("fileid")).distinct(), b)


_RULES = f"r as (select distinct coalesce(split_part(fileid, '/', 1), '') folder, fileid as name, src, dst from {_provided()} where fileid is not null and src is not null and dst is not null)"
_FILES = "x as (select distinct folder, name, 'sas' kind from r union select folder, regexp_replace(name, '\\.[^.]*$', '') || '.py', 'py' from r where length(name) % 3 = 0)"


@query(f"""with {_RULES}, {_FILES}, g as (select folder, name, list(src || '>' || dst order by src, dst) rules, count(*) n from r group by 1, 2),
 own as (select distinct folder, name, dst from r), rd as (select distinct folder, name, src t from r where (folder, name, src) not in (select * from own)),
 flow as (select distinct rd.folder, w.name a, rd.name b from rd join own w on w.folder = rd.folder and w.dst = rd.t and w.name <> rd.name),
 lead as (select folder, rules, arg_min(name, row(if(contains(name, 'full'), 0, 1), length(name), name)) a from g group by 1, 2),
 same as (select g.folder, l.a, g.name b from g join lead l on l.folder = g.folder and l.rules = g.rules and l.a <> g.name),
 sub as (select y.folder, arg_min(z.name, row(z.n, z.name)) a, y.name b from g y join g z on y.folder = z.folder and y.n < z.n and list_has_all(z.rules, y.rules) group by 1, 3),
 der as (select o.folder, arg_min(p.name, row(-length(regexp_replace(p.name, '\\.[^.]*$', '')), p.name)) a, o.name b from x o join x p on p.folder = o.folder and p.kind = 'sas' and starts_with(o.name, regexp_replace(p.name, '\\.[^.]*$', '')) where o.kind <> 'sas' group by 1, 3)
 select folder, a from_name, b to_name, 'flow' kind from flow union all select folder, a, b, 'same' from same union all select folder, a, b, 'subset' from sub union all select folder, a, b, 'derived' from der""")
def grf_folder_links(spark, d):
    """How the files of each folder are linked: flow, same rules, subset of the rules, derived."""
    e = provided(spark, d).filter("fileid is not null and src is not null and dst is not null")
    rules = Scratch(spark, "links").write(e.select(F.split_part("fileid", F.lit("/"), F.lit(1)).alias("folder"), F.col("fileid").alias("name"), "src", "dst").distinct())
    files = rules.select("folder", "name", F.lit("sas").alias("kind")).distinct()
    made = files.filter("length(name) % 3 = 0").select("folder", F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit(".py")).alias("name"), F.lit("py").alias("kind"))
    return lineage.folder_links(files.union(made), rules)


@query(f"""with recursive e as {_E}, c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src), lp as (select src node from c where src = dst), comp as (select node, least(node, coalesce((select min(x.dst) from c x join c y on x.dst = y.src and y.dst = x.src where x.src = node), node)) k from lp),
 b as (select a.k, max(e.src) src from e join comp a on a.node = e.src join comp z on z.node = e.dst where a.k = z.k and e.dst = z.k group by 1)
 select b.k component, (select count(*) from comp where comp.k = b.k) members, b.src, b.k dst, 'in a loop of ' || (select count(*) from comp where comp.k = b.k) || ': break the flow ' || b.src || ' -> ' || b.k || ' to serialize' sentence from b""")
def grf_break_suggestions(spark, d):
    e = level_edges(spark, d)
    return graph.break_suggestions(graph.run_order(e), e)


_DAG = f"(select distinct src, dst from {_provided()} where src is not null and dst is not null and src < dst)"


@query(f"""with recursive e as {_DAG}, nd as (select src node from e union select dst from e), l as (select node, 0 level from nd union select e.dst, l.level + 1 from l join e on e.src = l.node),
 m as (select node, max(level)::int level from l group by 1), b as (select dst node, min(src) s from e group by 1)
 select node, level, case when b.s is null then 'score 0: no flows in - nothing feeds ' || node || '; it can run first' else 'score ' || level || ': ' || b.s || ' -> ' || node || ', ready at level ' || greatest(level - 1, 0) end reason from m left join b using (node)""")
def grf_order_reasons(spark, d):
    """The order of runs over the lineage's flows, where tables have many sources, with the reason of each level."""
    e = provided(spark, d).filter("src < dst").select("src", "dst").distinct()
    return graph.reasons(graph.run_order(e), e)


_SNAPS = f"""o as (select distinct snapshot_no s, {f('fileid')} fileid, {n('source_canonical_name')} src, {n('target_canonical_name')} dst from lineage where {n('source_canonical_name')} is not null and {n('target_canonical_name')} is not null and {f('fileid')} is not null)"""


@query(f"""with {_SNAPS}, ch as (select s, 'added' c from o where s > (select min(snapshot_no) from lineage) and (s - 1, fileid, src, dst) not in (select * from o) union all select s + 1, 'removed' from o where s < (select max(snapshot_no) from lineage) and (s + 1, fileid, src, dst) not in (select * from o))
 select s as version, count(*) filter (c = 'added') n_added, count(*) filter (c = 'removed') n_removed, 0::bigint n_changed from ch group by 1""")
def snk_timeline(spark, d):
    """Per saved version the flows added and removed against the one before, from the version table."""
    from quillspan.operators.snapshots import snapshot_changes

    rows = table(spark, d, "lineage").select(F.col("snapshot_no").alias("version"), file_of("fileid").alias("fileid"), name_of("source_canonical_name").alias("src"), name_of("target_canonical_name").alias("dst"), F.lit(1).alias("there"), F.lit(0).alias("at"))
    return reports.timeline(snapshot_changes(rows, ["fileid", "src", "dst"], "version", "at", ["there"]), "version")


_REPLAY = f"""with e as (select {f('fileid')} fileid, seq, {n('event_type')} t from store_log where {f('fileid')} is not null) select fileid, max(seq) last_seq, arg_max(t, seq) last_event,
 coalesce(arg_max(t = 'file_ingested', case when t in ('file_ingested', 'file_removed') then seq end), false) present from e group by 1"""


@query(_REPLAY)
def evt_recover(spark, d):
    """A checkpoint at two thirds of the log, then recovery by the events behind it: the state is that of a whole replay."""
    log = table(spark, d, "store_log")
    upto = log.agg(F.percentile_approx("seq", 0.66)).first()[0]
    where = store.checkpoint(store.state_at(log, upto), Scratch(spark, "checkpoints").path("store"), upto or 0)
    return store.recover(spark, where, log)


@query(f"with e as (select {f('fileid')} fileid, seq, {n('event_type')} t, session_id from store_log), l as (select fileid, arg_max(t, seq) t, arg_max(session_id, seq) set_by from e where fileid is not null and t in ('file_ingested', 'file_removed') group by 1) select fileid, set_by from l where t = 'file_ingested'")
def str_follow_files(spark, d):
    """The event log as a stream of files, folded into a merge store batch by batch: the files that are there, and who put them."""
    s = Scratch(spark, "stream")
    log = table(spark, d, "store_log")
    log.repartition(3).write.parquet(f"{s.root}/in")
    held = file_store(spark)
    follow(spark, f"{s.root}/in", log.schema, f"{s.root}/ck", held).awaitTermination()
    state = held.read() if held.tiers else spark.createDataFrame([], "fileid string, set_by string")
    held.release()
    return state


@query(f"select time_bucket(interval 1 day, ts) as start, {n('event_type')} event_type, count(*) n from store_log group by 1, 2")
def str_per_window(spark, d):
    """Events per day and kind as a stream with a watermark, written in append mode by rounds, late rows within it."""
    s = Scratch(spark, "windows")
    log = table(spark, d, "store_log")
    log.write.parquet(f"{s.root}/in")
    counted = per_window(spark.readStream.schema(log.schema).parquet(f"{s.root}/in"), late="400 days")
    name = f"windows_{s.root[-12:]}"
    counted.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumn("start", F.col("start").cast("timestamp_ntz"))
