"""Queries that run dialect programs over the test tables, with the SQL they are held against."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.catalog import Catalog, visible
from quillspan.functions import sas
from quillspan.plans.datastep import read_lines
from quillspan.plans.programs import Pig, run_hive, run_sas
from quillspan.session import table

#: What orders the tables where order is observable.
ORDERS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "events": ["event_id"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"]}


def catalog(spark: SparkSession, d: str, lib: str = "") -> Catalog:
    cat = Catalog(spark, default="")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        cat.put(f"{lib}{name}", table(spark, d, name), ORDERS.get(name) if lib else None)
    if lib:
        e = table(spark, d, "events").withColumn("value", F.expr("case when event_id % 7 = 0 then null else value end")).withColumn("user_id", F.expr("case when event_id % 11 = 0 then null else user_id end"))
        cat.put(f"{lib}gaps", e, ["event_id"])
    return cat


def hive(script: str, spark: SparkSession, d: str) -> DataFrame:
    return run_hive(catalog(spark, d), script)


def pig(script: str, rel: str, spark: SparkSession, d: str) -> DataFrame:
    return Pig(catalog(spark, d)).run(script)[rel]


def sasq(program: str, out: str, spark: SparkSession, d: str) -> DataFrame:
    return run_sas(catalog(spark, d, "tpch."), program).get(out)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _hive(name: str, script: str, sql: str | None = None) -> None:
    _add(name, partial(hive, script), sql or script.rpartition(";")[2] if ";" not in script.strip().rstrip(";") else sql)


def _pig(name: str, rel: str, script: str, sql: str) -> None:
    _add(name, partial(pig, script, rel), sql)


def _sas(name: str, out: str, program: str, sql: str | None) -> None:
    _add(name, partial(sasq, program, out), sql)


# ---- Hive ----
_hive("hive_ctas_filter_case", "create table t as select o_orderkey, o_totalprice, case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and not o_orderstatus = 'F'; select * from t",
      "select o_orderkey, o_totalprice, case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end band from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus <> 'F'")
_hive("hive_group_having", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice * (1 - l_discount)) / count(*), 4) as mean_net, coalesce(max(l_tax), 0.0) as top_tax from lineitem group by l_returnflag, l_linestatus having count(*) > 10 and sum(l_quantity) > 100",
      "select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) qty, round(sum(l_extendedprice * (1 - l_discount)) / count(*), 4) mean_net, coalesce(max(l_tax), 0.0) top_tax from lineitem group by all having count(*) > 10 and sum(l_quantity) > 100")
_hive("hive_join_order_limit", "select o.o_orderkey, c.c_name, o.o_totalprice from orders o join customer c on o.o_custkey = c.c_custkey where c.c_acctbal > 0 order by o.o_totalprice desc, o.o_orderkey limit 100",
      "select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey where c_acctbal > 0 order by o_totalprice desc, o_orderkey limit 100")
_hive("hive_union_insert", "create table t (k bigint, v string); insert into t select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'; insert into t select o_orderkey, o_orderpriority from orders where o_totalprice > 200000 union all select c_custkey, c_mktsegment from customer; select k, v from t",
      "select o_orderkey k, o_orderstatus v from orders where o_orderstatus = 'F' union all select o_orderkey, o_orderpriority from orders where o_totalprice > 200000 union all select c_custkey, c_mktsegment from customer")
_hive("hive_nested_scalar", "select t.l_suppkey, t.qty from (select l_suppkey, sum(l_quantity) as qty from (select l_suppkey, l_quantity from lineitem where l_discount > 0.02) s group by l_suppkey) t where t.qty > (select avg(u.q) from (select sum(l_quantity) as q from lineitem where l_discount > 0.02 group by l_suppkey) u)",
      "with t as (select l_suppkey, sum(l_quantity) qty from lineitem where l_discount > 0.02 group by 1) select * from t where qty > (select avg(qty) from t)")
_hive("hive_cast_coalesce_like_between", "select p_partkey, cast(p_name as int) as bad, coalesce(cast(p_brand as int), p_size) as c, cast(p_retailprice as string) as s from part where p_type like '%E%' and p_size between 5 and 30 and p_name is not null",
      "select p_partkey, try_cast(p_name as int) bad, coalesce(try_cast(p_brand as int), p_size) c, p_retailprice::varchar s from part where p_type like '%E%' and p_size between 5 and 30 and p_name is not null")
_hive("hive_left_full_joins", "select c.c_custkey, o.o_orderkey, n.n_name from customer c left join (select * from orders where o_totalprice > 250000) o on c.c_custkey = o.o_custkey full outer join nation n on n.n_nationkey = c.c_nationkey",
      "select c_custkey, o_orderkey, n_name from customer left join (select * from orders where o_totalprice > 250000) on c_custkey = o_custkey full join nation on n_nationkey = c_nationkey")
_hive("hive_count_distinct", "select o_orderpriority, count(distinct o_custkey) as n_cust, min(o_orderdate) as first_day from orders group by o_orderpriority", "select o_orderpriority, count(distinct o_custkey) n_cust, min(o_orderdate) first_day from orders group by 1")
_hive("hive_theta_join", "select a.n_name as a_name, b.n_name as b_name from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", "select a.n_name a_name, b.n_name b_name from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
_hive("hive_distinct_alias_order", "select distinct month(o_orderdate) as m, o_orderstatus as s from orders order by m desc, s limit 20 offset 2", "select distinct month(o_orderdate)::int m, o_orderstatus s from orders order by m desc, s limit 20 offset 2")
_hive("hive_in_list_arith", "select l_orderkey, l_quantity * 2 - 1 as q, l_extendedprice / nullif(l_discount, 0.0) as r from lineitem where l_linenumber in (1, 3) and l_quantity < 3", "select l_orderkey, l_quantity * 2 - 1 q, l_extendedprice / nullif(l_discount, 0) r from lineitem where l_linenumber in (1, 3) and l_quantity < 3")
_hive("hive_group_no_aggregate", "select c_mktsegment as seg, c_nationkey as nk from customer group by c_mktsegment, c_nationkey", "select distinct c_mktsegment seg, c_nationkey nk from customer")

# ---- Pig ----
_pig("pig_load_filter_store", "b", "a = LOAD 'lineitem' USING PigStorage(',') AS (l_orderkey:long, l_quantity:double, l_returnflag:chararray); b = FILTER a BY (l_quantity > 45 AND l_returnflag == 'R') OR NOT l_quantity >= 2; STORE b INTO 'out' USING PigStorage(',');",
     "select l_orderkey, l_quantity, l_returnflag from lineitem where (l_quantity > 45 and l_returnflag = 'R') or l_quantity < 2")
_pig("pig_foreach_arith", "b", "a = FILTER lineitem BY l_suppkey != 0; b = FOREACH a GENERATE l_orderkey AS k, l_partkey / l_suppkey AS q, -l_quantity + 1 AS m, l_extendedprice - (l_extendedprice * l_discount) AS net, UPPER(l_returnflag) AS f, $0 AS first;",
     "select l_orderkey k, l_partkey // l_suppkey q, -l_quantity + 1 m, l_extendedprice - (l_extendedprice * l_discount) net, upper(l_returnflag) f, l_orderkey as first from lineitem where l_suppkey <> 0")
_pig("pig_group_agg", "s", "g = GROUP orders BY o_orderpriority; s = FOREACH g GENERATE group AS pr, COUNT(orders) AS n, MIN(orders.o_totalprice) AS lo, MAX(orders.o_totalprice) AS hi, ROUND(SUM(orders.o_totalprice), 2) AS total, ROUND(AVG(orders.o_totalprice), 4) AS mean;",
     "select o_orderpriority pr, count(*) n, min(o_totalprice) lo, max(o_totalprice) hi, round(sum(o_totalprice), 2) total, round(avg(o_totalprice), 4) mean from orders group by 1")
_pig("pig_group_many_keys", "s", "g = GROUP lineitem BY (l_returnflag, l_linestatus); s = FOREACH g GENERATE group.l_returnflag AS f, group.l_linestatus AS t, COUNT(lineitem) AS n;", "select l_returnflag f, l_linestatus t, count(*) n from lineitem group by 1, 2")
_pig("pig_group_all", "s", "g = GROUP events ALL; s = FOREACH g GENERATE COUNT(events) AS n, MAX(events.value) AS top;", "select count(*) n, max(value) top from events")
_pig("pig_join3", "f", "j = JOIN orders BY o_custkey, customer BY c_custkey; f0 = FILTER j BY c_acctbal > 5000; k = JOIN f0 BY c_nationkey, nation BY n_nationkey; f = FOREACH k GENERATE f0::o_orderkey AS o, nation::n_name AS n;",
     "select o_orderkey o, n_name n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where c_acctbal > 5000")
_pig("pig_order_limit_distinct", "d", "o = ORDER orders BY o_totalprice DESC, o_orderkey; l = LIMIT o 500; p = FOREACH l GENERATE o_orderpriority, o_orderstatus; d = DISTINCT p;",
     "select distinct o_orderpriority, o_orderstatus from (select * from orders order by o_totalprice desc, o_orderkey limit 500)")
_pig("pig_union_split", "u", "SPLIT events INTO big IF value > 50, clicks IF event_type == 'click', rest IF value <= 5; a = FOREACH big GENERATE event_id, 'big' AS tag; b = FOREACH clicks GENERATE event_id, 'click' AS tag; c = FOREACH rest GENERATE event_id, 'low' AS tag; u = UNION a, b, c;",
     "select event_id, 'big' tag from events where value > 50 union all select event_id, 'click' from events where event_type = 'click' union all select event_id, 'low' from events where value <= 5")
_pig("pig_cross", "p", "c = CROSS nation, region; p = FOREACH c GENERATE n_name, r_name;", "select n_name, r_name from nation, region")
_pig("pig_cogroup_inner", "s", "f = FILTER supplier BY s_acctbal > 5000; c = COGROUP nation BY n_nationkey INNER, f BY s_nationkey INNER PARALLEL 4; s = FOREACH c GENERATE group AS k, SIZE(nation) AS a, SIZE(f) AS b;",
     "select k, a, b from (select n_nationkey k, count(*)::int a from nation group by 1) join (select s_nationkey k, count(*)::int b from supplier where s_acctbal > 5000 group by 1) using (k)")
_pig("pig_cogroup_outer", "s", "f = FILTER supplier BY s_acctbal > 8000; c = COGROUP nation BY n_nationkey, f BY s_nationkey OUTER; s = FOREACH c GENERATE group AS k, SIZE(nation) AS a, SIZE(f) AS b;",
     "select coalesce(x.k, y.k) k, coalesce(a, 0) a, coalesce(b, 0) b from (select n_nationkey k, count(*)::int a from nation group by 1) x full join (select s_nationkey k, count(*)::int b from supplier where s_acctbal > 8000 group by 1) y on x.k = y.k")
_pig("pig_matches", "f", "f = FILTER part BY p_type MATCHES '.*(TIN|STEEL)' OR p_brand MATCHES 'Brand#1.';", "select * from part where regexp_full_match(p_type, '.*(TIN|STEEL)') or regexp_full_match(p_brand, 'Brand#1.')")

# ---- SAS ----
_sas("sas_subset_if_month", "work.q1", "data work.q1; set tpch.orders; if month(o_orderdate) <= 3; if o_totalprice > 1000; run;", "select * from orders where month(o_orderdate) <= 3 and o_totalprice > 1000")
_sas("sas_proc_sql_agg", "work.t", "proc sql; create table work.t as select round(sum(o_totalprice), 0.01) as total, max(o_totalprice) as hi, min(o_totalprice) as lo, count(*) as n, round(avg(o_totalprice), 0.001) as mean from tpch.orders; ; run;",
     "select round(sum(o_totalprice) * 100) / 100 total, max(o_totalprice) hi, min(o_totalprice) lo, count(*) n, round(avg(o_totalprice) * 1000) / 1000 mean from orders")
_sas("sas_monthly_group", "work.m", "proc sql; create table work.m as select month(o_orderdate) as mon, round(sum(o_totalprice), 0.01) as total from tpch.orders group by month(o_orderdate) having total > 0 order by mon; quit;",
     "select month(o_orderdate)::int mon, round(sum(o_totalprice) * 100) / 100 total from orders group by 1")
_sas("sas_missing_compare", "work.m", "data work.m; set tpch.gaps; lt = value < 20; ge = value >= 20; eq = value = .; ne = user_id ne .; less = value < user_id; inn = user_id in (1, 2, 3); if value <= 20 or user_id > 100; keep event_id lt ge eq ne less inn; run;",
     """with g as (select event_id, case when event_id % 7 = 0 then null else value end v, case when event_id % 11 = 0 then null else user_id end u from events)
 select event_id, (v is null or v < 20)::int::double lt, (v is not null and v >= 20)::int::double ge, (v is null)::int::double eq, (u is not null)::int::double ne,
  ((v is null and u is not null) or coalesce(v < u, false))::int::double less, coalesce(u in (1, 2, 3), false)::int::double inn from g where v is null or v <= 20 or coalesce(u > 100, false)""")
_sas("sas_missing_sort", "work.s", "proc sql; create table work.s as select user_id, event_id from tpch.gaps order by user_id, event_id limit 150; quit;",
     "select case when event_id % 11 = 0 then null else user_id end user_id, event_id from events order by 1 nulls first, 2 limit 150")
_sas("sas_missing_arith", "work.a", "data work.a; set tpch.gaps; x = value + user_id * 2; y = -value; z = sum(value, user_id); m = max(value, user_id); n = nmiss(value, user_id); keep event_id x y z m n; run;",
     """with g as (select event_id, case when event_id % 7 = 0 then null else value end v, case when event_id % 11 = 0 then null else user_id end u from events)
 select event_id, v + u * 2 x, -v y, case when v is not null or u is not null then coalesce(v, 0) + coalesce(u, 0) end z, greatest(v, u) m, ((v is null)::int + (u is null)::int) n from g""")
_sas("sas_div_zero", "work.d", "data work.d; set tpch.gaps; r = value / (user_id - 5); p = user_id ** 2; keep event_id r p; run;",
     "with g as (select event_id, case when event_id % 7 = 0 then null else value end v, case when event_id % 11 = 0 then null else user_id end u from events) select event_id, case when u = 5 then null else v / (u - 5) end r, pow(u, 2) p from g")
_sas("sas_above_average", "work.b", "proc sql; create table work.a as select avg(value) as mean from tpch.gaps; create table work.b as select event_id, value from tpch.gaps where value > (select mean from work.a); quit;",
     "with g as (select event_id, case when event_id % 7 = 0 then null else value end as value from events) select * from g where value > (select avg(value) from g)")
_sas("sas_if_then_else", "work.c", "data work.c (drop=props); set tpch.gaps (where=(event_type ne 'view') rename=(value=v)); if v = . then do; band = 'none'; pts = 0; end; else if v > 50 then band = 'high'; else band = 'low'; if event_type = 'error' then delete; keep event_id v band pts; run;",
     "with g as (select event_id, event_type, case when event_id % 7 = 0 then null else value end v from events) select event_id, v, case when v is null then 'none' when v > 50 then 'high' else 'low' end band, case when v is null then 0 end pts from g where event_type not in ('view', 'error')")
_sas("sas_output_two", "work.u", "data work.big work.small; set tpch.part; if p_size > 25 then output work.big; else output work.small; run; data work.u; set work.big work.small (keep=p_partkey p_size); keep p_partkey p_size p_brand; run;",
     "select p_partkey, p_size, case when p_size > 25 then p_brand end p_brand from part")
_sas("sas_first_last", "work.f", "proc sort data=tpch.orders out=work.o; by o_custkey; run; data work.f; set work.o; by o_custkey; if first.o_custkey or last.o_custkey; keep o_custkey o_orderkey; run;",
     "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) a, row_number() over (partition by o_custkey order by o_orderkey desc) z from orders) where a = 1 or z = 1")
_sas("sas_sort_nodupkey", "work.n", "proc sort data=tpch.orders out=work.n nodupkey; by o_custkey o_orderstatus; run;",
     "select * exclude (rn) from (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) rn from orders) where rn = 1")

_SIDES = """a as (select *, row_number() over (partition by k order by seq) i, count(*) over (partition by k) n from l),
 b as (select *, row_number() over (partition by k order by seq) i, count(*) over (partition by k) n from r),
 sp as (select k, unnest(generate_series(1, max(n))) i from (select k, n from a union all select k, n from b) group by k)"""


def _merge_sql(left: str, right: str, cols: str) -> str:
    return f"with l as ({left}), r as ({right}), {_SIDES} select {cols} from sp left join a on sp.k is not distinct from a.k and least(sp.i, a.n) = a.i left join b on sp.k is not distinct from b.k and least(sp.i, b.n) = b.i"


_sas("sas_merge_one_to_one", "work.m", "data work.l; set tpch.nation; k = n_nationkey; v = n_name; keep k v; run; data work.r; set tpch.nation (where=(n_nationkey > 9)); k = n_nationkey + 5; w = n_regionkey; v = 'right'; keep k w v; run; data work.m; merge work.l work.r; by k; run;",
     _merge_sql("select n_nationkey k, n_name v, n_nationkey seq from nation", "select n_nationkey + 5 k, n_regionkey w, 'right' v, n_nationkey seq from nation where n_nationkey > 9", "sp.k, case when a.n is not null then a.v else b.v end v, b.w"))
_sas("sas_merge_one_to_many", "work.m", "data work.l; set tpch.customer; k = c_custkey; keep k c_name; run; data work.r; set tpch.orders; k = o_custkey; keep k o_orderkey o_totalprice; run; data work.m; merge work.l work.r; by k; run;",
     _merge_sql("select c_custkey k, c_name, c_custkey seq from customer", "select o_custkey k, o_orderkey, o_totalprice, o_orderkey seq from orders", "sp.k, a.c_name, b.o_orderkey, b.o_totalprice"))
_sas("sas_merge_many_to_many", "work.m", "data work.l; set tpch.gaps (where=(event_type = 'click')); k = user_id; v = value; a_id = event_id; keep k v a_id; run; data work.r; set tpch.gaps (where=(event_type = 'purchase')); k = user_id; v = value; b_id = event_id; keep k v b_id; run; data work.m; merge work.l work.r; by k; run;",
     _merge_sql("select case when event_id % 11 = 0 then null else user_id end k, case when event_id % 7 = 0 then null else value end v, event_id a_id, event_id seq from events where event_type = 'click'",
                "select case when event_id % 11 = 0 then null else user_id end k, case when event_id % 7 = 0 then null else value end v, event_id b_id, event_id seq from events where event_type = 'purchase'",
                "sp.k, case when a.n is not null then a.v else b.v end v, a.a_id, b.b_id"))
_sas("sas_merge_missing_by", "work.m", "data work.m; merge tpch.nation tpch.region; by n_regionkey; run;", "select n_nationkey, n_name, n_regionkey, r_regionkey, r_name from nation, region where false")
_sas("sas_merge_in_flags", "work.m", "data work.l; set tpch.customer; k = c_custkey; keep k c_name; run; data work.r; set tpch.orders (where=(o_totalprice > 200000)); k = o_custkey; keep k o_orderkey; run; data work.m; merge work.l (in=a) work.r (in=b); by k; if a and not b; run;",
     "select c_custkey::bigint k, c_name, null::bigint o_orderkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 200000)")
_sas("sas_attach_first_row", "work.m", "proc sql; create table work.t as select max(o_totalprice) as top, 'x' as n_name from tpch.orders; quit; data work.t2; set tpch.region; keep r_regionkey r_name; run; data work.m; if _n_ = 1 then set work.t2; set tpch.nation; run;",
     "select n.*, r_regionkey, r_name from nation n, (select * from region order by r_regionkey limit 1)")
_sas("sas_attach_empty", "work.m", "data work.e; set tpch.region; if r_regionkey > 99; run; data work.m; if _n_ = 1 then set work.e; set tpch.nation; run;", "select n.*, null::int r_regionkey, null::varchar r_name from nation n")
_sas("sas_std_var_nmiss", "work.s", "proc sql; create table work.s as select event_type, round(std(value), 0.0001) as sd, round(var(value), 0.01) as v, nmiss(value) as miss, count(value) as n, mean(user_id) > 0 as pos from tpch.gaps group by event_type; quit;",
     "select event_type, round(stddev_samp(v0) * 10000) / 10000 sd, round(var_samp(v0) * 100) / 100 v, count(*) filter (v0 is null) miss, count(v0) n, 1.0::double pos from (select event_type, case when event_id % 7 = 0 then null else value end v0 from events) group by 1")
_sas("sas_substr_upcase_concat_pow", "work.p", "data work.p; set tpch.part; a = substr(p_name, 2, 3); b = upcase(p_name) || '-' || lowcase(p_brand); c = p_size ** 2; d = abs(p_size - 20); e = round(p_retailprice); keep p_partkey a b c d e; run;",
     "select p_partkey, substr(p_name, 2, 3) a, upper(p_name) || '-' || lower(p_brand) b, pow(p_size, 2) c, abs(p_size - 20) d, round(p_retailprice) e from part")
_sas("sas_union_all_4", "work.u", "proc sql; create table work.u as select n_name as x from tpch.nation union all select r_name as x from tpch.region union all select c_mktsegment as x from tpch.customer union all select s_name as x from tpch.supplier; quit;",
     "select n_name x from nation union all select r_name from region union all select c_mktsegment from customer union all select s_name from supplier")
_sas("sas_order_desc_limit", "work.o", "proc sql; create table work.o as select o_orderkey, o_totalprice from tpch.orders order by o_totalprice desc, o_orderkey limit 25; quit;", "select o_orderkey, o_totalprice from orders order by 2 desc, 1 limit 25")
_sas("sas_group_first_row", "work.g", "proc sql; create table work.g as select o_orderpriority, o_orderkey, count(*) as n from tpch.orders group by o_orderpriority; quit;", "select o_orderpriority, min(o_orderkey) o_orderkey, count(*) n from orders group by 1")
_sas("sas_nway_left_join", "work.j", "proc sql; create table work.j as select c.c_custkey, n.n_name, r.r_name from tpch.customer c left join tpch.nation n on c.c_nationkey = n.n_nationkey and n.n_regionkey < 3 left join tpch.region r on n.n_regionkey = r.r_regionkey; quit;",
     "select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey and n_regionkey < 3 left join region on n_regionkey = r_regionkey")
_sas("sas_datalines_roundtrip", "work.s", "data work.s; input id $ amount day :mmddyy10.; format day mmddyy10.; datalines;\n\n001 100 01/01/2023\n002 . 02/15/2023\n   003 7.25\n;\nrun;",
     "select * from (values ('001', 100.0::double, date '2023-01-01'), ('002', null, date '2023-02-15'), ('003', 7.25, null)) t(id, amount, day)")


def sas_date_days_1960(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", sas.days(F.col("o_orderdate")).alias("n_days"), F.date_add(F.lit(sas.EPOCH).cast("date"), sas.days(F.col("o_orderdate"))).alias("back"))


def sas_print_format(spark: SparkSession, d: str) -> DataFrame:
    c = run_sas(catalog(spark, d, "tpch."), "data work.p; set tpch.gaps; x = value / 3; keep event_id x ts; format ts mmddyy10.; run;")
    df = c.get("work.p")
    return df.select("event_id", sas.show_number(F.col("x")).alias("x"), sas.show_date(F.col("ts").cast("date"), c.formats["ts"]).alias("day"))


def src_list_input(spark: SparkSession, d: str) -> DataFrame:
    """List input at size: order rows written as lines of text and read back."""
    lines = table(spark, d, "orders").select(F.concat_ws(" ", F.lit(" "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, ".").otherwise(F.col("o_orderstatus")), F.date_format("o_orderdate", "MM/dd/yyyy")).alias("line"))
    return read_lines(lines, "line", [("k", "num", None), ("status", "char", None), ("day", "date", "mmddyy10"), ("extra", "num", None)])


_add("sas_date_days_1960", sas_date_days_1960, "select o_orderkey, (o_orderdate::date - date '1960-01-01')::int n_days, o_orderdate::date back from orders")
_add("sas_print_format", sas_print_format, "select event_id, case when event_id % 7 = 0 then '.' when value / 3 = floor(value / 3) then (value / 3)::bigint::varchar else printf('%.12g', value / 3) end x, strftime(ts, '%m/%d/%Y') as day from events")
_add("src_list_input", src_list_input, "select o_orderkey::double k, case when o_orderkey % 5 = 0 then null else o_orderstatus end status, o_orderdate::date as day, null::double extra from orders")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A SAS program over the orders table: a DATA step, then PROC SQL over its result."""
    program = "data work.o; set tpch.orders; if month(o_orderdate) <= 3; run; proc sql; create table work.q1 as select o_orderpriority, round(sum(o_totalprice), 0.01) as total from work.o group by o_orderpriority; quit;"
    return visible(run_sas(catalog(spark, d, "tpch."), program).raw("work.q1"))


_add("sas_flagship", flagship, "select o_orderpriority, round(sum(o_totalprice) * 100) / 100 total from orders where month(o_orderdate) <= 3 group by 1")
