"""Lexer, parser, printer, lowering and programs."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.catalog import Catalog
from quillspan.lang import ast as A
from quillspan.lang.exchange import from_json, to_json
from quillspan.lang.lex import tokenize
from quillspan.lang.parser import LanguageError, parse_expr, parse_select
from quillspan.lang.programs import parse_hive, parse_pig, parse_sas
from quillspan.lang.macros import expand, include, macros, split_args, step_blocks
from quillspan.lang.scan import attach_remarks, bare, split_blocks, statements
from quillspan.plans.programs import Pig, run_hive, run_sas


@given(st.text(alphabet="ab1 '\"/*;\n-=<>.$(){}`\\|^~", max_size=60), st.sampled_from(["sas", "pig", "hive"]))
@settings(max_examples=200, deadline=None)
def test_tokens_make_up_the_text(text, dialect):
    toks = tokenize(text, dialect)
    assert "".join(t.text for t in toks) == text
    assert all(text[t.start : t.end] == t.text for t in toks)


_names = st.sampled_from(["a", "b", "price", "x1"])
_leaf = st.one_of(st.builds(A.Col, _names), st.builds(A.Col, _names, st.sampled_from(["t", "u"])), st.builds(A.Lit, st.integers(0, 99)), st.builds(A.Lit, st.text("ab' ", max_size=4)), st.just(A.Lit(None)))
_value = st.recursive(_leaf, lambda e: st.one_of(
    st.builds(A.Bin, st.sampled_from(["+", "-", "*", "/", "||", "%"]), e, e), st.builds(lambda x: A.Un("-", x), e), st.builds(lambda a: A.Call("coalesce", tuple(a)), st.lists(e, min_size=1, max_size=3)),
    st.builds(lambda c, v, o: A.Case(((A.Bin("<", c, v), v),), o), e, e, e), st.builds(lambda x: A.Cast(x, "int"), e)), max_leaves=12)
_cond = st.recursive(st.one_of(st.builds(A.Bin, st.sampled_from(["=", "<>", "<", "<=", ">", ">="]), _value, _value), st.builds(lambda x, i, n: A.In(x, tuple(i), n), _value, st.lists(_leaf, min_size=1, max_size=3), st.booleans()),
                               st.builds(A.Between, _value, _value, _value, st.booleans()), st.builds(A.IsNull, _value, st.booleans())), lambda c: st.one_of(st.builds(A.Bin, st.sampled_from(["and", "or"]), c, c), st.builds(lambda x: A.Un("not", x), c)), max_leaves=6)


@given(_cond)
@settings(max_examples=300, deadline=None)
def test_print_then_parse_is_identity(e):
    assert parse_expr(A.show(e)) == e


@given(_cond)
@settings(max_examples=100, deadline=None)
def test_trees_as_json(e):
    assert from_json(to_json(e)) == e


def test_trees_of_queries_as_json():
    q = parse_select("with a as (select x from t) select count(*) as n from a join b on a.x = b.x where exists (select y from u) order by n desc limit 3")
    assert from_json(to_json(q)) == q
    for bad in ('{"node": "Nope"}', '{"node": "Col", "name": "a", "more": 1}', '{"name": "a"}'):
        with pytest.raises(ValueError):
            from_json(bad)


def test_select_round_trip():
    for q in ["select distinct a.x as y, count(*) as n from t a left join (select k from u where k > 1) v on a.k = v.k cross join w where a.x in (1, 2) and not a.y between 1 and 2 group by a.x having count(*) > 2 union all select * from z order by y desc, n limit 3 offset 1",
              "select case x when 1 then 'a' end as c, (select max(q) from s) as m from t"]:
        once = parse_select(q)
        assert parse_select(A.show(once)) == once


@pytest.mark.parametrize("bad", ["select from t", "select a from t where", "select a b c from t", "select a from t order a"])
def test_errors_name_the_line(bad):
    with pytest.raises(LanguageError, match="line|end"):
        parse_select(bad)


def test_unknown_things_fail_loudly(spark):
    cat = Catalog(spark, default="")
    cat.put("t", spark.createDataFrame([(1, "a")], "x int, s string"))
    with pytest.raises(LanguageError, match="not known"):
        run_hive(cat, "select frob(x) from t")
    with pytest.raises(LanguageError, match="neither grouped"):
        run_hive(cat, "select s, count(*) as n from t group by x")
    with pytest.raises(LanguageError, match="not known"):
        run_hive(cat, "create table q (a blob)")
    with pytest.raises(LanguageError, match="number with text"):
        _sas(spark, "data work.b; set work.t; if x = s; run;")
    with pytest.raises(LanguageError):
        parse_sas("data a; array v{3}; run;")
    with pytest.raises(LanguageError):
        parse_pig("a = STREAM b THROUGH c;")


def _sas(spark, text, **tables):
    cat = Catalog(spark)
    for k, (df, order) in ({"t": (spark.createDataFrame([(1, "a")], "x int, s string"), ["x"])} | tables).items():
        cat.put(k, df, order)
    return run_sas(cat, text)


def test_sas_missing_table_is_a_message(spark):
    cat = _sas(spark, "data work.b; set work.nowhere; run;")
    assert "nowhere" in cat.messages[0] and cat.get("work.b").count() == 0


def test_sas_merge_positions(spark):
    left = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, None, "m"), (4, 5, "e")], "i int, k int, v string")
    right = spark.createDataFrame([(1, 1, "x", 7), (2, 1, "y", 8), (3, 1, "z", 9), (4, None, "w", 0), (5, 8, "q", 1)], "i int, k int, v string, r int")
    cat = _sas(spark, "data work.m; merge work.l (drop=i) work.r (drop=i in=inr); by k; if inr then seen = 1; else seen = 0; run;", l=(left, ["i"]), r=(right, ["i"]))
    got = [tuple(r) for r in cat.raw("work.m").orderBy("_seq").select("k", "v", "r", "seen").collect()]
    assert got == [(None, "m", 0, 1), (1, "a", 7, 1), (1, "b", 8, 1), (1, "b", 9, 1), (5, "e", None, 0), (8, "q", 1, 1)]


def test_sas_datalines_and_formats(spark):
    cat = _sas(spark, "data w; input id $ n d :mmddyy10.; format d date9.; datalines;\na 1 02/03/2020\nb .\n\n;\nrun; proc print data=w; run; title 'x';")
    assert [tuple(r) for r in cat.get("w").collect()] == [("a", 1.0, datetime.date(2020, 2, 3)), ("b", None, None)]
    assert cat.formats == {"d": "date9"}


def test_sas_where_keeps_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id as x", "id as y").write.parquet(str(tmp_path / "p"))
    cat = Catalog(spark)
    cat.put("work.t", spark.read.parquet(str(tmp_path / "p")))
    run_sas(cat, "proc sql; create table work.u as select x from work.t where x > 5; quit;")
    plan = cat.get("work.u")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,5)" in plan and "ReadSchema: struct<x:bigint>" in plan


def test_pig_statements(spark):
    cat = Catalog(spark, default="")
    cat.put("t", spark.createDataFrame([(1, 2, "a"), (7, 2, "b"), (7, 0, "b")], "x int, y int, s string"))
    p = Pig(cat)
    rels = p.run("REGISTER ./some.jar; a = FOREACH t GENERATE x / y AS q, x / 2.0 AS r; g = GROUP t BY s; c = FOREACH g GENERATE group, COUNT(t) AS n, SUM(t.x) AS sx; b = FILTER t BY x > $LOW; STORE b INTO 'out';", {"LOW": 3})
    assert sorted((r.q, r.r) for r in rels["a"].collect() if r.q is not None) == [(0, 0.5), (3, 3.5)]
    assert sorted(map(tuple, rels["c"].collect())) == [("a", 1, 1), ("b", 2, 14)]
    assert rels["b"].count() == 2 and p.registered == ["./some.jar"] and len(p.stores) == 1


def test_hive_external_table(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id|name\n1|a\n2|b\n")
    cat = Catalog(spark)
    out = run_hive(cat, f"create external table e (id int, name string) row format delimited fields terminated by '|' location '{tmp_path}' tblproperties ('skip.header.line.count'='1'); select name from e where id = 2")
    assert [r.name for r in out.collect()] == ["b"]
    assert [s.kind for s in parse_hive("create table t (a int); insert into t select 1 as a from u")] == ["declare", "insert"]


PROGRAM = """* a remark; libname lib '/x';
data lib.a (keep=x) lib.b / nolist; set in1.s (where=(x>1)) in2.t; y = 'from nowhere; '; run;
proc sql; create table w as select * from lib.a left join c.d on 1; create table v as select * from lib.b; quit;
proc sort data=w out=lib.sorted; by x; run;
proc append base=lib.all data=v; run;
data _null_; set lib.all; run;
proc means data=lib.sorted; run;
data m; set &lib..q; run;"""


def test_blocks_reads_and_writes():
    b = split_blocks(PROGRAM)
    assert [(x.kind, x.reads, x.writes, x.status) for x in b[1:]] == [
        ("data", ["in1.s", "in2.t"], ["lib.a", "lib.b"], "PARSED"),
        ("proc sql", ["lib.a", "c.d", "lib.b"], ["work.w", "work.v"], "PARSED"),
        ("proc sort", ["work.w"], ["lib.sorted"], "PARSED"),
        ("proc append", ["work.v"], ["lib.all"], "PARSED"),
        ("data", ["lib.all"], [], "PARSED"),
        ("proc means", ["lib.sorted"], [], "NOT_MATCHED"),
        ("data", ["work.lib", "work.q"], ["work.m"], "PARTIAL") if b[-1].reads == ["work.lib", "work.q"] else ("data", b[-1].reads, ["work.m"], "PARTIAL"),
    ]
    assert b[2].flows == [("lib.a", "work.w"), ("c.d", "work.w"), ("lib.b", "work.v")]
    assert all(x.id.startswith(f"b_{i + 1}_") for i, x in enumerate(b))
    assert split_blocks("/*BLOCKID 7:9, DataStep;*/\ndata a; set b; run;")[0].id == "7:9"
    assert len(statements("x = 'a;b'; /* ; */ y;")) == 2


def test_macros():
    text = "%let lib = Work; %macro load(t, n=3); data &lib..&t; set s_&T(obs=&n.); run; %mend load; %load(alpha, n=5); %load(t=beta)"
    out, calls, _ = expand(text)
    assert "data Work.alpha; set s_alpha(obs=5); run;" in out and "data Work.beta; set s_beta(obs=3); run;" in out
    assert calls == [("load", {"t": "alpha", "n": "5"}), ("load", {"t": "beta", "n": "3"})]
    assert macros(text)[0]["load"].params == [("t", None), ("n", "3")]
    assert split_args("a, f(b, c), 'd,e'") == ["a", "f(b, c)", "'d,e'"]
    assert expand("x &unknown y")[0] == "x &unknown y"
    loop = expand("%macro r; %r %mend; %r")
    assert len(loop.calls) <= 50 and loop.cut and not expand(text).cut
    left = expand("%macro m(t, u); data &t; set &u..x; run; %mend; %let u = outer; %m(a); %m(b, lib) data c; set '&u' \"&u.1\"; run; /* %m(z) */")
    assert "data a; set &u..x;" in left.text and "data b; set lib.x;" in left.text and "'&u' \"outer1\"" in left.text and "%m(z)" in left.text
    assert [b.status for b in split_blocks(left.text)] == ["PARTIAL", "PARSED", "PARTIAL"]
    m = macros("%macro two(t); %macro inner; x %mend; data a; set &t; run; proc sort data=a out=b; by x; run; %mend two; rest")
    assert m[1].strip() == "rest" and m[0]["two"].of_steps
    assert [(b.id, b.reads, b.writes) for b in step_blocks(m[0]["two"], "lib.c", def_id="7:9", instance=2)] == [("7:9#2.1", ["lib.c"], ["work.a"]), ("7:9#2.2", ["work.a"], ["work.b"])]


@pytest.mark.parametrize("text, reads, writes, status", [
    ("proc sql; create table o as select * from a, lib.b as x, (select q from c where z in (select k from d)) s left join e on x.i = e.i where a.t > 1; quit;", ["work.a", "lib.b", "work.c", "work.d", "work.e"], ["work.o"], "PARSED"),
    ("proc sql; create table o as with t as (select * from raw.s), u as (select * from t) select * from t, u; quit;", ["raw.s"], ["work.o"], "PARSED"),
    ("proc sql; insert into lib.o select year(d), trim(both ' ' from n) from a; delete from b where 1; update c set x = 1; drop table z; quit;", ["work.a"], ["lib.o", "work.b", "work.c"], "PARSED"),
    ("proc sql; create table o as select * from , b; quit;", ["work.b"], ["work.o"], "PARTIAL"),
    ("proc append base=x new=y; run;", ["work.y"], ["work.x"], "PARSED"),
    ("proc append base=x; run;", [], ["work.x"], "PARTIAL"),
    ("data a; set ; run;", [], ["work.a"], "PARTIAL"),
    ("data a; update m t; by k; run;", ["work.m", "work.t"], ["work.a"], "PARSED"),
    ("data a; infile datalines dsd dlm='|' truncover; input x $; datalines;\n1|2\n;\nrun;", [], ["work.a"], "PARSED"),
    ("data a; if _n_ = 1 then set one; set two; run;", ["work.one", "work.two"], ["work.a"], "PARSED"),
])
def test_tables_of_blocks(text, reads, writes, status):
    (b,) = split_blocks(text)
    assert (b.reads, b.writes, b.status) == (reads, writes, status)


def test_remarks():
    text = "/* top */\n\ndata a; /* in */\n  set b; /* end */\n/* after */\n\n\n/* before */\nx = '/* no */';\n* star remark;\nrun;"
    assert [(line, said, pos) for line, said, pos, _ in attach_remarks(text)] == [(1, "top", "leading"), (3, "in", "trailing"), (4, "end", "trailing"), (5, "after", "trailing"), (8, "before", "leading"), (10, "star remark", "leading")]
    assert bare(text) == "data a; set b; x = '/* no */'; run;"
    assert attach_remarks("/* only */") == [(1, "only", "prologue", None)] and bare("") == "" and attach_remarks("") == []
    assert attach_remarks("data\na /* mid */\nb;")[0][2] == "inline"


def test_include():
    files = {"a.sas": "one; %include 'b.sas'; ", "b.sas": "two;"}
    assert include("%include 'a.sas'; three; %include 'gone.sas';", files.get) == ("one; two;  three; ", ["gone.sas"])
    assert include("%include 'x';", lambda _: "%include 'x';")[1] == ["x"]


def order_of(cat, name, *cols):
    return [tuple(r) for r in cat.raw(name).orderBy("_seq").select(*cols).collect()]


def test_set_of_several_keeps_the_order(spark):
    cat = Catalog(spark)
    cat.put("a", spark.createDataFrame([(10, "x"), (2, "x"), (9, "y")], "n int, s string"), order=["n"])
    cat.put("b", spark.createDataFrame([("q", 100), ("p", 5)], "t string, n int"), order=["t", "n"])
    run_sas(cat, "data c; set a b; run; data d; set b c (drop=s); run; data one; if _n_ = 1 then set c; set b (keep=t); run;")
    assert order_of(cat, "c", "n") == [(2,), (9,), (10,), (5,), (100,)]
    assert order_of(cat, "d", "n") == [(5,), (100,), (2,), (9,), (10,), (5,), (100,)]
    assert {r.n for r in cat.get("one").collect()} == {2}


def test_sort_descending_keeps_an_order(spark):
    cat = Catalog(spark)
    rows = [(1, "a", 2.5), (2, "ab", None), (3, None, -1.0), (4, "b", 2.5), (5, "a", 7.0), (6, "é", 0.0)]
    cat.put("t", spark.createDataFrame(rows, "id int, s string, x double"), order=["id"])
    run_sas(cat, "proc sort data=t out=u; by descending s x; run; proc sort data=t out=v; by descending x; run; data f; set u; by descending s; if first.s; run;")
    assert order_of(cat, "u", "id") == [(6,), (4,), (2,), (1,), (5,), (3,)]
    assert order_of(cat, "v", "id") == [(5,), (1,), (4,), (6,), (3,), (2,)]
    assert sorted(r.id for r in cat.get("f").collect()) == [1, 2, 3, 4, 6]


def test_update_step(spark):
    cat = Catalog(spark)
    cat.put("m", spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (2, "b2", 2.5), (None, "n", 0.0)], "k int, s string, x double"), order=["k", "s"])
    cat.put("t", spark.createDataFrame([(1, 1, 5.0, None), (2, 1, None, "z"), (3, 2, 9.0, "y"), (4, 7, 1.0, None), (5, None, 3.0, "w")], "i int, k int, x double, extra string"), order=["i"])
    run_sas(cat, "data o; update m t (drop=i); by k; run;")
    assert sorted(map(tuple, cat.get("o").select("k", "s", "x", "extra").collect()), key=str) == sorted([(1, "a", 5.0, "z"), (2, "b", 9.0, "y"), (2, "b2", 2.5, None), (None, "n", 3.0, "w"), (7, None, 1.0, None)], key=str)
    assert order_of(cat, "o", "k", "s") == [(None, "n"), (1, "a"), (2, "b"), (2, "b2"), (7, None)]
    run_sas(cat, "data e; set t; if k > 99; run; data p; update m e (drop=i); by k; run;")
    assert cat.get("p").count() == 4


def test_infile(spark, tmp_path):
    (tmp_path / "a.txt").write_text('id|name|day\n1|"x|y"|01/31/2023\n2||.\n3|z\n')
    (tmp_path / "b.txt").write_text("  1 a\n\n2 .\n")
    cat = Catalog(spark, folder=str(tmp_path))
    run_sas(cat, "data a; infile 'a.txt' dsd dlm='pipe' truncover firstobs=2; input id name $ day :mmddyy10.; run; data b; infile 'b.txt'; input id name $; run; data c; infile 'b.txt' firstobs=2; input id name $; run;")
    assert order_of(cat, "a", "id", "name", "day") == [(1.0, "x|y", datetime.date(2023, 1, 31)), (2.0, None, None), (3.0, "z", None)]
    assert order_of(cat, "b", "id", "name") == [(1.0, "a"), (2.0, None)] and order_of(cat, "c", "id") == [(2.0,)]
    with pytest.raises(LanguageError):
        run_sas(cat, "data a; infile 'a.txt' recfm=n; input x; run;")


def test_with_and_exists(spark):
    cat = Catalog(spark, default="")
    cat.put("t", spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x int, s string"))
    cat.put("u", spark.createDataFrame([(1, 5), (1, 6), (9, 7)], "x int, y int"))
    got = run_hive(cat, "with big as (select x, y from u where y > 5), few as (select x from big) select t.x as x from t where exists (select f.x as one from few f where f.x = t.x)")
    assert [r.x for r in got.collect()] == [1]
    got = run_hive(cat, "select a.x as x from t a where not exists (select b.y as y from u b where b.x = a.x and b.y > 5) and a.x < (select max(y) as m from u)")
    assert sorted(r.x for r in got.collect()) == [2, 3]
    with pytest.raises(Exception, match="more than one row|SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        run_hive(cat, "select x from t where x = (select x from u)").collect()
    for q in ["with a as (select x from t) select * from a where exists (select y from u where u.x = a.x) limit 3"]:
        assert parse_select(A.show(parse_select(q))) == parse_select(q)
    with pytest.raises(LanguageError):
        parse_select("select x from t where x in (select x from u)")


def test_group_takes_one_row(spark):
    cat = Catalog(spark)
    cat.put("t", spark.createDataFrame([(1, "a", 9), (1, "b", 1)], "g int, s string, n int"))
    run_sas(cat, "proc sql; create table o as select g, s, n, count(*) as c from t group by g; quit;")
    assert [tuple(r) for r in cat.get("o").collect()] == [(1, "a", 9, 2)]  # a row that exists


def test_stored_tables(spark, tmp_path):
    cat = Catalog(spark, default="", warehouse=str(tmp_path / "w"), folder=str(tmp_path))
    cat.put("t", spark.createDataFrame([(1, "a"), (2, "b")], "x int, s string"))
    run_hive(cat, "create table o as select * from t where x > 1; create table p (x int); insert into p select x from t; insert into p select x + 5 as x from t;")
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "w/p")).collect()) == [1, 2, 6, 7] and spark.read.parquet(str(tmp_path / "w/o")).count() == 1
    p = Pig(cat)
    p.run("STORE t INTO 'out' USING PigStorage('|'); back = LOAD 'out' USING PigStorage('|') AS (x:int, s:chararray);")
    assert sorted(map(tuple, p.rels["back"].collect())) == [(1, "a"), (2, "b")]
    cat.folder = None
    p.run("STORE t INTO 'gone';")
    assert "was not written" in cat.messages[-1]


def test_cogroup_aggregates_without_bags(spark):
    cat = Catalog(spark, default="")
    cat.put("t", spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0)], "x int, y double"))
    cat.put("u", spark.createDataFrame([(1, "a"), (3, "b"), (3, "c")], "k int, s string"))
    rels = Pig(cat).run("c = COGROUP t BY x, u BY k; a = FOREACH c GENERATE group AS g, SIZE(t) AS n, COUNT(u) AS m, SUM(t.y) AS total, MAX(u.s) AS top; b = FOREACH c GENERATE group AS g, t, SIZE(u) AS m; d = COGROUP t BY x INNER, u BY k INNER; e = FOREACH d GENERATE group, COUNT(t) AS n;")
    assert sorted(map(tuple, rels["a"].collect())) == [(1, 2, 1, 5.0, "a"), (2, 1, 0, 5.0, None), (3, 0, 2, None, "c")]
    assert "collect_list" not in rels["a"]._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.g, len(r.t), r.m) for r in rels["b"].collect()) == [(1, 2, 1), (2, 1, 0), (3, 0, 2)]
    assert [tuple(r) for r in rels["e"].collect()] == [(1, 2)]
