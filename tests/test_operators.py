"""Verification, graph, store, sources, sinks and the event stream; with nulls, repeats and empty tables."""

import datetime
import io
import random

import pyarrow as pa
import pytest

from quillspan.lang.facts import facts
from quillspan.lang.parser import parse_expr
from quillspan.operators import graph, lineage, store, verify
from quillspan.operators.ranking import global_rank, latest_before, running_sum
from quillspan.operators.registry import SCHEMA, Conflict, MacroRegistry
from quillspan.sources import readers, writers
from quillspan.streaming import eventlog
from pyspark.sql import functions as F


@pytest.mark.parametrize("ref, conv, verdict, n", [
    ([(1, 2.0)], [(1, 2.0)], "PASS", 0), ([(1, 200.0)], [(1, 999.0)], "FAIL", 2), ([(1, 30.376666666666665), (2, 5.0)], [(2, 5.0), (1, 30.3766667)], "PASS", 0),
    ([(1, 1.0), (1, 1.0)], [(1, 1.0)], "FAIL", 1), ([(None, float("nan"))], [(None, float("nan"))], "PASS", 0), ([], [], "PASS", 0), ([(1, None)], [], "FAIL", 1)])
def test_compare_rows(spark, ref, conv, verdict, n):
    a, b = (spark.createDataFrame(x, "a int, b double") for x in (ref, conv))
    assert tuple(verify.compare_rows(a, b).first()) == (verdict, n)
    assert verify.samples(a, b).count() <= 5


def test_missing_sides(spark):
    a = spark.createDataFrame([(1,)], "a int")
    assert verify.compare_rows(None, a).first().verdict == "REF_MISSING"
    assert verify.compare_rows(a, None).first().verdict == "CONV_MISSING"
    assert verify.compare_rows(None, None, spark).first().verdict == "REF_MISSING"


@pytest.mark.parametrize("mutate", ["drop", "double", "change", "swap"])
def test_mutations_are_found(spark, mutate):
    rows = [(i, f"n{i % 7}", i / 3) for i in range(50)]
    bad = {"drop": rows[1:], "double": rows + rows[:1], "change": [(0, "n0", 0.00001)] + rows[1:], "swap": [(r[0], r[1], -r[2]) for r in rows]}[mutate]
    a, b = (spark.createDataFrame(x, "a int, b string, c double") for x in (rows, bad))
    assert verify.compare_rows(a, b).first().verdict == "FAIL"


def test_legs(spark):
    found = verify.legs(parse_expr("a > 1 and (b = 2 or c < 3)"))
    assert len(found) == 3 and len(found[2][1]) == 2
    df = spark.createDataFrame([(0, 2, 0), (5, 2, 9), (5, 0, 1), (None, None, None)], "a int, b int, c int")
    assert [(r.n_true, r.n_false) for r in verify.leg_coverage(df, parse_expr("a > 1 and (b = 2 or c < 3)")).orderBy("leg_no").collect()] == [(2, 2), (1, 1), (1, 0)]


def test_global_rank_and_latest_before(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", "a", "b", None]), i, rnd.random() < 0.3) for i in range(500)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "k string, n int, w boolean").repartition(6)
    assert all(r["rank"] == r.n + 1 for r in global_rank(df, ["n"]).collect())
    for r in latest_before(df, ["k"], "n", F.col("w"), "prev", width=16).collect():
        assert r.prev == max((n for k, n, w in data if k == r.k and w and n < r.n), default=None)
    assert latest_before(df.limit(0), ["k"], "n", F.col("w"), "prev").count() == 0


def reachable(edges, a):
    seen, todo = set(), [a]
    while todo:
        x = todo.pop()
        for s, d in edges:
            if s == x and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_graph(spark, seed):
    rnd = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(18)]
    # the first has loops and several parents, the second at most one parent
    edges = {(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(26)} if seed == 1 else {(rnd.choice(nodes), d) for d in nodes[2:]} | {("n03", "n03x"), ("n03x", "n03y")}
    df = spark.createDataFrame([*edges, ("n01", None)], "src string, dst string")
    used = {x for e in edges for x in e}
    far = {a: reachable(edges, a) for a in used}
    assert {(r.src, r.dst) for r in graph.closure(df).collect()} == {(a, b) for a in used for b in far[a]}
    comp = {r.node: r.component for r in graph.components(df).collect()}
    assert comp == {a: min([a, *(b for b in far[a] if a in far[b])]) for a in used}
    order = {r.node: r for r in graph.run_order(df).collect()}
    for a in used:
        assert order[a].in_loop == (a in far[a])
        before = [s for s, d in edges for m in used if comp[m] == comp[a] and d == m and comp[s] != comp[a]]
        assert order[a].level == max((order[s].level + 1 for s in before), default=0)
    start = spark.createDataFrame([("n04",), (None,)], "node string")
    assert {r.node for r in graph.reach(df, start, 20).collect()} == {"n04"} | far.get("n04", set())
    assert graph.components(df.limit(0)).count() == 0


def test_store_upsert_and_delta(spark):
    cols = "fileid string, src string, dst string, level string, block_id string"
    old = spark.createDataFrame([("f", "a", "b", "block", "b1"), ("f", "a", "c", "block", "b2"), ("g", "x", "y", "file", None)], cols)
    new = spark.createDataFrame([("f", "a", "b", "block", "b9"), ("f", "q", "r", "block", "b9"), ("h", "n", "m", "block", "b1")], cols)
    assert {(r.src, r.colour) for r in store.freshness(new, old).collect()} == {("a", "yellow"), ("q", "red"), ("n", "green")}
    assert [tuple(r) for r in store.lost_flows(new, old).collect()] == [("f", "a", "c", "block", "b2")]
    assert {(r.src, r.change) for r in store.save_delta(new, old).collect()} == {("q", "added"), ("n", "added"), ("a", "removed"), ("x", "removed")}
    assert sorted(r.fileid for r in writers.upsert(old, new, "fileid").collect()) == ["f", "f", "g", "h"]
    assert store.freshness(new.limit(0), old).count() == 0


def test_facts_of_subquery():
    got = facts("proc sql; create table work.t as select s.q as z from (select max(a) as q, b from lib.x where c = 1 group by b) s where s.b > (select min(m) from lib.y); quit;", {"lib.x": ["a", "b", "c"], "lib.y": ["m"]})
    assert ("col", "work.t", "z", "lib.x", "a") in got and ("ctl", "work.t", "", "lib.y", "m") in got and ("ctl", "work.t", "", "lib.x", "c") in got
    assert {f[3] for f in got if f[0] == "ds"} == {"lib.x", "lib.y"}


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, datetime.date(2020, 1, 2)), (None, None, None), ("c", 1 / 3, datetime.date(1960, 1, 1))], "name string, n double, d date")
    assert [tuple(r) for r in writers.canonical(df, {"d": "mmddyy10"}).collect()] == [("a", "1.5", "01/02/2020"), (".", ".", "."), ("c", "0.333333333333", "01/01/1960")]
    writers.write_canonical(df, str(tmp_path / "c"), {"d": "mmddyy10"})
    back, formats = readers.schema_csv(spark, str(tmp_path / "c"), '[{"name": "name", "type": "char"}, {"name": "n", "type": "num"}, {"name": "d", "type": "date", "format": "mmddyy10"}]')
    assert formats == {"d": "mmddyy10"} and sorted(map(str, back.select("name", "d").collect())) == sorted(map(str, df.select("name", "d").collect()))
    text = writers.listing_text(df, "work.x", ["d"])
    assert writers.listing_text(df, "work.x", ["d"], most=2).endswith("more rows were left out\n") and writers.listing_text(df, "work.x", ["d"], most=3) == text
    assert len(writers.listing_text(df.limit(0), "work.x", ["d"]).splitlines()) == 2
    lines = spark.createDataFrame(list(enumerate(text.splitlines())), "i int, line string")
    assert [(r.title, r.obs, r["values"][0]) for r in readers.listing(lines, "i", "line").orderBy("obs").collect()] == [("work.x", 1, "."), ("work.x", 2, "c"), ("work.x", 3, "a")]
    same, sink = spark.createDataFrame([("same",)] * 500, "s string"), io.BytesIO()
    assert writers.arrow_stream(same, sink) == 500 and pa.ipc.open_stream(io.BytesIO(sink.getvalue())).read_all().num_rows == 500
    blob = writers.arrow_parts(same).first().blob
    assert pa.types.is_dictionary(pa.ipc.open_stream(bytes(blob)).schema[0].type)
    assert writers.from_arrow_parts(writers.arrow_parts(same), "s string").distinct().count() == 1
    empty = io.BytesIO()
    assert writers.arrow_stream(same.limit(0), empty) == 0 and pa.ipc.open_stream(io.BytesIO(empty.getvalue())).read_all().num_rows == 0
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "part-0.csv").write_text("a,b\n1,2\n")
    (tmp_path / "p" / "_SUCCESS").write_text("")
    assert [tuple(r) for r in readers.part_files(spark, str(tmp_path / "p"), ["a", "b"]).collect()] == [("1", "2")]


def test_listing_of_many_columns(spark):
    wide = " ".join(f"v{i}" for i in range(1500))
    lines = spark.createDataFrame(list(enumerate(["Table: work.w", "obs a b", f"1 {wide}", "2"])), "i int, line string")
    got = {r.obs: list(r["values"]) for r in readers.listing(lines, "i", "line").collect()}
    assert got == {1: wide.split(), 2: []}


def test_estate(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "X.sas").write_text("data a; run;")
    (tmp_path / "y.sas").write_text("data b; run;")
    all_ = readers.estate(spark, str(tmp_path))
    assert sorted(r.fileid for r in all_.collect()) == ["sub/x.sas", "y.sas"]
    known = spark.createDataFrame(all_.filter("fileid = 'y.sas'").collect())
    assert [r.fileid for r in readers.estate(spark, str(tmp_path), known).collect()] == ["sub/x.sas"]
    assert readers.estate(spark, str(tmp_path), known, version="2").count() == 2


def test_event_stream_equals_batch(spark, tmp_path):
    schema = "seq long, ts timestamp_ntz, session_id string, event_type string, fileid string, payload string"
    t = datetime.datetime(2025, 1, 1)
    log = [(1, t, "s1", "file_ingested", "a", None), (2, t, "s1", "file_ingested", "b", None), (3, t, "s2", " FILE_REMOVED", "A", None), (4, t, "s3", "file_ingested", "c", None), (5, t, "s3", "file_enriched", "b", None), (6, t, "s4", "file_ingested", "a ", None)]
    df = spark.createDataFrame(log, schema)
    df.filter("seq in (3, 4, 6)").write.parquet(str(tmp_path / "in" / "1"))  # later events arrive first
    df.filter("seq not in (4, 6)").write.parquet(str(tmp_path / "in" / "2"))
    folded = eventlog.file_store(spark)
    eventlog.follow(spark, f"{tmp_path}/in/*", df.schema, str(tmp_path / "ck"), folded).awaitTermination()
    assert {r.fileid: r.set_by for r in folded.read().collect()} == {"a": "s4", "b": "s1", "c": "s3"}
    assert {r.fileid for r in store.latest_state(df).filter("present").collect()} == {"a", "b", "c"}
    assert sum(r.n for r in eventlog.per_window(df).collect()) == 6


def test_workflow_and_transfer():
    from quillspan.lang.parser import LanguageError
    from quillspan.lang.workflows import transfer, workflow

    nodes, edges = workflow('<workflow-app><start to="a"/><action name="a"><pig/><ok to="e"/><error to="k"/></action><kill name="k"/><end name="e"/></workflow-app>')
    assert ("a", "action", "pig") in nodes and ("a", "k", "error") in edges
    with pytest.raises(LanguageError):
        workflow('<workflow-app><start to="nowhere"/></workflow-app>')
    assert transfer("sqoop export --connect c --table t --export-dir /d --batch --input-null-string x")["options"] == {"batch": "true", "input-null-string": "x"}
    with pytest.raises(LanguageError):
        transfer("sqoop eval --connect c")


def test_plan_lineage(spark):
    from quillspan.lang.planlineage import lineage

    a = spark.createDataFrame([(1, 2)], "x int, y int")
    df = a.filter("y > 1").groupBy((F.col("x") + F.col("y")).alias("k")).agg(F.max("y").alias("m"), F.count("*").alias("n")).withColumn("z", F.col("m") * 2)
    assert lineage(df) == [("k", "x"), ("k", "y"), ("m", "y"), ("z", "y")]


def test_lifecycle_and_verdicts(spark):
    from quillspan.operators import reports

    e = spark.createDataFrame([("1", 1, "add", "f", True), ("2", 2, "confirm", "f", None), ("3", 3, "reject", "f", True), ("4", 1, "add", "g", True), ("5", 9, "reject", "g", False), ("6", None, "add", None, True)], "edit_id string, at int, action string, src string, requires_check boolean")
    got = {r.edit_id: (r.cleared, r.out_of_queue) for r in reports.edit_lifecycle(e, ["src"]).collect()}
    assert got == {"1": (True, False), "2": (False, False), "3": (False, False), "4": (False, True), "5": (False, False), "6": (False, False)}
    t = spark.createDataFrame([(True, False, True), (False, True, True), (True, True, True), (True, False, False)], "p boolean, b boolean, r boolean")
    assert [r[0] for r in t.select(reports.three_way(F.col("p"), F.col("b"), F.col("r"))).collect()] == ["rows", "MISSING", "bytes", "FAIL"]
    m = spark.createDataFrame([("a", "f1"), ("a", "f2"), ("b", "f1")], "macroname string, fileid string")
    assert {r.macroname: (r.n_defined, r.calls) for r in reports.pivot_by_macro(m, m.filter("macroname = 'a'")).collect()} == {"a": (2, 2), "b": (1, 0)}
    c = spark.createDataFrame([(2, "added"), (2, "removed"), (2, "added"), (3, "changed")], "v int, change_type string")
    assert {r.v: (r.n_added, r.n_removed, r.n_changed) for r in reports.timeline(c, "v").collect()} == {2: (2, 1, 0), 3: (0, 0, 1)}


def test_delimited_and_single_block(spark):
    from quillspan.catalog import Catalog
    from quillspan.plans.programs import run_sas

    lines = spark.createDataFrame([("1|\"a|b\"|2.5",), ("2|.|",), ("3",), (None,)], "line string")
    assert [tuple(r) for r in readers.delimited(lines.filter("line is not null"), "line", "id int, s string, n double").collect()] == [(1, "a|b", 2.5), (2, None, None), (3, None, None)]
    cat = Catalog(spark)
    cat.put("a", spark.createDataFrame([(1,), (5,)], "x int"), ["x"])
    run_sas(cat, "data work.a; set work.none; run; data work.b; set work.a; if x > 2; run;", block=1)
    assert [r.x for r in cat.get("b").collect()] == [5] and not cat.messages


def test_listing_of_several_tables(spark):
    text = ["no title yet", "1 lost", "Table: a.x", "Obs v", "1 p", "", "2 q", "Table: b.y", "Obs v", "1 r"] + ["filler"] * 9000 + ["2 s"]
    got = readers.listing(spark.createDataFrame(list(enumerate(text)), "i int, line string").repartition(3), "i", "line").collect()
    assert sorted((r.title, r.obs, r["values"][0]) for r in got) == [("a.x", 1, "p"), ("a.x", 2, "q"), ("b.y", 1, "r"), ("b.y", 2, "s")]


def test_running_sum(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["hot", "hot", "a", None]), rnd.randrange(-9000, 30000), rnd.choice([1, 0, None, 3])) for _ in range(2000)]
    got = running_sum(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], "o", "v", "s").collect()
    assert len(got) == len(rows)
    for r in rnd.sample(got, 60):
        assert r.s == sum(v or 0 for k, o, v in rows if k == r.k and o <= r.o)


def test_block_law(spark):
    rows = [("f", 1, 1, 3), ("f", 2, 5, 6), ("f", 3, 12, 13), ("f", 4, 14, 14), ("f", 5, 16, 40), ("f", 6, 41, 41), (None, 1, 1, 2), ("g", 1, 10, 10), ("g", 2, 30, 31)]
    got = {(r.fileid, r.n): r.run for r in lineage.block_law(spark.createDataFrame(rows, "fileid string, n int, l0 int, l1 int")).collect()}
    assert got == {("f", 1): 0, ("f", 2): 0, ("f", 3): 0, ("f", 4): 1, ("f", 5): 2, ("f", 6): 3, (None, 1): 0, ("g", 1): 0, ("g", 2): 1}


def test_registry_refuses_the_slower_writer(spark, tmp_path):
    r = MacroRegistry(spark, str(tmp_path / "reg"))
    row = lambda f, h, m: spark.createDataFrame([(f, h, m, ["a"], f"body {h}")], SCHEMA)
    assert r.version() == 0 and r.read().count() == 0
    seen = r.version()
    assert r.write(row("f.sas", "1", "M"), seen) == 1
    with pytest.raises(Conflict):
        r.write(row("g.sas", "1", "n"), seen)
    assert r.write(row("f.sas", "1", "other"), 1) == 1  # a known hash changes nothing
    assert r.write(row("f.sas", "2", "M"), 1) == 2 and r.macros() == {"m": (["a"], "body 2")}
    (tmp_path / "reg" / "claim3").write_text("")
    with pytest.raises(Conflict):
        r.write(row("g.sas", "1", "n"), 2)


def test_prune_checkpoints():
    day = 86400.0
    assert store.prune([(1, 0.0), (2, 10 * day), (3, 40 * day)], 50 * day) == [1, 2] and store.prune([(1, 0.0)], 99 * day) == [] and store.prune([], 0.0) == []


def test_order_of_loops(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("s", "s"), ("s", "t"), ("x", "y")]
    for extra in ([], [("x", "b"), ("y", "e")]):  # with and without nodes of several sources
        e = spark.createDataFrame([*links, *extra, links[0]], "src string, dst string")
        got = {r.node: (r.component, r.in_loop, r.level) for r in graph.run_order(e).collect()}
        up = 1 if extra else 0
        assert got["a"] == ("a", True, up) and got["b"][0] == got["c"][0] == "a" and got["d"] == ("d", False, up + 1) and got["e"][2] == up + 2
        assert got["s"] == ("s", True, 0) and got["t"][2] == 1 and got["x"][2] == 0 and got["y"][2] == 1
        said = {r.component: (r.members, r.src, r.dst) for r in graph.break_suggestions(graph.run_order(e), e).collect()}
        assert said == {"a": (3, "c", "a"), "s": (1, "s", "s")}


def test_closure_by_leaps(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)] + [("l0", "l1"), ("l1", "l2"), ("l2", "l0"), ("n005", "l0")]
    e = spark.createDataFrame(chain, "src string, dst string")
    got = {(r.src, r.dst): r.hops for r in graph.closure(e).collect()}
    assert got["n000", "n070"] == 70 and got["l0", "l0"] == 3 and got["n004", "l2"] == 4 and len(got) == 71 * 70 // 2 + 9 + 6 * 3
    assert {k for k, h in got.items() if h <= 5} == {(r.src, r.dst) for r in graph.closure(e, 5).collect()}
    reached = {r.node: r.n_downstream for r in graph.radius(e, spark.createDataFrame([("n000",), ("l1",), ("gone",), (None,)], "node string")).collect()}
    assert reached == {"n000": 73, "l1": 2, "gone": 0}


def test_folder_links(spark):
    files = spark.createDataFrame([("d", "full.sas", "sas"), ("d", "q1.sas", "sas"), ("d", "part.sas", "sas"), ("d", "other.sas", "sas"), ("d", "part_x.py", "py"), ("d", "zzz.py", "py"), ("e", "q1.sas", "sas")], "folder string, name string, kind string")
    rules = spark.createDataFrame([("d", n, s, t) for n in ("full.sas", "q1.sas") for s, t in (("a", "b"), ("b", "c"))] + [("d", "part.sas", "a", "b"), ("d", "other.sas", "c", "z"), ("e", "q1.sas", "c", "k")], "folder string, name string, src string, dst string")
    got = {(r.from_name, r.to_name, r.kind) for r in lineage.folder_links(files, rules).collect()}
    assert got == {("full.sas", "other.sas", "flow"), ("q1.sas", "other.sas", "flow"), ("full.sas", "q1.sas", "same"), ("full.sas", "part.sas", "subset"), ("part.sas", "part_x.py", "derived")}


def test_partitioned_folders_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FOLDER_ROWS", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('f', id % 5)) as folder_path")
    writers.write_partitioned(df, str(tmp_path / "p"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "p" / "folder_path=hot").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1000
