"""Orphans, change feeds, snapshots and hierarchies: against plain Python, with nulls, ties, repeats, empty tables and clashing columns."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators.changefeed import DELETE, PATCH, PUT, MergeStore, latest_copy
from quillspan.operators.hierarchy import below, hierarchy, intervals
from quillspan.operators.orphans import broken_references
from quillspan.operators.snapshots import snapshot_changes
from quillspan.plans import data_problems
from quillspan.session import Scratch, spread


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("match", ["simple", "partial", "full", "strict"])
def test_broken_references(spark, match):
    refs = [(1, "a", "x"), (2, "a", "q"), (3, None, "x"), (4, None, "q"), (5, "a", None), (6, "z", None), (7, None, None), (2, "a", "q")]
    targets = [("a", "x"), ("a", "x"), ("b", "y"), (None, "w"), (None, None)]
    r = spark.createDataFrame(refs, "id int, k string, l string")
    t = spark.createDataFrame([(*x, 9) for x in targets], "k string, l string, id int")  # id and names clash with refs
    got = sorted(x.id for x in broken_references(r, t, ["k", "l"], match).collect())

    def broken(k, l):
        if k is None and l is None:
            return False
        if match == "simple":
            return None not in (k, l) and (k, l) not in targets
        if match == "partial":
            return not any((k is None or k == a) and (l is None or l == b) for a, b in targets)
        return None in (k, l) or (k, l) not in targets

    assert got == sorted(i for i, k, l in refs if broken(k, l))
    assert broken_references(r, t.limit(0), ["k", "l"], match).count() == {"simple": 3, "partial": 7, "full": 7, "strict": 7}[match]
    assert broken_references(r.limit(0), t, ["k", "l"], match).count() == 0


def test_late_references(spark):
    r = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", None), (4, "c", 5)], "id int, k string, at int")
    t = spark.createDataFrame([("a", 3), ("a", 9), ("b", 1), ("c", None)], "k string, t int")
    assert rows(broken_references(r, t, ["k"], "simple", "at", "t").select("id", "state")) == [(2, "late")]


def replay(changes):
    state = {}
    for k, _, _, op, v in sorted(changes, key=lambda c: (c[1] is not None, c[1] or 0, c[2])):
        if op == PUT or (op == PATCH and k in state):
            state[k] = v
        elif op == DELETE:
            state.pop(k, None)
    return state


def test_merge_store(spark):
    rnd = random.Random(3)
    ops = [PUT, DELETE, PATCH, "other", None]
    changes = [(rnd.choice([None, "", "a", "b", "hot", "hot", "hot", f"k{rnd.randrange(30)}"]), rnd.choice([None, *range(20)]), i, rnd.choice(ops), f"v{i}") for i in range(400)]
    want = replay(changes)
    for fan_in in (2, 3, 9):
        rnd.shuffle(changes)
        store = MergeStore(spark, ["k"], ["t", "i"], "op", ["v"], buckets=3, fan_in=fan_in)
        for n in range(0, len(changes), 80):
            part = changes[n : n + 80] + rnd.sample(changes, 15)  # repeats, out of order
            store.append(spark.createDataFrame(part, "k string, t int, i int, op string, v string"))
        assert {r.k: r.v for r in store.read().collect()} == want
        assert max(store.runs.values()) < fan_in or len(store.runs) == 1
        store.compact()
        assert sum(store.runs.values()) == 1 and {r.k: r.v for r in store.read().collect()} == want
        store.close()
    empty = MergeStore(spark, ["k"], ["t", "i"], "op", ["v"], buckets=2)
    with pytest.raises(ValueError):
        empty.read()
    empty.append(spark.createDataFrame([], "k string, t int, i int, op string, v string"))
    assert empty.read().count() == 0
    empty.close()


def test_merge_reads_without_shuffle(spark):
    store = MergeStore(spark, ["k"], ["t"], "op", ["v"], buckets=4, fan_in=3)
    for n in range(5):
        store.append(spark.createDataFrame([("a", n, PUT, "x")], "k string, t int, op string, v string"))
    assert store.runs == {0: 2, 1: 1}
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    store.close()


FEED = "id string, got int, at int, k string, op string"


def test_merge_store_takes_amendments(spark):
    """The deliveries of a change in every order: only the latest counts, also where it moves the change to another key or takes it back."""
    feed = [("e1", 1, 1, "A", PUT), ("e1", 1, 1, "A", PUT), ("e1", 5, 1, "B", PUT), ("e2", 2, 2, "A", PATCH), ("e3", 3, 9, "C", DELETE), ("e3", 4, 0, "C", DELETE), ("e4", 2, 5, "C", PUT),
            ("e5", 1, 3, "D", PUT), ("e5", 6, 3, "D", "confirm"), (None, 1, 1, "E", PUT), (None, 1, 2, None, PUT), (None, None, 2, None, PUT)]
    want = {("B", "e1"), ("C", "e4"), ("E", None), (None, None)}
    rnd = random.Random(1)
    for fan_in in (2, 4):
        for last in range(3):
            rnd.shuffle(feed)
            store = MergeStore(spark, ["k"], ["at", "id"], "op", ["id"], change=["id"], version=["got"], buckets=2, fan_in=fan_in)
            parts = [feed[i::5] for i in range(5)] if last else [[f for f in feed if f != ("e1", 5, 1, "B", PUT)], [("e1", 5, 1, "B", PUT)]]  # the amendment alone and last
            for part in parts:
                store.append(spark.createDataFrame(part, FEED))
            got = [(r.k, r.id) for r in store.read().collect()]
            assert len(got) == len(want) and set(got) == want
            store.close()
    assert not any(t.name.startswith("runs_") for t in spark.catalog.listTables())


def test_merge_store_against_replay(spark):
    rnd = random.Random(8)
    feed = [(f"e{rnd.randrange(120)}", rnd.randrange(50), rnd.choice([None, *range(9)]), rnd.choice(["hot", "hot", None, "a", "b", "c"]), rnd.choice([PUT, PATCH, DELETE, "confirm", None])) for _ in range(400)]
    feed = list({(i, got): (i, got, *more) for i, got, *more in feed}.values())
    latest = {}
    for i, got, *more in sorted(feed, key=lambda f: f[1]):
        latest[i] = more
    want = replay([(k, at, int(i[1:]), op, i) for i, (at, k, op) in latest.items()])
    store = MergeStore(spark, ["k"], ["at", "no"], "op", ["id"], change=["id"], version=["got"], buckets=3, fan_in=2)
    for n in range(0, len(feed), 60):
        store.append(spark.createDataFrame(feed[n : n + 60] + rnd.sample(feed, 10), FEED).selectExpr("*", "cast(substring(id, 2) as int) as no", "1 as held", "2 as anchor"))
    assert {r.k: r.id for r in store.read().collect()} == want
    state = store.read()
    store.release()
    assert {r.k: r.id for r in state.collect()} == want  # readable without the catalog
    assert not any(t.name.startswith("runs_") for t in spark.catalog.listTables())


def test_arrivals(spark):
    df = spark.sql("select id, if(id % 7 = 0, null, timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, int(id % 50))) as at from range(500)")
    parts = data_problems.arrivals(df, "at", 4)
    assert sorted(r.id for p in parts for r in p.select("id").collect()) == list(range(500))
    assert len(parts) == 4 and min(p.count() for p in parts) > 50
    assert [p.count() for p in data_problems.arrivals(df.limit(0), "at", 4)] == [0]


def test_latest_copy(spark):
    df = spark.createDataFrame([("e", 1, "x"), ("e", 2, "y"), ("e", None, "z"), ("f", None, "a"), ("f", None, "b"), ("f", None, "b")], "id string, t int, v string")
    assert rows(latest_copy(df, "id", ["t"], ["v"])) == [("e", "y"), ("f", "b")]


def test_snapshot_changes(spark):
    rnd = random.Random(5)
    data = []
    for s in range(1, 6):
        for k in range(40):
            for _ in range(rnd.choice([0, 1, 1, 2])):
                data.append((s, rnd.choice([None, 1, 2, 3]), f"k{k}", rnd.choice([None, "", "A", "B"])))
    data += [(3, 1, None, "A"), (None, 1, "k1", "A")]
    df = spark.createDataFrame(data, "snap int, at int, k string, v string").selectExpr("*", "1 as before", "2 as change_type")
    held = {}
    for s, at, k, v in data:
        if k is not None and s is not None:
            key = (at is not None, at or 0, v is not None, v or "")
            if (s, k) not in held or key >= held[s, k][0]:
                held[s, k] = (key, v)
    want = []
    for s in range(2, 6):
        for k in {k for _, k in held}:
            a, b = held.get((s - 1, k)), held.get((s, k))
            if a and not b:
                want.append((s, k, "removed"))
            elif b and not a:
                want.append((s, k, "added"))
            elif a and b and a[1] != b[1]:
                want.append((s, k, "changed"))
    assert rows(snapshot_changes(df, ["k"], "snap", "at", ["v"])) == sorted(want, key=str)
    assert snapshot_changes(df.limit(0), ["k"], "snap", "at", ["v"]).count() == 0


def test_snapshots_that_were_never_delivered(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (7, "a", "x"), (7, "c", "x"), (9, "a", "y"), (9, "b", "x")], "snap int, k string, v string").withColumn("at", F.lit(1))
    assert rows(snapshot_changes(df, ["k"], "snap", "at", ["v"])) == sorted([(7, "b", "removed"), (7, "c", "added"), (9, "a", "changed"), (9, "b", "added"), (9, "c", "removed")], key=str)


def tree(parent):
    out = {}
    for v in parent:
        seen, x = [v], v
        while parent[x] is not None and parent[x] not in seen:
            x = parent[x]
            seen.append(x)
        if parent[x] is None:
            out[v] = (x, len(seen) - 1)
        else:
            out[v] = ("", -1 if parent[x] == v else -2)
    return out


@pytest.mark.parametrize("every", [1, 4, 1000])
def test_hierarchy(spark, every):
    rnd = random.Random(every)
    parent = {f"c{i}": f"c{i - 1}" if i else None for i in range(60)}  # a deep chain
    parent |= {f"n{i}": rnd.choice([f"n{rnd.randrange(i)}", "c40", "hub"]) if i else None for i in range(80)}
    parent |= {"hub": None, "self": "self", "r0": "r4", **{f"r{i}": f"r{i - 1}" for i in range(1, 5)}, "below": "r2", "below2": "below", "under": "self"}
    parent |= {f"q{i}": f"q{(i - 1) % 37}" for i in range(37)}  # a long loop
    links = [("g", v, p, "x") for v, p in parent.items()] + [("g", "n5", parent["n5"], "y"), (None, "a", "b", ""), ("g", None, None, ""), ("h", None, "alone", "")]
    df = spark.createDataFrame(links, "scope string, v string, p string, root string")
    got = hierarchy(df, "scope", "v", "p", every=every, with_path=True).collect()
    assert len(got) == len(parent) + 3
    want = tree(parent)
    for r in got:
        if r["scope"] == "g":
            assert (r.root, r.depth) == want[r.node], r
            if r.depth >= 0:
                assert r.path[0] == r.root and r.path[-1] == r.node and len(r.path) == r.depth + 1
                assert all(parent[b] == a for a, b in zip(r.path, r.path[1:]))
    assert {(r["scope"], r.node, r.root, r.depth) for r in got if r["scope"] != "g"} == {(None, "a", "b", 1), (None, "b", "b", 0), ("h", "alone", "alone", 0)}


def test_hierarchy_below_and_empty(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b")], "v string, p string").selectExpr("'x' as g", "v", "p")
    assert rows(below(hierarchy(df, "g", "v", "p", with_path=True), "g")) == [("x", "a", "b", 1), ("x", "a", "c", 2), ("x", "a", "d", 2), ("x", "b", "c", 1), ("x", "b", "d", 1)]
    assert hierarchy(df.limit(0), "g", "v", "p").count() == 0


def test_intervals(spark):
    rnd = random.Random(4)
    parent = {"n0": None, **{f"n{i}": rnd.choice([f"n{rnd.randrange(i)}", "n0", f"n{i - 1}"]) for i in range(1, 90)}, "other": None, "o1": "other", "self": "self", "below": "self"}
    df = spark.createDataFrame([("x", v, p) for v, p in parent.items()] + [(None, "b", "a")], "g string, v string, p string")
    got = {(r.g, r.node): r for r in intervals(df, "g", "v", "p").collect()}
    assert {k[1] for k in got if k[0]} == set(parent) - {"self", "below"} and len(got) == len(parent)
    above = {}
    for v in parent:
        x, above[v] = parent[v], set()
        while x and x not in above[v]:
            above[v].add(x)
            x = parent[x]
    for (g, v), r in got.items():
        inside = {w for (h, w), o in got.items() if h == g and o.root == r.root and r.enter < o.enter < r.leave}
        assert inside == ({w for w in parent if v in above[w]} - {"self", "below"} if g else {"b"} if v == "a" else set())
        assert r.leave - r.enter == 2 * len(inside) + 1
    assert intervals(df.limit(0), "g", "v", "p").count() == 0


def test_scratch_is_closed(spark, tmp_path):
    s = Scratch(spark, "t")
    kept, n = s.counted(spark.range(10), F.col("id") > 6)
    assert n == 3 and kept.count() == 10
    where = s.root.removeprefix("file://")
    assert os.path.isdir(where)
    s.close()
    assert not os.path.exists(where)


def test_spread(spark):
    df = Scratch(spark, "t").write(spark.createDataFrame([(1, "a")], "k int, t string").coalesce(1))
    assert spread(df, "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    big = spark.range(0, 1 << 30, 1, 1)
    assert spread(big, "id").rdd.getNumPartitions() == 1
