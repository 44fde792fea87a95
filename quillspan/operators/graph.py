"""Questions to a graph of edges (src, dst). Iterative ones write each round and count; nothing else reaches the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.hierarchy import hierarchy
from quillspan.session import Scratch

#: Steps of a relaxation that one job takes before its result is written.
STEPS = 4


def reach(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "down") -> DataFrame:
    """Nodes within ``hops`` of the seeds (column node) along or against the edges: node, hop (0 for seeds)."""
    scratch = Scratch(edges.sparkSession, "reach")
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    step = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct()
    seen = scratch.write(seeds.select("node").filter("node is not null").distinct().withColumn("hop", F.lit(0)), "seen")
    front = seen
    for hop in range(1, hops + 1):
        new = front.join(step, F.col("node") == F.col("__a")).select(F.col("__b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        front, n = scratch.counted(new, F.lit(True), "front")
        if not n:
            break
        seen = seen.union(front)
    return seen


def roles(edges: DataFrame, seeds: DataFrame, up: int, down: int) -> DataFrame:
    """Neighbourhood with each node's role: seed, up, down or both."""
    u = reach(edges, seeds, up, "up").select("node", F.lit(1).alias("u"), F.lit(0).alias("d"), (F.col("hop") == 0).cast("int").alias("s"))
    d = reach(edges, seeds, down, "down").select("node", F.lit(0).alias("u"), F.lit(1).alias("d"), (F.col("hop") == 0).cast("int").alias("s"))
    return u.union(d).groupBy("node").agg(F.max("u").alias("u"), F.max("d").alias("d"), F.max("s").alias("s")).select("node", F.when(F.col("s") == 1, "seed").when((F.col("u") == 1) & (F.col("d") == 1), "both").when(F.col("u") == 1, "up").otherwise("down").alias("role"))


def closure(edges: DataFrame, within: int | None = None) -> DataFrame:
    """All (src, dst) with a path from src to dst, and its least length ``hops``; as many rows as there are such pairs.

    Paths are doubled: ``leap`` holds the pairs joined by a path of exactly 2^k edges, ``known`` those of up to 2^k. A round adds every
    known pair that goes on by a leap, so the rounds grow with the logarithm of the longest path.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    leap = scratch.write(edges.select("src", "dst").dropna().distinct(), "leap")
    known, n = leap.withColumn("hops", F.lit(1)), None
    length = 1
    while within is None or length < within:
        on = known.alias("p").join(leap.alias("q"), F.col("p.dst") == F.col("q.src")).select(F.col("p.src").alias("src"), F.col("q.dst").alias("dst"), (F.col("p.hops") + length).alias("hops"))
        more, count = scratch.counted(known.union(leap.withColumn("hops", F.lit(length))).union(on).groupBy("src", "dst").agg(F.min("hops").alias("hops")), F.lit(True), "known")
        if count == n:
            break
        leap, known, n, length = scratch.write(_leaps(leap), "leap"), more, count, 2 * length
    return known if within is None else known.filter(F.col("hops") <= within)


def _leaps(leap: DataFrame) -> DataFrame:
    """Pairs joined by two leaps."""
    return leap.alias("p").join(leap.alias("q"), F.col("p.dst") == F.col("q.src")).select(F.col("p.src").alias("src"), F.col("q.dst").alias("dst")).distinct()


def _one_parent(e: DataFrame) -> bool:
    return e.groupBy("dst").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def _tree(e: DataFrame) -> DataFrame:
    return hierarchy(e.withColumn("g", F.lit("")), "g", "dst", "src").drop("g")


def _forest_components(scratch: Scratch, e: DataFrame) -> DataFrame:
    """Where every node has at most one edge in, loops are told by the hierarchy operator; their least node by doubling along them."""
    tree = scratch.write(_tree(e), "tree")
    least = _ring_least(scratch, e, tree.filter("depth = -1").select("node"))
    return tree.select("node").join(least, "node", "left").select("node", F.coalesce("least", "node").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components: node, component (its least node).

    Nodes without an edge in or out among those left are components of their own and are trimmed; the rest is coloured by the least
    node that reaches each, and what reaches back within a colour is the component of that least node.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.write(edges.select("src", "dst").dropna().distinct(), "edges")
    if _one_parent(e):
        return _forest_components(scratch, e)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    left = scratch.write(e.filter("src != dst"), "left")
    found = []
    while not left.isEmpty():
        size = left.count()
        inner = left.select(F.col("src").alias("n")).intersect(left.select(F.col("dst").alias("n")))
        cut = scratch.write(left.join(inner, F.col("src") == F.col("n"), "left_semi").join(inner, F.col("dst") == F.col("n"), "left_semi"), "cut")
        if cut.count() < size:
            left = cut
            continue
        colour = scratch.write(left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")), "colour")
        while True:
            best = left.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("n")).agg(F.min("colour").alias("c"))
            next_, moved = scratch.counted(colour.join(best, F.col("node") == F.col("n"), "left").select("node", F.least("colour", "c").alias("colour"), (F.col("c") < F.col("colour")).alias("moved")), F.coalesce("moved", F.lit(False)), "colour")
            if not moved:
                break
            colour = next_.select("node", "colour")
        same = left.join(colour.select(F.col("node").alias("sn"), F.col("colour").alias("sc")), F.col("src") == F.col("sn")).join(colour.select(F.col("node").alias("dn"), F.col("colour").alias("dc")), F.col("dst") == F.col("dn")).filter("sc = dc")
        same = scratch.write(same.select("src", "dst", F.col("sc").alias("colour")), "same")
        back = scratch.write(colour.filter("node = colour").select("node", F.col("node").alias("component")), "back")
        front = back
        while True:
            new = front.join(same, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "component").distinct().join(back, "node", "left_anti")
            front, n = scratch.counted(new, F.lit(True), "front")
            if not n:
                break
            back = back.union(front)
        found.append(back)
        done = back.select(F.col("node").alias("n"))
        left = scratch.write(left.join(done, F.col("src") == F.col("n"), "left_anti").join(done, F.col("dst") == F.col("n"), "left_anti"), "left")
    if not found:
        return nodes.withColumn("component", F.col("node"))
    known = reduce(DataFrame.union, found)
    return nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def run_order(edges: DataFrame) -> DataFrame:
    """Level of each node in the order of runs: the longest way from a source after loops are condensed; node, component, in_loop, level."""
    scratch = Scratch(edges.sparkSession, "order")
    distinct = scratch.write(edges.select("src", "dst").dropna().distinct(), "edges")
    if _one_parent(distinct):
        return _forest_order(scratch, distinct)
    comp = scratch.write(components(distinct), "comp")
    size = comp.groupBy("component").agg(F.count("*").alias("size"))
    own = distinct.filter("src = dst").select(F.col("src").alias("node")).withColumn("own", F.lit(True))
    e = distinct.join(comp.select(F.col("node").alias("sn"), F.col("component").alias("a")), F.col("src") == F.col("sn")).join(comp.select(F.col("node").alias("dn"), F.col("component").alias("b")), F.col("dst") == F.col("dn"))
    e = scratch.write(e.filter("a != b").select("a", "b").distinct(), "condensed")
    level = scratch.write(size.select("component", F.lit(0).alias("level")), "level")
    while True:
        next_ = level
        for _ in range(STEPS):
            push = e.join(next_, F.col("a") == F.col("component")).groupBy(F.col("b").alias("c")).agg((F.max("level") + 1).alias("l"))
            next_ = next_.join(push, F.col("component") == F.col("c"), "left").select("component", F.greatest("level", "l").alias("level"))
        was = level.select("component", F.col("level").alias("was"))
        next_, moved = scratch.counted(next_.join(was, "component").withColumn("moved", F.col("level") > F.col("was")), F.col("moved"), "level")
        if not moved:
            break
        scratch.drop(level)
        level = next_.select("component", "level")
        level._scratch_path = next_._scratch_path
    return _ordered(comp, level, size, own)


def _forest_order(scratch: Scratch, e: DataFrame) -> DataFrame:
    """Where every node has at most one edge in: a node's depth is its level. Only what lies on or below loops is looked at again."""
    tree, lost = scratch.counted(_tree(e), F.col("depth") < 0, "tree")
    calm = tree.filter("depth >= 0").select("node", F.col("node").alias("component"), F.lit(False).alias("in_loop"), F.col("depth").alias("level"))
    if not lost:
        return calm
    ring = tree.filter("depth = -1").select("node")
    least = _ring_least(scratch, e, ring)
    # below a loop, the level is the way from the loop: the same without the loop's own edges
    astray = e.join(tree.filter("depth < 0").select("node"), F.col("dst") == F.col("node"), "left_semi").join(ring, F.col("dst") == F.col("node"), "left_anti")
    under = _tree(astray).filter("depth > 0").select("node", F.col("node").alias("component"), F.lit(False).alias("in_loop"), F.col("depth").alias("level"))
    return calm.union(least.select("node", F.col("least").alias("component"), F.lit(True).alias("in_loop"), F.lit(0).alias("level"))).union(under)


def _ring_least(scratch: Scratch, e: DataFrame, ring: DataFrame) -> DataFrame:
    """The least node of each loop, by doubling along it: node, least."""
    start = e.join(ring, F.col("dst") == F.col("node"), "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("next"), F.least("dst", "src").alias("least"))
    ptr, n = scratch.counted(start, F.lit(True), "ring")
    while n:
        look = ptr.select(F.col("node").alias("n"), F.col("next").alias("next2"), F.col("least").alias("least2"))
        step = ptr.join(look, F.col("next") == F.col("n")).select("node", F.col("next2").alias("next"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("moved"))
        new, n = scratch.counted(step, F.col("moved"), "ring")
        if n:
            ptr = new.drop("moved")
    return ptr.select("node", "least")


def break_suggestions(order: DataFrame, edges: DataFrame) -> DataFrame:
    """For each loop the flow to break so that its nodes can run one after the other: component, members, src, dst, sentence.

    It is the flow into the loop's least node from the greatest node of the loop that feeds it. Members are counted; the first few are
    named. order: what ``run_order`` gives.
    """
    looped = order.filter("in_loop")
    a, b = looped.select(F.col("node").alias("src"), F.col("component").alias("ca")), looped.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    back = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").filter("ca = cb and dst = cb").groupBy("cb").agg(F.max("src").alias("src"))
    # the first few names only: a loop may have a third of all nodes
    first = looped.groupBy("component").agg(F.count("*").alias("members"))
    named = back.join(first, F.col("cb") == F.col("component")).select("component", "members", "src", F.col("component").alias("dst"))
    say = F.concat(F.lit("in a loop of "), F.col("members").cast("string"), F.lit(": break the flow "), F.col("src"), F.lit(" -> "), F.col("dst"), F.lit(" to serialize"))
    return named.withColumn("sentence", say)


def reasons(order: DataFrame, edges: DataFrame) -> DataFrame:
    """Why each node has its level: node, level, reason."""
    feeds = edges.filter("src != dst").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("by"))
    level = F.col("level").cast("string")
    why = F.when(F.col("by").isNull() & (F.col("level") == 0), F.concat(F.lit("score 0: no flows in - nothing feeds "), F.col("node"), F.lit("; it can run first"))).when(F.col("by").isNull(), F.concat(F.lit("score "), level, F.lit(": no direct flows in")))
    why = why.otherwise(F.concat(F.lit("score "), level, F.lit(": "), F.col("by"), F.lit(" -> "), F.col("node"), F.lit(", ready at level "), F.greatest(F.col("level") - 1, F.lit(0)).cast("string")))
    return order.join(feeds, "node", "left").select("node", "level", F.concat(why, F.when(F.col("in_loop"), "; in a loop: data feeds back into where it started").otherwise("")).alias("reason"))


def radius(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """How many nodes each seed's data reaches, itself left out: node, n_downstream. (seed, node) pairs grow by leaps, as in ``closure``."""
    scratch = Scratch(edges.sparkSession, "radius")
    start = seeds.select("node").filter("node is not null").distinct()
    leap = scratch.write(edges.select("src", "dst").dropna().distinct(), "leap")
    seen, n = start.withColumn("at", F.col("node")), None
    while True:
        on = seen.join(leap, F.col("at") == F.col("src")).select("node", F.col("dst").alias("at"))
        more, count = scratch.counted(seen.union(on).distinct(), F.lit(True), "seen")
        if count == n:
            break
        leap, seen, n = scratch.write(_leaps(leap), "leap"), more, count
    counts = seen.filter("node != at").groupBy("node").agg(F.count("*").alias("n"))
    return start.join(counts, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n_downstream"))


def _ordered(comp: DataFrame, level: DataFrame, size: DataFrame, own: DataFrame) -> DataFrame:
    return comp.join(level, "component").join(size, "component").join(own, "node", "left").select("node", "component", ((F.col("size") > 1) | F.coalesce("own", F.lit(False))).alias("in_loop"), "level")


def collapse(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between containers: ends are mapped (node, container), merged per pair, self-loops dropped; a fact wins over inferred."""
    m = lambda a, b: mapping.select(F.col("node").alias(a), F.col("container").alias(b))
    e = edges.join(m("sn", "a"), F.col("src") == F.col("sn")).join(m("dn", "b"), F.col("dst") == F.col("dn")).filter("a != b")
    return e.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count_distinct("table_name").alias("n_tables"), F.max(F.when(F.col("provenance") == "fact", 1).otherwise(0)).alias("is_fact"))
