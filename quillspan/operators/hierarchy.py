"""Parent-child links to full hierarchies.

Every node has at most one parent, so the links are a forest plus loops. The tree of unknown depth is solved in three steps:

1. deterministic hash splitters: about one node in ``every`` is a splitter, by the hash of its name; roots end walks too;
2. every node walks to its next splitter or root, by pointer doubling that stops there, so its rounds grow with the logarithm of the
   longest splitter-free stretch and not with the depth;
3. the reduced graph, which holds the splitters only, is solved by pointer doubling; every node then takes root, depth and path from
   its splitter.

Nodes whose walk ends nowhere are in or below a loop without splitters; splitters that reach no root are in or below a loop with
some. Both are handled by themselves: within them the images of f, f^2, f^4, ... shrink until the image is mapped onto itself, and
then it is exactly the nodes on loops.

Each round is written to the shared folder. Lookups join on the pointer against rows that are unique by node; where a third of all
nodes point to one node, the probing side's partition is split by Spark's skew handling. Nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.session import Scratch

WALKING, AT_SPLITTER, AT_ROOT = 0, 1, 2


def _parents(links: DataFrame, scope: str, child: str, parent: str) -> DataFrame:
    ends = F.array(F.struct(F.col(child).alias("v"), F.col(parent).alias("p")), F.struct(F.col(parent).alias("v"), F.lit(None).cast("string").alias("p")))
    return links.select(F.col(scope).alias("g"), F.explode(ends).alias("e")).filter("e.v is not null").groupBy("g", F.col("e.v").alias("v")).agg(F.min("e.p").alias("p"))


def _step(state: DataFrame) -> DataFrame:
    """Every walking row takes over the pointer of where it points to."""
    cols = state.columns
    look = state.select(F.col("g").alias("lg"), F.col("v").alias("lv"), *[F.col(c).alias(f"l{c}") for c in ("cur", "dist", "state", "seg") if c in cols])
    stepped = state.filter(F.col("state") == WALKING).join(look, F.col("g").eqNullSafe(F.col("lg")) & (F.col("cur") == F.col("lv")))
    stepped = stepped.select("g", "v", F.col("lcur").alias("cur"), (F.col("dist") + F.col("ldist")).alias("dist"), F.col("lstate").alias("state"), *([F.concat("seg", "lseg").alias("seg")] if "seg" in cols else []))
    return stepped.union(state.filter(F.col("state") != WALKING))


def _double(scratch: Scratch, state: DataFrame, label: str) -> DataFrame:
    """Doubles the pointers of all rows until they end, or until the walking ones only go round.

    As long as a walk is unfinished there are nodes at every distance along it, so some end in every round; if none does, the
    rest goes round. Two doublings make one job.
    """
    before = None
    while True:
        new, left = scratch.counted(_step(_step(state)), F.col("state") == WALKING, label)
        scratch.drop(state)
        state = new
        if left in (0, before):
            return state
        before = left


def hierarchy(links: DataFrame, scope: str, child: str, parent: str, every: int = 16, with_path: bool = False) -> DataFrame:
    """One row per scope and node: ``scope``, ``node``, ``root``, ``depth`` and, if asked, ``path`` (array, root first).

    depth is 0 for a root, which is its own root. Nodes on a loop (a node that is its own parent included) have root '' and depth
    -1, nodes below a loop root '' and depth -2; both have a null path. A null child with a parent makes the parent a node, a null
    parent makes the child a node; rows with neither are ignored; a null scope is a scope of its own. Repeated rows count once; a
    child with several parents takes the least by name. An empty table gives no rows.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    nodes = scratch.write(_parents(links, scope, child, parent), "nodes")
    no_seg = F.array().cast("array<string>")

    def splits(c: str) -> Column:
        return F.pmod(F.xxhash64("g", c), F.lit(every)) == 0

    first = nodes.select("g", "v", F.coalesce("p", "v").alias("cur"), F.when(F.col("p").isNull(), 0).otherwise(1).alias("dist"),
                         F.when(F.col("p").isNull(), AT_ROOT).when(splits("p"), AT_SPLITTER).otherwise(WALKING).alias("state"), *([F.when(F.col("p").isNull(), no_seg).otherwise(F.array("p")).alias("seg")] if with_path else []))
    walked = _double(scratch, first, "walk")

    # the reduced graph: a splitter that stopped at a splitter walks on from there
    reduced = walked.filter(splits("v")).withColumn("state", F.when(F.col("state") == AT_SPLITTER, WALKING).otherwise(F.when(F.col("state") == WALKING, AT_SPLITTER).otherwise(AT_ROOT)))
    solved = _double(scratch, reduced, "reduced")
    tops = solved.filter(F.col("state") == AT_ROOT).select(F.col("g").alias("sg"), F.col("v").alias("sv"), F.col("cur").alias("sroot"), F.col("dist").alias("sdist"), *([F.col("seg").alias("sseg")] if with_path else []))

    at_root = walked.filter(F.col("state") == AT_ROOT).select("g", "v", F.col("cur").alias("root"), F.col("dist").alias("depth"), *(["seg"] if with_path else []))
    via = walked.filter(F.col("state") == AT_SPLITTER).join(tops, F.col("g").eqNullSafe(F.col("sg")) & (F.col("cur") == F.col("sv")), "left")
    via = scratch.write(via.select("g", "v", F.col("sroot").alias("root"), (F.col("dist") + F.col("sdist")).alias("depth"), *([F.concat("seg", "sseg").alias("seg")] if with_path else [])), "via")
    lost = walked.filter(F.col("state") == WALKING).select("g", "v").union(via.filter("root is null").select("g", "v"))
    looped = _loops(scratch, nodes, lost)

    def shown(d: DataFrame) -> DataFrame:
        path = [F.reverse(F.concat(F.array("v"), "seg")).alias("path")] if with_path else []
        return d.select(F.col("g").alias(scope), F.col("v").alias("node"), "root", F.col("depth").cast("int").alias("depth"), *path)

    out = shown(at_root).union(shown(via.filter("root is not null")))
    if looped is not None:
        out = out.union(looped.select(F.col("g").alias(scope), F.col("v").alias("node"), F.lit("").alias("root"), "depth", *([F.lit(None).cast("array<string>").alias("path")] if with_path else [])))
    return out


def _loops(scratch: Scratch, nodes: DataFrame, lost: DataFrame) -> DataFrame | None:
    """Tells the nodes on loops from those below, among nodes that reach no root."""
    keys = lost.select(F.col("g").alias("xg"), F.col("v").alias("xv"))
    mine = nodes.join(keys, F.col("g").eqNullSafe(F.col("xg")) & (F.col("v") == F.col("xv")), "left_semi").select("g", "v", F.col("p").alias("cur"))
    f, n = scratch.counted(mine, F.lit(True), "loop")
    if not n:
        return None
    first, size = f, None

    def twice(f: DataFrame) -> DataFrame:
        look = f.select(F.col("g").alias("lg"), F.col("v").alias("lv"), F.col("cur").alias("lcur"))
        return f.join(look, F.col("g").eqNullSafe(F.col("lg")) & (F.col("cur") == F.col("lv"))).select("g", "v", F.col("lcur").alias("cur"))

    while True:
        image = f.select("g", F.col("cur").alias("v")).distinct()
        now = image.count()
        if now == size:
            break
        size = now
        f = scratch.write(twice(twice(f)), "loop")
    ring = image.select(F.col("g").alias("rg"), F.col("v").alias("rv"), F.lit(True).alias("hit"))
    return first.join(ring, F.col("g").eqNullSafe(F.col("rg")) & (F.col("v") == F.col("rv")), "left").select("g", "v", F.when(F.col("hit"), -1).otherwise(-2).alias("depth"))


def below(tree: DataFrame, scope: str) -> DataFrame:
    """All descendants: one row per ancestor and node below it, with their distance, from ``hierarchy(..., with_path=True)``."""
    up = tree.filter("path is not null").select(scope, "node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return up.filter(F.col("at") < F.col("depth")).select(scope, "ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))


#: Siblings are cut into so many groups by the hash of their names, so that no window holds all children of a node.
SIBLING_GROUPS = 1024


def intervals(links: DataFrame, scope: str, child: str, parent: str) -> DataFrame:
    """All descendants in linear size: one row per scope and node of a tree, with ``enter`` and ``leave``.

    A node lies below another exactly if they have the same scope and root and its ``enter`` lies between the other's ``enter`` and
    ``leave``; (leave - enter - 1) / 2 nodes lie below a node. The numbers are the places of the walk around each tree that goes down to
    a node and up from it. The walk is a list, so ``hierarchy`` numbers it, whatever the depth of the tree. Siblings are visited in the
    order of the hash of their names, in groups that are linked end to end. Nodes in and below loops have no rows; else as ``hierarchy``.
    """
    scratch = Scratch(links.sparkSession, "intervals")
    placed = hierarchy(links, scope, child, parent).filter("depth >= 0").select(F.col(scope).alias("g"), F.col("node").alias("v"), "root")
    up = _parents(links, scope, child, parent).select(F.col("g").alias("pg"), F.col("v").alias("pv"), "p")
    nodes = scratch.write(placed.join(up, F.col("g").eqNullSafe(F.col("pg")) & (F.col("v") == F.col("pv"))).select("g", "v", "p", "root"), "nodes")
    kids = nodes.filter("p is not null").select("g", "p", "v", F.xxhash64("v").alias("h")).withColumn("c", F.pmod("h", F.lit(SIBLING_GROUPS)))
    inside = Window.partitionBy("g", "p", "c").orderBy("h", "v")
    near = kids.select("g", "p", "c", "v", F.lead("v").over(inside).alias("next"))
    ends = kids.groupBy("g", "p", "c").agg(F.min_by("v", F.struct("h", "v")).alias("head"))
    ends = ends.select(F.col("g").alias("eg"), F.col("p").alias("ep"), F.col("c").alias("ec"), F.lead("head").over(Window.partitionBy("g", "p").orderBy("c")).alias("after"))
    near = near.join(ends, F.col("g").eqNullSafe(F.col("eg")) & (F.col("p") == F.col("ep")) & (F.col("c") == F.col("ec"))).select("g", "p", "v", F.coalesce("next", "after").alias("next"))
    first = kids.groupBy("g", "p").agg(F.min_by("v", F.struct("c", "h", "v")).alias("first")).select(F.col("g").alias("fg"), F.col("p").alias("fv"), "first")
    down = lambda c: F.concat(F.lit("d"), c)
    rise = lambda c: F.concat(F.lit("u"), c)
    goes = nodes.join(first, F.col("g").eqNullSafe(F.col("fg")) & (F.col("v") == F.col("fv")), "left").select("g", down("v").alias("a"), F.coalesce(down("first"), rise("v")).alias("b"))
    back = near.select("g", rise("v").alias("a"), F.coalesce(down("next"), rise("p")).alias("b"))
    walk = hierarchy(goes.union(back), "g", "a", "b").select("g", F.substring("node", 1, 1).alias("way"), F.expr("substring(node, 2)").alias("v"), "depth")
    places = walk.groupBy("g", "v").agg(F.max(F.when(F.col("way") == "d", F.col("depth"))).alias("d"), F.max(F.when(F.col("way") == "u", F.col("depth"))).alias("u"))
    top = places.select(F.col("g").alias("tg"), F.col("v").alias("tv"), F.col("d").alias("td"))
    out = nodes.select("g", "v", "root").join(places.withColumnsRenamed({"g": "xg", "v": "xv"}), F.col("g").eqNullSafe(F.col("xg")) & (F.col("v") == F.col("xv")))
    out = out.join(top, F.col("g").eqNullSafe(F.col("tg")) & (F.col("root") == F.col("tv")))
    return out.select(F.col("g").alias(scope), F.col("v").alias("node"), "root", (F.col("td") - F.col("d")).alias("enter"), (F.col("td") - F.col("u")).alias("leave"))
