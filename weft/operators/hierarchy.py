"""Parent-child rows to full hierarchies: root, depth, path, descendants and cycles.

Connected components are found first (star contraction). Every component up to `bound` nodes
is co-located in one task and traversed by an iterative depth-first search with node colours
(white, grey, black; an edge to a grey node is a back edge, and the walk from there is a cycle). A
component larger than the bound is never collected: its nodes find root and depth by pointer
doubling in distributed joins, the nodes reached from unended walks of more steps than there
are nodes are the cycles, and outside cycles path and descendants are doubled likewise, which
gives the same rows.

Defined results: links with a null end are dropped; repeated links count once; if a node has
several parents the least of them holds, and link_kinds tells what the other links are; a node
linked to itself, a node on a cycle and every node below one has root 'cycle' and depth -1 and no
path; the back edge of a cycle is the link to its least node; an empty table gives no rows. The
descendants of a node are the nodes whose path begins with its path and a slash, so a sorted table
answers for one node by a range; ancestors lists them all as pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.stars import components
from weft.session import cut, release, sized

#: Most nodes of a component that one task traverses.
BOUND = 50_000
CYCLE = "cycle"
_OUT = "node_id string, root_id string, depth int, parent_id string, path string, descendants bigint, on_cycle boolean, back_edge boolean"


def parents(links: DataFrame) -> DataFrame:
    """(node, parent): one row per node that is an end of a link, the parent null for none."""
    up = links.select(F.col("child").alias("node"), "parent").filter("node is not null and parent is not null")
    every = up.union(up.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    return every.groupBy("node").agg(F.min("parent").alias("parent"))


def traverse(node: list[str], parent: list, paths: bool = True) -> Iterator[tuple]:
    """Depth-first from the roots; a node's row is made when it turns black, from the path
    then on the stack. What the roots do not reach is in or below a cycle and is walked in order
    of id: a cycle is entered at its least node, and the link that comes back to it is a back edge."""
    below: dict = {}
    up = dict(zip(node, parent, strict=True))
    for n, p in up.items():
        below.setdefault(p, []).append(n)
    grey, black = 1, 2
    colour: dict = {}
    size: dict = {}
    ring: set = set()
    back: set = set()

    def walk(start: str) -> Iterator[tuple[str, list[str]]]:
        stack, path = [(start, iter(sorted(below.get(start, ()))))], [start]
        colour[start], size[start] = grey, 0
        while stack:
            at, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                colour[at] = black
                yield at, path
                stack.pop()
                path.pop()
                if stack:
                    size[stack[-1][0]] += size.pop(at) + 1
            elif child not in colour:
                colour[child], size[child] = grey, 0
                path.append(child)
                stack.append((child, iter(sorted(below.get(child, ())))))
            elif colour[child] == grey:
                back.add(child)
                ring.update(path[path.index(child) :])

    for root in below.get(None, []):
        for at, path in walk(root):
            yield at, root, len(path) - 1, up[at], "/" + "/".join(path) if paths else None, size[at], False, False
    left = sorted(n for n in up if n not in colour)
    for n in left:
        if n not in colour:
            for _ in walk(n):
                pass
    for n in left:
        yield n, CYCLE, -1, up[n], None, None, n in ring, n in back


def _framed(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])
    out["descendants"] = out["descendants"].astype("Int64")
    return out


def _small(paths: bool) -> Callable:
    """Whole components, the rows of each next to one another, over any number of batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, node, parent, out, weight = None, [], [], [], 0
        for batch in chain(batches, [None]):
            rows = zip(batch["component"], batch["node"], batch["parent"], strict=True) if batch is not None else [(None, None, None)]
            for c, n, p in rows:
                if c != at:
                    for r in traverse(node, parent, paths):
                        out.append(r)
                        weight += 100 + len(r[4] or "")
                        if weight > 8_000_000:
                            yield _framed(out)
                            out, weight = [], 0
                    at, node, parent = c, [], []
                if c is not None:
                    node.append(n)
                    parent.append(p)
        if out:
            yield _framed(out)

    return run


def doubled(up: DataFrame) -> DataFrame:
    """(node, root, depth, parent, on_cycle, back_edge) by pointer doubling; nodes that never end have root null."""
    # far: the node reached after `hops` steps, or the root once that is reached; low: the least node on the way there
    now = cut(up.select("node", F.coalesce("parent", "node").alias("far"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("hops"), F.col("parent").isNull().alias("done"), F.col("node").alias("low")))
    reach, total = 1, now.count()
    while reach <= total and not now.filter("not done").isEmpty():
        far = now.select(F.col("node").alias("far"), F.col("far").alias("f2"), F.col("hops").alias("h2"), F.col("done").alias("d2"), F.col("low").alias("l2"))
        open_ = now.filter("not done").join(far, "far").select("node", F.col("f2").alias("far"), (F.col("hops") + F.col("h2")).alias("hops"), F.col("d2").alias("done"), F.least("low", "l2").alias("low"))
        before, now = now, cut(now.filter("done").unionByName(open_))
        release(before)
        reach *= 2
    # a walk that has not ended after more steps than nodes stands on a cycle, and every node of a cycle is stood on
    ring = now.filter("not done").select(F.col("far").alias("node")).distinct().withColumn("ring", F.lit(True))
    ended = now.select("node", F.when(F.col("done"), F.col("far")).alias("root"), F.when(F.col("done"), F.col("hops")).alias("depth"), "low")
    out = ended.join(up, "node").join(ring, "node", "left").withColumn("on_cycle", F.col("ring").isNotNull())
    return out.withColumn("back_edge", F.col("on_cycle") & (F.col("low") == F.col("node"))).drop("ring", "low")


def laid(up: DataFrame) -> DataFrame:
    """(node, path, descendants) of trees by pointer doubling; up must be free of cycles.

    Not done is exactly a node at least `reach` deep; far is then its ancestor at that distance."""
    # trail: the path below far down to the node; size: nodes less than `reach` below, with the node
    now = cut(up.select(
        "node", F.coalesce("parent", "node").alias("far"), F.col("parent").isNull().alias("done"),
        F.when(F.col("parent").isNull(), "").otherwise(F.concat(F.lit("/"), "node")).alias("trail"), F.lit(1).cast("bigint").alias("size"),
    ))
    while not now.filter("not done").isEmpty():
        more = now.filter("not done").groupBy(F.col("far").alias("node")).agg(F.sum("size").alias("more"))
        grown = now.join(more, "node", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        far = now.select(F.col("node").alias("far"), F.col("far").alias("f2"), F.col("done").alias("d2"), F.col("trail").alias("t2"))
        open_ = grown.filter("not done").join(far, "far").select("node", F.col("f2").alias("far"), F.col("d2").alias("done"), F.concat("t2", "trail").alias("trail"), "size")
        before, now = now, cut(grown.filter("done").unionByName(open_))
        release(before)
    return now.select("node", F.concat(F.lit("/"), "far", "trail").alias("path"), (F.col("size") - 1).alias("descendants"))


def hierarchy(links: DataFrame, bound: int = BOUND, paths: bool = True, uuids: bool = False) -> DataFrame:
    """node_id, root_id, depth, parent_id, path, descendants, on_cycle, back_edge for each node of links
    (columns parent, child; uuids: canonical UUIDs), the same whatever the bound; without path
    and descendants if paths is false."""
    up = cut(parents(links))
    own = components(up.filter("parent is not null"), "node", "parent", uuids)
    with sized(up.sparkSession, up.count()):
        placed = cut(up.join(own, "node", "left").withColumn("component", F.coalesce("component", "node")))
        large = placed.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > bound).select("component")
        every_small = large.isEmpty()
    small = placed if every_small else placed.join(large, "component", "left_anti")
    small = small.repartition("component").sortWithinPartitions("component").select("component", "node", "parent")
    out = small.mapInPandas(_small(paths), _OUT)
    if not paths:
        out = out.drop("path", "descendants")
    if not every_small:
        rest = placed.join(large, "component", "left_semi").select("node", "parent")
        d = doubled(cut(rest))
        if paths:
            d = cut(d)
            d = d.join(laid(d.filter("root is not null").select("node", "parent")), "node", "left")
        out = out.unionByName(d.select(
            F.col("node").alias("node_id"), F.coalesce("root", F.lit(CYCLE)).alias("root_id"), F.coalesce(F.col("depth").cast("int"), F.lit(-1)).alias("depth"),
            F.col("parent").alias("parent_id"), *(["path", "descendants"] if paths else []), "on_cycle", "back_edge",
        ))
    return out


def link_kinds(links: DataFrame, uuids: bool = False) -> DataFrame:
    """(parent_id, node_id, kind) for every distinct link: tree if the node's path goes by it, cycle in
    or below a cycle, back if it closes one, and of the links to a node with several parents that
    its path does not follow, back if they lead to an ancestor, else cross."""
    rows = hierarchy(links, uuids=uuids)
    own = rows.select("node_id", F.col("parent_id").alias("followed"), "back_edge", (F.col("root_id") == CYCLE).alias("cyclic"))
    over = rows.select(F.col("node_id").alias("parent_id"), F.col("path").alias("way"))
    each = links.select(F.col("parent").alias("parent_id"), F.col("child").alias("node_id")).filter("parent_id is not null and node_id is not null").distinct()
    each = each.join(own, "node_id").join(over, "parent_id")
    above = F.contains(F.concat("way", F.lit("/")), F.concat(F.lit("/"), "node_id", F.lit("/")))
    followed = F.when(F.col("back_edge"), "back").when(F.col("cyclic"), "cycle").otherwise("tree")
    kind = F.when(F.col("followed") == F.col("parent_id"), followed).when(F.col("way").isNotNull() & above, "back").otherwise("cross")
    return each.select("parent_id", "node_id", kind.alias("kind"))


def ancestors(links: DataFrame, uuids: bool = False) -> DataFrame:
    """(ancestor, descendant, distance) for every node outside cycles: its full lists of
    ancestors and descendants as rows, by joins that double the distance until none is farther,
    so their number grows with the depth and a chain of n nodes has n * (n - 1) / 2 rows."""
    rows = hierarchy(links, paths=False, uuids=uuids)
    step = cut(rows.filter("depth > 0").select(F.col("node_id").alias("d"), F.col("parent_id").alias("a")))
    every, reach = cut(step.select("a", "d", F.lit(1).alias("k"))), 1
    while True:
        front = every.filter(F.col("k") == reach)
        more = cut(every.select(F.col("a").alias("m"), "d", F.col("k").alias("k1")).join(front.select(F.col("a").alias("a"), F.col("d").alias("m"), F.col("k").alias("k2")), "m").select("a", "d", (F.col("k1") + F.col("k2")).alias("k")))
        if more.isEmpty():
            break
        every, reach = every.union(more), reach * 2
    return every.select(F.col("a").alias("ancestor"), F.col("d").alias("descendant"), F.col("k").alias("distance"))
