"""Full hierarchies from parent-child links: paths, depths, roots, descendants and cycles.

Components are found by pointer doubling (a join per doubling, so 2**k levels in k rounds), each component is brought
together in one place and walked depth-first with node colouring. A component above `max_component` nodes isn't gathered:
its paths are built by doubling as well, so no task ever holds more than that many nodes of one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

_OUT = "node long, root long, depth long, path string, status string, n_descendants long, cycle long"


def _walk(nodes: list[int], parent_of: dict[int, int]) -> Iterator[tuple]:
    """Depth-first walk of one component in which every node has at most one parent."""
    children: dict[int, list[int]] = {}
    for child, parent in parent_of.items():
        children.setdefault(parent, []).append(child)
    start = next((n for n in nodes if n not in parent_of), None)
    on_cycle: set[int] = set()
    if start is None:
        start = nodes[0]
        colour: set[int] = set()
        while start not in colour:
            colour.add(start)
            start = parent_of[start]
        at = start
        while at not in on_cycle:
            on_cycle.add(at)
            at = parent_of[at]
        cycle = min(on_cycle)
        start = cycle
    white, grey, black = 0, 1, 2
    colours = dict.fromkeys(nodes, white)
    below = dict.fromkeys(nodes, 0)
    path: list[str] = []
    found: dict[int, tuple[int, str]] = {}
    stack = [start]
    while stack:
        node = stack[-1]
        if colours[node] == white:
            colours[node] = grey
            path.append(str(node))
            found[node] = (len(path) - 1, "" if on_cycle else "/".join(path))
            stack.extend(c for c in children.get(node, ()) if colours[c] == white)
        else:
            stack.pop()
            if colours[node] == grey:
                colours[node] = black
                path.pop()
                if stack:
                    below[parent_of[node]] += below[node] + 1 if node != start else 0
    for node in nodes:
        if on_cycle:
            yield node, -1, -1, "", "on_cycle" if node in on_cycle else "below_cycle", None if node in on_cycle else below[node], cycle
        else:
            depth, text = found[node]
            yield node, start, depth, text, "tree", below[node], None


def _walk_components(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by component; a component may go over the edge of a batch."""
    names = [part.split()[0] for part in _OUT.split(", ")]
    rest: pd.DataFrame | None = None

    def walked(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for _, one in rows.groupby("component", sort=False):
            known = one[one["parent"].notna()]
            out.extend(_walk(one["node"].tolist(), dict(zip(known["node"].tolist(), known["parent"].astype("int64").tolist()))))
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"n_descendants": "Int64", "cycle": "Int64"})

    for frame in frames:
        if not len(frame):
            continue
        rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        is_last = rows["component"] == rows["component"].iloc[-1]
        rest = rows[is_last]
        if not is_last.all():
            yield walked(rows[~is_last])
    if rest is not None:
        yield walked(rest)


class Hierarchy:
    """`nodes` (node, root, depth, path, status, n_descendants, cycle): one row per node.

    status is `tree`, `on_cycle` or `below_cycle`. In trees depth is 0 at the root and path joins the ids from the root
    with `/`; elsewhere root and depth are -1, path is empty and cycle is the least node of the cycle. n_descendants is
    null on cycles, where every node descends from every other. `links` (parent, child) are the links of the hierarchies and
    `dropped` (parent, child) those to further parents of a child, which a hierarchy can't have.
    """

    def __init__(self, nodes: DataFrame, links: DataFrame, dropped: DataFrame):
        self.nodes, self.links, self.dropped = nodes, links, dropped

    def descendants(self) -> DataFrame:
        """(ancestor, node, distance) for every node of a tree and each of its ancestors."""
        way = self.nodes.where("status = 'tree' AND depth > 0").select("node", "depth", F.posexplode(F.split("path", "/")).alias("at", "ancestor"))
        return way.where("at < depth").select(F.col("ancestor").cast("long").alias("ancestor"), "node", (F.col("depth") - F.col("at")).alias("distance"))

    def back_edges(self) -> DataFrame:
        """(cycle, parent, child): of each cycle the link that closes it, the one into its least node."""
        closing = self.nodes.where("status = 'on_cycle' AND node = cycle").select("cycle")
        return self.links.join(closing, F.col("child") == F.col("cycle")).select("cycle", "parent", "child")


def hierarchy(links: DataFrame, parent_col: str, child_col: str, max_component: int = 100_000) -> Hierarchy:
    """Arrange parent-child rows as full hierarchies.

    Repeated rows count once. A row without a parent makes its child a node; a row without a child makes nothing; a child
    with several parents keeps the least, and its other links are in `dropped`; a row from a node to itself is a cycle. An empty
    table gives empty results. Other columns are ignored. `max_component` bounds what one task holds, not what is found.
    """
    rows = links.select(F.col(parent_col).cast("long").alias("parent"), F.col(child_col).cast("long").alias("child")).where("child IS NOT NULL")
    parents = rows.groupBy("child").agg(F.min("parent").alias("parent"))
    tops = rows.where("parent IS NOT NULL").select(F.col("parent").alias("child")).distinct().withColumn("parent", F.lit(None).cast("long"))
    all_nodes = parents.unionByName(tops).groupBy("child").agg(F.min("parent").alias("parent")).withColumnRenamed("child", "node")
    all_nodes = written(all_nodes, "hierarchy-nodes")
    several = rows.where("parent IS NOT NULL").join(parents.where("parent IS NOT NULL").withColumnRenamed("parent", "kept"), "child").where("parent <> kept")
    dropped = several.select("parent", "child").distinct()
    links_kept = all_nodes.where("parent IS NOT NULL").select("parent", F.col("node").alias("child"))

    done = all_nodes.where("parent IS NULL").select("node", F.col("node").alias("component"), F.lit(0).cast("long").alias("depth"))
    # `jump` is 2**k links above the node, `least` the least node on the way there
    open_ = links_kept.select(F.col("child").alias("node"), F.col("parent").alias("jump"), F.lit(1).cast("long").alias("depth"), F.col("child").alias("least"))
    finished, left, span = [done], open_.count(), 1
    ends = done
    while left:
        far = open_.select(F.col("node").alias("jump"), F.col("jump").alias("j2"), F.col("depth").alias("d2"), F.col("least").alias("l2"))
        top = ends.select(F.col("node").alias("jump"), F.col("component").alias("c2"), F.col("depth").alias("e2"))
        step = written(open_.join(far, "jump", "left").join(top, "jump", "left"), "hierarchy-round")
        ended = step.where("c2 IS NOT NULL").select("node", F.col("c2").alias("component"), (F.col("depth") + F.col("e2")).alias("depth"))
        finished.append(ended)
        ends = ends.unionByName(ended)
        open_ = step.where("c2 IS NULL").select("node", F.col("j2").alias("jump"), (F.col("depth") + F.col("d2")).alias("depth"), F.least("least", "l2").alias("least"))
        span *= 2
        before, left = left, open_.count()
        if left == before and span >= left:  # no root is left to be reached, so the rest is on cycles or below, and `jump` is on one
            break
    trees = finished[0]
    for part in finished[1:]:
        trees = trees.unionByName(part)
    label = open_.select(F.col("node").alias("jump"), F.col("least").alias("component"))
    # the jumps are longer than any way to a cycle, and the same number of steps moves each node of a cycle to another one of it
    on_cycle = open_.select(F.col("jump").alias("node")).distinct().withColumn("on_it", F.lit(True))
    looped = open_.join(label, "jump").join(on_cycle, "node", "left").select("node", "component", F.lit(-1).cast("long").alias("depth"), F.coalesce("on_it", F.lit(False)).alias("on_it"))
    placed = written(trees.select("node", "component", "depth", F.lit(False).alias("on_it")).unionByName(looped).join(all_nodes, "node"), "hierarchy-components")

    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    large = sizes.where(F.col("size") > max_component).select("component")
    small_rows = placed.join(large, "component", "left_anti").select("component", "node", "parent")
    small = small_rows.repartition("component").sortWithinPartitions("component").mapInPandas(_walk_components, _OUT)
    if large.isEmpty():
        return Hierarchy(small, links_kept, dropped)
    big = placed.join(large, "component", "left_semi")
    return Hierarchy(small.unionByName(_walk_large(big)), links_kept, dropped)


def _walk_large(rows: DataFrame) -> DataFrame:
    """The same columns for components that aren't gathered: doubling instead of a walk."""
    trees = rows.where("depth >= 0")
    way = trees.select("node", F.col("parent").alias("jump"), F.col("node").cast("string").alias("path"))
    way = written(way, "hierarchy-way")
    while not way.where("jump IS NOT NULL").isEmpty():
        far = way.select(F.col("node").alias("jump"), F.col("jump").alias("j2"), F.col("path").alias("p2"))
        way = written(
            way.join(far, "jump", "left").select("node", F.col("j2").alias("jump"), F.when(F.col("p2").isNull(), F.col("path")).otherwise(F.concat_ws("/", "p2", "path")).alias("path")),
            "hierarchy-way",
        )
    above = way.select(F.explode(F.split("path", "/")).alias("a")).groupBy(F.col("a").cast("long").alias("node")).agg((F.count("*") - 1).alias("n_descendants"))
    out = trees.join(way.select("node", "path"), "node").join(above, "node").select(
        "node", F.col("component").alias("root"), "depth", "path", F.lit("tree").alias("status"), "n_descendants", F.lit(None).cast("long").alias("cycle")
    )
    hanging = rows.where("depth < 0")
    below = _descendants_below(hanging)
    looped = hanging.join(below, "node", "left").select(
        "node", F.lit(-1).cast("long").alias("root"), F.lit(-1).cast("long").alias("depth"), F.lit("").alias("path"),
        F.when(F.col("on_it"), "on_cycle").otherwise("below_cycle").alias("status"), F.when(~F.col("on_it"), F.coalesce("n_below", F.lit(0))).alias("n_descendants"), F.col("component").alias("cycle"),
    )
    return out.unionByName(looped)


def _descendants_below(hanging: DataFrame) -> DataFrame:
    """(node, n_below) of the nodes that hang below a cycle, by doubling up to the cycle's edge."""
    off = hanging.where("NOT on_it").select("node", "parent")
    inner = off.join(off.select(F.col("node").alias("parent")), "parent", "left_semi")
    way = off.join(inner.select("node", F.col("parent").alias("jump")), "node", "left").select("node", "jump", F.col("node").cast("string").alias("path"))
    way = written(way, "hierarchy-below")
    while not way.where("jump IS NOT NULL").isEmpty():
        far = way.select(F.col("node").alias("jump"), F.col("jump").alias("j2"), F.col("path").alias("p2"))
        way = written(
            way.join(far, "jump", "left").select("node", F.col("j2").alias("jump"), F.when(F.col("p2").isNull(), F.col("path")).otherwise(F.concat_ws("/", "p2", "path")).alias("path")),
            "hierarchy-below",
        )
    return way.select(F.explode(F.split("path", "/")).alias("a")).groupBy(F.col("a").cast("long").alias("node")).agg((F.count("*") - 1).alias("n_below"))
