"""Dependency graphs: component edges, Martin metrics, boundaries, reachability, cycles, shortest chains."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.functions import scalars as S
from quartzite.operators.fixpoints import equivalence, spread
from quartzite.operators.shared import Grown, cut


def component_edges(edges: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` between different components."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def martin(edges: DataFrame, census: DataFrame) -> DataFrame:
    """Couplings, instability, abstractness and distance by component; ``census``: component, types, abstractions."""
    ce = edges.groupBy(F.col("src").alias("component")).agg(F.count("*").alias("ce"))
    ca = edges.groupBy(F.col("dst").alias("component")).agg(F.count("*").alias("ca"))
    both = ce.join(ca, "component", "full").join(census, "component", "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = both.select("component", n("ca").alias("ca"), n("ce").alias("ce"), n("types").alias("types"), n("abstractions").alias("abstractions"))
    out = out.withColumn("instability", S.instability(F.col("ca"), F.col("ce")))
    out = out.withColumn("abstractness", F.when(F.col("types") > 0, F.col("abstractions") / F.col("types")).otherwise(F.lit(0.0)))
    return out.withColumn("distance", S.main_sequence_distance(F.col("abstractness"), F.col("instability")))


def unstable_dependencies(edges: DataFrame, metrics: DataFrame, margin: float) -> DataFrame:
    """Edges to a component less stable than their source by more than the margin."""
    m = metrics.select("component", "instability")
    out = edges.join(m.select(F.col("component").alias("src"), F.col("instability").alias("i_src")), "src")
    out = out.join(m.select(F.col("component").alias("dst"), F.col("instability").alias("i_dst")), "dst")
    return out.where(F.col("i_dst") - F.col("i_src") > margin)


def boundary_violations(edges: DataFrame, exceptions: DataFrame, forbidden: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges against declared boundaries. The rule tables hold ``a, b`` prefixes; ends match a prefix at a ``/``. They are small by
    declaration; edges are distinct components."""

    def under(end: str, prefix: str):  # noqa: ANN202
        return (F.col(end) == F.col(prefix)) | F.col(end).startswith(F.concat(F.col(prefix), F.lit("/")))

    match = under("src", "a") & under("dst", "b")
    left = edges.join(F.broadcast(exceptions), match, "left_anti")
    bad = left.join(F.broadcast(forbidden), match, "left_semi").withColumn("kind", F.lit("Forbidden"))
    rest = left.join(F.broadcast(forbidden), match, "left_anti")
    undeclared = rest.join(F.broadcast(allowed), match, "left_anti").withColumn("kind", F.lit("Undeclared"))
    return bad.unionByName(undeclared)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def reach(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``root, node, depth``: the least number of hops from each start, to the end or within ``max_depth``. Each round keeps only what
    is new, written as a part of what is seen, so plans stay short."""
    edges = cut(edges.select("src", "dst").distinct())
    start = start.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    seen = Grown(start.schema, start.sparkSession)
    front = seen.add(start)
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = cut(front.join(edges, front.node == edges.src).select("root", F.col("dst").alias("node")).distinct())
        again = seen.all().join(step, ["root", "node"], "left_semi")  # few, if the step is
        front = seen.add(step.join(again, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
    return seen.all()


LOCAL_EDGES = 200_000  # what one task settles, a few MB; beyond that nodes are coloured over the cluster


def _trimmed(edges: DataFrame, times: int = 2) -> DataFrame:
    """The edges that are left when nodes without a way in or a way out go, a few times over: long tails fall to the colouring."""
    for _ in range(times):
        ends = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
        edges = cut(edges.join(ends[0], "dst", "left_semi").join(ends[1], "src", "left_semi").select("src", "dst"))
    return edges


def components_of(edges: list[tuple]) -> dict:
    """Node to a number of its strongly connected component, by one depth-first walk with the least entry point that a node reaches."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    entered: dict = {}
    low: dict = {}
    group: dict = {}
    open_: list = []
    for root in out:
        if root in entered:
            continue
        walk = [(root, iter(out[root]))]
        entered[root] = low[root] = len(entered)
        open_.append(root)
        while walk:
            node, ways = walk[-1]
            for to in ways:
                if to not in entered:
                    entered[to] = low[to] = len(entered)
                    open_.append(to)
                    walk.append((to, iter(out[to])))
                    break
                if to not in group:
                    low[node] = min(low[node], entered[to])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == entered[node]:
                    while True:
                        member = open_.pop()
                        group[member] = entered[node]
                        if member == node:
                            break
    return group


def _settle(pieces: Iterator[pd.DataFrame]) -> pd.DataFrame:
    group = components_of([pair for b in pieces for pair in zip(b["src"].tolist(), b["dst"].tolist(), strict=True)])
    members: dict = {}
    for node, g in group.items():
        members.setdefault(g, []).append(node)
    return pd.DataFrame([(node, least) for m in members.values() if len(m) > 1 for least in (min(m),) for node in m], columns=["node", "scc"])


def _settled_here(edges: DataFrame) -> DataFrame:
    """``node, scc`` of a graph of at most LOCAL_EDGES edges, in one task."""
    kind = edges.schema["src"].dataType.simpleString()
    return edges.select("src", "dst").coalesce(1).mapInPandas(lambda batches: iter([_settle(batches)]), f"node {kind}, scc {kind}")


def _settled_apart(edges: DataFrame, local_edges: int) -> tuple[DataFrame, DataFrame]:
    """``node, scc`` of the pieces, connected either way, that have at most ``local_edges`` edges, many pieces a task; and the edges of the others."""
    piece = equivalence(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    placed = cut(edges.join(piece.withColumnRenamed("node", "src"), "src").select("src", "dst", "root"))
    large = cut(placed.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > local_edges).select("root"))
    if large.limit(1).count():
        few, rest = cut(placed.join(large, "root", "left_anti")), cut(placed.join(large, "root", "left_semi").select("src", "dst"))
    else:
        few, rest = placed, edges.limit(0)
    bins = 4 * few.count() // local_edges + 1  # of a quarter of what a task settles, and one whole piece at most
    kind = edges.schema["src"].dataType.simpleString()
    dealt = few.select("src", "dst", F.pmod(F.xxhash64("root"), F.lit(bins)).alias("bin"))
    return dealt.groupBy("bin").applyInPandas(lambda pdf: _settle(iter([pdf])), f"node {kind}, scc {kind}"), rest


def _least_above(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node that reaches each, itself included. A node takes the least root of those before it and, as that
    root is reached too, the root of its root: so long chains take few rounds."""
    label = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("root", F.col("node")))
    while True:
        near = edges.join(label.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("r"))
        step = cut(label.join(near, "node", "left").select("node", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved")))
        above = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = cut(step.join(above, "root").select("node", F.least("root", "top").alias("root"), (F.coalesce("moved", F.lit(False)) | (F.col("top") < F.col("root"))).alias("moved")))
        label = after.select("node", "root")
        if not after.where("moved").limit(1).count():
            return label


def cycles(edges: DataFrame, max_depth: int | None = None, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``node, scc`` of nodes on a cycle; scc is the least member. Whole strongly connected components, or with ``max_depth`` mutual
    reachability within so many hops. Pieces of at most ``local_edges`` edges that nothing links are settled side by side. In larger ones nodes are
    coloured by the node of least random rank that reaches them; those that reach it in turn are its component and go, and edges between colours with them. Ranks are new each round, so long chains
    of components part into many pieces at once. All relations grow with the edges only."""
    if max_depth is not None:
        far = reach(edges, edges.select(F.col("src").alias("node")).distinct(), max_depth)
        pairs = far.select("root", "node").where("root <> node")
        mutual = pairs.join(pairs.select(F.col("root").alias("node"), F.col("node").alias("root")), ["root", "node"])
        return mutual.groupBy(F.col("root").alias("node")).agg(F.least(F.min("node"), F.col("root")).alias("scc"))
    left = cut(edges.select("src", "dst").where("src <> dst"))
    found = left.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0)
    for turn in count(1):
        if left.limit(local_edges + 1).count() <= local_edges:
            return found.unionByName(_settled_here(left))
        settled, left = _settled_apart(left, local_edges)
        found = cut(found.unionByName(settled))
        if not left.limit(1).count():
            return found
        left = _trimmed(left)
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("rank"), F.col(c).alias("node")).alias(c)  # noqa: B023, E731
        ranked = cut(left.select(rank("src"), rank("dst")))
        color = _least_above(ranked)
        ends = [color.select(F.col("node").alias(end), F.col("root").alias(f"r_{end}")) for end in ("src", "dst")]
        same = cut(ranked.join(ends[0], "src").join(ends[1], "dst").where("r_src = r_dst").select("src", "dst", F.col("r_src").alias("scc")))
        # a node of a colour reaches the colour's node, the least of all, if that is the least that it reaches at all
        back = _least_above(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        members = cut(back.join(color.withColumnRenamed("root", "scc"), "node").where("root = scc").select("node.node", F.col("scc.node").alias("scc")))
        size = members.groupBy("scc").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
        found = cut(found.unionByName(members.join(size, "scc").select("node", F.col("least").alias("scc"))))
        rest = same.select("src.node", F.col("dst.node").alias("to")).join(members.select("node"), "node", "left_anti").withColumnRenamed("node", "src")
        left = cut(rest.join(members.select(F.col("node").alias("to")), "to", "left_anti").select("src", F.col("to").alias("dst")))


def shortest_untested(edges: DataFrame, coverage: DataFrame, max_depth: int | None = None) -> DataFrame:
    """For each covered root the least hops to a node of coverage exactly 0, ties to the least node. Hops are counted from those nodes back, so
    each node is reached once, however many roots lead to it."""
    edges = cut(edges.select("src", "dst"))
    entered = edges.select(F.col("dst").alias("node")).distinct().withColumn("entered", F.lit(True))
    ends = cut(coverage.select("node", "covered").join(entered, "node", "left").where("entered and covered = 0 or entered is null and covered > 0"))
    bare = ends.where("entered").select(F.col("node").alias("name"), F.col("node").alias("value"))
    far = spread(edges.select(F.col("dst").alias("name"), F.col("src").alias("target")), bare, max_depth)
    start = ends.where("entered is null").select(F.col("node").alias("root")).distinct()
    return start.join(far.withColumnRenamed("name", "root"), "root").select("root", F.col("depth").alias("hops"), F.col("value").alias("node"))
