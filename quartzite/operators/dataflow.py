"""Data flow over control-flow graphs as relations: reaching definitions, dominators, frontiers, phi nodes, control dependence, slices, facts
over an exploded graph. Graphs of any number of functions are one relation ``g, src, dst``; each round works on all of them.

A union problem is a closure that joins only what is new. The dominators are an intersection problem: each block holds the array of its
dominators, which shrinks from round to round until none changes; rounds follow the depth of a graph, arrays the depth of its dominator tree.

Defined results: blocks that the entry doesn't reach have no dominators and no frontier; a null name defines nothing; edges repeated count once.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.operators.fixpoints import close
from quartzite.operators.shared import cut


def reaching_definitions(edges: DataFrame, defs: DataFrame) -> DataFrame:
    """``g, block, name, origin``: definitions (``defs``: g, block, name) that may hold where a block begins. A block that defines a name kills others'."""
    e = edges.select("g", "src", "dst").distinct()
    d = defs.where("name is not null").select("g", "block", "name").distinct()
    start = d.join(e, (d.g == e.g) & (d.block == e.src)).select(d.g, F.col("dst").alias("block"), "name", F.col("src").alias("origin"))

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        through = new.join(d, ["g", "block", "name"], "left_anti")
        return through.join(e.withColumnRenamed("src", "block"), ["g", "block"]).select("g", F.col("dst").alias("block"), "name", "origin")

    return close(start, step)


def leaving_definitions(entering: DataFrame, defs: DataFrame) -> DataFrame:
    """What holds where a block ends: its own definitions, and those entering that it doesn't kill."""
    d = defs.where("name is not null").select("g", "block", "name").distinct()
    return d.withColumn("origin", F.col("block")).unionByName(entering.join(d, ["g", "block", "name"], "left_anti"))


def dominators(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """``g, block, doms``: the blocks that every way from the entry passes, the block itself among them, sorted. ``entries``: g, block."""
    e = cut(edges.select("g", "src", "dst").distinct())
    first = entries.select("g", "block", F.array("block").alias("doms"))
    known = cut(first)
    roots = entries.select("g", F.col("block").alias("dst")).distinct()
    for _ in count():
        met = e.join(known.select("g", F.col("block").alias("src"), "doms"), ["g", "src"]).join(roots, ["g", "dst"], "left_anti")
        # the common dominators of all predecessors that are known yet: those held by each
        held = met.select("g", "dst", "src", F.explode("doms").alias("dom")).groupBy("g", "dst", "dom").agg(F.count("*").alias("n"))
        n = met.groupBy("g", "dst").agg(F.count("*").alias("all"))
        common = held.join(n, ["g", "dst"]).where("n = all").groupBy("g", "dst").agg(F.collect_set("dom").alias("c"))
        new = n.join(common, ["g", "dst"], "left").select("g", F.col("dst").alias("block"), F.array_sort(F.array_union(F.coalesce("c", F.array().cast(known.schema["doms"].dataType)), F.array("dst"))).alias("doms"))
        after = cut(first.unionByName(new))
        if not after.join(known, ["g", "block", "doms"], "left_anti").limit(1).count():
            return after
        known = after


def immediate(doms: DataFrame) -> DataFrame:
    """``g, block, idom``: of a block's proper dominators the one with the most of its own."""
    d = doms.select("g", "block", F.explode("doms").alias("dom")).where("dom <> block")
    depth = doms.select("g", F.col("block").alias("dom"), F.size("doms").alias("depth"))
    return d.join(depth, ["g", "dom"]).groupBy("g", "block").agg(F.max_by("dom", "depth").alias("idom"))


def frontiers(edges: DataFrame, doms: DataFrame) -> DataFrame:
    """``g, block, at``: where the dominance of a block ends: it dominates a predecessor, but is no proper dominator itself."""
    d = doms.select("g", F.col("block").alias("src"), F.explode("doms").alias("block"))
    at = edges.select("g", "src", F.col("dst").alias("at")).distinct().join(d, ["g", "src"]).select("g", "block", "at").distinct()
    own = doms.select("g", F.col("block").alias("at"), F.explode("doms").alias("block")).where("at <> block")
    return at.join(own, ["g", "block", "at"], "left_anti")


def phi_nodes(frontier: DataFrame, defs: DataFrame) -> DataFrame:
    """``g, block, name``: the iterated frontier of a name's definitions."""
    f = frontier.select("g", "block", "at")
    start = defs.where("name is not null").select("g", "block", "name").distinct().join(f, ["g", "block"]).select("g", F.col("at").alias("block"), "name")
    return close(start, lambda new, _: new.join(f, ["g", "block"]).select("g", F.col("at").alias("block"), "name"))


def control_dependence(edges: DataFrame, exits: DataFrame) -> DataFrame:
    """``g, dependent, controller``: one way out of the controller must pass the block, and another need not. ``exits``: g, block."""
    e = edges.select("g", "src", "dst").distinct()
    post = cut(dominators(e.select("g", F.col("dst").alias("src"), F.col("src").alias("dst")), exits))
    d = post.select("g", F.col("block").alias("dst"), F.explode("doms").alias("dependent"))
    must = e.join(d, ["g", "dst"]).select("g", "dependent", F.col("src").alias("controller")).distinct()
    own = post.select("g", F.col("block").alias("controller"), F.explode("doms").alias("dependent")).where("controller <> dependent")
    return must.join(own, ["g", "dependent", "controller"], "left_anti")


def backward_slices(edges: DataFrame, control: DataFrame, mentions: DataFrame, criteria: DataFrame) -> DataFrame:
    """``g, criterion, name, block``: the blocks that a name at a block (``criteria``: g, criterion, name) hangs on: predecessors that mention it (``mentions``: g, block,
    name), and what controls a block of the slice."""
    back = edges.select("g", F.col("dst").alias("block"), "src").distinct()
    seen = mentions.where("name is not null").select("g", F.col("block").alias("src"), "name").distinct()
    held = control.select("g", F.col("dependent").alias("block"), F.col("controller").alias("src"))

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        data = new.join(back, ["g", "block"]).join(seen, ["g", "src", "name"])
        return data.select("g", "criterion", "name", F.col("src").alias("block")).union(new.join(held, ["g", "block"]).select("g", "criterion", "name", F.col("src").alias("block")))

    return close(criteria.select("g", "criterion", "name", F.col("criterion").alias("block")), step)


def exploded_reach(edges: DataFrame, blocks: DataFrame, seeds: DataFrame, mentions: Column | None = None) -> DataFrame:
    """``g, block, fact``: the exploded graph's nodes that the entry's facts reach; a null fact always does. A block whose text (``blocks``: g, block,
    text) holds a fact's name makes a fact ``<name>_propagated``. ``seeds``: g, block (the entry), fact."""
    e = edges.select("g", F.col("src").alias("block"), "dst").distinct()
    text = blocks.select("g", "block", "text")
    zero = "\x00"  # joins and anti-joins need a value
    start = seeds.select("g", "block", F.coalesce("fact", F.lit(zero)).alias("fact")).union(seeds.select("g", "block", F.lit(zero)))
    makes = mentions if mentions is not None else F.col("text").contains(F.col("fact"))

    def step(new: DataFrame, _: DataFrame) -> DataFrame:
        met = new.join(text, ["g", "block"], "left").withColumn("makes", F.coalesce(makes & (F.col("fact") != zero), F.lit(False)))
        facts = F.explode(F.when(F.col("makes"), F.array("fact", F.concat("fact", F.lit("_propagated")))).otherwise(F.array("fact"))).alias("fact")
        return met.select("g", "block", facts).join(e, ["g", "block"]).select("g", F.col("dst").alias("block"), "fact")

    return close(start, step).withColumn("fact", F.when(F.col("fact") != zero, F.col("fact")))
