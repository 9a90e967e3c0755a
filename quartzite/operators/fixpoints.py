"""Fixpoints over small relations of facts: taint, points-to, equivalence, datalog, ancestors. Each round joins what is new with the
facts, drops what is known by an anti-join, and writes what is left as one more part of the facts, until nothing is new; with a bound on the rounds, more
of them raise. Relations that rounds read are written before the first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzite.operators.shared import Grown, cut


def close(start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], rounds: int | None = None) -> DataFrame:
    """The least relation that holds ``start`` and, with every row, what ``step(new, all)`` derives from it."""
    start = start.distinct()
    known = Grown(start.schema, start.sparkSession)
    new = known.add(start)
    for turn in count(1):
        made = cut(step(new, known.all()).distinct())
        again = known.all().join(made, made.columns, "left_semi")  # few, if few were made
        new = known.add(made.join(again, made.columns, "left_anti"))
        if new.isEmpty():
            return known.all()
        if turn == rounds:
            raise RuntimeError("the closure did not settle")


def spread(steps: DataFrame, start: DataFrame, rounds: int | None = None) -> DataFrame:
    """``start`` and all that steps lead to from it, with the round that reaches a name first (``depth``, 0: start) and the least ``value`` brought then, if
    there are values. ``steps``: name, target and columns that both ends share; ``start``: those, name, perhaps value. A step into what is reached is done:
    steps are written anew without those whenever a quarter or more of them may go, so all rounds together read a few times the steps."""
    on = [c for c in steps.columns if c != "target"]
    least = [F.min(c).alias(c) for c in start.columns if c not in on]
    one = lambda rows, depth: (rows.groupBy(*on).agg(*least) if least else rows.select(*on).distinct()).withColumn("depth", F.lit(depth))

    def met(rows: DataFrame, name: str, facts: DataFrame, how: str = "left_anti") -> DataFrame:
        same = [F.col(f"rows.{c}") == F.col(f"facts.{c}") for c in on if c != "name"] + [F.col(f"rows.{name}").eqNullSafe(F.col("facts.name"))]
        return rows.alias("rows").join(facts.select(*on).alias("facts"), reduce(Column.__and__, same), how)

    first = one(start, 0)
    known, recent = Grown(first.schema, first.sparkSession), Grown(first.schema, first.sparkSession)
    new = known.add(first)
    left = cut(met(steps, "target", new))
    size, since = left.count(), 0
    for depth in count(1) if rounds is None else range(1, rounds + 1):
        made = one(new.join(left, on).drop("name", "depth").withColumnRenamed("target", "name"), depth)
        if recent.paths:  # steps into these are left
            made = cut(made)
            made = met(made, "name", met(recent.all(), "name", made, "left_semi"))  # few, if few were made
        new = known.add(made)
        found = new.count()
        if not found:
            break
        recent.take(known)
        since += found
        if 4 * since >= size:
            left = cut(met(left, "target", recent.all()))
            size, since, recent.paths = left.count(), 0, []
        if not size:
            break
    return known.all()


def tainted(assigns: DataFrame, sources: DataFrame) -> DataFrame:
    """``path, name``: names that a source reaches through assignments of a file, in any order. ``assigns``: path, target, source."""
    return spread(assigns.select("path", F.col("source").alias("name"), "target"), sources.select("path", "name")).select("path", "name")


def taint_flows(assigns: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """Sink calls whose argument is tainted and not cleansed. ``sinks``: path, sink, argument, line, sanitized."""
    t = tainted(assigns, sources)
    return sinks.where(~F.col("sanitized")).join(t.withColumnRenamed("name", "argument"), ["path", "argument"], "left_semi")


def points_to(constraints: DataFrame) -> DataFrame:
    """Inclusion-based points-to sets ``pointer, target``. ``constraints``: kind (address, copy, load, store), a, b: a = &b, a = b, a = *b, *a = b."""
    of = lambda k: constraints.where(F.col("kind") == k).select("a", "b")
    constraints = cut(constraints.select("kind", "a", "b"))
    copy, load, store = of("copy"), of("load"), of("store")

    def step(new: DataFrame, known: DataFrame) -> DataFrame:
        """What a new fact yields by each constraint: as the fact of the pointer, or as that of what it points to."""
        of_ = lambda facts, p, t: facts.select(F.col("pointer").alias(p), F.col("target").alias(t))
        direct = new.join(copy.withColumnRenamed("b", "pointer"), "pointer").select(F.col("a").alias("pointer"), "target")
        out = direct
        for first, second in ((new, known), (known, new)):
            loaded = of_(first, "b", "q").join(load, "b").join(of_(second, "q", "t"), "q").select(F.col("a").alias("pointer"), F.col("t").alias("target"))
            stored = of_(first, "a", "q").join(store, "a").join(of_(second, "b", "t"), "b").select(F.col("q").alias("pointer"), F.col("t").alias("target"))
            out = out.union(loaded).union(stored)
        return out

    return close(of("address").select(F.col("a").alias("pointer"), F.col("b").alias("target")), step)


TOGETHER = 200_000  # pairs that a task joins at once, a few MB


def _together(batches: Iterator[pd.DataFrame], together: int) -> Iterator[pd.DataFrame]:
    """``node, root`` within each run of so many pairs as they come: a node and the least member of what the run joins it to."""

    def joined(run: list[pd.DataFrame]) -> pd.DataFrame:
        codes, names = pd.factorize(pd.concat([b[c] for c in ("a", "b") for b in run], ignore_index=True), sort=True)
        up, half = list(range(len(names))), len(codes) // 2
        for x, y in zip(codes[:half].tolist(), codes[half:].tolist(), strict=True):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[max(x, y)] = min(x, y)
        for k, over in enumerate(up):  # none goes over to a greater one, so the root of the one before is known
            up[k] = up[over]
        return pd.DataFrame({"node": names, "root": names.take(up)})

    run, size = [], 0
    for b in batches:
        run.append(b)
        size += len(b)
        if size >= together:
            yield joined(run)
            run, size = [], 0
    if size:
        yield joined(run)


def equivalence(pairs: DataFrame, rounds: int | None = None, together: int = TOGETHER) -> DataFrame:
    """``node, root``: unification classes, named by their least member. Pairs that stand near each other are joined where they stand; what is
    left are links between the roots of a node that several runs hold, few where classes stand together: up to ``together`` of them are one more run, and
    more are contracted. With a bound on the rounds, all pairs take them."""
    ends = pairs.select("a", "b").where("a is not null and b is not null")
    kind = ends.schema["a"].dataType
    if rounds is not None or kind != ends.schema["b"].dataType or not isinstance(kind, (T.IntegralType, T.StringType)):
        return _contracted(ends, rounds)
    joined = lambda pairs: pairs.mapInPandas(lambda batches: _together(batches, together), T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))
    placed = cut(joined(ends))
    met = cut(placed.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("far")))
    several = cut(met.where("root <> far").select("node", F.col("root").alias("least")))
    if several.isEmpty():
        return met.select("node", "root")
    links = cut(placed.join(several, "node").where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b")))
    group = joined(links.coalesce(1)) if links.limit(together + 1).count() <= together else _contracted(links)
    over = cut(group.select(F.col("node").alias("root"), F.col("root").alias("top")))
    return met.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def _contracted(ends: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node, root`` of pairs without nulls. Each round a node goes over to that of itself and its neighbours which has the
    least random rank; pairs within what it went over to are done, and the others, about half, go on between those. So all relations together
    are a few times the pairs, however long the chains; ranks are new each round."""
    ends = cut(ends)
    left = cut(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    for turn in count(1):
        if not left.limit(1).count():
            break
        if rounds is not None and turn > rounds:
            raise RuntimeError("the classes did not settle")
        rank = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: B023, E731
        beside = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")
        near = beside.groupBy(F.col("a").alias("node")).agg(F.min_by("b", rank("b")).alias("near"))
        move = cut(near.select("node", F.when(rank("near") < rank("node"), F.col("near")).otherwise(F.col("node")).alias("to")))
        moves.append(move)
        over = left.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        left = cut(over.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    alone = ends.where("a = b").select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    if not moves:
        return alone
    group = moves[-1].withColumnRenamed("to", "top")
    for move in reversed(moves[:-1]):  # from the last round back: where each went that others had gone over to
        group = cut(move.join(group.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("top", "to").alias("top")))
    least = group.groupBy("top").agg(F.min("node").alias("root"))
    return group.join(least, "top").select("node", "root").unionByName(alone.join(group, "node", "left_anti"))


def datalog(facts: DataFrame, rules: list[tuple[str, str]], rounds: int | None = None) -> DataFrame:
    """Facts ``relation, terms`` closed under rules head <- body of one literal each; the terms are copied as they are."""
    table = facts.sparkSession.createDataFrame(rules, "head string, body string")
    return close(facts.select("relation", "terms"), lambda new, _: new.join(F.broadcast(table.withColumnRenamed("body", "relation")), "relation").select(F.col("head").alias("relation"), "terms"), rounds)


LISTED = 6  # doublings in which a type holds its ancestors as a list, of 64 at most; longer ways go on as pairs


def ancestors(parents: DataFrame, rounds: int | None = None) -> DataFrame:
    """``type, ancestor`` of superclass chains, safe on cycles. The ways of 2^k hops are joined to all that are no longer, so their length doubles each
    round and a way is made once. Where a type has one base, it holds its ancestors as a list at first. ``parents``: type, base."""
    up = cut(parents.select("type", F.col("base").alias("ancestor")).where("type is not null and ancestor is not null").distinct())
    jump, turn = up, 0
    if up.groupBy("type").count().where("count > 1").isEmpty():
        lists = cut(up.select("type", F.array("ancestor").alias("up"), F.col("ancestor").alias("top")))
        while turn < LISTED and not lists.where("top is not null").isEmpty():
            turn += 1
            if rounds is not None and turn > rounds:
                raise RuntimeError("the closure did not settle")
            more = lists.select(F.col("type").alias("top"), F.col("up").alias("over"), F.col("top").alias("next"), F.size("up").alias("n"))
            both = lists.join(more, "top", "left").select("type", F.when(F.col("over").isNull(), F.col("up")).otherwise(F.array_distinct(F.concat("up", "over"))).alias("all"), "next", F.size("up") + F.col("n")).toDF("type", "up", "top", "n")
            lists = cut(both.select("type", "up", F.when(F.size("up") == F.col("n"), F.col("top")).alias("top")))  # a list that meets itself is a whole cycle
        up = lists.select("type", F.explode("up").alias("ancestor"))
        jump = lists.where("top is not null").select("type", F.col("top").alias("ancestor"))
        if jump.isEmpty():
            return up.where("type <> ancestor")
    known = Grown(up.schema, up.sparkSession)
    known.add(up)
    over = lambda a, b: a.join(b.select(F.col("type").alias("ancestor"), F.col("ancestor").alias("above")), "ancestor").select("type", F.col("above").alias("ancestor")).distinct()
    while True:
        turn += 1
        new = known.add(cut(over(jump, known.all())).join(known.all(), ["type", "ancestor"], "left_anti"))
        if new.isEmpty():
            return known.all().where("type <> ancestor")
        if turn == rounds:
            raise RuntimeError("the closure did not settle")
        jump = cut(over(jump, jump))
