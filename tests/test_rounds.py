"""What rounds read is made once, what they find is written once, and report readers need no order over rows."""

import random

import pytest
from pyspark.sql import functions as F

from quartzite.operators import fixpoints, graphs, interproc, shared


def test_a_closure_writes_each_fact_once(spark, monkeypatch):
    parts = []
    add = shared.Grown.add
    monkeypatch.setattr(shared.Grown, "add", lambda self, part: parts.append(add(self, part)) or parts[-1])
    steps = spark.createDataFrame([(k, k + 1) for k in range(5)], "a long, b long")
    closed = fixpoints.close(spark.createDataFrame([(0,)], "a long"), lambda new, _: new.join(steps, "a").select(F.col("b").alias("a")))
    assert sorted(r.a for r in closed.collect()) == list(range(6))
    assert sum(p.count() for p in parts) == 6


def test_many_parts_are_read_as_one(spark, monkeypatch):
    monkeypatch.setattr(shared.Grown, "FOLDERS", 2)
    grown = shared.Grown(spark.range(0).schema, spark)
    for k in range(5):
        grown.add(spark.range(k, k + 1))
    assert len(grown.paths) <= 2 and sorted(r.id for r in grown.all().collect()) == list(range(5))


@pytest.mark.parametrize("run", [
    lambda e: fixpoints.tainted(e.select(F.lit("f").alias("path"), F.col("dst").alias("target"), F.col("src").alias("source")), e.sparkSession.createDataFrame([("f", 0)], "path string, name long")),
    lambda e: fixpoints.points_to(e.select(F.when(F.col("src") == 0, "address").otherwise("copy").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"))),
    lambda e: graphs.reach(e, e.sparkSession.createDataFrame([(0,)], "node long")),
    lambda e: graphs.shortest_untested(e, e.sparkSession.createDataFrame([(k, 0.0 if k == 4 else 1.0) for k in range(5)], "node long, covered double")),
])
def test_edges_are_made_once(spark, run):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        made.add(1)
        return x

    edges = spark.createDataFrame([(k, k + 1) for k in range(4)], "src long, d long").repartition(1).select("src", seen("d").alias("dst"))
    run(edges).collect()
    assert made.value <= 8  # a copy for the plan's filter at most


def _written_rows(monkeypatch, columns):
    """Counts of the tables of these columns, as they are cut."""
    sizes, once = [], fixpoints.cut

    def counted(df):
        out = once(df)
        if set(columns) <= set(out.columns):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(fixpoints, "cut", counted)
    return sizes


def test_steps_into_what_is_tainted_are_dropped(spark, monkeypatch):
    """Every round reads the steps that are left, which shrink with what is reached; long ways from one source don't write them anew each round."""
    df = lambda rows, shape: spark.createDataFrame(rows, shape).coalesce(1)
    sizes = _written_rows(monkeypatch, ["path", "name", "target"])
    wide = [("f", 10 * k + i, 10 * k + i + 1) for k in range(20) for i in range(2)]
    got = fixpoints.tainted(df(wide, "path string, source long, target long"), df([("f", 10 * k) for k in range(20)] + [("g", 11)], "path string, name long"))
    assert sorted(map(tuple, got.collect())) == sorted([("f", 10 * k + i) for k in range(20) for i in range(3)] + [("g", 11)])
    assert sizes[0] == 40 and sizes[-1] <= 20
    sizes.clear()
    ring = [("f", i, (i + 1) % 7) for i in range(7)] + [("f", 3, None), ("f", 4, None), ("f", 6, 2), ("h", 0, 1)] + [("f", 100 + i, 200 + i) for i in range(60)]
    got = fixpoints.tainted(df(ring, "path string, source long, target long"), df([("f", 0), ("f", 0)], "path string, name long"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted([str(("f", i)) for i in range(7)] + ["('f', None)"])
    assert sizes == [70]  # no quarter of them was done


def test_untested_ways_don_t_grow_with_roots(spark, monkeypatch):
    """Thirty roots share one way: it is gone once, and least nodes, bounds, rings and uncovered roots count as before."""
    parts, add = [], shared.Grown.add
    monkeypatch.setattr(shared.Grown, "add", lambda self, part: parts.append(add(self, part)) or parts[-1])
    way = [(100 + r, 0) for r in range(30)] + [(i, i + 1) for i in range(5)] + [(5, 6), (5, 7), (6, 0), (200, 7), (201, 200)]
    cover = [(n, 1.0) for n in [*range(100, 130), *range(6), 201]] + [(6, 0.0), (7, 0.0), (200, None)]
    run = lambda depth: {tuple(r) for r in graphs.shortest_untested(spark.createDataFrame(way, "src long, dst long").coalesce(1), spark.createDataFrame(cover, "node long, covered double").coalesce(1), depth).collect()}
    assert run(None) == {(100 + r, 7, 6) for r in range(30)} | {(201, 2, 7)}
    assert sum(p.count() for p in parts) == 40  # a row a node
    assert run(3) == {(201, 2, 7)}


@pytest.mark.parametrize(("listed", "several"), [(6, False), (1, False), (6, True)])
def test_ancestors_as_lists_and_as_pairs(spark, monkeypatch, listed, several):
    monkeypatch.setattr(fixpoints, "LISTED", listed)
    rng = random.Random(listed)
    up = {(k, rng.randrange(24)) for k in range(20) for _ in range(2 if several else 1)}
    want = set(up)
    while more := {(a, d) for a, b in want for c, d in up if b == c} - want:
        want |= more
    got = [tuple(r) for r in fixpoints.ancestors(spark.createDataFrame(list(up), "type long, base long")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if a != b}


def test_summaries_take_a_join_a_round(spark, monkeypatch):
    joins = []

    def one_round(start, step):
        start = shared.cut(start)
        joins.append(step(start, start)._jdf.queryExecution().analyzed().toString().count("Join "))
        return start

    monkeypatch.setattr(interproc, "close", one_round)
    df = lambda shape, *rows: spark.createDataFrame(list(rows), shape)
    f = interproc.Facts(df("region string, target string, name string", ("a#1", "x", "@m")), df("region string, site int, line int, callee string, key string, pos int, name string", ("a#1", 1, 1, "g", "a#g", 0, "x")),
                        df("region string, line int, sink string, name string", ("a#1", 1, "eval", "x")), df("region string, name string", ("a#1", "x")), df("region string, pos int, name string", ("a#1", 0, "x")), df("region string, path string, key string", ("a#1", "a", "a#g")))
    interproc.summaries(f)
    assert joins == [1, 1, 1]
