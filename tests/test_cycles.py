"""Strongly connected components in one task and over the cluster, against mutual reachability."""

import random

import pytest

from quartzite.operators import fixpoints, graphs, layers


def mutual(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {n: reach(n) for e in edges for n in e}
    on = {n: {m for m in far[n] if n in far[m]} | {n} for n in far}
    return {(n, min(m)) for n, m in on.items() if len(m) > 1}


def graph(n, pairs, chain, seed=4):
    rng = random.Random(seed)
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(n + n // 4)} | {(100 + i, 101 + i) for i in range(chain)}
    return edges | {(200 + 2 * i + a, 200 + 2 * i + b) for i in range(pairs) for a, b in ((0, 1), (1, 0), (1, 2))}  # linked pairs


@pytest.mark.parametrize("seed", range(30))
def test_components_of_a_graph_in_memory(seed):
    edges = graph(12, 3, 4, seed)
    group = graphs.components_of(sorted(edges))
    members = {}
    for node, g in group.items():
        members.setdefault(g, set()).add(node)
    assert {(n, min(m)) for m in members.values() if len(m) > 1 for n in m} == mutual(edges)


def test_components_coloured_over_the_cluster(spark):
    edges = graph(10, 2, 3)
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    assert {tuple(r) for r in graphs.cycles(df, local_edges=4).collect()} == mutual(edges)
    assert graphs.cycles(df.limit(0)).count() == 0


def test_long_chains_and_many_linked_pairs_take_one_task(spark):
    edges = [(i, i + 1) for i in range(10_000)] + [(20_000 + 2 * i + a, 20_000 + 2 * i + b) for i in range(1000) for a, b in ((0, 1), (1, 0), (1, 2))]
    got = {tuple(r) for r in graphs.cycles(spark.createDataFrame([(f"n{a:06}", f"n{b:06}") for a, b in edges], "src string, dst string")).collect()}
    assert got == {(f"n{20_000 + 2 * i + k:06}", f"n{20_000 + 2 * i:06}") for i in range(1000) for k in (0, 1)}


def test_pieces_beyond_one_task_are_settled_without_colouring(spark, monkeypatch):
    """More edges than a task settles, in small pieces: none is coloured, and the classes of long chains are whole."""
    monkeypatch.setattr(graphs, "_least_above", lambda edges: pytest.fail("coloured"))
    rings = {(100 * k + i, 100 * k + (i + 1) % 7) for k in range(40) for i in range(7)}
    tails = {(100 * k + i, 100 * k + i + 1) for k in range(40) for i in range(6, 20)}
    df = spark.createDataFrame(sorted(rings | tails), "src long, dst long")
    assert {tuple(r) for r in graphs.cycles(df, local_edges=50).collect()} == {(100 * k + i, 100 * k) for k in range(40) for i in range(7)}


def test_classes_by_contraction(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(260)] + [(5000, 5000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    for kind, of in (("long", int), ("string", lambda x: f"n{x:05}")):
        df = spark.createDataFrame([(of(a), of(b)) for a, b in pairs], f"a {kind}, b {kind}")
        assert {tuple(r) for r in fixpoints.equivalence(df).collect()} == {(of(x), of(find(x))) for p in pairs for x in p}


def classes_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {(x, find(x)) for p in pairs for x in p}


def test_classes_that_stand_together_take_no_round(spark, monkeypatch):
    """Pairs of a class in one partition are joined there: no pair goes over the cluster."""
    monkeypatch.setattr(fixpoints, "_contracted", lambda *_: pytest.fail("contracted"))
    pairs = [(100 * k + i, 100 * k + i + 1) for k in range(30) for i in range(k % 9 + 1)] + [(9000, 9000)]
    df = spark.createDataFrame(pairs, "a long, b long").coalesce(1)
    assert sorted(tuple(r) for r in fixpoints.equivalence(df).collect()) == sorted(classes_of(pairs))


@pytest.mark.parametrize(("together", "kind", "of"), [(3, "long", int), (500, "string", lambda x: f"n{x:05}")])
def test_classes_over_many_runs(spark, together, kind, of):
    """A node that very many runs hold, a chain over all of them, nulls and self pairs: whole classes whatever a run holds."""
    pairs = [(0, 10 + i) for i in range(30)] + [(1000 + i, 1001 + i) for i in range(12)] + [(5000, 5000)]
    random.Random(8).shuffle(pairs)
    df = spark.createDataFrame([(of(a), of(b)) for a, b in pairs] + [(None, of(7)), (of(8), None)], f"a {kind}, b {kind}")
    got = [tuple(r) for r in fixpoints.equivalence(df, together=together).collect()]
    assert len(got) == len(set(got)) and set(got) == {(of(x), of(y)) for x, y in classes_of(pairs)}


def test_walks_over_many_components(spark):
    """Components that batches part are walked whole."""
    e = [(1000 * k + i, 1000 * k + (i + 1) % 30) for k in range(20) for i in range(30)]
    df = spark.createDataFrame(e, "src long, dst long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.scc: r.path for r in layers.cycle_paths(df, graphs.cycles(df)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1000 * k: " -> ".join(str(1000 * k + i % 30) for i in range(31)) for k in range(20)}
