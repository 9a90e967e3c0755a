"""Data flow on random graphs against plain evaluations."""

import random

import pytest

from quartzite.operators import dataflow


def graph(seed, n=9, m=16):
    rng = random.Random(seed)
    edges = {(i, i + 1) for i in range(n - 1)} | {(rng.randrange(n - 1), rng.randrange(1, n)) for _ in range(m - n)}
    return edges, {(b, rng.choice("xyz")) for b in range(n) for _ in range(rng.randrange(2))}


def reach(edges, start, without=None):
    seen, todo = set(), [start] if start != without else []
    while todo:
        b = todo.pop()
        if b not in seen:
            seen.add(b)
            todo += [d for s, d in edges if s == b and d != without]
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_flow_on_random_graphs(spark, seed):
    graphs = {g: graph(10 * seed + g) for g in range(4)}
    e = spark.createDataFrame([(g, s, d) for g, (edges, _) in graphs.items() for s, d in edges], "g int, src int, dst int")
    defs = spark.createDataFrame([(g, b, v) for g, (_, d) in graphs.items() for b, v in d] + [(0, 1, None)], "g int, block int, name string")
    entry = spark.createDataFrame([(g, 0) for g in graphs], "g int, block int")
    last = spark.createDataFrame([(g, 8) for g in graphs], "g int, block int")
    rows = lambda df: {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()}
    doms = dataflow.dominators(e, entry)
    held, front = dataflow.reaching_definitions(e, defs), dataflow.frontiers(e, doms)
    control = dataflow.control_dependence(e, last)
    got = [rows(x) for x in (held, doms, dataflow.immediate(doms), front, dataflow.phi_nodes(front, defs), control, dataflow.backward_slices(e, control, defs, spark.createDataFrame([(g, 8, "x") for g in graphs], "g int, criterion int, name string")))]
    want = [set() for _ in got]
    for g, (edges, d) in graphs.items():
        for b, v in d:
            todo, seen = [t for s, t in edges if s == b], set()
            while todo:
                at = todo.pop()
                if at not in seen:
                    seen.add(at)
                    want[0].add((g, at, v, b))
                    todo += [t for s, t in edges if s == at] if (at, v) not in d else []
        live = reach(edges, 0)
        dom = {b: {x for x in live if x == b or b not in reach(edges, 0, x)} for b in live}
        want[1] |= {(g, b, tuple(sorted(x))) for b, x in dom.items()}
        want[2] |= {(g, b, max(x - {b}, key=lambda y: len(dom[y]))) for b, x in dom.items() if b}
        df = {(x, t) for s, t in edges if s in live for x in dom[s] if x not in dom[t] - {t}}
        want[3] |= {(g, *x) for x in df}
        phi = {(t, v) for b, v in d for x, t in df if x == b}
        while True:
            more = phi | {(t, v) for b, v in phi for x, t in df if x == b}
            if more == phi:
                break
            phi = more
        want[4] |= {(g, *x) for x in phi}
        back = {(t, s) for s, t in edges}
        ends = reach(back, 8)
        post = {b: {x for x in ends if x == b or b not in reach(back, 8, x)} for b in ends}
        cd = {(x, s) for s, t in edges if t in ends for x in post[t] if x not in post.get(s, set()) - {s}}
        want[5] |= {(g, *x) for x in cd}
        cut, todo = {8}, [8]
        while todo:
            b = todo.pop()
            for x in {s for s, t in edges if t == b and (s, "x") in d} | {c for y, c in cd if y == b}:
                if x not in cut:
                    cut.add(x)
                    todo.append(x)
        want[6] |= {(g, 8, "x", b) for b in cut}
    assert got == want
