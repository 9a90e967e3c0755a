"""Control flow, dominators, tree distance, patterns."""

import random

import pytest
from pyspark.sql import functions as F

from quartzite.operators import flow
from quartzite.sources import code_source, python_source


def test_control_flow(spark):
    src = "def f(x):\n    if x:\n        return 1\n    while x:\n        g(x)\n    return 2\n"
    n = python_source.nodes(spark.createDataFrame([("m.py", src)], "path string, content string"))
    e = flow.control_flow(n)
    assert flow.flow_complexity(e).first().complexity >= 3
    kinds = sorted(r.kind for r in e.collect())
    assert kinds.count("true") == 2 and kinds.count("false") == 2 and "back" in kinds and kinds.count("return") == 2
    idom = {r.block: r.idom for r in flow.dominators(e).collect()}
    assert idom[1] == 0
    assert {r.controller for r in flow.control_dependence(e).collect()}


def test_control_flow_of_arms_and_jumps(spark):
    """Complexity is one more than the decisions, whatever arm jumps; dead code makes no blocks."""
    cases = {
        "if x:\n  return 1\n else:\n  b()\n c()": (2, {"true", "false", "return", "join"}),
        "if x:\n  a()\n elif y:\n  b()\n else:\n  c()": (3, {"true", "false", "join"}),
        "while x:\n  if y:\n   break\n  if z:\n   continue\n  a()": (4, {"break", "continue", "back", "true", "false", "join"}),
        "try:\n  a()\n except A:\n  b()\n except B:\n  return 2\n else:\n  c()\n finally:\n  d()": (3, {"except", "join", "return"}),
        "match x:\n  case 1:\n   a()\n  case _:\n   b()": (2, {"case", "join"}),
        "return 1\n if x:\n  a()": (1, {"return"}),
        "for i in x:\n  return i\n else:\n  b()": (2, {"true", "false", "return", "join"}),
    }
    src = [(f"m{i}.py", f"def f(x, y, z):\n {body}\n") for i, body in enumerate(cases)]
    e = flow.control_flow(python_source.nodes(spark.createDataFrame(src, "path string, content string"))).cache()
    got = {r.path: r.complexity for r in flow.flow_complexity(e).collect()}
    for i, (want, kinds) in enumerate(cases.values()):
        rows = [r for r in e.collect() if r.path == f"m{i}.py"]
        assert got[f"m{i}.py"] == want and {r.kind for r in rows} == kinds, (i, got, rows)
        ways: dict[int, set[int]] = {}
        for r in rows:
            ways.setdefault(r.src, set()).add(r.dst)
        seen, todo = {0}, [0]
        while todo:
            todo += [d for d in ways.get(todo.pop(), ()) if d not in seen and not seen.add(d)]
        assert seen == {0} | {r.dst for r in rows}  # all is reached


def test_tree_distance():
    t = lambda kinds, parents: flow.post_order(kinds, parents)
    a = t(list("fdace"), [None, 0, 1, 1, 0])
    assert flow.tree_distance(a, a) == 0
    assert flow.tree_distance(a, t(list("fdac"), [None, 0, 1, 1])) == 1
    assert flow.tree_distance(a, t(list("fdxce"), [None, 0, 1, 1, 0])) == 1
    rng = random.Random(1)
    for _ in range(20):  # a metric: symmetric, and no more than the sizes
        mk = lambda: t([rng.choice("ab") for _ in range(6)], [None, *(rng.randrange(i) for i in range(1, 6))])
        try:
            x, y = mk(), mk()
        except IndexError:
            continue
        assert flow.tree_distance(x, y) == flow.tree_distance(y, x) <= len(x) + len(y)


def test_patterns(spark):
    src = "eval(x)\nfoo(eval)\nprint(eval(y), 1)\n"
    n = python_source.nodes(spark.createDataFrame([("m.py", src)], "path string, content string"))
    rows = flow.find_pattern(n, '(Call (Identifier) @f (Identifier) @a (#eq? @f "eval"))').collect()
    assert sorted((r.f, r.a) for r in rows) == [("eval", "x"), ("eval", "y")]
    for bad in ("", "(Call", "Call)", "(Call (#foo? @a \"x\"))"):
        with pytest.raises(ValueError):
            flow.pattern_plan(bad)


def test_functions_that_batches_part_and_nodes_left_out(spark):
    """Edges and metrics are the same from statements only, from the columns asked for, and over batches that part a function."""
    from quartzite.operators import code

    src = "".join(f"def f{i}(x):\n    for a in x:\n        if a > {i} and x[a]:\n            continue\n        try:\n            g(a)\n        except E as e:\n            raise\n    match x:\n        case 1:\n            return\n        case _:\n            pass\n\n" for i in range(5))
    files = spark.createDataFrame([("a.py", src), ("b.py", src.replace("continue", "break")), ("c.py", "def f(:"), ("d.py", None)], "path string, content string")
    whole = python_source.nodes(files)
    some = python_source.nodes(files, columns=("path", "node_id", "parent_id", "kind", "name", "text", "owner_fn_id", "flags"), expressions=False)
    want = sorted(tuple(r) for r in flow.control_flow(whole).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        out = flow.control_flow(some)
        assert sorted(tuple(r) for r in out.collect()) == want and len({r[:2] for r in want}) == 10
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    cc = python_source.nodes(files, columns=code.COMPLEXITY_COLUMNS, kinds=code.COMPLEXITY_KINDS)
    assert sorted(map(tuple, code.function_complexity(cc).collect())) == sorted(map(tuple, code.function_complexity(whole).collect()))
    assert code.function_complexity(whole)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    st = python_source.nodes(files, columns=("path", "kind"), kinds=code.STRUCTURE_KINDS)
    assert sorted(map(tuple, code.structure(st).collect())) == sorted(map(tuple, code.structure(whole).collect())) and code.structure(st).count() == 4


def test_files_are_dealt_over_all_tasks(spark):
    """Small sources that a shuffle made aren't parsed in one task."""
    src = spark.range(64).groupBy("id").agg(F.concat(F.lit("f"), F.max("id")).alias("path"), F.lit("x = 1").alias("content"))
    assert python_source.nodes(src).select(F.spark_partition_id().alias("p")).distinct().count() == 4
    assert code_source.nodes(src.withColumn("language", F.lit("go"))).select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_complexity_where_files_are_read(spark):
    """As from nodes and edges, for functions of any form; no rows travel."""
    body = "    for a in x:\n        if a > {0} and x[a]:\n            continue\n        try:\n            g{0}(a)\n        except E as e:\n            raise\n    match x:\n        case 1:\n            return\n        case _:\n            pass\n"
    odd = "class C:\n  @p\n  async def m(self):\n    def n1(a, b={}):\n      while a: break\n      else: return\n    return 1\n    if x: y\n@d\ndef f(x) -> int:\n  '''doc'''\n  with x: return (yield)\ndef f(x): return 1 if x else 2\ndef empty(): ...\nlambda: 0\nif x:\n  def g1():\n    while x: pass\n"
    files = [(f"m{k}.py", "".join(f"def f{i}(x):\n" + body.format(i + 1) * (1 + i % 3) for i in range(k, k + 9)) + (odd if k % 2 else "")) for k in range(8, 13)] + [("e.py", "def f(:"), ("n.py", None)]
    df = spark.createDataFrame(files, "path string, content string")
    n = python_source.nodes(df).cache()
    names = n.where("kind = 'FunctionDef'").select("path", F.col("node_id").alias("fn"), "name", F.col("start_line").alias("line"))
    want = flow.flow_complexity(flow.control_flow(n)).join(names, ["path", "fn"]).select("path", "name", "line", "complexity")
    out = flow.source_complexity(df)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.count() == 45 + 2 * 6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
