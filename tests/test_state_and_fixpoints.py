"""Streams, fixpoints, syntax nodes and sinks on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from quartzite.operators import code, fixpoints, rules
from quartzite.sources import files, python_source, sinks
from quartzite.streaming import policy_state


def run_stream(spark, tmp_path, schema, batches, build):
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src / "*"))
    q = build(stream).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table("out").collect()]


def test_breaker_keeps_state_between_batches(spark, tmp_path):
    schema = "session string, seq long, denied_rules array<string>"
    batches = [[("s", 1, ["a"]), ("s", 2, ["a", "b"])], [("s", 3, ["a"])], [("s", 4, []), ("s", 5, ["a"])]]
    rows = run_stream(spark, tmp_path, schema, batches, policy_state.circuit_breaker)
    assert sorted(rows) == [("s", 1, "a", 1, False), ("s", 2, "a", 2, False), ("s", 2, "b", 1, False), ("s", 3, "a", 3, True), ("s", 5, "a", 1, False)]


def test_issue_workflow(spark):
    steps = [(1, "confirm"), (1, "resolve"), (1, "confirm"), (1, "close"), (2, "close"), (3, "resolve"), (3, "reopen"), (3, "reopen"), (4, "resolve"), (4, "resolve"), (4, "unconfirm")]
    e = spark.createDataFrame([(i, n, t, "Fixed" if n != 9 else "WontFix") for n, (i, t) in enumerate(steps)], "issue long, seq long, transition string, resolution string")
    assert {tuple(r) for r in policy_state.issue_states(e).collect()} == {(1, "Closed", "Fixed", 1), (2, "Open", None, 1), (3, "Open", None, 1), (4, "Resolved", "Fixed", 2)}


def test_fixpoints(spark):
    c = spark.createDataFrame([("address", "p", "x"), ("copy", "q", "p"), ("address", "r", "q"), ("load", "s", "r"), ("store", "r", "t"), ("address", "t", "y")], "kind string, a string, b string")
    assert {tuple(r) for r in fixpoints.points_to(c).collect()} == {("p", "x"), ("q", "x"), ("q", "y"), ("r", "q"), ("s", "x"), ("s", "y"), ("t", "y")}
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a int, b int")
    assert {tuple(r) for r in fixpoints.equivalence(pairs).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    f = spark.createDataFrame([("p", ["x", "y"])], "relation string, terms array<string>")
    assert {r.relation for r in fixpoints.datalog(f, [("q", "p"), ("p", "q"), ("z", "q")]).collect()} == {"p", "q", "z"}
    up = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "type string, base string")
    assert {tuple(r) for r in fixpoints.ancestors(up).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "b")}
    assigns = spark.createDataFrame([("f", "b", "a"), ("f", "c", "b"), ("g", "c", "b")], "path string, target string, source string")
    sources = spark.createDataFrame([("f", "a")], "path string, name string")
    sink = spark.createDataFrame([("f", "exec", "c", 9, False), ("f", "exec", "c", 10, True), ("g", "exec", "c", 1, False)], "path string, sink string, argument string, line int, sanitized boolean")
    assert [r.line for r in fixpoints.taint_flows(assigns, sources, sink).collect()] == [9]


SOURCE = '''
import os, pickle
from a.b import *
DEBUG = True
class C:
    items = []
    def __init__(self):
        self.a = 1
    def one(self):
        return self.a
    def two(self):
        return self.a if self.b else self.b
    def three(self):
        return self.z
def f(x, y={}):
    def inner():
        while x: pass
    try:
        os.system(x)
    except:
        raise ValueError("bad")
    if x == None or type(x) == int:
        f2(open("a"))
    cursor.execute(f"select {x}")
    requests.get(x, verify=False)
def f2(z): return f2(z)
async def g():
    time.sleep(1)
    lock = threading.Lock()
    for i in x:
        M.objects.get(id=i)
'''


def test_nodes_rules_and_metrics(spark):
    src = spark.createDataFrame([("m.py", SOURCE), ("bad.py", "def ("), ("empty.py", None)], "path string, content string")
    n = python_source.nodes(src).cache()
    cc = {r.name: r.cyclomatic for r in code.function_complexity(n).collect()}
    assert cc == {"__init__": 1, "one": 1, "two": 2, "three": 1, "f": 4, "inner": 2, "f2": 1, "g": 2}
    found = {r.rule_id for r in rules.node_findings(n).collect()}
    want = "os-system-usage bare-except none-comparison-with-equality type-comparison open-without-encoding unclosed-open-file sql-injection-string-building requests-verify-false requests-missing-timeout mutable-default-argument mutable-class-attribute wildcard-import django-debug-true raise-without-from-in-except async-function-with-sync-blocking-call threading-mixed-with-asyncio django-queryset-evaluated-in-loop"
    assert {f"python:{w}" for w in want.split()} <= found
    assert [(r.path, r.kind) for r in n.where("kind = 'ERROR'").collect()] == [("bad.py", "ERROR")]
    names = {(r.path, r.node_id): r.name for r in n.where("kind = 'FunctionDef'").collect()}
    assert {(names[r.path, r.caller], names[r.path, r.callee]) for r in code.call_edges(n).collect()} == {("f", "f2")}
    assert [r.lcom for r in code.lcom(n).collect()] == [2] and [r.wmc for r in code.wmc(n).collect()] == [5]
    assert {r.module for r in code.imports(n).collect()} == {"os", "pickle", "a.b"}
    inside = n.where("kind = 'FunctionDef' and name = 'inner'").first()
    outer = n.where("kind = 'FunctionDef' and name = 'f'").first()
    assert outer.node_id < inside.node_id and outer.post > inside.post and inside.owner_fn_id == outer.node_id


def test_secrets_and_files(spark, tmp_path):
    key = "AKIA" + "A" * 16
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, text in {"a/x.py": f"k = '{key}'", "a/y.txt": key, "node_modules/z.js": key, "a/t.min.js": key}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "a" / "latin.py").write_bytes(b"\xff\xfe")
    f = files.source_files(spark, str(tmp_path))
    assert [(r.path, r.language) for r in f.collect()] == [("a/x.py", "python")]
    lines = f.select("path", F.lit(1).alias("line"), F.col("content").alias("text"))
    assert [r.rule_id for r in rules.secret_findings(lines).collect()] == ["secrets:aws-access-key-id"]


def test_sinks(spark):
    f = spark.createDataFrame([("r:x", "Blocker", "m", "p.py", 3)], "rule_id string, severity string, message string, path string, start_line int")
    log = json.loads(sinks.sarif_log(f).first().sarif)
    assert log["runs"][0]["results"][0]["level"] == "error" and log["runs"][0]["results"][0]["ruleId"] == "r:x"
    m = spark.createDataFrame([("ncloc", 5.0)], "key string, value double")
    assert json.loads(sinks.findings_json(f, m).first().report)["measures"] == {"ncloc": 5.0}
    assert sinks.text_report(f).first().line == "p.py:3 [Blocker] r:x: m"
    assert sinks.mermaid(spark.createDataFrame([("a", "b")], "src string, dst string")).first().chart == 'flowchart LR\n  "a" --> "b"'


def test_unfinished_fixpoints_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "type int, base int")
    assert fixpoints.ancestors(chain, 4).count() == 21
    with pytest.raises(RuntimeError):
        fixpoints.ancestors(chain, 1)
    pairs = chain.toDF("a", "b")
    assert {r.root for r in fixpoints.equivalence(pairs, 7).collect()} == {0}
    with pytest.raises(RuntimeError):
        fixpoints.equivalence(pairs, 1)


def test_lcom_of_a_long_chain(spark):
    """Forty methods, each sharing a field with the next only, are one group."""
    body = "".join(f"    def m{i}(self):\n        return self.f{i} + self.f{i + 1}\n" for i in range(40))
    n = python_source.nodes(spark.createDataFrame([("m.py", "class C:\n" + body)], "path string, content string"))
    assert [r.lcom for r in code.lcom(n).collect()] == [1]


def test_points_to_against_brute_force(spark):
    import random

    rng = random.Random(4)
    for _ in range(2):
        rows = [(rng.choice(["address", "copy", "copy", "load", "store"]), rng.randrange(8), rng.randrange(8)) for _ in range(14)]
        facts = {(a, b) for k, a, b in rows if k == "address"}
        while True:
            new = {(a, t) for k, a, b in rows if k == "copy" for p, t in facts if p == b}
            new |= {(a, t) for k, a, b in rows if k == "load" for p, q in facts if p == b for p2, t in facts if p2 == q}
            new |= {(q, t) for k, a, b in rows if k == "store" for p, q in facts if p == a for p2, t in facts if p2 == b}
            if new <= facts:
                break
            facts |= new
        c = spark.createDataFrame([*rows, ("address", 99, 99)], "kind string, a int, b int")
        assert {tuple(r) for r in fixpoints.points_to(c).collect()} == facts | {(99, 99)}


def test_issues_that_batches_part(spark):
    """States go on from batch to batch; the null issue is one too; no task holds an issue whole."""
    steps = [(i, n, t) for i in (*range(40), None) for n, t in enumerate(["confirm", "resolve", "close", "reopen", "confirm"][: 3 + (i or 0) % 3])]
    e = spark.createDataFrame([(i, n, t, "Fixed") for i, n, t in reversed(steps)], "issue long, seq long, transition string, resolution string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = policy_state.issue_states(e)
        got = {tuple(r) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(i, "Closed", "Fixed", (i or 0) % 3) for i in (*range(40), None)}
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
