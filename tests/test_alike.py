"""Files that are alike to the rules are read once."""

from pyspark.sql import functions as F

from quartzite.operators import node_rules
from quartzite.plans import more
from quartzite.sources import code_source


def test_findings_of_files_that_are_alike(spark, monkeypatch):
    """The same findings as of each file by itself, tests and endings apart, with one read of each text."""
    samples = [(language, t) for _, language, *texts in more.NODE_SAMPLES for t in texts] + [("typescript", None), ("typescript", ""), (None, "f()"), ("typescript", "function f(a) {\n" + "  b();\n" * 60 + "}\n")]
    paths = ("src/f{}.ts", "src/f{}.tsx", "src/tests/f{}.ts", "src/f{}.test.ts", "src/f{}.go", "f{}.java", "a.b/f{}", "tests/f{}.Ts", "src/f{}.rs")
    rows = [(p.format(f"{i}_{k}"), language, text) for i, (language, text) in enumerate(samples) for p in paths for k in (0, 1)]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    n = code_source.nodes(files, columns=node_rules.COLUMNS).cache()
    want = node_rules.function_findings(n).unionByName(node_rules.class_findings(n))
    read = []
    nodes = code_source.nodes
    monkeypatch.setattr(code_source, "nodes", lambda f, **k: read.append(f.count()) or nodes(f, **k))
    marked = node_rules.alike(files)
    got = marked.select("path", "same").join(node_rules.alike_findings(marked), "same").select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    assert read[0] <= len(set(samples)) * len(paths) < len(rows) and marked.where(F.col("same").isNull()).count() == 0
