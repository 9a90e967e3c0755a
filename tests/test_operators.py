"""Semantics that the tables at hand don't reach."""

from pyspark.sql import functions as F

from quartzite.functions import scalars as S
from quartzite.operators import clones, graphs
from quartzite.sources import reports


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(column.alias("v")).first().v


def test_suppression(spark):
    rows = [("x // quartzite-ignore", True), ("x // quartzite-ignore: a, b:c why", True), ("x // quartzite-ignore: z", False), ("x quartzite-ignore please", False), ("plain", False)]
    df = spark.createDataFrame(rows, "text string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", S.suppressed(F.col("text"), F.lit("b:c"))).collect())


def test_scores(spark):
    assert value(spark, S.crap_score(F.lit(1), F.lit(100.0))) == 1.0
    assert value(spark, S.crap_score(F.lit(10), F.lit(0.0))) == 110.0
    assert value(spark, S.instability(F.lit(0), F.lit(0))) == 0.5
    assert value(spark, S.percent(F.lit(0), F.lit(0))) is None
    assert [value(spark, S.debt_rating(F.lit(x))) for x in (0.05, 0.051, 0.2, 0.5, 0.6)] == ["A", "B", "C", "D", "E"]
    assert value(spark, S.component_of(F.lit("a/b/c/d.rs"))) == "a/b"
    assert value(spark, S.component_of(F.lit("d.rs"))) == "(root)"
    assert value(spark, S.entropy(F.lit("abab"))) == 1.0 and value(spark, S.entropy(F.lit(""))) == 0.0


def test_globs():
    import re

    assert re.match(S.glob_to_regex("src/**/*.py"), "src/a/b/x.py") and re.match(S.glob_to_regex("src/**/*.py"), "src/x.py")
    assert not re.match(S.glob_to_regex("src/*.py"), "src/a/x.py")


def test_overlaps(spark):
    rows = [(1, "a", 1, 5), (1, "a", 4, 9), (1, "a", 6, 8), (1, "b", 1, 2), (2, "a", 1, 3)]
    kept = clones.without_overlaps(spark.createDataFrame(rows, "set_id long, path string, start_line long, end_line long")).collect()
    assert sorted(tuple(r) for r in kept) == [(1, "a", 1, 5), (1, "a", 6, 8), (1, "b", 1, 2), (2, "a", 1, 3)]


def test_cycles_and_reach(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 5)], "src int, dst int")
    assert sorted(tuple(r) for r in graphs.cycles(e, 4).collect()) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    far = graphs.reach(e, spark.createDataFrame([(1,)], "node int"), 9)
    assert sorted((r.node, r.depth) for r in far.collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_long_cycles_are_whole(spark):
    ring = [(i, (i + 1) % 11) for i in range(11)]
    e = spark.createDataFrame([*ring, (3, 20), (20, 21), (21, 22), (22, 20), (22, 30), (30, 31), (31, 31)], "src int, dst int")
    assert sorted(tuple(r) for r in graphs.cycles(e).collect()) == [(i, 0) for i in range(11)] + [(20, 20), (21, 20), (22, 20)]
    assert graphs.cycles(e.limit(0)).count() == 0


def one(spark, text):
    return spark.createDataFrame([("r", text)], "report string, content string")


def test_lcov_last_wins_and_declared_totals(spark):
    lines, totals = reports.lcov(one(spark, "TN:\nSF:a.c\nDA:1,5\nDA:1,0\nDA:2,3\nBRDA:1,0,0,1\nBRDA:1,0,1,-\nLF:9\nLH:4\nend_of_record"))
    assert sorted((r.line, r.hits) for r in lines.collect()) == [(1, 0), (2, 3)]
    t = totals.first()
    assert (t.covered_lines, t.coverable_lines, t.covered_branches, t.coverable_branches) == (4, 9, 1, 2)


def test_junit_nested(spark):
    xml = '<testsuites><testsuite name="o" tests="9"><testsuite name="i" failures="1"><testcase name="a"><failure/></testcase><testcase name="b"/></testsuite></testsuite></testsuites>'
    rows = reports.junit(one(spark, xml)).collect()
    assert [(r.name, r.tests, r.failures, r.passed) for r in rows] == [("i", 2, 1, 1)]


def test_diff_and_blame(spark):
    d = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +10,4 @@\n a\n+b\n-c\n+d\n e"
    assert sorted((r.path, r.line) for r in reports.changed_lines(one(spark, d)).collect()) == [("x.py", 11), ("x.py", 12)]
    sha = "a" * 40
    b = f"{sha} 1 1 2\nauthor Ann\nauthor-mail <a@b>\nauthor-time 5\nsummary s\n\tone\n{sha} 2 2\n\ttwo"
    rows = sorted((r.line, r.author, r.summary) for r in reports.blame(one(spark, b)).collect())
    assert rows == [(1, "Ann", "s"), (2, "Ann", "s")]


def test_scenarios(spark):
    text = "@covers(src/**)\nFeature: f\n@covers(a/*.ts)\nScenario: s\nWhen x\nThen y\n@covers(b/*)\nScenario Outline: o\nWhen x\nAnd z\nThen y\nExamples:\n|h|\n@covers(**)\nScenario: t\nWhen a\nThen b"
    rows = {(r.glob, r.credited) for r in reports.scenario_claims(one(spark, text)).collect()}
    assert rows == {("src/**", True), ("a/*.ts", True), ("b/*", False), ("**", False)}


def test_mutation_and_detection(spark):
    r = reports.mutation(one(spark, '{"files":{"a":{"mutants":[{"status":"Ignored"}]}}}')).first()
    assert r.total == 1 and r.score is None
    assert value(spark, reports.detect_format(F.lit('{"data":[{"files":[]}]}'))) == "llvm-cov"
    assert value(spark, reports.detect_format(F.lit("hello"))) is None
