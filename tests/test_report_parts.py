"""Coverage reports and diffs are read part by part, without rows put in order."""

from quartzite.sources import reports


def _read(spark, reader, text):
    out = reader(spark.createDataFrame([("r", text)], "report string, content string"))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    return sorted(tuple(r)[1:] for r in out.collect())


def test_lcov_parts(spark):
    text = "TN:\r\nDA:9,9\r\nSF:a\r\nDA:1,1\nDA:1,0\nend_of_record\nSF:b\nDA:1,2\nSF:a\nDA:2,x\nDA:3,4"
    assert _read(spark, lambda d: reports.lcov(d)[0], text) == [("a", 1, 0), ("a", 3, 4), ("b", 1, 2)]
    assert _read(spark, lambda d: reports.lcov(d)[1], "SF:a\nDA:1,1\nDA:2,0\nSF:a\nLH:5\nLF:6") == [("a", 1, 2, 0, 0), ("a", 5, 6, 0, 0)]


def test_xml_parts(spark):
    text = '<line number="9" hits="9"/><class name="n"><class filename="a" x="1"><line number="1" hits="0"></line></class><classes><class name="z">\n<line\nnumber="1" hits="3"/><class filename="b"/><lines><line number="2"/></lines>'
    assert _read(spark, reports.cobertura, text) == [("a", 1, 3), ("b", 2, None)]
    text = '<line nr="9" ci="1"/><sourcefile name="a"><line nr="1" ci="0"/><line nr="2" ci="3"/></sourcefile><sourcefile name="b"><line nr="1" ci="1"/></sourcefile>'
    assert _read(spark, lambda d: reports.jacoco(d)[0], text) == [("a", 1, 0), ("a", 2, 1), ("b", 1, 1)]


def test_diff_parts(spark):
    text = "diff --git a/f b/f\n--- a/f\n+++ b/f\t2020\n@@ -1,2 +3,4 @@ x\n kept\n+++ looks like a file\n-gone\n+new\n\\ No newline\n@@ -9 +20 @@\r\n+q\r\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n+z\n--- /dev/null\n+++ b/h\n@@ -0,0 +1 @@\n+one"
    assert _read(spark, reports.changed_lines, text) == [("f", 4), ("f", 5), ("f", 20), ("h", 1)]
    assert _read(spark, reports.changed_lines, "+++ b/f\n@@ -1 +1 @@\n+a\n+++ b/g\n@@ -1 +2 @@\n b\n+c") == [("f", 1), ("g", 3)]
