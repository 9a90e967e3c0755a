"""Declared flows: missing steps, steps that never ran, steps without data."""

from quartzite.operators import registered_flows


def test_first_gap_in_declared_order(spark):
    steps = spark.createDataFrame([("a", 1, "x.rs", "f"), ("a", 2, "x.rs", "gone"), ("a", 3, "x.rs", "cold"), ("b", 1, "x.rs", "cold"), ("c", 1, "y.rs", "nodata"), ("c", 2, "x.rs", "f")], "flow string, step int, path string, function string")
    index = spark.createDataFrame([("x.rs", "f", 1, 3), ("x.rs", "f", 50, 60), ("x.rs", "cold", 5, 6), ("y.rs", "nodata", 1, 9)], "path string, function string, start_line int, end_line int")
    lines = spark.createDataFrame([("x.rs", 1, 2), ("x.rs", 3, 0), ("x.rs", 5, 0), ("x.rs", 55, 9)], "path string, line int, hits int")
    e = registered_flows.evaluated(steps, index, lines)
    assert {(r.flow, r.step): (r.status, r.coverage_percent) for r in e.collect()} == {("a", 1): ("found", 50.0), ("a", 2): ("missing", None), ("a", 3): ("found", 0.0), ("b", 1): ("found", 0.0), ("c", 1): ("found", None), ("c", 2): ("found", 50.0)}
    assert {tuple(r) for r in registered_flows.first_gaps(e).collect()} == {("a", 2, "x.rs", "gone", "missing"), ("b", 1, "x.rs", "cold", "found")}
    assert registered_flows.first_gaps(e.limit(0)).count() == 0
