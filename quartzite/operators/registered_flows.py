"""Flows that someone has declared step by step: whether each step's function is still there, how much of it ran, and the first step that fails.

A step whose function isn't found is a finding of its own (the flow has drifted); one whose function ran not at all is another; a step without any
coverage data is neither, for no evidence isn't evidence of no test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.operators.reviews import coverage_of_spans


def evaluated(steps: DataFrame, index: DataFrame, covered: DataFrame) -> DataFrame:
    """``flow, step, path, function, status, coverage_percent`` in the declared order. ``steps``: flow, step, path, function; ``index``: path, function,
    start_line, end_line, of which the first of a name counts; ``covered``: path, line, hits. status: missing, or found."""
    first = index.groupBy("path", "function").agg(F.min(F.struct("start_line", "end_line")).alias("span")).select("path", "function", "span.*")
    asked = steps.select("path", "function").distinct().join(first, ["path", "function"])
    spans = coverage_of_spans(asked.select("path", "start_line", "end_line").distinct(), covered)
    found = asked.join(spans, ["path", "start_line", "end_line"]).select("path", "function", F.lit("found").alias("status"), F.col("coverage").alias("coverage_percent"))
    out = steps.join(found, ["path", "function"], "left")
    return out.select("flow", "step", "path", "function", F.coalesce("status", F.lit("missing")).alias("status"), "coverage_percent")


def first_gaps(results: DataFrame) -> DataFrame:
    """``flow, step, path, function, status`` of each flow's first step that is missing or ran not at all; flows without one give no row."""
    bad = results.where("status = 'missing' or coverage_percent = 0")
    return bad.groupBy("flow").agg(F.min_by(F.struct("step", "path", "function", "status"), "step").alias("s")).select("flow", "s.*")
