"""What a review of a change or of an issue comes to: triage, completion, added markers and dependencies, coverage of spans, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzite.operators.shared import folded

#: The triage label that follows, by label and event.
TRIAGE = {
    ("New", "start"): "Reproducing", ("Reproduced", "start"): "Diagnosing", ("Diagnosed", "start"): "Fixing", ("GateRejected", "start"): "Fixing",
    ("Reproducing", "repro_failed"): "Reproduced", ("Reproducing", "repro_passed"): "NeedsInfo", ("Diagnosing", "diagnosed"): "Diagnosed",
    ("Fixing", "fix_accepted"): "FixReady", ("Fixing", "fix_rejected"): "GateRejected",
}


def repro_event(exit_code: Column) -> Column:
    """A run that fails reproduces the issue; so does one that never ended."""
    return F.when(exit_code == 0, "repro_passed").otherwise("repro_failed")


def triage(events: DataFrame) -> DataFrame:
    """``issue, label, errors`` after all events in order; one that doesn't fit is an error and changes nothing. ``events``: issue, seq, event."""

    def step(state: tuple, row: tuple) -> tuple:
        after = TRIAGE.get((state[0], row[0]))
        return (after, state[1]) if after else (state[0], state[1] + 1)

    steps = events.select(F.col("issue").cast("long").alias("issue"), "event", "seq")
    return folded(steps, "issue", [F.asc_nulls_last("seq")], ("New", 0), step, "issue long, label string, errors int")


def completion(before: DataFrame, now: DataFrame, target: str | None, keys: list[str]) -> DataFrame:
    """One row: ``TargetRemains`` with the findings of the target rule, else ``Regressed`` with those beyond the former bag, else ``Done``."""
    remains = now.where(F.col("rule_id") == target).agg(F.count("*").alias("remaining")) if target else now.limit(0).agg(F.count("*").alias("remaining"))
    added = now.select(*keys).exceptAll(before.select(*keys)).agg(F.count("*").alias("added"))
    verdict = F.when(F.col("remaining") > 0, "TargetRemains").when(F.col("added") > 0, "Regressed").otherwise("Done")
    return remains.join(F.broadcast(added)).select(verdict.alias("verdict"), F.when(F.col("remaining") > 0, F.col("remaining")).otherwise(F.col("added")).alias("n"))  # two one-row tables


def added_markers(changes: DataFrame, markers: list[str]) -> DataFrame:
    """``path, text``: lines of new content with a marker whose exact text isn't among the marker lines of the old; repeats stay, text is
    trimmed only here. ``changes``: path, old, new; a null old is empty."""
    has = lambda line: F.exists(F.array(*map(F.lit, markers)), lambda m: line.contains(m))
    lines = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), has)
    new = F.filter(lines("new"), lambda line: ~F.array_contains(lines("old"), line))
    return changes.select("path", F.explode(new).alias("text")).select("path", F.trim("text").alias("text"))


def added_dependencies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Dependencies of a manifest that it hadn't; ``path, dependency``."""
    return new.select("path", "dependency").distinct().join(old.select("path", "dependency"), ["path", "dependency"], "left_anti")


def coverage_of_spans(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """``spans`` (path, start_line, end_line) with the share of their instrumented lines that were hit; NULL where none is. A range
    join within a path: both sides meet by path and buckets of lines, so a long file isn't paired line by span."""
    width = 256
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))).alias("_bucket")
    keyed = spans.withColumn("_span", F.monotonically_increasing_id())
    place = keyed.select("_span", "path", "start_line", "end_line", cut("start_line", "end_line"))
    hits = lines.select("path", "line", "hits", F.floor(F.col("line") / width).alias("_bucket"))
    inside = place.join(hits, ["path", "_bucket"]).where("line between start_line and end_line")
    share = inside.groupBy("path", "start_line", "end_line").agg((100.0 * F.countDistinct(F.when(F.col("hits") > 0, F.col("line"))) / F.countDistinct("line")).alias("coverage"))
    return spans.join(share, ["path", "start_line", "end_line"], "left")


def changelog(events: DataFrame) -> DataFrame:
    """``issue, seq, field, old, new``: each change of a field against the value before it. ``events``: issue, seq, field, value."""
    w = Window.partitionBy("issue", "field").orderBy("seq")
    return events.withColumn("old", F.lag("value").over(w)).where("not old <=> value").select("issue", "seq", "field", "old", F.col("value").alias("new"))


def reviewed(hotspots: DataFrame, reviews: DataFrame) -> DataFrame:
    """Hotspots with the status of their last review; ``TO_REVIEW`` before any."""
    last = reviews.groupBy("key").agg(F.max_by("status", "seq").alias("status"))
    return hotspots.join(last, "key", "left").withColumn("status", F.coalesce("status", F.lit("TO_REVIEW")))


def most_recent(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def flattened_profile(chain: DataFrame, name: str) -> DataFrame:
    """A profile's effective rules as a profile of its own, without a parent. ``chain``: rule_id, severity, depth."""
    return chain.groupBy("rule_id").agg(F.min_by("severity", "depth").alias("severity")).select(F.lit(name).alias("profile"), "rule_id", "severity", F.lit(0).alias("depth"))
