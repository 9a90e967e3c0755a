"""Findings of line rules, their suppression, and what is summed from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.functions import scalars as S


@dataclass(frozen=True)
class LineRule:
    rule_id: str
    pattern: str
    severity: str
    issue_type: str
    effort: int
    hotspot: bool = False
    needs: tuple[str, ...] = ()  # texts of which a match must hold one: cheap to look for before the pattern is tried

    def hit(self, text: Column) -> Column:
        found = text.rlike(self.pattern)
        if not self.needs:
            return found
        some = text.contains(self.needs[0])
        for n in self.needs[1:]:
            some |= text.contains(n)
        return some & found


def source_lines(files: DataFrame, path: str = "doc_id", content: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``path, line, text`` (1-based), and the columns to keep."""
    return files.select(F.col(path).alias("path"), *keep, F.posexplode(F.split(F.col(content), "\n")).alias("pos", "text")).withColumn(
        "line", (F.col("pos") + 1).cast("long")
    ).drop("pos")


def line_findings(lines: DataFrame, rules: list[LineRule]) -> DataFrame:
    """At most one finding for each rule and line, all rules in one scan."""
    hits = F.array_compact(F.array(*(F.when(r.hit(F.col("text")), F.lit(r.rule_id)) for r in rules)))
    return lines.withColumn("rule_id", F.explode(hits))


def unsuppressed(findings: DataFrame) -> DataFrame:
    return findings.where(~S.suppressed(F.col("text"), F.col("rule_id")))


def rule_table(spark: SparkSession, rules: list[LineRule]) -> DataFrame:
    """The rule dimension: a constant of the program, so it may be broadcast."""
    rows = [(r.rule_id, r.severity, r.issue_type, r.effort, r.hotspot) for r in rules]
    return F.broadcast(spark.createDataFrame(rows, "rule_id string, severity string, issue_type string, effort int, hotspot boolean"))


def severity_counts(issues: DataFrame, *by: str) -> DataFrame:
    return issues.groupBy(*by, "severity").agg(F.count("*").alias("n"), F.sum(F.col("effort").cast("long")).alias("minutes"))


def effort_by_rule_and_component(issues: DataFrame, component: Column) -> DataFrame:
    """Minutes by rule and, independently, by component: one row for each."""
    base = issues.select("rule_id", component.alias("component"), "effort")
    sets = base.groupingSets([["rule_id"], ["component"]], "rule_id", "component")
    return sets.agg(F.sum(F.col("effort").cast("long")).alias("minutes"), F.count("*").alias("n"))


def facets(issues: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Counts by each dimension under the filters of the others. The issues are read once: they are counted by all dimensions together,
    and each of those counts goes to every facet whose filters it passes."""
    once = issues.groupBy(*(F.col(d).cast("string").alias(d) for d in filters)).agg(F.count("*").alias("n"))
    parts = []
    for d in filters:
        passes = F.lit(True)
        for other, value in filters.items():
            if other != d and value is not None:
                passes &= F.col(other) == value
        parts.append(F.when(passes, F.struct(F.lit(d).alias("facet"), F.col(d).alias("value"))))
    return once.select(F.explode(F.array_compact(F.array(*parts))).alias("f"), "n").groupBy("f.facet", "f.value").agg(F.sum("n").alias("n"))


def page(issues: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page, newest first: size 0 is 50, else 1 to 500; page 0 is 1."""
    size = 50 if size == 0 else max(1, min(size, 500))
    number = max(1, number)
    return issues.orderBy(*order).offset((number - 1) * size).limit(size)


def type_ratings(issues: DataFrame) -> DataFrame:
    """Reliability from the worst bug, security from the worst vulnerability; A for none."""
    rank = S.severity_rank(F.col("severity"))
    worst = lambda kind: F.max(F.when(F.col("issue_type") == kind, rank))
    return issues.agg(worst("Bug").alias("b"), worst("Vulnerability").alias("v")).select(
        S.rating_of_rank(F.col("b")).alias("reliability"), S.rating_of_rank(F.col("v")).alias("security")
    )


def line_totals(lines: DataFrame, rules: list[LineRule], *by: str) -> DataFrame:
    """``by``, lines, counts by severity, hotspots, minutes: lines and findings in one pass and one aggregation. Without ``by``, one row,
    and files (by ``path``) too."""
    t = lines
    hits = [f"_hit{i}" for i in range(len(rules))]
    t = t.select(*by, *([] if by else ["path"]), *(r.hit(F.col("text")).cast("int").alias(h) for r, h in zip(rules, hits, strict=True)))
    total = lambda chosen: sum((F.sum(h) for r, h in zip(rules, hits, strict=True) if chosen(r)), F.lit(0))
    minutes = sum((F.sum(F.col(h).cast("long") * r.effort) for r, h in zip(rules, hits, strict=True) if not r.hotspot), F.lit(0))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = [n(total(lambda r, s=s: not r.hotspot and r.severity == s)).alias(s.lower()) for s in S.SEVERITIES]
    own = [F.count("*").alias("lines"), *sums, n(total(lambda r: r.hotspot)).alias("hotspots"), n(minutes).alias("minutes")]
    if by:
        return t.groupBy(*by).agg(*own)
    per_file = t.groupBy("path").agg(*own)
    return per_file.agg(F.count("*").alias("files"), *(n(F.sum(c)).alias(c) for c in ("lines", *(s.lower() for s in S.SEVERITIES), "hotspots", "minutes")))


def measures(totals: DataFrame, names: list[str]) -> DataFrame:
    """``key, value`` of one row of totals, without those not reported."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")
    return totals.select(rows).select("m.key", "m.value").where("value is not null")


def gate(measured: DataFrame, conditions: DataFrame) -> DataFrame:
    """Each condition against its measure: NoValue passes, a strict breach fails."""
    breach = F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return conditions.join(measured.withColumnRenamed("key", "metric"), "metric", "left").withColumn(
        "status", F.when(F.col("value").isNull(), "NoValue").when(breach, "Failed").otherwise("Passed")
    )


def protected(writes: DataFrame, globs: list[str]) -> DataFrame:
    """``writes`` (path) with a verdict: a protected path is denied whatever was found in it."""
    hit = F.lit(False)
    for g in globs:
        hit |= F.col("path").rlike(S.glob_to_regex(g))
    return writes.withColumn("verdict", F.when(hit, "Deny"))


def policy(findings: DataFrame, lists: DataFrame, threshold_rank: int) -> DataFrame:
    """Advisory warns, blocking denies, escalate escalates, else the severity threshold denies; a finding that trips nothing is dropped,
    an advisory one too unless another list or the threshold would have caught it."""
    on = lists.groupBy("rule_id").agg(*(F.bool_or(F.col("list") == k).alias(k) for k in ("advisory", "blocking", "escalate")))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    over = S.severity_rank(F.col("severity")) >= threshold_rank
    caught = has("blocking") | has("escalate") | over
    verdict = F.when(~caught, None).when(has("advisory"), "Warn").when(has("blocking"), "Deny").when(has("escalate"), "Escalate").otherwise("Deny")
    return findings.join(F.broadcast(on), "rule_id", "left").withColumn("verdict", verdict).where("verdict is not null").drop("advisory", "blocking", "escalate")
