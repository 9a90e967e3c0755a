"""Reports out of findings: JSON, SARIF, CSV, text, agent prompts, component flowcharts. Texts are built by aggregation; writers are Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LOG_FINDINGS = 20_000  # in one log, about


def _shards(findings: DataFrame, most: int) -> DataFrame:
    """``findings`` with a column that deals their files to as many logs as it takes, so that no task builds all of one text."""
    n = max(1, -(-findings.count() // most))
    return findings.withColumn("_log", F.pmod(F.xxhash64("path"), F.lit(n)) if n > 1 else F.lit(0).cast("long"))


def sarif_log(findings: DataFrame, tool: str = "quartzite", most: int = LOG_FINDINGS) -> DataFrame:
    """``sarif``: a log of about ``most`` findings a row, each whole by itself; an empty log for none. ``findings``: rule_id, severity,
    message, path, start_line."""
    level = F.when(F.col("severity").isin("Blocker", "Critical"), "error").when(F.col("severity") == "Major", "warning").otherwise("note")
    region = F.struct(F.col("start_line").alias("startLine"))
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))
    dealt = _shards(findings, most)
    log = dealt.groupBy("_log").agg(F.sort_array(F.collect_list(result)).alias("results"))
    empty = dealt.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).cast("long").alias("_log"), F.lit(None).cast(log.schema["results"].dataType).alias("results"))
    log = log.unionByName(empty.withColumn("results", F.coalesce("results", F.array().cast(log.schema["results"].dataType))))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool"), F.col("results").alias("results"))
    return log.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def findings_json(findings: DataFrame, measures: DataFrame) -> DataFrame:
    """One row ``report``: issues and measures as one document."""
    issues = findings.agg(F.sort_array(F.collect_list(F.struct(*findings.columns))).alias("issues"))
    values = measures.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("measures"))
    return issues.join(F.broadcast(values)).select(F.to_json(F.struct("issues", "measures")).alias("report"))  # two one-row tables


def write_csv(findings: DataFrame, path: str) -> None:
    findings.select("rule_id", "severity", "path", "start_line", "message").write.option("header", True).option("escape", '"').csv(path)


def write_audit(verdicts: DataFrame, path: str) -> None:
    verdicts.write.mode("append").json(path)


def text_report(findings: DataFrame) -> DataFrame:
    """Sorted lines ``line`` for people."""
    order = F.desc("severity"), F.col("path"), F.col("start_line"), F.col("rule_id")
    return findings.orderBy(*order).select(F.format_string("%s:%d [%s] %s: %s", "path", F.col("start_line").cast("int"), "severity", "rule_id", "message").alias("line"))


def mermaid(edges: DataFrame) -> DataFrame:
    """One row ``chart``: the component flowchart."""
    line = F.concat(F.lit('  "'), "src", F.lit('" --> "'), "dst", F.lit('"'))
    return edges.agg(F.concat(F.lit("flowchart LR\n"), F.array_join(F.sort_array(F.collect_set(line)), "\n")).alias("chart"))


def agent_prompt(findings: DataFrame, gate: DataFrame) -> DataFrame:
    """One row ``prompt``: issues to fix and failed gate conditions."""
    a = findings.agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit(" "), "rule_id", F.lit(" "), "message"))), "\n").alias("i"))
    b = gate.where("status = 'Failed'").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), "metric"))), "\n").alias("g"))
    return a.join(F.broadcast(b)).select(F.concat(F.lit("Fix these issues:\n"), "i", F.lit("\nFailed conditions:\n"), "g").alias("prompt"))


def mutation_gaps(findings: DataFrame) -> DataFrame:
    """``by_rule`` counts of mutation findings; no row where there are none."""
    return findings.where(F.col("rule_id").startswith("mutation:")).groupBy("rule_id").agg(F.count("*").alias("n"))
