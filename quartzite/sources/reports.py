"""Readers of coverage, test, mutation, issue, diff, blame and scenario reports.

Each takes a relation ``report, content`` (one row a file) and returns rows; nothing is collected. Coverage reports and diffs are split where a file's
part begins, and a part into its lines, so no rows are put in order; where reports are dealt by ``report`` already, nothing is shuffled. For the others one
report is one group of a window.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def _order() -> WindowSpec:
    return Window.partitionBy("report").orderBy("pos")


def _lines(reports: DataFrame) -> DataFrame:
    return reports.select("report", F.posexplode(F.split("content", "\r?\n")).alias("pos", "text"))


def _tags(reports: DataFrame) -> DataFrame:
    """The tags of XML reports in document order, whatever their layout in lines: ``report, pos, tag, name``."""
    tags = reports.select("report", F.posexplode(F.regexp_extract_all("content", F.lit("(<[^>!?]+>)"), F.lit(1))).alias("pos", "tag"))
    return tags.withColumn("name", F.regexp_extract("tag", "^</?([A-Za-z:_-]+)", 1))


def _parts(reports: DataFrame, begin: str) -> DataFrame:
    """The parts of reports that begin where the pattern does: ``report, at, part``; what stands before the first is no part."""
    return reports.select("report", F.posexplode(F.split("content", f"(?={begin})")).alias("at", "part")).where(F.col("part").rlike(f"^(?:{begin})"))


def _in_parts(parts: DataFrame, found: Column, name: str) -> DataFrame:
    """``parts`` with each of what is found in a part, and its place in the report as a number."""
    each = parts.select("*", F.posexplode(found).alias("k", name))
    return each.withColumn("pos", F.col("at") * F.lit(1 << 32) + F.col("k"))


def attribute(tag: Column, name: str) -> Column:
    """NULL where the tag doesn't have it."""
    found = F.regexp_extract(tag, f'[\\s]{name}\\s*=\\s*"([^"]*)"', 1)
    return F.when(tag.rlike(f"[\\s]{name}\\s*="), found)


def _number(c: Column) -> Column:
    return c.try_cast("bigint")


def _last_hits(rows: DataFrame) -> DataFrame:
    """Of lines that a report repeats the last counts: ``report, path, line, hits``."""
    return rows.groupBy("report", "path", "line").agg(F.max_by("hits", "pos").alias("hits"))


def _most_hits(rows: DataFrame) -> DataFrame:
    return rows.groupBy("report", "path", "line").agg(F.max("hits").alias("hits"))


def lcov(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (the last of repeats wins) and totals by path; declared LH and LF win over counted lines."""
    files = _parts(reports, "(?<![^\\n])SF:").withColumn("path", F.regexp_extract("part", "^SF:([^\\n]*?)\\r?(?:\\n|$)", 1))
    own = _in_parts(files.withColumnRenamed("part", "_part"), F.split("_part", "\r?\n"), "text").withColumn("open", F.col("at")).drop("_part")
    da = F.split(F.expr("substring(text, 4)"), ",")
    data = own.where(F.col("text").startswith("DA:")).select("report", "path", "open", "pos", _number(da[0]).alias("line"), _number(da[1]).alias("hits")).where("line is not null and hits is not null")
    declared = lambda key: F.max(F.when(F.col("text").startswith(f"{key}:"), _number(F.expr(f"substring(text, {len(key) + 2})"))))
    counted = F.count_if(F.col("text").rlike("^DA:[0-9]+,[0-9]+")), F.count_if(F.col("text").rlike("^DA:[0-9]+,0*[1-9]"))
    totals = own.groupBy("report", "path", "open").agg(
        F.coalesce(declared("LH"), counted[1]).alias("covered_lines"), F.coalesce(declared("LF"), counted[0]).alias("coverable_lines"),
        F.coalesce(declared("BRH"), F.count_if(F.col("text").rlike("^BRDA:.*,0*[1-9][0-9]*$"))).alias("covered_branches"),
        F.coalesce(declared("BRF"), F.count_if(F.col("text").startswith("BRDA:"))).alias("coverable_branches"),
    )
    return _last_hits(data), totals.drop("open")


def _file_lines(reports: DataFrame, name: str, key: str) -> DataFrame:
    """The line tags that follow a tag of that name with the attribute ``key``, its ``path``: ``report, path, pos, tag``."""
    files = _parts(reports, f"<{name}(?![A-Za-z:_-])[^>!?]*[\\s]{key}\\s*=[^>!?]*>")
    files = files.withColumn("path", attribute(F.regexp_extract("part", "^(<[^>!?]+>)", 1), key))
    return _in_parts(files, F.regexp_extract_all("part", F.lit("(<line(?![A-Za-z:_-])[^>!?]*>)"), F.lit(1)), "tag").select("report", "path", "pos", "tag")


def cobertura(reports: DataFrame) -> DataFrame:
    rows = _file_lines(reports, "class", "filename")
    return _last_hits(rows.select("report", "path", "pos", _number(attribute(F.col("tag"), "number")).alias("line"), _number(attribute(F.col("tag"), "hits")).alias("hits")).where("line is not null"))


def jacoco(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (covered if an instruction is), and the totals of LINE and BRANCH counters at every level of nesting together."""
    tags = _tags(reports)
    rows = _file_lines(reports, "sourcefile", "name")
    covered = F.when(_number(attribute(F.col("tag"), "ci")) > 0, 1).otherwise(0).cast("long")
    lines = _last_hits(rows.select("report", "path", "pos", _number(attribute(F.col("tag"), "nr")).alias("line"), covered.alias("hits")))
    kind = attribute(F.col("tag"), "type")
    part = lambda t, a: F.coalesce(F.sum(F.when(kind == t, _number(attribute(F.col("tag"), a)))), F.lit(0))
    totals = tags.where("name = 'counter'").groupBy("report").agg(
        part("LINE", "covered").alias("covered_lines"), (part("LINE", "covered") + part("LINE", "missed")).alias("coverable_lines"),
        part("BRANCH", "covered").alias("covered_branches"), (part("BRANCH", "covered") + part("BRANCH", "missed")).alias("coverable_branches"),
    )
    return lines, totals


def llvm_cov(reports: DataFrame) -> DataFrame:
    """The most of the counts of a line's segments that have one."""
    schema = "data array<struct<files array<struct<filename string, segments array<array<string>>>>>>"
    files = reports.select("report", F.explode(F.from_json("content", schema)["data"]).alias("d")).select("report", F.explode("d.files").alias("f"))
    seg = files.select("report", F.col("f.filename").alias("path"), F.explode("f.segments").alias("s")).where("s[3] = 'true' or s[3] = '1'")
    return _most_hits(seg.select("report", "path", _number(F.col("s")[0]).alias("line"), _number(F.col("s")[2]).alias("hits")))


def istanbul(reports: DataFrame) -> DataFrame:
    """Statements stand for the line that they start on; the most of repeats."""
    schema = "map<string, struct<statementMap map<string, struct<start struct<line bigint>>>, s map<string, bigint>>>"
    files = reports.select("report", F.explode(F.from_json("content", schema)).alias("path", "f"))
    st = files.select("report", "path", "f.s", F.explode("f.statementMap").alias("id", "at"))
    return _most_hits(st.select("report", "path", F.col("at.start.line").alias("line"), F.coalesce(F.element_at("s", F.col("id")), F.lit(0)).alias("hits")).where("line is not null"))


def detect_format(content: Column) -> Column:
    """By content, never by name; NULL where no format is known."""
    t = F.ltrim(content)
    return (
        F.when(t.rlike("^(TN:|SF:|DA:)"), "lcov").when(t.contains("<report"), "jacoco").when(t.contains("<coverage"), "cobertura")
        .when(t.startswith("{") & t.contains('"data"') & t.contains('"files"'), "llvm-cov").when(t.contains('"statementMap"'), "istanbul")
    )


def junit(reports: DataFrame) -> DataFrame:
    """Suites: declared counts, gaps filled from their cases. The innermost suite counts; passed is what is left, at least 0."""
    tags = _tags(reports)
    opens = (F.col("name") == "testsuite") & ~F.col("tag").startswith("</")
    own = tags.withColumn("suite", F.sum(F.when(opens, 1).otherwise(0)).over(_order())).where("suite > 0")
    outer = F.lead("name").over(_order()) == "testsuite"  # a suite whose next tag opens another is only a frame
    own = own.withColumn("frame", opens & outer & ~F.col("tag").endswith("/>") & ~F.lead("tag").over(_order()).startswith("</"))
    said = lambda a: F.max(F.when(opens, _number(attribute(F.col("tag"), a))))
    closing = F.col("tag").startswith("</")
    cases = lambda n: F.count_if((F.col("name") == n) & ~closing)
    suites = own.groupBy("report", "suite").agg(
        F.max(F.when(opens, attribute(F.col("tag"), "name"))).alias("name"), F.coalesce(said("tests"), cases("testcase")).alias("tests"),
        F.coalesce(said("failures"), cases("failure")).alias("failures"), F.coalesce(said("errors"), cases("error")).alias("errors"),
        F.coalesce(said("skipped"), cases("skipped")).alias("skipped"), F.coalesce(F.max(F.when(opens, attribute(F.col("tag"), "time").try_cast("double"))), F.lit(0.0)).alias("seconds"),
        F.bool_or("frame").alias("frame"),
    )
    suites = suites.where("not frame").drop("frame", "suite")
    return suites.withColumn("passed", F.greatest(F.lit(0), F.col("tests") - F.col("failures") - F.col("errors") - F.col("skipped")))


#: Mutant statuses of the report schema.
MUTANT_STATUS = {"Killed": "killed", "Survived": "survived", "Timeout": "timeout", "NoCoverage": "no_coverage", "Ignored": "ignored", "CompileError": "error", "RuntimeError": "error", "Pending": "pending"}


def mutation(reports: DataFrame) -> DataFrame:
    """Counts by status and the score, NULL where no mutant counts. An unknown status is an error of its report."""
    schema = "files map<string, struct<mutants array<struct<status string>>>>"
    files = reports.select("report", F.explode(F.from_json("content", schema)["files"]).alias("path", "f"))
    each = files.select("report", F.explode("f.mutants.status").alias("status"))
    known = F.when(F.col("status").isin(*MUTANT_STATUS), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown mutant status "), F.col("status"))))
    n = lambda kind: F.count_if(F.col("status").isin(*(k for k, v in MUTANT_STATUS.items() if v == kind))).alias(kind)
    out = each.withColumn("status", known).groupBy("report").agg(F.count("*").alias("total"), *(n(k) for k in dict.fromkeys(MUTANT_STATUS.values())))
    caught = F.col("killed") + F.col("timeout")
    return out.withColumn("score", F.try_divide(caught * 100.0, caught + F.col("survived") + F.col("no_coverage")))


def sarif(reports: DataFrame) -> DataFrame:
    """Results of kind fail with a place, unless suppressed and not rejected or under review: rule, severity, message, path, line."""
    schema = """runs array<struct<tool struct<driver struct<name string, rules array<struct<id string, properties map<string, string>>>>>,
      results array<struct<ruleId string, ruleIndex int, kind string, level string, message struct<text string>, properties map<string, string>,
        suppressions array<struct<status string>>, locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int>>>>>>>>"""
    runs = reports.select("report", F.explode(F.from_json("content", schema)["runs"]).alias("run")).select("report", "run.tool.driver.rules", F.explode("run.results").alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    held = F.exists(F.coalesce("r.suppressions", F.array()), lambda s: ~F.coalesce(s["status"], F.lit("accepted")).isin("rejected", "underReview"))
    rows = runs.where((F.coalesce("r.kind", F.lit("fail")) == "fail") & place.isNotNull() & ~held)
    by_id = F.get(F.filter(F.coalesce("rules", F.array()), lambda x: x["id"] == F.col("r.ruleId")), F.lit(0))
    rule = F.coalesce(by_id, F.get("rules", F.col("r.ruleIndex")))
    score = F.coalesce(F.element_at("r.properties", "security-severity"), F.element_at(rule["properties"], "security-severity")).try_cast("double")
    level = F.coalesce("r.level", F.lit("warning"))
    by_level = F.when(level == "error", "Major").when(level == "warning", "Minor").otherwise("Info")
    by_score = F.when(score >= 9, "Blocker").when(score >= 7, "Critical").when(score >= 4, "Major").otherwise("Minor")
    uri = F.regexp_replace(place["artifactLocation"]["uri"], "^(file://)?(\\./)?", "")
    return rows.select(
        "report", F.coalesce(F.col("r.ruleId"), rule["id"]).alias("rule_id"), F.when(score.isNotNull(), by_score).otherwise(by_level).alias("severity"),
        F.col("r.message.text").alias("message"), uri.alias("path"), place["region"]["startLine"].cast("long").alias("line"),
    )


def changed_lines(reports: DataFrame) -> DataFrame:
    """New-side lines that unified diffs add: ``report, path, line``."""
    old_side = "--- [^\\n]*\\n\\+\\+\\+ "  # an added line may look like a new side, but not with an old side before it
    begins = F.col("content").rlike(f"(?<![^\\n]){old_side}")
    files = F.when(begins, F.split("content", f"(?<![^\\n])(?={old_side})")).otherwise(F.split("content", "(?<![^\\n])(?=\\+\\+\\+ )"))
    path = F.regexp_extract("part", "(?<![^\\n])\\+\\+\\+ (?:b/)?([^\\t\\r\\n]*)", 1)
    files = reports.select("report", F.explode(files).alias("part")).where(F.col("part").rlike("(?<![^\\n])\\+\\+\\+ ")).select("report", path.alias("path"), "part")
    hunks = files.select("report", "path", F.explode(F.split("part", "(?<![^\\n])(?=@@)")).alias("hunk")).where(F.col("hunk").startswith("@@"))
    body = F.filter(F.split("hunk", "\r?\n"), lambda x: x.startswith("+") | x.startswith(" "))
    first = _number(F.regexp_extract("hunk", "^@@ -[0-9,]+ \\+([0-9]+)", 1))
    own = hunks.select("report", "path", first.alias("first"), F.posexplode(body).alias("at", "text"))
    return own.where(F.col("text").startswith("+") & (F.col("path") != "/dev/null")).select("report", "path", (F.col("first") + F.col("at")).alias("line")).distinct()


def blame(reports: DataFrame) -> DataFrame:
    """Lines of porcelain blame with the facts of their commit, which stand only at its first line."""
    own = _lines(reports)
    head = F.regexp_extract("text", "^([0-9a-f]{40}) [0-9]+ ([0-9]+)", 1), F.regexp_extract("text", "^([0-9a-f]{40}) [0-9]+ ([0-9]+)", 2)
    own = own.withColumn("sha", F.last(F.when(head[0] != "", head[0]), ignorenulls=True).over(_order())).withColumn("line", F.last(F.when(head[0] != "", _number(head[1])), ignorenulls=True).over(_order()))
    fact = lambda k: F.max(F.when(F.col("text").startswith(f"{k} "), F.substring("text", len(k) + 2, 10_000))).alias(k.replace("-", "_"))
    commits = own.groupBy("report", "sha").agg(*(fact(k) for k in ("author", "author-mail", "author-time", "summary")))
    return own.where(F.col("text").startswith("\t")).select("report", "sha", "line").join(commits, ["report", "sha"])


def scenario_claims(reports: DataFrame) -> DataFrame:
    """``report, glob, credited``: @covers(glob) tags of feature files. A scenario is credited with a When and a Then (and Examples rows, if
    it is an outline) for a glob narrower than everything; a feature's tags if any of its scenarios is."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for report, content in zip(pdf["report"], pdf["content"], strict=True):
            feature: list[str] = []
            blocks: list[dict] = []
            pending: list[str] = []
            now: dict | None = None
            for raw in (content or "").splitlines():
                s = raw.strip()
                if s.startswith("@"):
                    pending += [t[8:-1].strip() for t in s.split() if t.startswith("@covers(") and t.endswith(")")]
                elif s.startswith("Feature:"):
                    feature, pending = pending, []
                elif s.startswith(("Background:", "Rule:")):
                    pending, now = [], None
                elif s.startswith(("Scenario Outline:", "Scenario Template:", "Scenario:", "Example:")):
                    now = {"globs": pending, "outline": s.startswith(("Scenario Outline", "Scenario Template")), "steps": set(), "last": "", "rows": -1}
                    blocks.append(now)
                    pending = []
                elif now is not None:
                    word = s.split(" ", 1)[0]
                    if s.startswith(("Examples:", "Scenarios:")):
                        now["rows"] = 0
                    elif s.startswith("|") and now["rows"] >= 0:
                        now["rows"] += 1
                    elif word in ("Given", "When", "Then"):
                        now["last"] = word
                        now["steps"].add(word)
                    elif word in ("And", "But", "*"):
                        now["steps"].add(now["last"])
            whole = [b for b in blocks if {"When", "Then"} <= b["steps"] and (not b["outline"] or b["rows"] > 1)]
            out += [(report, g, b in whole and g != "**") for b in blocks for g in b["globs"]]
            out += [(report, g, bool(whole) and g != "**") for g in feature]
        return pd.DataFrame(out, columns=["report", "glob", "credited"])

    kind = reports.schema["report"].dataType.simpleString()
    return reports.select("report", "content").mapInPandas(lambda it: (run(p) for p in it), f"report {kind}, glob string, credited boolean")


def coverage(reports: DataFrame, declared: str | None = None) -> DataFrame:
    """``report, path, line, hits`` of reports of any known format, declared or found by content; one of none of them is an error when it is read."""
    known = F.lit(declared) if declared else detect_format(F.col("content"))
    told = reports.withColumn("_format", F.coalesce(known, F.raise_error(F.concat(F.lit("no coverage format is known for report "), F.col("report").cast("string")))))
    readers = {"lcov": lambda d: lcov(d)[0], "cobertura": cobertura, "jacoco": lambda d: jacoco(d)[0], "llvm-cov": llvm_cov, "istanbul": istanbul}
    if declared:
        return readers[declared](told.drop("_format"))
    parts = [read(told.where(F.col("_format") == name).drop("_format")).select("report", "path", F.col("line").cast("long").alias("line"), F.col("hits").cast("long").alias("hits")) for name, read in readers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
