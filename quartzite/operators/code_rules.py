"""Rules on source text as data: a pattern on code without comments and strings, or on the text as it stands, for some languages and paths.

All rules of a language run in one pass over its files, JVM-side: a file is tokenised by one pattern into an array, comments and what stands in
quotes are blanked there without losing a line, and each rule marks where its pattern begins; only lines with a mark become rows. A rule of
other files costs its file nothing.

Defined results: a null content has no findings; a rule finds a line once; files of an unknown language get the rules for any language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.functions import scalars as S

MARK = "\x01"
_COMMENT_LINE = r"^\s*(//|#|\*|/\*)"
#: What a token may be, by the family of a language: comments first, then strings; all else is code. Loops are possessive, so long texts cost no stack.
_QUOTED = {'"': r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', "'": r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'", "`": r"`[^`\\]*+(?:\\.[^`\\]*+)*+`", "c": r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'", "t": r'"""[^"]*+(?:"{1,2}[^"]++)*+"""|\'\'\'[^\']*+(?:\'{1,2}[^\']++)*+\'\'\''}
_BLOCK = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
FAMILIES = {
    "c": (rf"//[^\n]*+|{_BLOCK}", _QUOTED['"'] + "|" + _QUOTED["'"] + "|" + _QUOTED["`"]),
    "rust": (rf"//[^\n]*+|{_BLOCK}", _QUOTED['"'] + "|" + _QUOTED["c"]),
    "hash": (r"#[^\n]*+", _QUOTED["t"] + "|" + _QUOTED['"'] + "|" + _QUOTED["'"]),
    "php": (rf"//[^\n]*+|#(?!\[)[^\n]*+|{_BLOCK}", _QUOTED['"'] + "|" + _QUOTED["'"]),
    "mark": (r"<!--[^-]*+(?:-(?!->)[^-]*+)*+-->", _QUOTED['"'] + "|" + _QUOTED["'"]),
}
FAMILY = {
    "rust": "rust", "swift": "rust", "kotlin": "rust", "scala": "rust", "php": "php", "html": "mark", "xml": "mark",
    **dict.fromkeys(("python", "ruby", "bash", "yaml", "elixir", "dockerfile", "hcl"), "hash"),
}


@dataclass(frozen=True)
class CodeRule:
    """``on``: code (without comments and strings) or text. ``unless``: of the line; ``file`` and ``absent``: of the whole text; ``path``
    and ``off_path``: of the path. ``tests``: whether test files are looked at. ``bad`` and ``good``: a text with a finding and one without."""

    rule_id: str
    severity: str
    issue_type: str
    effort: int
    languages: tuple[str, ...]
    pattern: str
    bad: str
    good: str
    on: str = "code"
    unless: str | None = None
    file: str | None = None
    absent: str | None = None
    path: str | None = None
    off_path: str | None = None
    tests: bool = True
    hotspot: bool = False
    at: tuple[str, str] = ("", "")  # the paths of bad and good, where a rule asks for them


def masked(content: Column, family: str) -> Column:
    """The text with comments gone and strings empty, line by line where they were."""
    comment, string = FAMILIES[family]
    parts = F.regexp_extract_all(content, F.lit(rf"(?s){comment}|{string}|[^/#'\"`<]++|."), F.lit(0))
    kept = lambda t: F.regexp_replace(t, "[^\n]+", "")
    blank = lambda t: F.when(t.rlike(rf"(?s)^(?:{comment})$"), kept(t)).when(t.rlike(rf"(?s)^(?:{string})$"), F.concat(F.substring(t, 1, 1), kept(t), F.substring(t, 1, 1))).otherwise(t)
    return F.array_join(F.transform(parts, blank), "")


def _text(value: str) -> str:
    """A literal of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _lines_of(rule: CodeRule, k: int) -> str:
    """SQL of the lines, from 1, on which matches of rule ``k`` begin, as (k, line). As text, hundreds of rules are parsed at once; built from columns,
    each of their parts is a call to the driver's JVM."""
    pattern = _text(f"(?m){rule.pattern}")
    wanted = [f"{rule.on} rlike {pattern}"]
    if rule.languages:
        wanted.append(f"language in ({', '.join(map(_text, rule.languages))})")
    for column, regex, has in (("text", rule.file, True), ("text", rule.absent, False), ("path", rule.path, True), ("path", rule.off_path, False)):
        if regex:
            wanted.append(f"{'' if has else 'not '}{column} rlike {_text(f'(?m){regex}')}")
    if not rule.tests:
        wanted.append("not in_test")
    marked = f"split(regexp_replace({rule.on}, {pattern}, {_text(MARK + '$0')}), '\\n')"
    hit = f"contains(line, {_text(MARK)})"
    unless = rule.unless or (_COMMENT_LINE if rule.on == "text" else None)
    if unless:
        hit += f" and not replace(line, {_text(MARK)}, '') rlike {_text(unless)}"
    lines = f"filter(transform({marked}, (line, i) -> if({hit}, i + 1, null)), i -> i is not null)"
    return f"if({' and '.join(f'({w})' for w in wanted)}, transform({lines}, i -> struct({k} as k, i as line)), null)"


def code_findings(files: DataFrame, rules: list[CodeRule]) -> DataFrame:
    """``path, rule_id, severity, issue_type, effort, hotspot, line``. ``files``: path, language, content."""
    source = files.where(F.col("content").isNotNull()).select("path", F.coalesce("language", F.lit("")).alias("language"), F.col("content").alias("text"))
    source = source.withColumn("in_test", S.is_test_path(F.col("path")))
    names = "k int, rule_id string, severity string, issue_type string, effort int, hotspot boolean"
    known = [(k, r.rule_id, r.severity, r.issue_type, r.effort, r.hotspot) for k, r in enumerate(rules)]
    table = F.broadcast(files.sparkSession.createDataFrame(known, names))  # a constant of the program
    out = []
    for family in FAMILIES:
        own = [lang for lang, f in FAMILY.items() if f == family]
        here = F.col("language").isin(own) if family != "c" else ~F.col("language").isin(list(FAMILY))
        fitting = [(k, r) for k, r in enumerate(rules) if not r.languages or (set(r.languages) & set(own) if family != "c" else set(r.languages) - set(FAMILY))]
        if not fitting:
            continue
        # a generator keeps the text without comments from being computed for every rule
        code = source.where(here).withColumn("code", F.explode(F.array(masked(F.col("text"), family))))
        hits = F.expr(f"flatten(array_compact(array({', '.join(_lines_of(r, k) for k, r in fitting)})))")
        out.append(code.select("path", F.explode(hits).alias("f")).select("path", "f.k", F.col("f.line").cast("long").alias("line")))
    found = out[0]
    for d in out[1:]:
        found = found.unionByName(d)
    return found.join(table, "k").select("path", "rule_id", "severity", "issue_type", "effort", "hotspot", "line")
