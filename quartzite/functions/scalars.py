"""Scalar expressions of the engine: ranks, ratings, scores and text tests. NULL means "not reported", never 0."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities and ratings from least to worst.
SEVERITIES = ("Info", "Minor", "Major", "Critical", "Blocker")
RATINGS = ("A", "B", "C", "D", "E")
DEBT_GRID = (0.05, 0.1, 0.2, 0.5)
MINUTES_PER_LINE = 30.0
HIGH_CRAP = 30.0


def lookup(value: Column, table: dict, default: object = None) -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES)})


def rating_of_rank(rank: Column) -> Column:
    """The rating of the worst severity rank; A where there is none."""
    return F.coalesce(lookup(rank, dict(enumerate(RATINGS))), F.lit("A"))


def rating_number(rating: Column) -> Column:
    return lookup(rating, {r: i + 1 for i, r in enumerate(RATINGS)})


def debt_ratio(minutes: Column, lines: Column, per_line: float = MINUTES_PER_LINE) -> Column:
    return F.when(lines > 0, minutes / (lines * per_line)).otherwise(F.lit(0.0))


def debt_rating(ratio: Column) -> Column:
    out = F.lit(RATINGS[-1])
    for bound, name in reversed(list(zip(DEBT_GRID, RATINGS, strict=False))):
        out = F.when(ratio <= bound, name).otherwise(out)
    return out


def health_score(blocker: Column, critical: Column, major: Column, hotspots: Column, lines: Column, duplicated_percent: Column) -> Column:
    kloc = F.greatest(lines / 1000.0, F.lit(1.0))
    raw = 100.0 - (10.0 * blocker + 5.0 * critical + major + 2.0 * hotspots) / kloc - 0.5 * duplicated_percent
    return F.round(F.greatest(raw, F.lit(0.0))).cast("int")


def density(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(100.0), part * 100.0 / whole)).otherwise(F.lit(0.0))


def comment_density(comments: Column, lines: Column) -> Column:
    return F.when(comments + lines > 0, comments * 100.0 / (comments + lines)).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """NULL where the whole is 0."""
    return F.when(whole > 0, part * 100.0 / whole)


def crap_score(complexity: Column, coverage_percent: Column) -> Column:
    bare = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - coverage_percent / 100.0))
    return complexity * complexity * bare * bare * bare + complexity


def instability(ca: Column, ce: Column) -> Column:
    """0.5 for an isolated component."""
    return F.when(ca + ce > 0, ce / (ca + ce)).otherwise(F.lit(0.5))


def main_sequence_distance(abstractness: Column, instable: Column) -> Column:
    return F.abs(abstractness + instable - 1)


def entropy(text: Column) -> Column:
    """Shannon bits a character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    bits = F.aggregate(
        F.array_distinct(chars), F.lit(0.0),
        lambda a, c: a - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n),
    )
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def halstead(n1: Column, n2: Column, total1: Column, total2: Column) -> dict[str, Column]:
    """Volume, difficulty, effort, bugs and seconds from distinct and total operators and operands."""
    vocabulary = n1 + n2
    volume = F.when(vocabulary > 0, (total1 + total2) * F.log2(vocabulary)).otherwise(F.lit(0.0))
    difficulty = (n1 / 2.0) * (total2 / F.greatest(n2, F.lit(1)))
    effort = difficulty * volume
    return {"volume": volume, "difficulty": difficulty, "effort": effort, "bugs": volume / 3000.0, "seconds": effort / 18.0}


def maintainability(volume: Column, complexity: Column, lines: Column) -> Column:
    raw = 171 - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * complexity - 16.2 * F.log(F.greatest(lines, F.lit(1)))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171))


def cvss_severity(score: Column) -> Column:
    return F.when(score >= 9.0, "Blocker").when(score >= 7.0, "Critical").when(score >= 4.0, "Major").when(score > 0, "Minor").otherwise("Info")


def line_key(line: Column) -> Column:
    """A line without any of its white space."""
    return F.regexp_replace(line, "[ \t\r\f]+", "")


def component_of(path: Column) -> Column:
    """The first two directories of a path, ``(root)`` for none."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.least(F.lit(2), F.size(parts) - 1))
    return F.when(F.size(parts) <= 1, "(root)").otherwise(F.array_join(dirs, "/"))


def is_hex_digest(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]+$") & F.length(text).isin(32, 40, 56, 64, 96, 128)


def is_uuid(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def is_test_path(path: Column) -> Column:
    p = F.lower(path)
    return p.contains(".spec.") | p.contains(".test.") | p.contains("__tests__") | p.contains("/tests/") | p.startswith("tests/") | F.arrays_overlap(
        F.split(path, "/"), F.array(F.lit("tests"), F.lit("__tests__"), F.lit("fixtures"))
    )


def suppressed(line: Column, rule: Column, marker: str = "quartzite-ignore") -> Column:
    """Whether the ignore marker on a line speaks for a rule: bare for all, after a colon for those listed, and not at all where a
    word follows without a colon."""
    rest = F.regexp_extract(line, f"{re.escape(marker)}(.*)$", 1)
    listed = F.transform(F.split(F.regexp_extract(rest, "^:(.*)$", 1), ","), lambda e: F.get(F.split(F.trim(e), "\\s+"), F.lit(0)))
    return line.contains(marker) & F.when(rest.startswith(":"), F.array_contains(listed, rule)).otherwise(~rest.rlike("^[ \t]*[0-9A-Za-z]"))


def glob_to_regex(glob: str) -> str:
    """``*`` within a segment, ``**`` across segments, ``?`` one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"
