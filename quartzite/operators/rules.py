"""Rule registry: secrets on raw lines, and Python rules as filters on syntax nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.functions import scalars as S
from quartzite.operators.findings import LineRule, line_findings

#: Credential formats of well-known providers.
PROVIDERS = [
    LineRule("secrets:aws-access-key-id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "Blocker", "Vulnerability", 10),
    LineRule("secrets:aws-secret-access-key", r"(?i)aws_secret_access_key\s*[:=]\s*['\"]?[A-Za-z0-9/+=]{40}['\"]?", "Blocker", "Vulnerability", 10),
    LineRule("secrets:gcp-api-key", r"\bAIza[0-9A-Za-z_\-]{35}\b", "Blocker", "Vulnerability", 10),
    LineRule("secrets:gcp-service-account-key", r'"private_key"\s*:\s*"-----BEGIN (RSA )?PRIVATE KEY', "Blocker", "Vulnerability", 10),
    LineRule("secrets:azure-storage-connection-string", r"AccountKey=[A-Za-z0-9+/]{40,}={0,2}", "Blocker", "Vulnerability", 10),
    LineRule("secrets:azure-sas-token", r"[?&]sv=\d{4}-\d{2}-\d{2}[^\s\x22\x27]*[?&]sig=[A-Za-z0-9%]{20,}", "Blocker", "Vulnerability", 10),
    LineRule("secrets:stripe-live-key", r"\b(?:sk|pk|rk)_live_[0-9a-zA-Z]{24,}\b", "Blocker", "Vulnerability", 10),
    LineRule("secrets:private-key-block", r"-----BEGIN ((RSA|EC|DSA|OPENSSH|PGP) )?PRIVATE KEY-----", "Blocker", "Vulnerability", 10),
    LineRule("secrets:github-token", r"\bgh[oprsu]_[A-Za-z0-9]{36,}\b|\bgithub_pat_[A-Za-z0-9_]{22,}\b", "Blocker", "Vulnerability", 10),
    LineRule("secrets:slack-token", r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b", "Blocker", "Vulnerability", 10),
    LineRule("secrets:npm-token", r"\bnpm_[A-Za-z0-9]{36,}\b", "Blocker", "Vulnerability", 10),
    LineRule("secrets:jwt-like-token", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "Blocker", "Vulnerability", 10),
]


@dataclass(frozen=True)
class NodeRule:
    """A finding for each node of a kind for which the SQL condition holds."""

    rule_id: str
    severity: str
    issue_type: str
    effort: int
    kind: str
    condition: str
    tests: bool = True  # whether test files are looked at too
    hotspot: bool = False


def _flag(name: str) -> str:
    return f"array_contains(flags, '{name}')"


def _keyword(pattern: str) -> str:
    return f"exists(flags, f -> f rlike '^kw:{pattern}')"


_LOGGING = "'logging.debug', 'logging.info', 'logging.warning', 'logging.error', 'logging.exception', 'logging.critical'"
_REQUESTS = "name rlike '^(requests|httpx)[.](get|post|put|patch|delete|head|request)$'"
PYTHON = [
    NodeRule("python:assert-used-in-production", "Minor", "Vulnerability", 10, "assert_statement", "true", False, True),
    NodeRule("python:async-function-with-sync-blocking-call", "Major", "Bug", 15, "Call", "in_async and name in ('time.sleep', 'requests.get', 'requests.post', 'subprocess.run', 'urllib.request.urlopen')"),
    NodeRule("python:bare-except", "Major", "Bug", 10, "except_clause", "name is null"),
    NodeRule("python:bind-all-interfaces", "Minor", "Vulnerability", 10, "StringLiteral", "name = '0.0.0.0'", True, True),
    NodeRule("python:bool-comparison-with-equality", "Minor", "CodeSmell", 5, "comparison_operator", _flag("equals_bool")),
    NodeRule("python:broad-exception-swallowed", "Major", "Bug", 15, "except_clause", f"name in ('Exception', 'BaseException') and {_flag('pass_only')}"),
    NodeRule("python:debugger-left-in-code", "Major", "Bug", 2, "Call", "name in ('pdb.set_trace', 'ipdb.set_trace', 'breakpoint')"),
    NodeRule("python:django-debug-true", "Blocker", "Vulnerability", 5, "Assignment", "name = 'DEBUG' and text rlike '=\\\\s*True$' and owner_fn_id is null"),
    NodeRule("python:eager-logging-interpolation", "Minor", "CodeSmell", 5, "Call", f"name rlike '(^|[.])(log|logger|logging)[.](debug|info|warning|error|exception|critical)$' and {_flag('built_text')}"),
    NodeRule("python:exception-swallowed-pass-only", "Minor", "CodeSmell", 10, "except_clause", f"name not in ('Exception', 'BaseException') and {_flag('pass_only')}"),
    NodeRule("python:flask-debug-true", "Blocker", "Vulnerability", 5, "Call", f"name rlike '[.]run$' and {_keyword('debug=True$')}"),
    NodeRule("python:global-statement-usage", "Minor", "CodeSmell", 20, "global_statement", "true"),
    NodeRule("python:hardcoded-local-path", "Major", "CodeSmell", 5, "StringLiteral", "name rlike '^(/home/[a-z]|/Users/[A-Za-z]|[A-Z]:[\\\\\\\\/]Users)'"),
    NodeRule("python:insecure-tempfile", "Major", "Vulnerability", 10, "Call", "name = 'tempfile.mktemp'"),
    NodeRule("python:len-as-condition", "Minor", "CodeSmell", 5, "if_statement", _flag("tests_len")),
    NodeRule("python:literal-identity-comparison", "Major", "Bug", 5, "comparison_operator", _flag("is_literal")),
    NodeRule("python:logging-logger-root-usage", "Minor", "CodeSmell", 10, "Call", f"name in ({_LOGGING})"),
    NodeRule("python:missing-docstring-on-public-api", "Minor", "CodeSmell", 5, "FunctionDef", f"parent_kind = 'SourceUnit' and name not like '\\\\_%' and {_flag('undocumented')}", False),
    NodeRule("python:missing-type-annotations", "Major", "CodeSmell", 10, "FunctionDef", f"name not like '\\\\_%' and {_flag('unannotated')}"),
    NodeRule("python:mutable-class-attribute", "Major", "Bug", 10, "Assignment", f"parent_kind = 'class_definition' and {_flag('mutable_value')}"),
    NodeRule("python:mutable-default-argument", "Major", "Bug", 10, "FunctionDef", _flag("mutable_default")),
    NodeRule("python:datetime-utcnow-naive", "Minor", "CodeSmell", 5, "Call", "name in ('datetime.utcnow', 'datetime.datetime.utcnow')"),
    NodeRule("python:none-comparison-with-equality", "Minor", "CodeSmell", 5, "comparison_operator", _flag("equals_none")),
    NodeRule("python:open-without-encoding", "Minor", "CodeSmell", 5, "Call", f"name = 'open' and not {_keyword('encoding=')} and not text rlike '[\\'\\\"][rwax+]*b[rwax+]*[\\'\\\"]'"),
    NodeRule("python:os-system-usage", "Critical", "Vulnerability", 15, "Call", "name = 'os.system'"),
    NodeRule("python:paramiko-insecure-host-key-policy", "Critical", "Vulnerability", 15, "Call", "name rlike 'set_missing_host_key_policy$' and text rlike 'AutoAddPolicy|WarningPolicy'"),
    NodeRule("python:pickle-load-untrusted-data", "Critical", "Vulnerability", 20, "Call", "name in ('pickle.load', 'pickle.loads')", True, True),
    NodeRule("python:print-debug-left-in-code", "Minor", "CodeSmell", 5, "Call", "name = 'print'", False),
    NodeRule("python:raise-generic-exception", "Minor", "CodeSmell", 10, "raise_statement", "text rlike '^raise (Exception|BaseException)\\\\b'"),
    NodeRule("python:raise-without-from-in-except", "Minor", "CodeSmell", 5, "raise_statement", "in_except and text <> 'raise' and not text rlike '\\\\sfrom\\\\s' and text rlike '[(]'"),
    NodeRule("python:requests-missing-timeout", "Major", "Bug", 5, "Call", f"{_REQUESTS} and not {_keyword('timeout=')}"),
    NodeRule("python:requests-verify-false", "Critical", "Vulnerability", 5, "Call", f"{_REQUESTS} and {_keyword('verify=False$')}"),
    NodeRule("python:sql-injection-string-building", "Blocker", "Vulnerability", 20, "Call", f"name rlike '[.](execute|executemany)$' and {_flag('built_text')}"),
    NodeRule("python:sqlalchemy-raw-sql-without-bind", "Blocker", "Vulnerability", 20, "Call", f"name in ('text', 'sqlalchemy.text') and {_flag('built_text')}"),
    NodeRule("python:subprocess-shell-true", "Critical", "Vulnerability", 20, "Call", f"name like 'subprocess.%' and {_keyword('shell=True$')}"),
    NodeRule("python:nested-comprehension-too-deep", "Minor", "CodeSmell", 15, "list_comprehension", _flag("several_for")),
    NodeRule("python:type-comparison", "Minor", "Bug", 5, "comparison_operator", _flag("compares_type")),
    NodeRule("python:type-hint-mismatch-implementation", "Major", "Bug", 10, "FunctionDef", _flag("returns_value")),
    NodeRule("python:unclosed-open-file", "Major", "CodeSmell", 10, "Call", "name = 'open' and parent_kind <> 'with_item'"),
    NodeRule("python:unsafe-yaml-load", "Critical", "Vulnerability", 10, "Call", f"name = 'yaml.load' and not {_keyword('Loader=')}"),
    NodeRule("python:unused-loop-variable", "Minor", "CodeSmell", 2, "for_statement", _flag("unused_target")),
    NodeRule("python:wildcard-import", "Minor", "CodeSmell", 10, "import_from_statement", "text rlike 'import\\\\s+[*]'"),
    NodeRule("python:xml-xxe-hotspot", "Major", "Vulnerability", 15, "Call", "name rlike '^(xml[.]etree[.]ElementTree|ET|ElementTree|minidom)[.](parse|fromstring|parseString)$'", True, True),
    NodeRule("python:django-queryset-evaluated-in-loop", "Major", "CodeSmell", 20, "Call", "owner_loop_id is not null and name like '%.objects.%'", False),
    NodeRule("python:threading-mixed-with-asyncio", "Major", "CodeSmell", 20, "Call", "in_async and name like 'threading.%'"),
    NodeRule("python:tarfile-unsafe-extraction", "Critical", "Vulnerability", 10, "Call", f"name rlike '[.](extractall)$' and not {_keyword('filter=')}"),
]

#: What their conditions read.
PYTHON_COLUMNS = ("path", "kind", "name", "text", "start_line", "end_line", "owner_fn_id", "owner_loop_id", "in_async", "in_except", "parent_kind", "flags")
#: What is left of them where findings are only counted.
PYTHON_COUNTED = tuple(c for c in PYTHON_COLUMNS if c not in ("start_line", "end_line"))
#: Kinds of which no condition holds without a flag, and kinds of which one reads the text.
PYTHON_FLAGGED = tuple(sorted({r.kind for r in PYTHON} - {r.kind for r in PYTHON if r.condition.split("'")[::2] != ["array_contains(flags, ", ")"]}))
PYTHON_TEXT_KINDS = tuple(sorted({r.kind for r in PYTHON if "text" in r.condition}))


def secret_findings(lines: DataFrame) -> DataFrame:
    """Provider credentials on any line of any file."""
    return line_findings(lines, PROVIDERS)


def node_findings(nodes: DataFrame, rules: list[NodeRule] = PYTHON, active: dict[str, str] | None = None) -> DataFrame:
    """``path, rule_id, severity, issue_type, effort, hotspot, start_line, end_line``: all rules in one scan of the nodes. ``active``: the
    rules of a profile with their severity there; all, with their own, if not given."""
    return _met(nodes, rules, active, "start_line", "end_line").select("path", "f.*", "start_line", "end_line")


def node_counts(nodes: DataFrame, rules: list[NodeRule] = PYTHON, active: dict[str, str] | None = None) -> DataFrame:
    """``path, rule_id, n``: how many findings of a rule a file has, from nodes that came ``counted``."""
    return _met(nodes, rules, active, "n").groupBy("path", "f.rule_id").agg(F.sum("n").alias("n"))


def _met(nodes: DataFrame, rules: list[NodeRule], active: dict[str, str] | None, *kept: str) -> DataFrame:
    """The path of each node, each rule that it breaks as ``f``, and the columns that are ``kept``."""
    chosen = [r for r in rules if active is None or r.rule_id in active]
    test = S.is_test_path(F.col("path"))
    hit = lambda r: F.expr(r.condition) & (F.lit(r.tests) | ~test)
    made = lambda r: F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit((active or {}).get(r.rule_id, r.severity)).alias("severity"), F.lit(r.issue_type).alias("issue_type"), F.lit(r.effort).alias("effort"), F.lit(r.hotspot).alias("hotspot"))
    kinds = sorted({r.kind for r in chosen})
    found = F.lit(None)
    for k in kinds:  # a node meets the rules of its kind only
        found = F.when(F.col("kind") == k, F.array_compact(F.array(*(F.when(hit(r), made(r)) for r in chosen if r.kind == k)))).otherwise(found)
    return nodes.where(F.col("kind").isin(*kinds)).select("path", F.explode(found).alias("f"), *kept)
