"""All rules on source text, by ruleset."""

from __future__ import annotations

from quartzite.operators.code_rules import CodeRule
from quartzite.rulesets import php, python, react, rust, security, typescript

RULES: list[CodeRule] = [*typescript.RULES, *react.RULES, *rust.RULES, *security.RULES, *php.RULES, *python.RULES]
#: An ending by language, for samples.
ENDING = {"typescript": "ts", "rust": "rs", "php": "php", "python": "py", "go": "go", "java": "java", "html": "html", "hcl": "tf", "dockerfile": "dockerfile"}


def samples() -> list[tuple[str, str, str, str, str]]:
    """(rule, bad or good, language, path with a place for a number, text) of every rule."""
    out = []
    for r in RULES:
        language = r.languages[0] if r.languages else "typescript"
        for kind, text, at in (("bad", r.bad, r.at[0]), ("good", r.good, r.at[1])):
            out.append((r.rule_id, kind, language, at or f"a/{r.rule_id.replace(':', '/')}{{}}.{ENDING[language]}", text))
    return out
