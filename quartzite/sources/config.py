"""Project files that steer a scan. They are single small files of a project and are read on the driver."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def load_project(directory: str, name: str = "quartzite.toml") -> dict:
    """The project's settings; an empty dict without a file."""
    at = Path(directory, name)
    return tomllib.loads(at.read_text()) if at.is_file() else {}


def gate_conditions(spark: SparkSession, config: dict) -> DataFrame:
    """``metric, op, threshold`` of the settings, else the default gate."""
    rows = [(c["metric"], c["op"], float(c["threshold"])) for c in config.get("gate", {}).get("conditions", [])]
    rows = rows or [("blocker", ">", 0.0), ("critical", ">", 0.0), ("parse_failures", ">", 0.0), ("coverage", "<", 80.0), ("mutation_score", "<", 60.0), ("crap_high_risk_functions", ">", 0.0)]
    return spark.createDataFrame(rows, "metric string, op string, threshold double")


def custom_rules(config: dict) -> list:
    """Line rules of the settings; one with a pattern that doesn't compile is left out."""
    from quartzite.operators.findings import LineRule

    out = []
    for r in config.get("rules", {}).get("custom", []):
        try:
            re.compile(r["pattern"])
        except (re.error, KeyError):
            continue
        out.append(LineRule(r["id"], r["pattern"], r.get("severity", "Major"), r.get("type", "CodeSmell"), int(r.get("effort", 10))))
    return out


def ts_aliases(spark: SparkSession, directory: str) -> DataFrame:
    """``prefix, directory`` of the compiler paths, with one hop to the file it extends."""
    found: dict[str, str] = {}
    for name in ("tsconfig.json", "jsconfig.json"):
        at = Path(directory, name)
        if not at.is_file():
            continue
        bare = lambda p: json.loads(re.sub(r"(?m)^\s*//.*$", "", p.read_text()))
        own = bare(at)
        chain = [own]
        if isinstance(own.get("extends"), str) and (base := at.parent / own["extends"]).is_file():
            chain.insert(0, bare(base))
        for c in chain:
            options = c.get("compilerOptions", {})
            for key, targets in options.get("paths", {}).items():
                if targets:
                    found[key.rstrip("*")] = str(Path(options.get("baseUrl", "."), targets[0].rstrip("*"))).replace("\\", "/")
        break
    return spark.createDataFrame(sorted(found.items()), "prefix string, directory string")


def rust_crates(directory: str) -> dict[str, str]:
    """Crate names, with underscores, to their directories."""
    out = {}
    for at in sorted(Path(directory).rglob("Cargo.toml")):
        name = tomllib.loads(at.read_text()).get("package", {}).get("name")
        if name:
            out[name.replace("-", "_")] = str(at.parent.relative_to(directory))
    return out


def exit_code(worst_rank: int | None, threshold_rank: int | None, gate_failed: bool, health: int | None, least_health: int | None) -> int:
    """3 on any breach, else 0."""
    breach = threshold_rank is not None and worst_rank is not None and worst_rank >= threshold_rank
    return 3 if breach or gate_failed or least_health is not None and health is not None and health < least_health else 0
