"""Rings of an architecture by directory names, dependencies that point outward, and questions about one file of the import graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.functions import scalars as S

#: Directory names by ring, and how far out a ring lies.
SEGMENTS = {
    "domain": ("domain", "domains", "entities", "entity", "aggregate", "aggregates", "value_objects", "value-objects", "valueobjects", "core"),
    "application": ("application", "applications", "usecase", "usecases", "use_case", "use_cases", "use-cases", "interactor", "interactors"),
    "port": ("port", "ports"),
    "adapter": ("adapter", "adapters", "controller", "controllers", "handler", "handlers", "presenter", "presenters", "presentation", "delivery", "transport", "web", "http", "rest", "graphql", "routes", "views", "cli"),
    "infrastructure": ("infrastructure", "infra", "persistence", "database", "gateway", "gateways", "driven", "driving"),
}
DEPTH = {"domain": 0, "application": 1, "port": 1, "adapter": 2, "infrastructure": 2}


def layer_of(path: Column) -> Column:
    """The innermost ring among the names of a path, the first of equals; ``unclassified`` for none."""
    ring = {name: layer for layer, names in SEGMENTS.items() for name in names}
    layers = F.filter(F.transform(F.split(F.lower(path), "/"), lambda s: S.lookup(s, ring)), lambda x: x.isNotNull())
    inner = F.array_min(F.transform(layers, lambda x, i: F.struct(S.lookup(x, DEPTH).alias("depth"), i.alias("at"), x.alias("layer"))))
    return F.coalesce(inner["layer"], F.lit("unclassified"))


def custom_layer_of(path: Column, taxonomy: list[tuple[str, str]]) -> Column:
    """The ring that the first matching glob of ``taxonomy`` (glob, ring) declares, else that of the names."""
    for _, ring in taxonomy:
        if ring not in DEPTH:
            raise ValueError(f"unknown ring {ring}")
    return F.coalesce(*(F.when(path.rlike(S.glob_to_regex(glob)), ring) for glob, ring in taxonomy), layer_of(path)) if taxonomy else layer_of(path)


def outward_dependencies(edges: DataFrame, taxonomy: list[tuple[str, str]] | None = None) -> DataFrame:
    """``src, dst, from_layer, to_layer`` of edges of no test file whose source lies further in than their target."""
    of = lambda c: custom_layer_of(F.col(c), taxonomy or [])
    named = edges.where(~S.is_test_path(F.col("src"))).withColumn("from_layer", of("src")).withColumn("to_layer", of("dst"))
    return named.where(S.lookup(F.col("from_layer"), DEPTH) < S.lookup(F.col("to_layer"), DEPTH)).select("src", "dst", "from_layer", "to_layer")


def dependencies(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("src") == path).select("dst").distinct()


def dependents(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("dst") == path).select("src").distinct()


def cycles_touching(members: DataFrame, path: str) -> DataFrame:
    """All members of the cycle that holds ``path``. ``members``: node, scc."""
    return members.join(members.where(F.col("node") == path).select("scc"), "scc", "left_semi")


def cycle_paths(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``scc, path``: a walk through each component from its least member, always to the first neighbour in order that closes it or is new."""
    inner = edges.join(members.select(F.col("node").alias("src"), "scc"), "src").join(members.select(F.col("node").alias("dst"), F.col("scc").alias("to")), "dst").where("scc = to").select("scc", "src", "dst").distinct()

    def walk(ways: dict) -> str:
        start = at = min(ways)
        path, seen = [start], {start}
        while at is not None:
            at = next((x for x in ways.get(at, ()) if x == start or x not in seen), None)
            if at is not None:
                path.append(at)
                seen.add(at)
            if at == start:
                break
        return " -> ".join(map(str, path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Components stand one after the other, however the batches part them."""
        now, ways = None, {}
        for b in batches:
            out = []
            for scc, src, dst in zip(b["scc"].tolist(), b["src"].tolist(), b["dst"].tolist(), strict=True):
                if ways and scc != now:
                    out.append((now, walk(ways)))
                    ways = {}
                now = scc
                ways.setdefault(src, []).append(dst)
            yield pd.DataFrame(out, columns=["scc", "path"])
        if ways:
            yield pd.DataFrame([(now, walk(ways))], columns=["scc", "path"])

    kind = members.schema["scc"].dataType.simpleString()
    return inner.repartition("scc").sortWithinPartitions("scc", "src", "dst").mapInPandas(run, f"scc {kind}, path string")
