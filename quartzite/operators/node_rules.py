"""Rules on syntax nodes of any language: what a function or a class amounts to, and graph rules on files and components.

Each rule is an aggregation over the node relation of ``python_source`` or ``code_source``; a function or class is one group and no larger than
its source. Findings are ``path, rule_id, severity, issue_type, effort, line, measure``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.functions import scalars as S
from quartzite.operators import code, graphs, layers
from quartzite.operators.shared import stored
from quartzite.sources import code_source

#: Limits, severities and minutes of the rules; kinds that nest, that stay flat, that jump.
COMPLEXITY, COGNITIVE, FUNCTION_LINES, JSX_LINES, METHODS, FIELDS, WMC, NESTED_FUNCTIONS, EXPORTS, INTERFACE = 10, 15, 50, 80, 20, 15, 25, 4, 25, 8
LCOM_METHODS, LCOM_FIELDS, INHERITANCE = 4, 2, 5
SEQUENCE_DISTANCE, SEQUENCE_TYPES, SEQUENCE_COUPLINGS, STABILITY_MARGIN, STABILITY_DEPENDENTS = 0.7, 5, 3, 0.25, 2
NESTING = ("if_statement", "while_statement", "for_statement", "loop_expression", "repeat_statement", "catch_clause", "except_clause", "conditional_expression", "switch_statement", "match_statement")
FLAT = ("elif_clause",)
QUERIES = ("query", "execute", "find", "findOne", "findMany", "findAll", "fetchAll", "fetchone", "fetchall", "select")
#: What the rules read of a node.
COLUMNS = ("path", "node_id", "post", "parent_id", "kind", "name", "start_line", "end_line", "owner_fn_id", "owner_class_id", "owner_loop_id", "parent_kind", "flags")


def _finding(df: DataFrame, rule_id: str, severity: str, effort: int, line: str, measure, issue_type: str = "CodeSmell") -> DataFrame:  # noqa: ANN001
    return df.select(
        "path", F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(issue_type).alias("issue_type"), F.lit(effort).alias("effort"), F.col(line).cast("long").alias("line"),
        measure.cast("double").alias("measure"),
    )


def _functions(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'FunctionDef'").select("path", F.col("node_id").alias("fn"), "name", "start_line", "end_line", "flags", "owner_fn_id", "owner_class_id", "parent_kind", "post")


def cognitive_complexity(nodes: DataFrame) -> DataFrame:
    """``path, fn, cognitive``: each decision counts one, and one more for every decision around it; tests joined by and, or count one for each
    joint, jumps out of nested loops none. Depth is how many nesting nodes of the function hold a node, by their pre- and post-order numbers."""
    own = nodes.where(F.col("owner_fn_id").isNotNull()).select("path", F.col("owner_fn_id").alias("fn"), "node_id", "post", "kind")
    counted = own.where(F.col("kind").isin(*NESTING, *FLAT, "boolean_operator"))
    outer = own.where(F.col("kind").isin(*NESTING)).select("path", "fn", F.col("node_id").alias("above"), F.col("post").alias("above_post"))
    depth = counted.join(outer, ["path", "fn"], "left").groupBy("path", "fn", "node_id", "kind").agg(F.count_if((F.col("above") < F.col("node_id")) & (F.col("above_post") > F.col("post"))).alias("depth"))
    return depth.groupBy("path", "fn").agg(F.sum(F.when(F.col("kind").isin(*NESTING), 1 + F.col("depth")).otherwise(1)).alias("cognitive"))


def function_findings(nodes: DataFrame) -> DataFrame:
    fns = _functions(nodes)
    cc = code.function_complexity(nodes)
    lines = F.col("end_line") - F.col("start_line") + 1
    most = F.when(F.col("path").rlike(r"\.(tsx|jsx)$"), JSX_LINES).otherwise(FUNCTION_LINES)
    own = nodes.where(F.col("owner_fn_id").isNotNull()).groupBy("path", F.col("owner_fn_id").alias("fn")).agg(F.count_if(F.col("kind") == "await_expression").alias("awaits"), F.count_if(F.col("kind") == "yield").alias("yields"))
    inside = fns.select("path", F.col("fn").alias("above"), F.col("post").alias("above_post"))
    nested = fns.join(inside, "path").where("above < fn and above_post > post").groupBy("path", "fn", "start_line").agg((F.count("*") + 1).alias("depth"))
    quiet = fns.where(F.array_contains("flags", "async") & F.col("path").rlike(r"\.[jt]sx?$")).join(own, ["path", "fn"], "left").where("coalesce(awaits, 0) + coalesce(yields, 0) = 0")
    looped = nodes.where((F.col("kind") == "Call") & F.col("owner_loop_id").isNotNull() & F.regexp_extract("name", r"([^.:>]+)$", 1).isin(*QUERIES) & F.col("name").rlike("[.:>]"))
    tries = nodes.where("kind = 'try_statement'").select("path", F.col("node_id").alias("t"), F.col("post").alias("t_post"))
    parse = nodes.where("kind = 'Call' and name = 'JSON.parse'").where(~S.is_test_path(F.col("path")))
    bare = parse.join(tries, (parse.path == tries.path) & (F.col("t") < F.col("node_id")) & (F.col("t_post") > F.col("post")), "left_anti")
    top = fns.where(F.col("parent_kind").isin("SourceUnit", "Module") & (F.arrays_overlap("flags", F.array(F.lit("export"), F.lit("pub"), F.lit("public"))) | F.col("path").rlike(r"\.(py|go)$")))
    parts = [
        _finding(cc.where(F.col("cyclomatic") > COMPLEXITY), "smells:high-complexity", "Major", 30, "start_line", F.col("cyclomatic")),
        _finding(fns.where((lines > most) & ~S.is_test_path(F.col("path"))), "smells:long-function", "Minor", 10, "start_line", lines),
        _finding(cognitive_complexity(nodes).where(F.col("cognitive") > COGNITIVE).join(fns.select("path", "fn", "start_line"), ["path", "fn"]), "smells:cognitive-complexity", "Major", 30, "start_line", F.col("cognitive")),
        _finding(nested.where((F.col("depth") > NESTED_FUNCTIONS) & F.col("path").rlike(r"\.[jt]sx?$")), "typescript:max-function-nesting-depth", "Major", 15, "start_line", F.col("depth")),
        _finding(quiet, "typescript:async-function-without-await", "Minor", 3, "start_line", F.lit(1)),
        _finding(looped, "smells:db-call-in-loop", "Major", 20, "start_line", F.lit(1)),
        _finding(bare, "typescript:json-parse-unguarded", "Major", 10, "start_line", F.lit(1), "Bug"),
        _finding(top.groupBy("path").agg(F.count("*").alias("n"), F.min("start_line").alias("start_line")).where(F.col("n") > EXPORTS), "architecture:functional-module", "Major", 10, "start_line", F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def class_findings(nodes: DataFrame) -> DataFrame:
    kinds = ("class_definition", "class_declaration", "struct_item", "impl_item")
    classes = nodes.where(F.col("kind").isin(*kinds)).select("path", F.col("node_id").alias("cls"), "name", "start_line")
    methods = nodes.where((F.col("kind") == "FunctionDef") & F.col("parent_kind").isin(*kinds)).select("path", F.col("parent_id").alias("cls"), F.col("node_id").alias("method"), "name")
    own = nodes.where((F.col("kind") == "MemberAccess") & F.col("name").rlike(r"^(self|this|\$this)(\.|->)\w+$") & F.col("owner_fn_id").isNotNull())
    field = own.select("path", F.col("owner_fn_id").alias("method"), F.regexp_extract("name", r"(\w+)$", 1).alias("field")).distinct().join(methods.drop("name"), ["path", "method"])
    cc = code.function_complexity(nodes).select("path", F.col("fn").alias("method"), "cyclomatic")
    size = methods.join(cc, ["path", "method"]).groupBy("path", "cls").agg(F.count("*").alias("methods"), F.sum("cyclomatic").alias("wmc"))
    fields = field.groupBy("path", "cls").agg(F.countDistinct("field").alias("fields"))
    facts = classes.join(size, ["path", "cls"], "left").join(fields, ["path", "cls"], "left").na.fill(0, ["methods", "wmc", "fields"])
    relevant = field.join(methods.where(F.col("name").isin("__init__", "constructor")).select("path", "method"), ["path", "method"], "left_anti")
    named = lambda c: F.to_json(F.struct("path", "cls", c))
    groups = code.equivalence(relevant.select(named("method").alias("a"), named("field").alias("b")))
    lcom = relevant.select("path", "cls", named("method").alias("node")).distinct().join(groups, "node").groupBy("path", "cls").agg(F.countDistinct("root").alias("lcom"), F.count("*").alias("used"))
    loose = facts.join(lcom, ["path", "cls"]).where((F.col("lcom") > 1) & (F.col("used") >= LCOM_METHODS) & (F.col("fields") >= LCOM_FIELDS))
    wide = nodes.where(F.col("kind").isin("interface_declaration", "trait_item")).select("path", F.col("node_id").alias("cls"), "start_line")
    demands = nodes.where(F.col("kind").isin("FunctionDef", "Call") & F.col("parent_kind").isin("interface_declaration", "trait_item")).groupBy("path", F.col("parent_id").alias("cls")).agg(F.count("*").alias("n"))
    parts = [
        _finding(facts.where((F.col("methods") > METHODS) | (F.col("fields") > FIELDS)), "smells:god-class", "Major", 10, "start_line", F.col("methods")),
        _finding(facts.where(F.col("wmc") > WMC), "smells:ck-oo-metrics", "Major", 10, "start_line", F.col("wmc")),
        _finding(loose, "smells:low-cohesion", "Major", 10, "start_line", F.col("lcom")),
        _finding(wide.join(demands, ["path", "cls"]).where(F.col("n") > INTERFACE), "smells:fat-interface", "Minor", 10, "start_line", F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def alike(files: DataFrame) -> DataFrame:
    """``files`` with ``same``, a path for all files of one language and text whose paths are one to the rules here: by their ending, and by whether they are tests."""
    text = F.concat(F.coalesce("language", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    place = F.when(S.is_test_path(F.col("path")), "tests/").otherwise("src/")
    return files.withColumn("same", F.concat(place, F.sha2(text, 256), F.regexp_extract("path", r"\.\w*$", 0)))


def alike_findings(files: DataFrame) -> DataFrame:
    """Findings on functions and classes by ``same`` instead of ``path``: of files that are ``alike``, one is read. Joined with them on ``same``, they are
    what ``function_findings`` and ``class_findings`` find in each."""
    one = files.select("same", F.coalesce("language", F.lit("")).alias("language"), F.coalesce("content", F.lit("")).alias("content")).distinct()
    n = stored(code_source.nodes(one, path="same", columns=COLUMNS))
    return stored(function_findings(n).unionByName(class_findings(n)).withColumnRenamed("path", "same"))


def graph_findings(edges: DataFrame, census: DataFrame, component_edges: DataFrame) -> DataFrame:
    """Findings of the architecture rules: files in a cycle, dependencies that point outward (``edges``: src, dst paths), components far from
    the main sequence, and stable ones that lean on less stable ones (``census``: component, types, abstractions)."""
    at = lambda df, c: df.withColumn("path", F.col(c).cast("string")).withColumn("line", F.lit(1))
    martin = graphs.martin(component_edges, census)
    far = martin.where((F.col("distance") > SEQUENCE_DISTANCE) & (F.col("types") >= SEQUENCE_TYPES) & (F.col("ca") + F.col("ce") >= SEQUENCE_COUPLINGS))
    leaning = graphs.unstable_dependencies(component_edges, martin, STABILITY_MARGIN).join(martin.where(F.col("ca") >= STABILITY_DEPENDENTS).select(F.col("component").alias("src")), "src", "left_semi")
    parts = [
        _finding(at(graphs.cycles(edges), "node"), "architecture:dependency-cycle", "Major", 60, "line", F.lit(1)),
        _finding(at(layers.outward_dependencies(edges), "src"), "architecture:hexagonal-layer-violation", "Major", 45, "line", F.lit(1)),
        _finding(at(far, "component"), "architecture:main-sequence-deviation", "Major", 120, "line", F.col("distance")),
        _finding(at(leaning, "src"), "architecture:stable-dependency-violation", "Major", 90, "line", F.col("i_dst") - F.col("i_src")),
    ]
    return reduce(DataFrame.unionByName, parts)


def inheritance_findings(parents: DataFrame) -> DataFrame:
    """Classes with more than so many ancestors. ``parents``: path, type, base, line."""
    from quartzite.operators.fixpoints import ancestors

    depth = ancestors(parents.select("type", "base")).groupBy("type").agg(F.count("*").alias("depth")).where(F.col("depth") > INHERITANCE)
    return _finding(parents.join(depth, "type"), "smells:deep-inheritance", "Major", 120, "line", F.col("depth"))
