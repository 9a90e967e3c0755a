"""Facts and metrics from syntax nodes: complexity, structure, calls, imports, classes, cohesion."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.operators.fixpoints import equivalence
from quartzite.sources import code_source
from quartzite.sources.python_source import dealt
from quartzite.sources.shapes import frames

#: Kinds that are decision points, statements and control structures.
BRANCHES = ("if_statement", "case_clause", "conditional_expression", "boolean_operator", "elif_clause", "match_arm", "switch_case")
LOOPS = ("while_statement", "for_statement", "for_in_statement", "loop_expression", "repeat_statement")
EXCEPTIONS = ("except_clause", "catch_clause")
CLASSES = ("class_definition", "class_declaration", "struct_item", "interface_declaration", "trait_item", "enum_item")
STATEMENTS = (
    "expression_statement", "pass_statement", "return_statement", "if_statement", "for_statement", "while_statement", "break_statement", "continue_statement",
    "try_statement", "assert_statement", "raise_statement", "with_statement", "delete_statement", "Assignment", "VariableDecl",
)


#: What the metrics read, for a parser to make no more.
COMPLEXITY_COLUMNS = ("path", "node_id", "kind", "name", "start_line", "end_line", "owner_fn_id")
COMPLEXITY_KINDS = ("FunctionDef", *BRANCHES, *LOOPS, *EXCEPTIONS)
STRUCTURE_KINDS = ("SourceUnit", "ERROR", "FunctionDef", *CLASSES, *STATEMENTS)  # a file has a row even if it holds nothing


def function_complexity(nodes: DataFrame) -> DataFrame:
    """1 and the decision points of each function that no inner function holds, by kind. A definition and the points it owns meet in one
    aggregation, so the nodes are read once."""
    count = lambda kinds: F.count_if(~is_fn & F.col("kind").isin(*kinds))
    is_fn = F.col("kind") == "FunctionDef"
    own = F.max(F.when(is_fn, F.struct("name", "start_line", "end_line"))).alias("own")
    rows = nodes.where(F.col("kind").isin(*COMPLEXITY_KINDS)).withColumn("fn", F.when(is_fn, F.col("node_id")).otherwise(F.col("owner_fn_id"))).where("fn is not null")
    out = rows.groupBy("path", "fn").agg(own, count(BRANCHES).alias("branches"), count(LOOPS).alias("loops"), count(EXCEPTIONS).alias("exceptions")).where("own is not null")
    out = out.select("path", "fn", "own.name", "own.start_line", "own.end_line", "branches", "loops", "exceptions")
    return out.withColumn("cyclomatic", 1 + F.col("branches") + F.col("loops") + F.col("exceptions"))


def _facts(rows: list[tuple]) -> list[list]:
    """Number, name, first and last line, decision points by kind and names called of each function of a file, by columns."""
    fns = {r[1]: [r[1], r[7], r[9], r[11], 0, 0, 0, []] for r in rows if r[6] == "FunctionDef"}
    for r in rows:
        own, kind = fns.get(r[13]), r[6]
        if own is not None and kind != "FunctionDef":
            own[4] += kind in BRANCHES
            own[5] += kind in LOOPS
            own[6] += kind in EXCEPTIONS
            if kind == "Call" and r[7] is not None and r[7] not in own[7]:
                own[7].append(r[7])
    return [list(c) for c in zip(*fns.values(), strict=True)] or [[] for _ in range(8)]


def functions(files: DataFrame, deal: bool = True) -> DataFrame:
    """``function_complexity`` of files (path, language, content) of brace and keyword languages with ``calls``, the names that a function calls, in no order.
    A function is in one file, so it is summed up where the file is read; files of one shape are read once."""
    fields = [("path", pa.string()), ("fn", pa.int32()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), *((c, pa.int64()) for c in ("branches", "loops", "exceptions")), ("calls", pa.list_(pa.string()))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return frames(batches, code_source.read_by("functions", _facts), fields)

    source = files.select("path", "language", "content")
    out = (dealt(source) if deal else source).mapInArrow(read, "path string, fn int, name string, start_line int, end_line int, branches long, loops long, exceptions long, calls array<string>")
    return out.withColumn("cyclomatic", 1 + F.col("branches") + F.col("loops") + F.col("exceptions"))


def structure(nodes: DataFrame) -> DataFrame:
    """Functions, classes and statements of each file."""
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return nodes.groupBy("path").agg(count("FunctionDef").alias("functions"), count(*CLASSES).alias("classes"), count(*STATEMENTS).alias("statements"))


def call_edges(nodes: DataFrame) -> DataFrame:
    """Calls of a file's own functions by name: the first definition wins, self calls and repeats are dropped."""
    fns = nodes.where("kind = 'FunctionDef'").groupBy("path", "name").agg(F.min("node_id").alias("callee"))
    calls = nodes.where("kind = 'Call' and owner_fn_id is not null").select("path", "name", F.col("owner_fn_id").alias("caller"))
    return calls.join(fns, ["path", "name"]).where("caller <> callee").select("path", "caller", "callee").distinct()


def imports(nodes: DataFrame) -> DataFrame:
    """``path, module, line``; an import of several modules gives a row each."""
    rows = nodes.where(F.col("kind").isin("import_statement", "import_from_statement"))
    return rows.select("path", F.explode(F.split("name", ",")).alias("module"), F.col("start_line").alias("line"))


def import_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """Absolute imports resolved to files: a module is its path with or without the package's own file."""
    key = lambda c: F.regexp_replace(F.regexp_replace(c, "\\.py$", ""), "/__init__$", "")
    targets = files.select(F.col("path").alias("dst"), key(F.col("path")).alias("module_path"))
    return found.withColumn("module_path", F.translate("module", ".", "/")).join(targets, "module_path").where("path <> dst").select(F.col("path").alias("src"), "dst").distinct()


def methods(nodes: DataFrame) -> DataFrame:
    """``path, cls, method, name`` of functions directly in a class."""
    m = nodes.where("kind = 'FunctionDef' and parent_kind = 'class_definition'")
    return m.select("path", F.col("parent_id").alias("cls"), F.col("node_id").alias("method"), "name")


def method_fields(nodes: DataFrame) -> DataFrame:
    """Own fields that each method touches."""
    own = nodes.where("kind = 'MemberAccess' and name rlike '^self[.][^.]+$' and owner_fn_id is not null")
    return own.select("path", F.col("owner_fn_id").alias("method"), F.substring_index("name", ".", -1).alias("field")).distinct().join(methods(nodes).drop("name"), ["path", "method"])


def wmc(nodes: DataFrame) -> DataFrame:
    """Weighted methods of a class: the sum of their complexities."""
    cc = function_complexity(nodes).select("path", F.col("fn").alias("method"), "cyclomatic")
    return methods(nodes).join(cc, ["path", "method"]).groupBy("path", "cls").agg(F.sum("cyclomatic").alias("wmc"), F.count("*").alias("methods"))


def lcom(nodes: DataFrame) -> DataFrame:
    """Groups of a class's methods connected by shared fields; constructors and methods without fields don't count."""
    mf = method_fields(nodes).join(methods(nodes).where("name = '__init__'").select("path", "method"), ["path", "method"], "left_anti").select("path", "cls", "method", "field")
    pairs = mf.select(F.to_json(F.struct("path", "cls", "method")).alias("a"), F.to_json(F.struct("path", "cls", "field")).alias("b"))
    group = equivalence(pairs)
    own = mf.select("path", "cls", F.to_json(F.struct("path", "cls", "method")).alias("node")).distinct()
    return own.join(group, "node").groupBy("path", "cls").agg(F.countDistinct("root").alias("lcom"))
