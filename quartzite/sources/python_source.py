"""Python sources as a relation of syntax nodes, by the standard library's parser.

Trees become rows with pre- and post-order numbers, so "inside" is an interval test; the nearest function, class and loop of a node,
whether it is in async code or in an except clause, and a few facts that need a look at children (``flags``) are columns, so that most rules
are plain filters. A file that doesn't parse gives one ERROR node. Columns are bytes from 1, as the relation demands.
"""

from __future__ import annotations

import ast
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.sources.shapes import frames, shapes

SCHEMA = (
    "path string, node_id int, post int, parent_id int, child_idx int, depth int, kind string, name string, text string, start_line int, start_col int, "
    "end_line int, end_col int, owner_fn_id int, owner_class_id int, owner_loop_id int, in_async boolean, in_except boolean, parent_kind string, flags array<string>"
)
#: Node kinds by the parser's class.
KINDS = {
    "Module": "SourceUnit", "FunctionDef": "FunctionDef", "AsyncFunctionDef": "FunctionDef", "ClassDef": "class_definition", "Call": "Call", "Name": "Identifier", "Attribute": "MemberAccess",
    "Assign": "Assignment", "AnnAssign": "Assignment", "AugAssign": "Assignment", "If": "if_statement", "For": "for_statement", "AsyncFor": "for_statement", "While": "while_statement",
    "Try": "try_statement", "ExceptHandler": "except_clause", "With": "with_statement", "AsyncWith": "with_statement", "Return": "return_statement", "Raise": "raise_statement",
    "Assert": "assert_statement", "Pass": "pass_statement", "Break": "break_statement", "Continue": "continue_statement", "Import": "import_statement", "ImportFrom": "import_from_statement",
    "Expr": "expression_statement", "Global": "global_statement", "Nonlocal": "nonlocal_statement", "BoolOp": "boolean_operator", "Compare": "comparison_operator", "IfExp": "conditional_expression",
    "Lambda": "lambda", "ListComp": "list_comprehension", "SetComp": "set_comprehension", "DictComp": "dictionary_comprehension", "GeneratorExp": "generator_expression", "JoinedStr": "formatted_string",
    "match_case": "case_clause", "Match": "match_statement", "withitem": "with_item", "arg": "parameter", "Delete": "delete_statement", "Yield": "yield", "Await": "await",
}
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_MUTABLE = (ast.List, ast.Dict, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp)
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_UNSEEN = (ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)
_LEAVES = frozenset((ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.alias))
_ARMS = ("orelse", "finalbody")
_NONE = (None,) * 10


def dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = dotted(node.value)
        return f"{base}.{node.attr}" if base else f"?.{node.attr}"
    return None


def _name(n: ast.AST) -> str | None:
    if isinstance(n, ast.Call):
        return dotted(n.func)
    if isinstance(n, ast.ExceptHandler):
        return None if n.type is None else ast.unparse(n.type)
    if isinstance(n, (ast.Name, ast.Attribute)):
        return dotted(n)
    if isinstance(n, ast.Assign):
        return dotted(n.targets[0])
    if isinstance(n, (ast.AnnAssign, ast.AugAssign)):
        return dotted(n.target)
    if isinstance(n, ast.ImportFrom):
        return "." * n.level + (n.module or "")
    if isinstance(n, ast.Import):
        return ",".join(a.name for a in n.names)
    if isinstance(n, ast.arg):
        return n.arg
    return getattr(n, "name", None)


def _flags(n: ast.AST) -> list[str]:
    out = []
    if isinstance(n, _FUNCTION):
        a = n.args
        if any(isinstance(x, _MUTABLE) or isinstance(x, ast.Call) and dotted(x.func) in ("list", "dict", "set") for x in [*a.defaults, *a.kw_defaults]):
            out.append("mutable_default")
        named = [x for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if x.arg not in ("self", "cls")]
        if n.returns is None or any(x.annotation is None for x in named):
            out.append("unannotated")
        if ast.get_docstring(n, clean=False) is None:
            out.append("undocumented")
        if isinstance(n.returns, ast.Constant) and n.returns.value is None and any(isinstance(x, ast.Return) and x.value is not None and not (isinstance(x.value, ast.Constant) and x.value.value is None) for x in ast.walk(n)):
            out.append("returns_value")
        if isinstance(n, ast.AsyncFunctionDef):
            out.append("async")
    if isinstance(n, ast.ExceptHandler) and all(isinstance(x, ast.Pass) for x in n.body):
        out.append("pass_only")
    if isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)) and len(n.generators) > 1:
        out.append("several_for")
    if isinstance(n, ast.For) and isinstance(n.target, ast.Name) and not n.target.id.startswith("_"):
        if not any(isinstance(x, ast.Name) and x.id == n.target.id for b in n.body for x in ast.walk(b)):
            out.append("unused_target")
    if isinstance(n, (ast.Assign, ast.AnnAssign)) and isinstance(n.value, _MUTABLE):
        out.append("mutable_value")
    if isinstance(n, ast.Compare):
        for op, x in zip(n.ops, n.comparators, strict=True):
            constant = isinstance(x, ast.Constant)
            if isinstance(op, (ast.Eq, ast.NotEq)) and constant and x.value is None:
                out.append("equals_none")
            if isinstance(op, (ast.Eq, ast.NotEq)) and constant and isinstance(x.value, bool):
                out.append("equals_bool")
            if isinstance(op, (ast.Is, ast.IsNot)) and constant and x.value is not None and not isinstance(x.value, bool) and x.value is not ...:
                out.append("is_literal")
        if isinstance(n.left, ast.Call) and dotted(n.left.func) == "type" and isinstance(n.ops[0], (ast.Eq, ast.NotEq)):
            out.append("compares_type")
    if isinstance(n, ast.Call):
        first = n.args[0] if n.args else None
        if isinstance(first, ast.JoinedStr) or isinstance(first, ast.BinOp) and isinstance(first.op, (ast.Mod, ast.Add)) or isinstance(first, ast.Call) and (dotted(first.func) or "").endswith(".format"):
            out.append("built_text")
        out += [f"kw:{k.arg}={ast.unparse(k.value)}" for k in n.keywords if k.arg]
    if isinstance(n, (ast.If, ast.While)) and isinstance(n.test, ast.Call) and dotted(n.test.func) == "len":
        out.append("tests_len")
    return out


def parse(path: str, content: str, columns: tuple[str, ...] | None = None, kinds: frozenset[str] | None = None, expressions: bool = True,
          text_kinds: frozenset[str] | None = None, flagged: frozenset[str] = frozenset()) -> list[tuple]:
    """The nodes of a file, numbered alike whatever is asked for: of ``kinds`` only, without expressions, with ``columns`` filled only, with
    text for ``text_kinds`` only, of the kinds ``flagged`` only those with flags."""
    try:
        return _rows(path, content, columns, kinds, expressions, text_kinds, flagged)[0]
    except (SyntaxError, ValueError, RecursionError) as e:
        line = getattr(e, "lineno", None) or 1
        return [(path, 0, 0, None, 0, 0, "ERROR", None, str(e)[:200], line, 1, line, 1, None, None, None, False, False, None, [])]


def _rows(path: str, content: str, columns: tuple[str, ...] | None, kinds: frozenset[str] | None, expressions: bool, text_kinds: frozenset[str] | None, flagged: frozenset[str]) -> tuple[list[tuple], int, ast.Module, set[int]]:
    """The nodes that are asked for, how many there are in all, the tree, and those without a place of their own, which stand from its first
    line to its last."""
    texts, flags = columns is None or "text" in columns, columns is None or "flags" in columns
    tree = ast.parse(content)
    lines = content.split("\n")
    rows: dict[int, list] = {}
    placeless: set[int] = set()

    def segment(a: int, b: int, c: int, d: int) -> str:
        if a == c and a <= len(lines) and lines[a - 1].isascii():
            return lines[a - 1][b:d]
        part = lines[a - 1 : c]
        if not part:
            return ""
        part[-1] = part[-1].encode()[:d].decode("utf-8", "replace")
        part[0] = part[0].encode()[b:].decode("utf-8", "replace") if a != c else part[0].encode()[b:d].decode("utf-8", "replace")
        return "\n".join(part)

    post = met = 0
    stack: list[tuple] = [(tree, None, 0, 0, None, None, None, False, False, None, None)]
    while stack:  # children are pushed in reverse, a marker closes a node
        node, parent, index, depth, fn, cls, loop, in_async, in_except, above, part = stack.pop()
        if isinstance(node, int):
            if node in rows:
                rows[node][2] = post
            post += 1
            continue
        me, met = met, met + 1
        what = type(node)
        kind = "StringLiteral" if what is ast.Constant and isinstance(node.value, str) else KINDS.get(what.__name__, what.__name__)
        if (kinds is None or kind in kinds) and (expressions or not isinstance(node, ast.expr)):
            if not hasattr(node, "lineno"):
                placeless.add(me)
            at = (getattr(node, "lineno", 1), getattr(node, "col_offset", 0), getattr(node, "end_lineno", len(lines)) or 1, getattr(node, "end_col_offset", 0) or 0)
            text = segment(*at) if texts and (text_kinds is None or kind in text_kinds) and hasattr(node, "lineno") else ""
            name = node.value if kind == "StringLiteral" else _name(node)
            own = (_flags(node) + ([f"in:{part}"] if part else [])) if flags else []
            if own or kind not in flagged:
                rows[me] = [path, me, 0, parent, index, depth, kind, name, text, at[0], at[1] + 1, at[2], at[3] + 1, fn, cls, loop, in_async, in_except, above, own]
        if what in _LEAVES:
            if me in rows:
                rows[me][2] = post
            post += 1
            continue
        stack.append((me, *_NONE))
        if isinstance(node, _FUNCTION):
            fn, loop, in_async, in_except = me, None, isinstance(node, ast.AsyncFunctionDef), False
        elif isinstance(node, ast.ClassDef):
            cls = me
        elif isinstance(node, _LOOPS):
            loop = me
        elif isinstance(node, ast.ExceptHandler):
            in_except = True
        children: list[tuple] = []
        for field in what._fields:
            value = getattr(node, field, None)
            if isinstance(value, list):
                arm = field if field in _ARMS else None
                children += [(c, arm) for c in value if isinstance(c, ast.AST) and not isinstance(c, _UNSEEN)]
            elif isinstance(value, ast.AST) and not isinstance(value, _UNSEEN):
                children.append((value, None))
        for i in range(len(children) - 1, -1, -1):
            stack.append((children[i][0], me, i, depth + 1, fn, cls, loop, in_async, in_except, kind, children[i][1]))
    return [tuple(r) for r in rows.values()], met, tree, placeless


FIELDS = [tuple(c.split()) for c in SCHEMA.split(", ")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_NODES, _LINES = ("node_id", "parent_id", "owner_fn_id", "owner_class_id", "owner_loop_id"), ("start_line", "end_line")
_STARTS = "(?<=\n)(?={0}[A-Za-z_@])(?!{0}(?:else|elif|except|finally)\\b)"
_WHOLE = re.compile("\"\"\"|'''|\r|barry_as_FLUFL")
_DEFINES = re.compile(r"^ *(?:async|def|class)\b", re.MULTILINE)
_HEADER = re.compile(r"(async )?def \w+\([^\n#]*\):\n")
_INDENT = re.compile(r"\n*( +)[^ \n#]")
_NUMBER = re.compile(r"(?<!\w)\d\w*\.[A-Za-z_]")
_starts: dict[int, re.Pattern] = {}
FILE, HEADER, BODY, ASYNC = "", " pass", "def f():\n", "async def f():\n"  # where a part stands, by what makes it a program


def odd(text: str) -> bool:
    """Whether a numbered name may be something else there: part of a string, or of a number such as 1.e5."""
    return '"' in text or "'" in text or "\\" in text or "." in text and _NUMBER.search(text) is not None


def _cut(text: str, indent: int) -> list[str]:
    """Before each line with that indent that begins with a word, but not between a decorator and what it stands before."""
    if indent not in _starts:
        _starts[indent] = re.compile(_STARTS.format(" " * indent))
    parts: list[str] = []
    for part in _starts[indent].split(text):
        if parts and parts[-1][indent : indent + 1] == "@" and not _DEFINES.search(parts[-1]):
            parts[-1] += part
        else:
            parts.append(part)
    return parts


def statements(content: str) -> list[tuple[str, str]]:
    """A file cut into parts and where they stand: its statements, and of plain functions the header and the statements. If each part is a
    program there, the file is one after the other; if not, a statement goes over several parts, and the file has to be read whole."""
    if not content.isascii() or _WHOLE.search(content):
        return [(content, FILE)]
    parts: list[tuple[str, str]] = []
    for part in _cut(content, 0):
        header = _HEADER.match(part)
        indent = header and not odd(part) and "\t" not in part and "\f" not in part and _INDENT.match(part, header.end())
        if indent:
            parts.append((header.group(), HEADER))
            parts += [(x, ASYNC if header.group(1) else BODY) for x in _cut(part[header.end() :], len(indent.group(1)))]
        else:
            parts.append((part, FILE))
    return parts


def _unit(post: int, last: int) -> tuple:
    """A file's own node."""
    return ("", 0, post, None, 0, 0, "SourceUnit", None, "", 1, 1, last, 1, None, None, None, False, False, None, [])


class Reader:
    """The columns but the path of a file's nodes, the same as from ``parse``; parts of one shape are parsed once. ``counted``: nodes that
    are alike in all columns come once, with how many there are; owners are 0 where there are any."""

    def __init__(self, columns: tuple[str, ...] | None, kinds: frozenset[str] | None, expressions: bool = True, text_kinds: frozenset[str] | None = None, flagged: frozenset[str] = frozenset(), counted: bool = False) -> None:
        self.asked = columns, kinds, expressions, text_kinds, flagged
        place = {name: i for i, (name, _) in enumerate(FIELDS)}
        self.names = [c for c in columns or place if c != "path"]
        self.chosen = [place[c] for c in self.names]
        self.unit, self.defines = (kinds is None or k in kinds for k in ("SourceUnit", "FunctionDef"))
        self.shifted = ["node" if c in _NODES else "line" if c in _LINES else c if c in ("post", "child_idx") else "" for c in self.names]
        self.texts = "text" in self.names and self.defines and (text_kinds is None or "FunctionDef" in text_kinds)
        self.counted = counted
        if counted and (self.texts or set(self.names) & {"node_id", "post", "parent_id", "child_idx", "start_line", "start_col", "end_line", "end_col"}):
            raise ValueError("nodes that are counted have no numbers, no places and no texts of functions")
        self.known = {where: shapes(("python", where, counted, *self.asked), lambda text, where=where: self._part(text, where), odd) for where in (FILE, HEADER, BODY, ASYNC)}

    def columns(self, content: str | None) -> list[list]:
        parts = statements(content or "")
        if len(parts) > 1:
            try:
                if self.counted:
                    return self._counts([(self.known[where].columns(text), k) for (text, where), k in Counter(parts).items()])
                return self._joined(parts, [self.known[where].columns(text) for text, where in parts])
            except (SyntaxError, ValueError, RecursionError):
                pass
        rows = parse("", content or "", *self.asked)
        return self._counts([(self._columns(rows), 1)], True) if self.counted else self._columns(rows)

    def _columns(self, rows: list) -> list[list]:
        if self.counted:
            return [[tuple(r[i]) if name == "flags" else r[i] and 0 if name in _NODES else r[i] for r in rows] for i, name in zip(self.chosen, self.names, strict=True)]
        return [[r[i] for r in rows] for i in self.chosen]

    def _counts(self, parts: list[tuple[list[list], int]], whole: bool = False) -> list[list]:
        n: dict[tuple, int] = {}
        width = len(self.names)
        for part, k in parts:
            for row in zip(*part[:width], strict=True):
                n[row] = n.get(row, 0) + k
        if self.unit and not whole:
            n.update(zip(zip(*self._columns([_unit(0, 0)]), strict=True), [1], strict=True))
        return [*(list(c) for c in zip(*n, strict=True)), list(n.values())] if n else [[] for _ in range(width + 1)]

    def _part(self, text: str, where: str) -> list[list]:
        """Columns of a part's nodes, numbered from 1 where 0 is what holds it; then how many nodes and statements there are and where the last
        ends, and which rows are statements and which have no place."""
        program = text[:-1] + where + "\n" if where == HEADER else where + text
        found, met, tree, placeless = _rows("", program, *self.asked)
        rows = [list(r) for r in found if r[1]]  # without the file's own node
        n, end = len(tree.body), [0, 0]
        if where != FILE:
            only = tree.body[0] if n == 1 else None
            if not isinstance(only, _FUNCTION) or only.returns or where == HEADER and not (len(only.body) == 1 and isinstance(only.body[0], ast.Pass) and not getattr(only, "type_params", None)):
                raise ValueError("not a part of a function")
            if where == HEADER:
                met, rows = met - 1, [r for r in rows if r[6] != "pass_statement"]
            else:  # without the function that it was put into, and that one's arguments
                rows, met, n, end = [r for r in rows if r[1] > 2], met - 2, len(only.body), [only.end_lineno - 1, only.end_col_offset + 1]
                for r in rows:
                    r[1], r[2], r[9], r[11] = r[1] - 2, r[2] - 1, r[9] - 1, r[11] - 1
                    r[3], r[13], r[14], r[15] = (None if v is None else max(0, v - 2) for v in (r[3], r[13], r[14], r[15]))
                placeless = {x - 2 for x in placeless}
        return [*self._columns(rows), [met - 1, n, *end], [k for k, r in enumerate(rows) if r[3] == 0], [k for k, r in enumerate(rows) if r[1] in placeless]]

    def _joined(self, texts: list[tuple[str, str]], parts: list[list[list]]) -> list[list]:
        out: list[list] = [[] for _ in self.names]
        nodes = posts = lines = children = 0  # so far
        fn = inner = begun = at = 0  # the open function: its number, its children, the line before it, its row
        end, held = [0, 0], []
        last = 1 + sum(text.count("\n") for text, _ in texts)
        for (text, where), (*own, (met, n, *until), top, placeless) in zip([*texts, ("", FILE)], [*parts, [*([] for _ in out), [0, 0, 0, 0], [], []]], strict=True):
            inside = where in (BODY, ASYNC)
            if fn and not inside:
                if self.defines:
                    closed = {"post": posts, "end_line": begun + end[0], "end_col": end[1]}
                    if self.texts:
                        whole = "".join(held).split("\n")[: end[0]]
                        closed["text"] = "\n".join([*whole[:-1], whole[-1][: end[1] - 1]])
                    for name, value in closed.items():
                        if name in self.names:
                            out[self.names.index(name)][at] = value
                posts, fn = posts + 1, 0
            if where == HEADER:
                fn, inner, begun, at, held = nodes + 1, 1, lines, len(out[0]), []
            holder = fn if inside else 0
            for column, name, by, values in zip(out, self.names, self.shifted, own, strict=True):
                if by == "node":
                    if nodes or inside:
                        values = [v + nodes if v else v if v is None else holder for v in values]
                elif by == "post":
                    values = [v + posts for v in values]
                elif by == "line":
                    values = [v + lines for v in values]
                    for k in placeless:
                        values[k] = 1 if name == "start_line" else last
                elif by:
                    values = values.copy()
                    for k in top:
                        values[k] += inner - 1 if inside else children
                column += values
            if inside:
                inner, end = inner + n, [lines - begun + until[0], until[1]]
            else:
                children += n
            if fn:
                held.append(text)
            nodes, posts, lines = nodes + met, posts + met - (where == HEADER), lines + text.count("\n")
        if self.unit:
            row = _unit(nodes, last)
            out = [[row[i], *column] for i, column in zip(self.chosen, out, strict=True)]
        return out


def fields_of(columns: tuple[str, ...] | None) -> list[tuple[str, pa.DataType]]:
    kinds = dict(FIELDS)
    return [(c, _TYPES[kinds[c]]) for c in columns or kinds]


def schema_of(columns: tuple[str, ...] | None) -> str:
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    return ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)


def dealt(files: DataFrame) -> DataFrame:
    """Files over as many tasks as a shuffle has: parsing takes far longer than its few bytes tell the adaptive planner, which would join tasks."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def nodes(files: DataFrame, path: str = "path", content: str = "content", columns: tuple[str, ...] | None = None, kinds: tuple[str, ...] | None = None, expressions: bool = True,
          text_kinds: tuple[str, ...] | None = None, flagged: tuple[str, ...] = (), deal: bool = True, counted: bool = False) -> DataFrame:
    """``ast_node`` rows of every file; a null content is an empty file. Where a query needs only some ``columns`` or ``kinds``, no expressions,
    text of ``text_kinds`` only, or of the kinds ``flagged`` only nodes with flags, the others are not made; numbers and owners are those of the whole tree, and a file that doesn't parse keeps
    its ERROR. ``counted``: nodes of a file that are alike in the columns come once, ``n`` tells how many there are, and owners are 0 where there are any. ``deal``: not needed where the files are dealt over all tasks as they come."""
    source = files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content"))
    only, having = (None if k is None else frozenset(k) for k in (kinds, text_kinds))
    fields, schema = fields_of(columns), schema_of(columns)
    if counted:
        fields, schema = [*fields, ("n", pa.int64())], schema + ", n long"
    read = lambda batches: frames(batches, Reader(columns, only, expressions, having, frozenset(flagged), counted).columns, fields)
    return (dealt(source) if deal else source).mapInArrow(read, schema)
