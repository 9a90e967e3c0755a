"""Sources of brace and keyword languages as the relation of syntax nodes that ``python_source`` gives for Python, by one shared tokeniser.

A language is a row of facts: its comments, quotes, keywords and how its blocks open and close. Tokens become nodes of the neutral kinds (functions,
classes, calls, member accesses, assignments, declarations, comments, strings) and of control flow; a block belongs to the statement that
opened it. No grammar is needed, so a file with errors still yields its nodes: unclosed blocks end with the file, stray closers are skipped.

Defined results: a null content is an empty file; an unknown language gives the file's node alone; columns are characters from 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.sources.python_source import FIELDS, dealt, fields_of, schema_of
from quartzite.sources.shapes import frames, shapes

_C = r"//[^\n]*|/\*.*?\*/"
_HASH = r"\#[^\n]*"
_DOUBLE, _SINGLE, _BACK = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'", r"`(?:[^`\\]|\\.)*`"
_TRIPLE = r'"""(?:[^\\]|\\.)*?"""'
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'"


@dataclass(frozen=True)
class Language:
    """``blocks``: braces, or words that open and close. ``functions``: words that begin one; ``bare``: a name with parameters and a block is
    one too. Words map to kinds by ``words``."""

    comments: str
    strings: tuple[str, ...]
    functions: tuple[str, ...] = ()
    bare: bool = False
    classes: dict[str, str] = field(default_factory=dict)
    words: dict[str, str] = field(default_factory=dict)
    declares: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    closes: tuple[str, ...] = ()
    opens: tuple[str, ...] = ()
    arrows: str = ""
    newline_ends: bool = True
    assigns: tuple[str, ...] = ("=", "+=", "-=", "*=", "/=", "%=", ":=", "??=", "||=", "&&=", "|=", "&=", "^=")
    tests: tuple[str, ...] = ("&&", "||")


_CONTROL = {
    "if": "if_statement", "for": "for_statement", "foreach": "for_statement", "while": "while_statement", "switch": "switch_statement", "case": "switch_case", "default": "switch_default",
    "catch": "catch_clause", "try": "try_statement", "return": "return_statement", "throw": "throw_statement", "break": "break_statement", "continue": "continue_statement", "do": "do_statement",
}
_TYPES = {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_item", "struct": "struct_item", "record": "class_declaration", "trait": "trait_item", "namespace": "namespace", "object": "class_declaration", "protocol": "interface_declaration", "extension": "class_declaration", "union": "struct_item", "module": "namespace"}
_some = lambda *names: {n: _TYPES[n] for n in names}
_JVM = dict(comments=_C, strings=(_TRIPLE, _DOUBLE, _CHAR), words=_CONTROL)
LANGUAGES = {
    "typescript": Language(_C, (_DOUBLE, _SINGLE, _BACK), ("function",), True, _some("class", "interface", "enum", "namespace"), _CONTROL | {"await": "await_expression", "yield": "yield"}, ("const", "let", "var"), ("import",), arrows="=>"),
    "rust": Language(_C, (r'r(#*)".*?"\1', _DOUBLE, _CHAR), ("fn",), False, _some("struct", "enum", "trait", "union") | {"impl": "impl_item", "mod": "mod_item"}, {"if": "if_statement", "for": "for_statement", "while": "while_statement", "loop": "loop_expression", "match": "match_statement", "return": "return_statement", "break": "break_statement", "continue": "continue_statement", "unsafe": "unsafe_block", "await": "await_expression"}, ("let", "static", "const"), ("use",), arrows="=>"),
    "go": Language(_C, (_BACK, _DOUBLE, _CHAR), ("func",), False, {}, {"if": "if_statement", "for": "for_statement", "switch": "switch_statement", "select": "switch_statement", "case": "switch_case", "default": "switch_default", "return": "return_statement", "break": "break_statement", "continue": "continue_statement", "defer": "defer_statement", "go": "go_statement"}, ("var", "const"), ("import",)),
    "java": Language(bare=True, classes=_some("class", "interface", "enum", "record"), imports=("import",), **_JVM),
    "csharp": Language(bare=True, classes=_some("class", "interface", "enum", "struct", "record", "namespace"), imports=("using",), declares=("var",), **_JVM),
    "kotlin": Language(functions=("fun",), classes=_some("class", "interface", "object"), imports=("import",), declares=("val", "var"), **(_JVM | {"words": _CONTROL | {"when": "match_statement"}}), arrows="->"),
    "scala": Language(functions=("def",), classes=_some("class", "object", "trait"), imports=("import",), declares=("val", "var"), **(_JVM | {"words": _CONTROL | {"match": "match_statement"}})),
    "groovy": Language(functions=(), bare=True, classes=_some("class", "interface", "enum", "trait"), imports=("import",), declares=("def",), **(_JVM | {"strings": (_TRIPLE, _DOUBLE, _SINGLE)})),
    "swift": Language(functions=("func", "init"), classes=_some("class", "struct", "enum", "protocol", "extension"), imports=("import",), declares=("let", "var"), **(_JVM | {"strings": (_TRIPLE, _DOUBLE), "words": _CONTROL | {"guard": "if_statement", "repeat": "repeat_statement"}})),
    "c": Language(_C, (_DOUBLE, _CHAR), (), True, _some("struct", "enum", "union"), _CONTROL, (), (), newline_ends=False),
    "cpp": Language(_C, (_DOUBLE, _CHAR), (), True, _some("class", "struct", "enum", "union", "namespace"), _CONTROL, ("auto",), (), newline_ends=False),
    "php": Language(_C + "|" + _HASH, (_DOUBLE, _SINGLE), ("function", "fn"), False, _some("class", "interface", "trait", "enum"), _CONTROL | {"elseif": "if_statement"}, (), ("use", "require", "require_once", "include", "include_once"), tests=("&&", "||", "and", "or")),
    "bash": Language(r"(?:(?<=\s)|^)\#[^\n]*", (_DOUBLE, r"'[^']*'"), ("function",), True, {}, {"if": "if_statement", "elif": "elif_clause", "for": "for_statement", "while": "while_statement", "until": "while_statement", "case": "switch_statement", "return": "return_statement"}, ("local", "declare", "export"), ("source",), closes=("fi", "done", "esac"), opens=("if", "for", "while", "until", "case")),
    "lua": Language(r"--\[\[.*?\]\]|--[^\n]*", (_DOUBLE, _SINGLE, r"\[\[.*?\]\]"), ("function",), False, {}, {"if": "if_statement", "elseif": "elif_clause", "for": "for_statement", "while": "while_statement", "repeat": "repeat_statement", "return": "return_statement", "break": "break_statement"}, ("local",), ("require",), closes=("end", "until"), opens=("function", "if", "for", "while", "repeat"), tests=("and", "or")),
    "ruby": Language(_HASH, (_DOUBLE, _SINGLE), ("def",), False, _some("class", "module"), {"if": "if_statement", "unless": "if_statement", "elsif": "elif_clause", "for": "for_statement", "while": "while_statement", "until": "while_statement", "case": "switch_statement", "when": "switch_case", "begin": "try_statement", "rescue": "except_clause", "return": "return_statement"}, (), ("require", "require_relative"), closes=("end",), opens=("def", "class", "module", "if", "unless", "for", "while", "until", "case", "begin", "do"), tests=("&&", "||", "and", "or")),
    "elixir": Language(_HASH, (_TRIPLE, _DOUBLE, _SINGLE), ("def", "defp", "defmacro"), False, {"defmodule": "class_declaration"}, {"if": "if_statement", "unless": "if_statement", "case": "switch_statement", "cond": "switch_statement", "for": "for_statement", "try": "try_statement", "rescue": "except_clause"}, (), ("import", "alias", "use", "require"), closes=("end",), opens=("do",), tests=("&&", "||", "and", "or")),
    "hcl": Language(_HASH + "|" + _C, (_DOUBLE,), ("resource", "module", "data", "variable", "output", "provider"), False, {}, {"for": "for_statement"}),
    "css": Language(r"/\*.*?\*/", (_DOUBLE, _SINGLE), (), False, {}, {}),
    "dockerfile": Language(_HASH, (_DOUBLE, _SINGLE), (), False, {}, {}),
}
_STAY = {"if_statement", "elif_clause", "switch_case", "switch_default", "return_statement", "throw_statement", "break_statement", "continue_statement", "await_expression", "yield", "defer_statement", "go_statement"}
_LOOPS = {"for_statement", "while_statement", "loop_expression", "repeat_statement", "do_statement"}
_OWN_WORDS = {"else", "in", "of", "new", "then", "do", "fi", "done", "esac", "end", "not", "is", "as", "when", "where", "async", "public", "private", "static", "protected", "export", "pub", "final", "override", "extends", "implements", "with", "typeof", "delete", "void"}
_BASH_STARTS = {"then", "do", "else", "&&", "||", "|"}
_scanners: dict[str, re.Pattern] = {}


def scanner(language: str) -> re.Pattern:
    """Tokens of a language: comments, strings, words, numbers, operators, line ends."""
    if language not in _scanners:
        own = LANGUAGES[language]
        name = r"[A-Za-z_$@][\w$]*" if language != "css" else r"[.\#@]?[A-Za-z_][\w-]*"
        if language == "php":
            name = r"\$*[A-Za-z_]\w*"
        if language in ("rust",):
            name = r"[A-Za-z_]\w*!?(?=[({\[])|[A-Za-z_]\w*"
        parts = [f"(?P<comment>{own.comments})", f"(?P<string>{'|'.join(own.strings)})".replace(r"\1", r"(?P=hashes)").replace("r(#*)", "r(?P<hashes>#*)"), f"(?P<word>{name})", r"(?P<number>\d[\w.]*)",
                 r"(?P<op>=>|->|===|!==|==|!=|<=|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\.|\?\?|::|:=|\+=|-=|\*=|/=|%=|\|=|&=|\^=|\+\+|--|\.\.\.|\S)", r"(?P<line>\n)"]
        _scanners[language] = re.compile("|".join(parts), re.DOTALL | re.MULTILINE)
    return _scanners[language]


def tokens(language: str, content: str) -> list[tuple[str, str, int, int]]:
    """(class, text, line, column) of every token but white space."""
    out, line, start = [], 1, 0
    for m in scanner(language).finditer(content):
        kind, text = m.lastgroup, m.group()
        if kind == "hashes":
            kind = "string"
        out.append((kind, text, line, m.start() - start + 1))
        n = text.count("\n")
        if n:
            line += n
            start = m.start() + text.rfind("\n") + 1
    return out


class _Tree:
    def __init__(self, path: str):
        self.path, self.rows, self.post = path, [], 0
        self.children: dict[int, int] = {}

    def add(self, kind: str, name: str | None, text: str, line: int, col: int, scope: list) -> int:
        """A node in the innermost open block."""
        me = len(self.rows)
        parent = scope[-1][0] if scope else None
        owner = lambda kinds: next((s[0] for s in reversed(scope) if self.rows[s[0]][6] in kinds), None)
        fn = owner({"FunctionDef"})
        inside = next((s[0] for s in reversed(scope) if self.rows[s[0]][6] in _LOOPS | {"FunctionDef"}), None)
        loop = inside if inside is not None and self.rows[inside][6] in _LOOPS else None
        index = self.children.get(parent, 0)
        self.children[parent] = index + 1
        caught = any(self.rows[s[0]][6] in ("catch_clause", "except_clause") for s in scope)
        is_async = fn is not None and "async" in self.rows[fn][19]
        end_line, end_col = line + text.count("\n"), col + len(text) if "\n" not in text else len(text) - text.rfind("\n")
        cls = owner({"class_declaration", "struct_item", "interface_declaration", "trait_item", "enum_item", "impl_item"})
        self.rows.append([self.path, me, -1, parent, index, len(scope), kind, name, text, line, col, end_line, end_col, fn, cls, loop, is_async, caught, self.rows[parent][6] if parent is not None else None, []])
        return me

    def close(self, node: int, line: int, col: int) -> None:
        row = self.rows[node]
        row[11], row[12] = line, col


def parse(path: str, language: str, content: str) -> list[tuple]:
    """The nodes of one file in order of their start."""
    tree = _Tree(path)
    last = content.count("\n") + 1
    root = tree.add("SourceUnit", None, "", 1, 1, [])
    tree.close(root, last, 1)
    own = LANGUAGES.get(language)
    if own is None:
        return _finish(tree)
    all_tokens = tokens(language, content)
    code = [t for t in all_tokens if t[0] != "comment"]
    scope: list[tuple[int, str]] = [(root, "")]
    pending: tuple[int, int, str] | None = None  # a statement that waits for its block, the depth of brackets there, its kind
    brackets: list[tuple[str, int]] = []  # open brackets and where they are among the code tokens
    ends: dict[int, int] = {}  # of a closed bracket, where it was opened
    modifiers: set[str] = set()
    fresh = True  # a statement begins here
    i, n, receiver = 0, len(code), -1
    for kind, text, line, col in all_tokens:
        if kind == "comment":
            tree.add("Comment", None, text, line, col, scope)
            continue
        nxt = next((t for t in code[i + 1 : i + 3] if t[0] != "line"), ("", "", 0, 0))
        prev = code[i - 1] if i else ("line", "\n", 0, 0)
        named = i > 1 and code[i - 2][0] == "word"  # whether a member operator before the token joins it to a name
        i += 1
        if kind == "line":
            if own.newline_ends and pending and len(brackets) == pending[1] and nxt[1] != "{" and not own.opens and pending[2] in ("FunctionDef", "mod_item"):
                pending = None
            fresh = True
            continue
        if kind == "string":
            tree.add("StringLiteral", text.strip("\"'`"), text, line, col, scope)
        elif kind == "word":
            if language == "bash" and (fresh or prev[1] in _BASH_STARTS) and not text.startswith("$") and nxt[1] not in ("=", "(", ")") and text not in own.words and text not in _OWN_WORDS and text not in own.declares and text not in own.imports and text not in own.functions:
                tree.add("Call", text, text, line, col, scope)
                fresh = False
                continue
            name = None
            if text == "func" and nxt[1] == "(" and language == "go":  # a receiver stands before the name
                close = next((k for k in range(i, min(n, i + 24)) if code[k][1] == ")"), n)
                name = code[close + 1][1] if close + 1 < n and code[close + 1][0] == "word" and close + 2 < n and code[close + 2][1] == "(" else None
                receiver = close + 1 if name else receiver
            if i - 1 == receiver and language == "go":
                fresh = False
                continue
            _word(tree, own, language, (text, line, col), prev, nxt, scope, modifiers, fresh, named)
            if name:
                tree.rows[-1][7] = name
            at = len(tree.rows) - 1
            made = tree.rows[at][6] if tree.rows[at][9] == line and tree.rows[at][10] == col else None
            if text in own.functions and made == "FunctionDef" or made in own.classes.values() or made in own.words.values() and made not in _STAY - {"if_statement", "elif_clause"}:
                pending = (at, len(brackets), made)
            if text in own.closes:
                _shut(tree, scope, "word", line, col + len(text))
                pending = None
            elif text in own.opens and (language != "ruby" or text not in ("if", "unless", "while", "until") or fresh or prev[1] in ("=", "(")):
                if text == "do" and scope[-1][1] == "word" and pending is None and language == "ruby" and tree.rows[scope[-1][0]][6] in _LOOPS and tree.rows[scope[-1][0]][9] == line:
                    pass  # the do of a loop opens nothing of its own
                elif text != "do" or pending is None or language == "elixir":
                    node = pending[0] if pending else root if not tree.rows else at
                    scope.append((node, "word"))
                    pending = None
        elif text in "([{" and text:
            brackets.append((text, i - 1))
            if text == "{":
                node = None
                if pending and len(brackets) - 1 <= pending[1]:
                    node, pending = pending[0], None
                elif own.bare and language != "bash" or own.bare and prev[1] == ")":
                    node = _bare(tree, language, code, i - 1, ends, scope)
                if node is None and own.arrows and prev[1] == own.arrows:
                    node = _last_arrow(tree, prev[2])
                scope.append((scope[-1][0] if node is None else node, "{"))
        elif text in ")]}" and text:
            opened = {")": "(", "]": "[", "}": "{"}[text]
            if any(b == opened for b, _ in brackets):
                while brackets:
                    b, where = brackets.pop()
                    if b == "{":
                        _shut(tree, scope, "{", line, col + 1)
                    if b == opened:
                        ends[i - 1] = where
                        break
        elif text == own.arrows and language == "typescript":
            me = tree.add("FunctionDef", _arrow_name(code, i - 1, ends), "=>", line, col, scope)
            tree.rows[me][19].append("arrow")
            if "async" in modifiers:
                tree.rows[me][19].append("async")
                modifiers.discard("async")
        elif text == own.arrows and scope and tree.rows[scope[-1][0]][6] == "match_statement":
            tree.add("match_arm", None, text, line, col, scope)
        elif text in own.tests:
            tree.add("boolean_operator", text, text, line, col, scope)
        elif text in own.assigns:
            tree.add("Assignment", _dotted(code, i - 2), text, line, col, scope)
        elif text == "?" and language in ("typescript", "java", "csharp", "c", "cpp", "php", "groovy") and nxt[1] not in (":", ".", ",", ")", ">", ";", "=", "php"):
            tree.add("conditional_expression", None, text, line, col, scope)
        elif text == ";":
            if pending and len(brackets) <= pending[1]:
                pending = None
            modifiers.clear()
        if text in own.tests and kind == "word":
            tree.add("boolean_operator", text, text, line, col, scope)
        fresh = text in (";", "{", "}")
        if fresh:
            modifiers.clear()
    while len(scope) > 1:
        _shut(tree, scope, scope[-1][1], last, 1)
    return _finish(tree)


def _last_arrow(tree: _Tree, line: int) -> int | None:
    return next((r[1] for r in reversed(tree.rows) if r[6] == "FunctionDef" and "arrow" in r[19] and r[9] == line), None)


def _shut(tree: _Tree, scope: list, how: str, line: int, col: int) -> None:
    """Close the innermost block that was opened this way, and what is still open within it."""
    if not any(s[1] == how for s in scope[1:]):
        return
    while True:
        node, was = scope.pop()
        if node:
            tree.close(node, line, col)
        if was == how:
            return


def _dotted(code: list, at: int) -> str | None:
    """The name that ends at a token: words joined by member operators."""
    parts: list[str] = []
    while at >= 0 and code[at][0] == "word":
        parts.append(code[at][1])
        if at >= 2 and code[at - 1][1] in (".", "::", "->", "?.") and code[at - 2][0] == "word":
            parts.append({"?.": "."}.get(code[at - 1][1], code[at - 1][1]))
            at -= 2
        else:
            break
    return "".join(reversed(parts)) or None


def _arrow_name(code: list, at: int, ends: dict[int, int]) -> str | None:
    """What an arrow function is assigned to: the name before ``=`` or ``:`` and its parameters."""
    start = ends.get(at - 1, at - 1)
    if start >= 1 and code[start - 1][1] == "async":
        start -= 1
    if start >= 2 and code[start - 1][1] in ("=", ":") and code[start - 2][0] == "word":
        return code[start - 2][1]
    return None


_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "foreach", "using", "lock", "synchronized", "elseif", "new", "function", "when", "match", "with", "super", "this"}
_AFTER_PARAMETERS = {"throws", "const", "noexcept", "override", "final", "where", "async", "abstract", "virtual"}


def _bare(tree: _Tree, language: str, code: list, at: int, ends: dict[int, int], scope: list) -> int | None:
    """A function without a keyword whose block opens at ``at``: a name, its parameters, perhaps a return type or modifiers."""
    k = at - 1
    while k >= 0 and (code[k][0] in ("word", "line") or code[k][1] in (",", ".", ":", "<", ">", "[", "]", "|", "&", "?", "::", "*", "->")) and k > at - 24:
        k -= 1
    if k < 0 or code[k][1] != ")" or k not in ends:
        return None
    between = [t[1] for t in code[k + 1 : at] if t[0] != "line"]
    if between and not (between[0] in _AFTER_PARAMETERS or between[0] in (":", "->")):
        return None
    name = ends[k] - 1
    if name < 0 or code[name][0] != "word" or code[name][1] in _NOT_NAMES:
        return None
    before = code[name - 1][1] if name else ""
    if before in (".", "new", "=", "(", ",", "return", "::") and language not in ("cpp",):
        return None
    # the name stood as a call until its block opened
    for row in reversed(tree.rows):
        if row[6] == "Call" and row[9] == code[name][2] and row[10] == code[name][3]:
            row[6], row[7] = "FunctionDef", code[name][1]
            line = [t[1] for t in code[max(0, name - 8) : name]]
            row[19] += [w for w in ("async", "static", "public", "private", "override", "abstract") if w in line[line.index("}") + 1 if "}" in line else 0 :]]
            return row[1]
    return None


def _word(tree: _Tree, own: Language, language: str, token: tuple[str, int, int], prev: tuple, nxt: tuple, scope: list, modifiers: set[str], fresh: bool, named: bool) -> None:
    text, line, col = token
    add = lambda kind, name=None: tree.add(kind, name, text, line, col, scope)
    member = prev[1] in (".", "::", "->", "?.")
    if not member and text in own.imports and (fresh or prev[0] == "line"):
        add("import_statement")
    elif not member and text in own.functions and (nxt[0] in ("word", "string") or nxt[1] in ("(", "*", "&")):
        name = nxt[1].strip("\"'") if nxt[0] in ("word", "string") else None
        me = add("FunctionDef", name)
        tree.rows[me][19] += sorted(modifiers & {"async", "pub", "unsafe", "public", "private", "static", "export", "local", "const"})
        modifiers.clear()
    elif not member and text in own.classes and nxt[0] in ("word", "") or text == "impl" and text in own.classes:
        me = add(own.classes[text], nxt[1] if nxt[0] == "word" else None)
        tree.rows[me][19] += sorted(modifiers & {"pub", "public", "unsafe", "abstract", "export"})
        modifiers.clear()
    elif (not member or text == "await") and text in own.words and not (text == "default" and nxt[1] != ":" and language != "go") and not (text == "unsafe" and nxt[1] != "{"):
        if text in ("while",) and prev[1] == "}" and scope and tree.rows[scope[-1][0]][6] == "do_statement":
            return
        add(own.words[text])
    elif not member and text in own.declares and nxt[1] not in own.functions:
        add("VariableDecl", nxt[1] if nxt[0] == "word" else None)
    elif text in _OWN_WORDS:
        modifiers.add(text)
    elif nxt[1] == "(" or language == "rust" and text.endswith("!"):
        if prev[1] in own.functions:
            return
        add("Call", _chain(tree, text, prev, line, named))
    elif member:
        add("MemberAccess", _chain(tree, text, prev, line, named))
    elif prev[1] not in own.functions and prev[1] not in own.classes and prev[1] not in own.declares:
        add("Identifier", text)
    if text in ("unsafe", "pub", "abstract"):
        modifiers.add(text)


def _chain(tree: _Tree, text: str, prev: tuple, line: int, named: bool) -> str:
    """The dotted name of a member: what stands before it, joined."""
    if prev[1] not in (".", "::", "->", "?.") or not tree.rows:
        return text
    base = tree.rows[-1]
    if named and base[6] in ("Identifier", "MemberAccess") and base[9] >= line - 1 and base[7]:
        return f"{base[7]}{'.' if prev[1] == '?.' else prev[1]}{text}"
    return f"?{'.' if prev[1] == '?.' else prev[1]}{text}"


def _finish(tree: _Tree) -> list[tuple]:
    """Post-order numbers from the parents, children before their parent in order."""
    below: dict[int | None, list[int]] = {}
    for r in tree.rows:
        below.setdefault(r[3], []).append(r[1])
    post, stack = 0, [(0, False)]
    while stack:
        node, done = stack.pop()
        if done:
            tree.rows[node][2] = post
            post += 1
        else:
            stack.append((node, True))
            stack += [(c, False) for c in reversed(below.get(node, []))]
    return [tuple(r) for r in tree.rows]


def read_by(what: object, columns_of: Callable[[list[tuple]], list[list]]) -> Callable[[str | None, str | None], list[list]]:
    """What ``columns_of`` makes of a file's nodes; ``what`` says all that it goes by. Files of one shape are read once, as words, numbers, strings
    and comments end where they end whatever digits a name has."""
    known = {own: shapes((own, what), lambda text, own=own: columns_of(parse("", own, text)), lambda _: False) for own in LANGUAGES}
    return lambda language, text: known[language].columns(text or "") if language in known else columns_of(parse("", "", text or ""))


def reader(columns: tuple[str, ...] | None) -> Callable[[str | None, str | None], list[list]]:
    """The columns but the path of a file's nodes, the same as from ``parse``."""
    chosen = [i for c in columns or [name for name, _ in FIELDS] if c != "path" for i, (name, _) in enumerate(FIELDS) if name == c]
    return read_by(columns, lambda rows: [[r[i] for r in rows] for i in chosen])


def nodes(files: DataFrame, path: str = "path", language: str = "language", content: str = "content", columns: tuple[str, ...] | None = None) -> DataFrame:
    """``ast_node`` rows of every file of a brace or keyword language, with ``columns`` only where they are given."""
    source = files.select(F.col(path).cast("string").alias("path"), F.col(language).alias("language"), F.col(content).alias("content"))
    return dealt(source).mapInArrow(lambda batches: frames(batches, reader(columns), fields_of(columns)), schema_of(columns))
