"""Control flow and trees of single functions: blocks, dominators, control dependence, tree edit distance, structural patterns.

A function is bounded by its source, so these run function by function in Python; what they return are relations again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.sources import python_source
from quartzite.sources.shapes import frames

_LOOPS = ("for_statement", "while_statement")
_ENDS = {"return_statement": "return", "raise_statement": "raise"}


class _Node(NamedTuple):
    node_id: int
    parent_id: int | None
    kind: str
    flags: list[str]
    text: str | None


def _body(nodes: list[_Node]) -> tuple[dict[int, list[int]], dict[int, _Node]]:
    """Children by their parent, and the nodes by number; they come in order."""
    rows = {r.node_id: r for r in nodes}
    below: dict[int, list[int]] = {}
    for r in rows.values():
        if r.parent_id is not None:
            below.setdefault(r.parent_id, []).append(r.node_id)
    return below, rows


class _Blocks:
    """The basic blocks of one function: 0 is the entry, 1 the exit. What follows a jump in its block can't be reached and makes none."""

    def __init__(self, below: dict[int, list[int]], rows: dict[int, object]):
        self.below, self.rows = below, rows
        self.edges: list[tuple[int, int, str]] = []
        self.count = 2

    def fresh(self) -> int:
        self.count += 1
        return self.count - 1

    def go(self, at: int | None, to: int, kind: str) -> None:
        if at is not None:
            self.edges.append((at, to, kind))

    def arms(self, node: int) -> tuple[list[int], list[int], list[int]]:
        """Children by their part: the body, what stands under else, what stands under finally."""
        parts: tuple[list[int], list[int], list[int]] = ([], [], [])
        for c in self.below.get(node, []):
            flags = self.rows[c].flags
            parts[2 if "in:finalbody" in flags else 1 if "in:orelse" in flags else 0].append(c)
        return parts

    def walk(self, nodes: list[int], block: int | None, loop: tuple[int, int] | None) -> int | None:
        """The block in which control is after ``nodes``, none if it never gets there. ``loop``: where continue and break go."""
        for n in nodes:
            if block is None:
                return None
            kind = self.rows[n].kind
            if kind in _ENDS:
                self.go(block, 1, _ENDS[kind])
                return None
            if loop and kind in ("break_statement", "continue_statement"):
                self.go(block, loop[kind == "break_statement"], kind.split("_")[0])
                return None
            if kind == "if_statement":
                body, other, _ = self.arms(n)
                inner, after = self.fresh(), self.fresh()
                self.go(block, inner, "true")
                self.go(self.walk(body, inner, loop), after, "join")
                if other:
                    inner = self.fresh()
                    self.go(block, inner, "false")
                    self.go(self.walk(other, inner, loop), after, "join")
                else:
                    self.go(block, after, "false")
                block = self.reached(after)
            elif kind in _LOOPS:
                body, other, _ = self.arms(n)
                head, inner, after = self.fresh(), self.fresh(), self.fresh()
                self.go(block, head, "join")
                self.go(head, inner, "true")
                self.go(self.walk(body, inner, (head, after)), head, "back")
                if other:
                    inner = self.fresh()
                    self.go(head, inner, "false")
                    self.go(self.walk(other, inner, loop), after, "join")
                else:
                    self.go(head, after, "false")
                block = self.reached(after)
            elif kind == "try_statement":
                body, other, last = self.arms(n)
                caught = [c for c in body if self.rows[c].kind == "except_clause"]
                after = self.fresh()
                for c in caught:
                    inner = self.fresh()
                    self.go(block, inner, "except")
                    self.go(self.walk(self.below.get(c, []), inner, loop), after, "join")
                end = self.walk([c for c in body if c not in set(caught)] + other, block, loop)
                self.go(end, after, "join")
                block = self.walk(last, self.reached(after), loop)
            elif kind == "match_statement":
                after, whole = self.fresh(), False
                for c in self.below.get(n, []):
                    if self.rows[c].kind == "case_clause":
                        parts = self.below.get(c, [])
                        whole = whole or bool(parts) and self.rows[parts[0]].text == "_"
                        inner = self.fresh()
                        self.go(block, inner, "case")
                        self.go(self.walk(self.below.get(c, []), inner, loop), after, "join")
                if not whole:
                    self.go(block, after, "false")
                block = self.reached(after)
            else:
                block = self.walk(self.below.get(n, []), block, loop)
        return block

    def reached(self, block: int) -> int | None:
        return block if any(e[1] == block for e in self.edges) else None


def _edges(fn: int, held: list[_Node]) -> list[tuple[int, int, str]]:
    """The edges of one function."""
    b = _Blocks(*_body(held))
    b.go(b.walk(b.below.get(fn, []), 0, None), 1, "join")
    return b.edges


def _measure(edges: list[tuple[int, int, str]]) -> int:
    """What ``flow_complexity`` tells of a function's edges."""
    return max(1, len(edges) - len({b for e in edges for b in e[:2]}) + 2)


def source_complexity(files: DataFrame, deal: bool = True) -> DataFrame:
    """``path, name, line, complexity`` of each function of Python files (path, content): ``flow_complexity`` of their control flow. A function is in
    one file, so it is measured where the file is read, and neither nodes nor edges travel."""
    fields = [("path", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("complexity", pa.int32())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = python_source.Reader(("node_id", "parent_id", "kind", "flags", "text", "owner_fn_id", "name", "start_line"), None, False, frozenset(("MatchAs",)))

        def columns_of(content: str | None) -> list[list]:
            held: dict[int, list[_Node]] = {}
            names: dict[int, tuple[str, int]] = {}
            for *node, fn, name, line in zip(*reader.columns(content), strict=True):
                if node[2] == "FunctionDef":
                    names[node[0]] = name, line
                    fn = node[0] if fn is None else fn
                if fn is not None:
                    held.setdefault(fn, []).append(_Node._make(node))
            out = [(*names[fn], _measure(e)) for fn, own in held.items() if fn in names and (e := _edges(fn, own))]
            return [list(c) for c in zip(*out, strict=True)] or [[], [], []]

        return frames(batches, columns_of, fields)

    source = files.select("path", "content")
    return (python_source.dealt(source) if deal else source).mapInArrow(read, "path string, name string, line int, complexity int")


def control_flow(nodes: DataFrame) -> DataFrame:
    """``path, fn, src, dst, kind`` of edges between basic blocks 0 (entry), 1 (exit) and on. Forks have an edge to each arm (true, false,
    except, case), loops a head with a back edge; break and continue leave for the loop's end and head, returns and raises for the exit."""

    def edges_of(path: str, fn: int, held: list[_Node]) -> list[tuple]:
        return [(path, fn, *e) for e in _edges(fn, held)]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["path", "fn", "src", "dst", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Functions stand one after the other, however the batches part them."""
        now, held = None, []
        for b in batches:
            out: list[tuple] = []
            for path, fn, *node in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (path, fn) != now:
                    out += edges_of(*now, held)
                    held = []
                now = (path, fn)
                held.append(_Node(*node))
            yield made(out)
        if held:
            yield made(edges_of(*now, held))

    own = nodes.withColumn("fn", F.coalesce("owner_fn_id", F.when(F.col("kind") == "FunctionDef", F.col("node_id")))).where("fn is not null")
    text = F.when(F.col("kind") == "MatchAs", F.col("text")).alias("text")
    dealt = own.select("path", "fn", "node_id", "parent_id", "kind", "flags", text).repartition("path", "fn").sortWithinPartitions("path", "fn", "node_id")
    return dealt.mapInArrow(run, "path string, fn int, src int, dst int, kind string")


def flow_complexity(edges: DataFrame) -> DataFrame:
    """Edges less blocks and 2, at least 1."""
    ends = edges.select("path", "fn", F.explode(F.array("src", "dst")).alias("b")).groupBy("path", "fn").agg(F.countDistinct("b").alias("n"))
    return edges.groupBy("path", "fn").agg(F.count("*").alias("e")).join(ends, ["path", "fn"]).select("path", "fn", F.greatest(F.col("e") - F.col("n") + 2, F.lit(1)).alias("complexity"))


def _idom(succ: dict[int, set[int]], root: int) -> dict[int, int]:
    """Immediate dominators of what the root reaches, by sets in reverse post-order until nothing changes."""
    order, seen, stack = [], {root}, [(root, iter(sorted(succ.get(root, ()))))]
    while stack:
        node, it = stack[-1]
        step = next((x for x in it if x not in seen), None)
        if step is None:
            order.append(node)
            stack.pop()
        else:
            seen.add(step)
            stack.append((step, iter(sorted(succ.get(step, ())))))
    order.reverse()
    pred: dict[int, set[int]] = {}
    for a, bs in succ.items():
        for b in bs:
            if a in seen:
                pred.setdefault(b, set()).add(a)
    dom = {n: {n} if n == root else set(order) for n in order}
    changed = True
    while changed:
        changed = False
        for n in order:
            if n != root:
                new = set.intersection(*(dom[p] for p in pred[n])) | {n}
                if new != dom[n]:
                    dom[n], changed = new, True
    return {n: max(dom[n] - {n}, key=lambda d: len(dom[d])) for n in order if n != root}


def dominators(edges: DataFrame, post: bool = False) -> DataFrame:
    """``path, fn, block, idom``; of the reversed graph from the exit if ``post``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        succ: dict[int, set[int]] = {}
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            succ.setdefault(b if post else a, set()).add(a if post else b)
        found = _idom(succ, 1 if post else 0)
        return pd.DataFrame([(pdf["path"].iloc[0], pdf["fn"].iloc[0], n, d) for n, d in found.items()], columns=["path", "fn", "block", "idom"])

    return edges.groupBy("path", "fn").applyInPandas(run, "path string, fn int, block int, idom int")


def control_dependence(edges: DataFrame) -> DataFrame:
    """``path, fn, dependent, controller``: a block depends on a fork if one way out of the fork must pass it and another need not."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        back: dict[int, set[int]] = {}
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            back.setdefault(b, set()).add(a)
        ipdom = _idom(back, 1)
        out = set()
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            at = b
            while at in ipdom and a in ipdom and at != ipdom[a]:
                out.add((at, a))
                at = ipdom[at]
        return pd.DataFrame([(pdf["path"].iloc[0], pdf["fn"].iloc[0], *x) for x in sorted(out)], columns=["path", "fn", "dependent", "controller"])

    return edges.groupBy("path", "fn").applyInPandas(run, "path string, fn int, dependent int, controller int")


def tree_distance(a: list[tuple[str, int]], b: list[tuple[str, int]]) -> int:
    """Edit distance of ordered labelled trees in post-order, each node with its label and the index of its leftmost leaf."""

    def keyroots(t: list[tuple[str, int]]) -> list[int]:
        last = {left: i for i, (_, left) in enumerate(t)}
        return sorted(last.values())

    dist = [[0] * len(b) for _ in a]
    for i in keyroots(a):
        for j in keyroots(b):
            la, lb = a[i][1], b[j][1]
            table = [[0] * (j - lb + 2) for _ in range(i - la + 2)]
            for x in range(1, i - la + 2):
                table[x][0] = x
            for y in range(1, j - lb + 2):
                table[0][y] = y
            for x in range(1, i - la + 2):
                for y in range(1, j - lb + 2):
                    p, q = la + x - 1, lb + y - 1
                    edit = min(table[x - 1][y], table[x][y - 1]) + 1
                    if a[p][1] == la and b[q][1] == lb:
                        table[x][y] = dist[p][q] = min(edit, table[x - 1][y - 1] + (a[p][0] != b[q][0]))
                    else:
                        table[x][y] = min(edit, table[a[p][1] - la][b[q][1] - lb] + dist[p][q])
    return dist[-1][-1] if a and b else len(a) + len(b)


def post_order(kinds: list[str], parents: list[int | None]) -> list[tuple[str, int]]:
    """Nodes in pre-order with their parents, as ``tree_distance`` takes them."""
    below: dict[int, list[int]] = {}
    for i, p in enumerate(parents):
        if p is not None:
            below.setdefault(p, []).append(i)
    out: list[tuple[str, int]] = []

    def visit(i: int) -> int:
        left = None
        for c in below.get(i, []):
            first = visit(c)
            left = first if left is None else left
        left = len(out) if left is None else left
        out.append((kinds[i], left))
        return left

    if kinds:
        visit(0)
    return out


_TOKEN = re.compile(r'\(|\)|#[a-z-]+\?|@[A-Za-z_]\w*|"(?:[^"\\]|\\.)*"|[A-Za-z_][\w]*')


def pattern_plan(pattern: str) -> tuple[list[tuple[int | None, str, str | None]], list[tuple[str, str, str]]]:
    """Steps (parent step, kind, capture) and predicates (test, capture, value) of a structural pattern such as
    ``(Call (Identifier) @f (#eq? @f "eval"))``. Raises ValueError on an empty pattern, an unmatched bracket or a bad predicate."""
    tokens = _TOKEN.findall(pattern)
    if not tokens:
        raise ValueError("empty pattern")
    steps: list[tuple[int | None, str, str | None]] = []
    tests: list[tuple[str, str, str]] = []
    stack: list[int] = []
    i, last = 0, None
    while i < len(tokens):
        t = tokens[i]
        if t == "(" and i + 1 < len(tokens) and tokens[i + 1].startswith("#"):
            if i + 4 >= len(tokens) or tokens[i + 4] != ")" or tokens[i + 1] not in ("#eq?", "#not-eq?", "#match?"):
                raise ValueError(f"bad predicate near {tokens[i + 1]}")
            value = tokens[i + 3].strip('"')
            if tokens[i + 1] == "#match?":
                re.compile(value)
            tests.append((tokens[i + 1], tokens[i + 2][1:], value))
            i += 5
            continue
        if t == "(":
            if i + 1 >= len(tokens) or not re.match(r"[A-Za-z_]", tokens[i + 1]):
                raise ValueError("a bracket without a kind")
            steps.append((stack[-1] if stack else None, tokens[i + 1], None))
            stack.append(len(steps) - 1)
            i += 2
            continue
        if t == ")":
            if not stack:
                raise ValueError("unmatched bracket")
            last = stack.pop()
        elif t.startswith("@") and last is not None:
            steps[last] = (steps[last][0], steps[last][1], t[1:])
        i += 1
    if stack:
        raise ValueError("unmatched bracket")
    return steps, tests


def find_pattern(nodes: DataFrame, pattern: str) -> DataFrame:
    """Matches ``path, root`` and the text of each capture: the pattern becomes joins on parent and child, siblings in order."""
    steps, tests = pattern_plan(pattern)
    base = nodes.select("path", "node_id", "parent_id", "child_idx", "kind", F.coalesce("name", "text").alias("text"))
    as_step = lambda k: base.where(F.col("kind") == steps[k][1]).select("path", *(F.col(c).alias(f"{c}_{k}") for c in ("node_id", "parent_id", "child_idx", "text")))
    out = as_step(0)
    before: dict[int, int] = {}
    for k in range(1, len(steps)):
        p = steps[k][0]
        out = out.join(as_step(k).withColumnRenamed(f"parent_id_{k}", f"node_id_{p}"), ["path", f"node_id_{p}"])
        if p in before:
            out = out.where(F.col(f"child_idx_{k}") > F.col(f"child_idx_{before[p]}"))
        before[p] = k
    captures = {c: k for k, (_, _, c) in enumerate(steps) if c}
    for test, capture, value in tests:
        text = F.col(f"text_{captures[capture]}")
        out = out.where(text == value if test == "#eq?" else text != value if test == "#not-eq?" else text.rlike(value))
    return out.select("path", F.col("node_id_0").alias("root"), *(F.col(f"text_{k}").alias(c) for c, k in captures.items())).distinct()
