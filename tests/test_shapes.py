"""Parts of one shape are parsed once, with the rows of whole parsing."""

import ast
import random
from collections import Counter

import pytest

from quartzite.operators import rules
from quartzite.sources import python_source

PARTS = [
    "import os{a}\nfrom m{a} import *\n", "@dec{a}\n@other\ndef f{a}(x{b}, y=[]):\n    '''doc'''\n    return x{b}\n", "x = [\n1,\na{a}\n]\n", "x = '''\nfoo{a}\n'''\n", "# c f{a}\n\n",
    "def f{a}(x, y=[]):\n    for i{a} in x:\n        g{b}(i{c}, key=f{a}.x{b})\n    if x == None: h{a}(x{b})\n", "if a{a}:\n  b{b}()\nelif c:\n  d{c}\nelse:\n  e{a}\n",
    "class C{a}(B{b}):\n    x{a} = []\n    async def m{c}(self, q{a}):\n        try:\n            await z{b}\n        except E{c} as e{a}:\n            pass\n        finally:\n            del z{b}\n",
    "x = 1.e{a} + 1..e{b} + 0x{a} + 1if a{b} else b{c}\n", "s = \"a{a} b{b}\" + f'{{q{a}}}'\n", "y{a}.b{b}.c{a}[{c}].d{b}(lambda q{a}: q{b}, {{k{a}: v for v in w{b}}})\n",
    "for x{a} in y{a}: pass\nelse:\n    z{b}\n", "match m{a}:\n    case P{b}(z{c}=1):\n        pass\n    case _:\n        r{a}\n", "x \\\n= a{a}\n", "x{a} = (\nb{b},\n)\n", "print(x{a}\n", "é{a} = b{a}\n",
    "def g{a}(x{a}: int = {b}) -> None:\n    return 1\n", "assert a{a} is {b}, b{b} != c{a}\n", "def f[T](x):\n  return a{a}\n", "def f(x):\n\n  # c{a}\n  return [q{a} for q{a} in x if q{b}]\n\n",
    "async def f{a}(x):\n  await g{b}()\n  @d{a}\n  def h{b}(): return 1\n  class K{c}:\n    def m(self): pass\n  for i{a} in x: print(i{b})\n  else:\n    y{a}\n# c\n\n",
    "def f(a=lambda x: (y)):\n x{a}\n x{b}\n  # odd\n if x:\n  try: y\n  except E: z\n else: w{c}\n", "def f(x): return (x):\n  y\n", "def f(x):\n  y{a}\n z{b}\n", "def f(x):\n  return x; z{b}\n  yield\n-x\n",
]


@pytest.mark.filterwarnings("ignore::SyntaxWarning")
def test_parts_give_what_the_whole_gives():
    rng = random.Random(3)
    kinds = frozenset(r.kind for r in rules.PYTHON)
    asked = [(None, None, True, None, frozenset()), (rules.PYTHON_COLUMNS, kinds, True, frozenset(rules.PYTHON_TEXT_KINDS), frozenset(rules.PYTHON_FLAGGED)),
             (("path", "node_id", "parent_id", "kind", "name", "text", "owner_fn_id", "flags"), None, False, None, frozenset()), (("kind", "child_idx", "path", "post"), frozenset({"Call", "SourceUnit"}), True, None, frozenset())]
    names = [f for f, _ in python_source.FIELDS]
    for _ in range(600):
        number = lambda: rng.choice((1, 2, 9, 10, 11))
        text = "".join(rng.choice(PARTS).format(a=number(), b=number(), c=number()) for _ in range(rng.randint(0, 4)))
        for change, often in ((lambda t: t.replace("\n", "\r\n"), 0.05), (lambda t: t[:-1], 0.05), (lambda t: " " + t, 0.03), (lambda t: t[: len(t) // 2] + rng.choice("(){}:\t\\\x00 \f") + t[len(t) // 2 :], 0.05)):
            text = change(text) if rng.random() < often else text
        for one in asked:
            rows = python_source.parse("", text, *one)
            assert python_source.Reader(*one).columns(text) == [[r[names.index(c)] for r in rows] for c in one[0] or names if c != "path"], text


def test_functions_of_one_shape_are_parsed_once(monkeypatch):
    body = "    if x > 1:\n        f{0}(x)\n    for i in range(2):\n        print(x)\n"
    text = "".join(f"def f{i}(x, y=[]):\n" + body.format(i + 1) * (1 + i % 7) for i in range(100, 400))
    want = python_source.parse("", text)
    calls, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda t: calls.append(t) or parse(t))
    got = python_source.Reader(None, None).columns(text)
    assert [list(r) for r in zip(*got, strict=True)] == [list(r[1:]) for r in want] and len(calls) < 20


def test_names_that_only_look_alike():
    """Equal names stay equal, others don't; a name from elsewhere is never filled in."""
    flags = lambda t: [r[19] for r in python_source.parse("", t) if r[6] == "for_statement"]
    reader = python_source.Reader(("name", "kind", "flags"), None)
    for a, b in ((1, 1), (2, 2), (1, 2), (3, 3), (2, 1), (2, 3)):
        text = f"x = 1\nfor i{a} in y:\n    g(i{b}, k=i{a}.e5)\n"
        name, kind, got = reader.columns(text)
        assert [f for k, f in zip(kind, got, strict=True) if k == "for_statement"] == flags(text)
        assert name == [r[7] for r in python_source.parse("", text)]


def test_rules_read_what_they_name(spark):
    """All nodes or only those that the rules read: the same findings."""
    text = "import os\nfrom m1 import *\nDEBUG = True\ndef f1(a1, b=[]):\n    for i1 in a1:\n        print(a1)\n    print(a1)\n    print(a1)\n    if len(a1):\n        raise Exception(a1)\n    if a1 == None:\n        return open(a1)\n"
    files = spark.createDataFrame([("a.py", text), ("tests/b.py", text.replace("f1", "_f2")), ("c.py", "def f(:"), ("d.py", None)], "path string, content string")
    some = python_source.nodes(files, columns=rules.PYTHON_COLUMNS, kinds=tuple({r.kind for r in rules.PYTHON}), text_kinds=rules.PYTHON_TEXT_KINDS, flagged=rules.PYTHON_FLAGGED)
    found = lambda n: sorted(map(tuple, rules.node_findings(n).collect()))
    assert found(some) == found(python_source.nodes(files)) and len({r[1] for r in found(some)}) > 8
    counted = python_source.nodes(files, columns=rules.PYTHON_COUNTED, kinds=tuple({r.kind for r in rules.PYTHON}), text_kinds=rules.PYTHON_TEXT_KINDS, flagged=rules.PYTHON_FLAGGED, counted=True)
    assert {(r.path, r.rule_id): r.n for r in rules.node_counts(counted).collect()} == Counter((r[0], r[1]) for r in found(some))
    assert counted.count() < some.count()
