"""Scopes on sources of every kind of binding."""

from quartzite.operators import scopes


def read(spark, text):
    s = scopes.structure(spark.createDataFrame([("a.ts", "typescript", text)], "path string, language string, content string"))
    bound = scopes.bindings(s)
    refs = scopes.resolved(s, bound)
    lines = {r.body: r.line for r in s.functions.collect()}
    return (
        {(r.line, r.name): (r.bound_line, r.how, r.captured) for r in refs.collect()},
        {(lines[r.body], r.name) for r in scopes.free_names(s, refs).collect()},
        {(lines[r.body], r.name) for r in scopes.own_bindings(s, bound).collect()},
    )


def test_shadowing_and_closures(spark):
    refs, free, own = read(spark, """import React, { useState as state, memo } from 'react';
const x = 1;
function outer(a, { b, k: c, ...rest }, [d = x]) {
  use(x, a, b, c, rest, d);
  let x = 2;
  if (a) {
    let x = 3;
    var hoisted = x;
    const f = (e) => {
      return x + e + a + memo;
    };
  }
  use(x, hoisted, k, state);
}
items.map((y) => y + x);
for (const z of items) {
  use(z);
}
try { use(z) } catch (err) {
  use(err, obj.err, { err: x });
}
""")
    assert refs[4, "x"] == refs[13, "x"] == (5, "let", False)
    assert refs[8, "x"] == (7, "let", False) and refs[10, "x"] == (7, "let", True)
    assert [refs[4, n] for n in ("a", "b", "c", "rest", "d")] == [(3, "parameter", False)] * 5
    assert refs[13, "hoisted"] == (8, "var", False) and refs[13, "k"] == (None, None, None) and refs[13, "state"] == (1, "import", True)
    assert refs[10, "e"] == (9, "parameter", False) and refs[10, "a"] == (3, "parameter", True) and refs[10, "memo"] == (1, "import", True)
    assert refs[15, "y"] == (15, "parameter", False) and refs[15, "x"] == (2, "const", False) == refs[20, "x"]
    assert refs[17, "z"] == (16, "const", False) and refs[19, "z"] == (None, None, None) and refs[20, "err"] == (19, "catch", False)
    assert {n for line, n in free if line == 9} == {"x", "a", "memo"} and {n for line, n in free if line == 3} == {"use", "memo", "k", "state"}
    assert {n for line, n in own if line == 3} == {"a", "b", "c", "rest", "d", "x", "hoisted", "f"} and {n for line, n in own if line == 9} == {"e"}


def test_declarations_of_several_names_and_nothing(spark):
    refs, free, _ = read(spark, "let a = 1, b = a;\nconst { c, d: { e } } = b, [g] = c\nuse(a, b, c, d, e)\nconst h = i => { i(e) }\n")
    assert refs[3, "a"] == (1, "let", False) and refs[3, "b"] == (1, "let", False) and refs[3, "e"] == (2, "const", False) and refs[3, "d"] == (None, None, None)
    assert refs[4, "i"][:2] == (4, "parameter")
    assert read(spark, None) == ({}, set(), set()) == read(spark, "}}}")
