"""The shared tokeniser and the rules on source text."""

import pytest
from pyspark.sql import functions as F

from quartzite.operators import code, code_rules
from quartzite.rulesets import registry
from quartzite.sources import code_source


def test_every_rule_tells_bad_from_good(spark):
    rows = [(path.format(i), language, text, rule, kind) for i, (rule, kind, language, path, text) in enumerate(registry.samples())]
    df = spark.createDataFrame(rows, "path string, language string, content string, rule string, kind string")
    found = {(r.path, r.rule_id) for r in code_rules.code_findings(df, registry.RULES).collect()}
    assert not [(rule, kind) for path, _, _, rule, kind in rows if ((path, rule) in found) != (kind == "bad")]
    assert len({r.rule_id for r in registry.RULES}) == len(registry.RULES) > 170


def test_masking_keeps_lines(spark):
    rows = [
        ("c", 'a = "x // y"; // c\n/* b\n c */ d = \'"\' + `e\n${f}`;', 'a = ""; \n\n d = \'\' + `\n`;'), ("hash", 'a = """b\n# c""" # d\ne = "#"', 'a = "\n" \ne = ""'),
        ("rust", "fn f<'a>(b: &'a str) { '\\'' ; \"//\" }", "fn f<'a>(b: &'a str) { '' ; \"\" }"), ("mark", "<a b='c'><!-- d\n -- e --></a>", "<a b=''>\n</a>"), ("c", "a / b // c", "a / b "), ("c", '"open\nb', '"open\nb'),
    ]
    for family, text, want in rows:
        assert spark.createDataFrame([(text,)], "t string").select(code_rules.masked(F.col("t"), family).alias("m")).first().m == want
    long = spark.range(1).select(F.concat(F.lit('"'), F.repeat(F.lit("x\\\\n"), 200_000), F.lit('" //'), F.repeat(F.lit("y"), 300_000)).alias("t"))
    assert long.select(F.length(code_rules.masked(F.col("t"), "c")).alias("n")).first().n == 3
    assert code_rules.code_findings(spark.createDataFrame([("a", None, None), ("b", None, "// TODO x")], "path string, language string, content string"), registry.RULES).select("rule_id").collect()[0][0] == "smells:todo-comment"


@pytest.mark.parametrize("language", sorted(code_source.LANGUAGES))
def test_odd_texts_still_give_nodes(language):
    for text in ("", "}}}) end end", "((({{{ if (", '"never closed\n', "/* never closed", "fn function def class if for", "a" * 5000, "{" * 300):
        rows = code_source.parse("p", language, text)
        assert rows[0][6] == "SourceUnit" and sorted(r[2] for r in rows) == list(range(len(rows)))
        assert all(r[3] is None or r[3] < r[1] for r in rows)


def test_shared_nodes_feed_the_metrics(spark):
    ts = "class A {\n  one() { return this.x; }\n  two(a) { if (a) { this.one(); } }\n}\nconst f = async (b) => {\n  await g(b);\n};\nfunction g(c) { switch (c) { case 1: return f(c); case 2: return 3; } }\n"
    n = code_source.nodes(spark.createDataFrame([("a.ts", "typescript", ts), ("b.x", "unknown", "a"), ("c.ts", "typescript", None)], "path string, language string, content string")).cache()
    assert {r.name: r.cyclomatic for r in code.function_complexity(n).collect()} == {"one": 1, "two": 2, "f": 1, "g": 3}
    names = {r.node_id: r.name for r in n.where("kind = 'FunctionDef'").collect()}
    assert {(names[r.caller], names[r.callee]) for r in code.call_edges(n).collect()} == {("f", "g"), ("g", "f")}
    assert [tuple(r) for r in code.structure(n).where("path = 'a.ts'").select("functions", "classes").collect()] == [(4, 1)]
    assert "async" in n.where("name = 'f' and kind = 'FunctionDef'").first().flags and n.where("kind = 'await_expression' and in_async").count() == 1


def test_functions_are_summed_up_where_files_are_read(spark, monkeypatch):
    """As by aggregation of the nodes; files that differ in numbered names are read once, with their own names."""
    from quartzite.plans import catalog, more

    texts = [(language, body.replace("{}", str(k))) for language, body in catalog.BODIES.items() for k in (7, 8, 9, 10, 11)]
    texts += [(s[1], t) for s in more.NODE_SAMPLES for t in s[2:]] + [(s[2], s[4]) for s in registry.samples()]
    texts += [("rust", f"fn a{k}() {{ b{k}('x', '\\u{{{k}}}'); let s = r#\"c{k}\"#; d{k + k % 2}(1.5e{k}); // e{k}\n f{k}::g{k}(a{k}) }}\n") for k in range(10, 20)]
    texts += [("typescript", f"const a{k} = async (b) => {{ c{k}(`x${{d{k}}}`, 'é'); }}; class K{k} {{ m{k}() {{ this.x{k}.y(); }} }}\n") for k in range(10, 20)] + [("unknown", "f1()"), (None, "f1()"), ("go", None)]
    files = spark.createDataFrame([(f"p{i}", *t) for i, t in enumerate(texts)], "path string, language string, content string")
    n = code_source.nodes(files).cache()
    whole = [r for i, (language, t) in enumerate(texts) for r in code_source.parse(f"p{i}", language or "", t or "")]
    assert sorted(map(repr, map(tuple, n.collect()))) == sorted(map(repr, whole))
    calls = n.where("kind = 'Call' and owner_fn_id is not null").groupBy("path", F.col("owner_fn_id").alias("fn")).agg(F.sort_array(F.collect_set("name")).alias("calls"))
    want = code.function_complexity(n).join(calls, ["path", "fn"], "left")
    got = code.functions(files).withColumn("calls", F.when(F.size("calls") > 0, F.sort_array("calls")))
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    seen, parse = [], code_source.parse
    monkeypatch.setattr(code_source, "parse", lambda *a: seen.append(a) or parse(*a))
    read = code_source.reader(("name", "text"))
    assert [read("go", f"func f{k}() {{ g{k}(h{k}) }}")[0] for k in range(100, 200)] == [[r[7] for r in parse("", "go", f"func f{k}() {{ g{k}(h{k}) }}")] for k in range(100, 200)] and len(seen) == 2
