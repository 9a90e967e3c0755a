"""Clone sets by brute force, string shapes, rings, walks and reviews."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quartzite.functions import strings as T
from quartzite.operators import clones, layers, reviews


def brute_regions(files, size=5):
    """The regions of all pairs of places, by their content."""
    kept, blocks = {}, {}
    for path, stmts in files.items():
        out = [x for i, x in enumerate(stmts) if i in (0, len(stmts) - 1) or not (stmts[i - 1][1] == x[1] == stmts[i + 1][1])]
        kept[path] = out
        blocks[path] = [tuple(s for _, s in out[i : i + size]) for i in range(len(out) - size + 1)]
    places = [(p, i) for p in sorted(files) for i in range(len(blocks[p]))]
    found = set()
    for k, (p, i) in enumerate(places):
        for r, j in places[k + 1 :]:
            if blocks[p][i] != blocks[r][j] or i and j and blocks[p][i - 1] == blocks[r][j - 1]:
                continue
            n = 0
            while i + n + 1 < len(blocks[p]) and j + n + 1 < len(blocks[r]) and blocks[p][i + n + 1] == blocks[r][j + n + 1]:
                n += 1
            for path, at in ((p, i), (r, j)):
                span = kept[path][at : at + n + size]
                found.add((tuple(s for _, s in span), path, span[0][0], span[-1][0]))
    return found


def brute_sets(files, min_lines, max_places):
    by = {}
    for content, *region in brute_regions(files):
        by.setdefault(content, []).append(tuple(region))
    out = set()
    for regions in by.values():
        keep = []
        for r in sorted(regions):
            if not any(k[0] == r[0] and r[1] <= k[2] for k in keep):
                keep.append(r)
        lines = max(b - a + 1 for _, a, b in keep)
        if 2 <= len(keep) <= max_places and lines >= min_lines:
            out |= {(*r, lines, len(keep)) for r in keep}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_clone_sets_against_brute_force(spark, seed):
    rng = random.Random(seed)
    bits = [[f"s{rng.randrange(30)}" for _ in range(rng.randint(4, 14))] for _ in range(6)]
    files = {}
    for f in range(7):
        stmts = [s for _ in range(4) for s in rng.choice(bits)] + [f"own{f}"] * 3
        files[f"f{f}"] = [(i + 1, s) for i, s in enumerate(stmts)]
    df = spark.createDataFrame([(p, i, s) for p, x in files.items() for i, s in x], "path string, line long, stmt string")
    b = clones.blocks(clones.collapse(df))
    got = Counter(tuple(r)[1:] for r in clones.matched_regions(b).collect())
    assert got == Counter(r[1:] for r in brute_regions(files))
    report = clones.clone_sets(df, min_lines=6, max_places=8).collect()
    assert {(r.path, r.start_line, r.end_line, r.lines, r.places) for r in report} == brute_sets(files, 6, 8)
    assert [r.lines * r.places for r in report] == sorted((r.lines * r.places for r in report), reverse=True)


def test_clones_at_any_number_of_places(spark):
    """66 and 1,000 copies of a file are found as 60 are; nested and periodic runs as brute force finds them; nothing gives nothing."""
    copies = [(f"f{n}", i + 1, f"step{i}(x)") for n in range(1000) for i in range(14)]
    df = spark.createDataFrame(copies, "path string, line long, stmt string")
    for n in (60, 66, 1000):
        some = df.where(F.substring("path", 2, 9).cast("int") < n)
        assert {tuple(r)[1:] for r in clones.matched_regions(clones.blocks(clones.collapse(some))).collect()} == {(f"f{i}", 1, 14) for i in range(n)}
        assert clones.clone_sets(some, max_places=None).where(F.col("places") == n).count() == n
    files = {f"p{n}": [(i + 1, "ab"[i % 2]) for i in range(20 + n)] + [(99, f"own{n}")] for n in range(3)}
    files |= {f"q{n}": [(i + 1, f"s{i}") for i in range(6 + n % 9)] for n in range(80)}
    df = spark.createDataFrame([(p, i, s) for p, x in files.items() for i, s in x], "path string, line long, stmt string")
    got = Counter(tuple(r)[1:] for r in clones.matched_regions(clones.blocks(clones.collapse(df))).collect())
    assert got == Counter(r[1:] for r in brute_regions(files))
    assert clones.matched_regions(clones.blocks(clones.collapse(df.limit(0)))).count() == 0


def test_token_statements(spark):
    text = 'a = "x // y" + 12; // note\n/* b\n c */ d("e")\n\nname = \'f\'  +  other'
    df = spark.createDataFrame([("p", text), ("n", None)], "path string, content string")
    rows = [(r.line, r.stmt, r.tokens, r.literals) for r in clones.token_statements(df).collect()]
    assert rows == [(1, "a = STR + NUM ;", 6, 2), (3, "d ( STR )", 4, 1), (5, "name = STR + other", 5, 1)]
    assert [r.stmt for r in clones.token_statements(df, rename=True).collect()][2] == "ID = STR + ID"
    df = spark.createDataFrame([("p", '/* a */ b /* c */ = "d\\\ne"\nf')], "path string, content string")
    assert [(r.line, r.stmt) for r in clones.token_statements(df).collect()] == [(1, "b = STR"), (3, "f")]


def test_clones_of_declarations_and_tables_are_left_out(spark):
    lines = [f"step{i}(x)" for i in range(12)]
    df = spark.createDataFrame([(p, i + 1, s) for p in "ab" for i, s in enumerate(lines)], "path string, line long, stmt string")
    decl = lambda n: spark.createDataFrame([(p, 2 + k) for p in "ab" for k in range(n)], "path string, line long")
    assert clones.clone_sets(df, decl(1)).count() == 2 and clones.clone_sets(df, decl(2)).count() == 0
    mostly = lambda n: df.withColumn("tokens", F.lit(4)).withColumn("literals", F.lit(n))
    assert clones.clone_sets(mostly(1)).count() == 2 and clones.clone_sets(mostly(2)).count() == 0
    assert clones.clone_sets(df, min_lines=13).count() == 0 and clones.clone_sets(df, max_places=1).count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_string_shapes(spark):
    lit = F.lit
    assert one(spark, T.unescape(lit("a\\n\\\\n\\q\\"))) == "a\n\\n\\q\\"
    assert one(spark, T.unquoted(lit('b"x"'))) == "x" and one(spark, T.unquoted(lit("plain"))) == "plain" and one(spark, T.unquoted(lit('"open'))) == '"open'
    assert one(spark, T.percent_decoded(lit("a%20b%zz%C3%A9%"))) == "a b%zzé%" and one(spark, T.percent_decoded(lit("%ff"))) == "%ff"
    for text, want in (("std::vec.push(x)", True), ("a.b(c)", False), ("select x from y", True), ("fromage", False)):
        assert one(spark, T.is_query(lit(text))) is want
    assert one(spark, T.is_compound_name(lit("a-b_c9"))) and not one(spark, T.is_compound_name(lit("a-Bc9"))) and not one(spark, T.is_compound_name(lit("single")))
    assert one(spark, T.in_module(lit("redis.client"), lit("redis"))) and not one(spark, T.in_module(lit("redisearch"), lit("redis")))
    assert one(spark, T.fingerprint(lit("r"), lit("p"), lit("m"))) != one(spark, T.fingerprint(lit("r"), lit("pm"), lit("")))


def test_rings(spark):
    for path, want in (("src/domain/a.ts", "domain"), ("adapters/domain/x", "domain"), ("src/web/persistence/x", "adapter"), ("lib/x", "unclassified"), ("Ports/use_cases/x", "port")):
        assert one(spark, layers.layer_of(F.lit(path))) == want
    assert one(spark, layers.custom_layer_of(F.lit("pkg/kernel/a"), [("pkg/kernel/**", "domain")])) == "domain"
    with pytest.raises(ValueError):
        layers.custom_layer_of(F.lit("x"), [("x", "moon")])
    e = spark.createDataFrame([("domain/a.ts", "infra/b.ts"), ("infra/b.ts", "domain/a.ts"), ("tests/domain/c.ts", "infra/b.ts"), ("ports/p.ts", "application/q.ts")], "src string, dst string")
    assert [tuple(r) for r in layers.outward_dependencies(e).collect()] == [("domain/a.ts", "infra/b.ts", "domain", "infrastructure")]
    assert [r.dst for r in layers.dependencies(e, "domain/a.ts").collect()] == ["infra/b.ts"] and layers.dependents(e, "infra/b.ts").count() == 2
    m = spark.createDataFrame([("a", "a"), ("b", "a"), ("x", "x"), ("y", "x")], "node string, scc string")
    assert {r.node for r in layers.cycles_touching(m, "b").collect()} == {"a", "b"}


def test_walks_take_the_first_way(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "a"), ("p", "q"), ("q", "r"), ("r", "q"), ("q", "p")], "src string, dst string")
    m = spark.createDataFrame([*((n, "a") for n in "abcd"), *((n, "p") for n in "pqr")], "node string, scc string")
    assert {r.scc: r.path for r in layers.cycle_paths(e, m).collect()} == {"a": "a -> b -> c -> a", "p": "p -> q -> p"}


def test_reviews(spark):
    steps = [(1, "start"), (1, "repro_failed"), (1, "start"), (1, "diagnosed"), (1, "start"), (1, "fix_rejected"), (1, "start"), (1, "fix_accepted"), (2, "fix_accepted"), (2, "start"), (2, "repro_passed")]
    e = spark.createDataFrame([(i, n, s) for n, (i, s) in enumerate(steps)], "issue long, seq long, event string")
    assert {tuple(r) for r in reviews.triage(e).collect()} == {(1, "FixReady", 0), (2, "NeedsInfo", 1)}
    assert one(spark, reviews.repro_event(F.lit(None).cast("int"))) == "repro_failed"
    rows = lambda *r: spark.createDataFrame([(x,) for x in r], "rule_id string")
    verdict = lambda a, b, t: tuple(reviews.completion(a, b, t, ["rule_id"]).first())
    assert verdict(rows("x"), rows("x", "y"), "x") == ("TargetRemains", 1) and verdict(rows("x"), rows("y", "y"), "x") == ("Regressed", 2) and verdict(rows("x", "y"), rows("y"), None) == ("Done", 0)
    c = spark.createDataFrame([("p", "  # noqa\nx", "# noqa\n  # noqa\nx"), ("q", None, " # noqa\n # noqa")], "path string, old string, new string")
    assert sorted(tuple(r) for r in reviews.added_markers(c, ["noqa"]).collect()) == [("p", "# noqa"), ("q", "# noqa"), ("q", "# noqa")]
    spans = spark.createDataFrame([("p", 1, 600), ("p", 700, 701), ("q", 1, 2)], "path string, start_line long, end_line long")
    lines = spark.createDataFrame([("p", 1, 1), ("p", 600, 0), ("p", 601, 5), ("r", 1, 1)], "path string, line long, hits long")
    assert {(r.path, r.start_line): r.coverage for r in reviews.coverage_of_spans(spans, lines).collect()} == {("p", 1): 50.0, ("p", 700): None, ("q", 1): None}


def test_logs_are_dealt_and_formats_found(spark):
    import json

    from quartzite.operators import findings
    from quartzite.sources import reports, sinks

    f = spark.createDataFrame([("r:x", "Blocker", "m", f"p{i}.py", i) for i in range(50)], "rule_id string, severity string, message string, path string, start_line int")
    logs = [json.loads(r.sarif) for r in sinks.sarif_log(f, most=10).collect()]
    assert 2 <= len(logs) <= 5 and sum(len(x["runs"][0]["results"]) for x in logs) == 50
    assert [json.loads(r.sarif)["runs"][0]["results"] for r in sinks.sarif_log(f.limit(0)).collect()] == [[]]
    one_report = lambda text: spark.createDataFrame([("r", text)], "report string, content string")
    assert [tuple(r) for r in reports.coverage(one_report("SF:a\nDA:1,2")).collect()] == [("r", "a", 1, 2)]
    assert [tuple(r) for r in reports.coverage(one_report("SF:a\nDA:1,2"), "lcov").collect()] == [("r", "a", 1, 2)]
    with pytest.raises(Exception, match="no coverage format"):
        reports.coverage(one_report("what is this")).collect()
    w = spark.createDataFrame([("a/b.lock",), ("a/b.py",)], "path string")
    assert [r.verdict for r in findings.protected(w, ["**/*.lock"]).orderBy("path").collect()] == ["Deny", None]
