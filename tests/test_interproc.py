"""Taint through calls and files, on sources and against a plain evaluation of the same rules."""

import pytest
from pyspark.sql import functions as F

from quartzite.operators import interproc, token_structure as ts

LIB = "import cp from 'child_process';\nexport function run(cmd: string) {\n  cp.execSync(cmd);\n}\nexport function launch(x: string) {\n  run(x);\n}\n"


def flows(spark, files, config=interproc.CROSS_FILE):
    df = spark.createDataFrame([(p, "typescript", t) for p, t in files.items()], "path string, language string, content string")
    f = interproc.facts(df, config)
    return {(r.path, r.line, r.source, r.callee) for r in interproc.cross_file_flows(f).collect()}, {(r.path, r.line, r.source, r.sink) for r in interproc.injections(f).collect()}


def test_flows_through_imports_chains_and_returns(spark):
    files = {
        "lib.ts": LIB,
        "main.ts": "import { launch } from './lib';\nconst target = process.argv[2];\nlaunch(target);\n",
        "clean.ts": "import { launch } from './lib';\nlaunch('ls');\n",
        "washed.ts": "import { launch } from './lib';\nconst t = escape(req.body.x)\nlaunch(t);\nlaunch(escapeShellArg(req.query.y));\n",
        "alias.ts": "import { run as go, launch } from './lib'\ngo(`ls ${req.params.id}`)\n",
        "sub/deep.ts": "import { run } from '../lib';\nfunction own(a: string, b: string): void {\n  const c = [a, { k: b }];\n  run(c)\n}\nown('x',\n  req.query.z);\nown(1, 2);\n",
        "read.ts": "export function readInput() { return process.argv[2] }\n",
        "both.ts": "import { readInput } from './read';\nimport { run } from './lib';\nconst data = readInput();\nrun(data);\nrun(readInput());\n",
        "decoy.ts": "export function run(cmd: string) { return cmd; }\n",
        "uses_decoy.ts": "import { run } from './decoy';\nrun(process.argv[2]);\n",
        "other.ts": "import { x } from './nowhere';\nrun(process.argv[2]);\n",
        "loose.ts": "launch(process.env.HOME);\n",
        "local.ts": "const go = (s: string) => {\n  eval(s);\n};\nfunction again(s) { if (s) { again(s + 1) } go(s) }\nagain(req.body)\n",
    }
    cross, _ = flows(spark, files)
    assert cross == {
        ("main.ts", 3, "process.argv", "launch"), ("alias.ts", 2, "req.params", "go"), ("sub/deep.ts", 6, "req.query", "own"), ("both.ts", 4, "readInput()", "run"), ("both.ts", 5, "readInput()", "run"),
        ("loose.ts", 1, "process.env", "launch"), ("local.ts", 5, "req.body", "again"),
    }


def test_flows_within_a_file(spark):
    files = {
        "a.ts": "const input = process.argv[2];\nconst copy = input;\neval(copy);\n",
        "b.ts": "const safe = \"literal\";\neval(safe);\n",
        "c.ts": "const input = process.argv[2];\nconst safe = escapeShellArg(input);\nexecSync(safe);\n",
        "d.ts": "let q\nq = `select ${req.body.name}`\ndb.query(q)\ndb.query(escape(q), 1)\n",
        "e.ts": None,
        "f.ts": "}) eval(req.query.a\n",
    }
    _, own = flows(spark, files, interproc.INJECTION)
    assert own == {("a.ts", 3, "process.argv", "eval"), ("d.ts", 3, "req.body", "query"), ("f.ts", 1, "req.query", "eval")}


def test_specifiers_take_the_first_ending(spark):
    asked = spark.createDataFrame([("a/b.ts", "./c"), ("a/b.ts", "../d"), ("a/b.ts", "react"), ("a/b.ts", "./e"), ("b.ts", "../../d"), ("a/b.ts", "./c.js")], "path string, specifier string")
    files = spark.createDataFrame([(x,) for x in ("a/c.tsx", "a/c.js", "d/index.ts", "a/e/index.js", "a/e.ts", "a/c/index.ts")], "path string")
    got = {(r.path, r.specifier): r.target for r in ts.module_specifiers(asked, files).collect()}
    assert got == {("a/b.ts", "./c"): "a/c.tsx", ("a/b.ts", "../d"): "d/index.ts", ("a/b.ts", "./e"): "a/e.ts", ("b.ts", "../../d"): "d/index.ts", ("a/b.ts", "./c.js"): "a/c.js"}


@pytest.mark.parametrize("seed", range(2))
def test_summaries_against_a_plain_evaluation(spark, seed):
    """Random facts: rules applied one by one until nothing is new."""
    import random

    rng = random.Random(seed)
    regions = [f"f{k % 4}#{k}" for k in range(12)] + [f"f{k}#-1" for k in range(4)]
    keys = {r: f"{r.split('#')[0]}#fn{r.split('#')[1]}" for r in regions if not r.endswith("-1")}
    pool = ["x", "y", "z", "@m", *(f"${k}" for k in keys.values())]
    pick = lambda n, *make: list({tuple(m() for m in make) for _ in range(n)})
    any_, name, var = (lambda: rng.choice(regions)), (lambda: rng.choice(pool)), (lambda: rng.choice("xyz"))
    flow, handed = pick(25, any_, var, name), pick(30, any_, lambda: rng.randrange(99), lambda: 1, lambda: "c", lambda: rng.choice(list(keys.values())), lambda: rng.randrange(2), name)
    sunk, given = pick(4, any_, lambda: 1, lambda: "eval", name), pick(8, any_, name)
    params = [(r, k, n) for r in keys for k, n in enumerate("xy")]
    df = lambda rows, shape: spark.createDataFrame(rows, shape)
    f = interproc.Facts(df(flow, "region string, target string, name string"), df(handed, "region string, site int, line int, callee string, key string, pos int, name string"), df(sunk, "region string, line int, sink string, name string"),
                        df(given, "region string, name string"), df(params, "region string, pos int, name string"), df([(r, r.split("#")[0], keys.get(r)) for r in regions], "region string, path string, key string"))
    got = {(r.kind, r.region, r.origin, r.name) for r in interproc.summaries(f).where("name not like '@%' and name not like '$%'").collect()}
    of = {k: r for r, k in keys.items()}
    facts = {("taint", r, f"p{k}", n) for r, k, n in params} | {("taint", r, "m", "@m") for r in regions}
    while True:
        more = set(facts)
        for kind, r, o, x in facts:
            if kind == "taint":
                more |= {("taint", r, o, t) for r2, t, n in flow if (r2, n) == (r, x)} | {("returns", r, o, "") for r2, n in given if (r2, n) == (r, x)}
                if o[0] == "p":
                    more |= {("sink", r, o, f"`eval` in {r.split('#')[0]}") for r2, _, _, n in sunk if (r2, n) == (r, x)}
                    more |= {("sink", r, o, s) for r2, _, _, _, k, j, n in handed if (r2, n) == (r, x) for k2, g, o2, s in facts if k2 == "sink" and (g, o2) == (of[k], f"p{j}")}
            if kind == "returns" and o[0] != "p":
                more |= {("taint", r2, f"{keys[r].split('#')[1]}()", f"${keys[r]}") for r2 in regions if r in keys}
        if more == facts:
            break
        facts = more
    assert got == {x for x in facts if x[3][:1] not in ("@", "$")}
