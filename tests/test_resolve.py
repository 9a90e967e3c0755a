"""Import resolution and project files."""

from quartzite.operators import resolve
from quartzite.sources import config


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b/index.tsx", "src/c.js", "lib/u.ts", "pkg/__init__.py", "pkg/m.py", "pkg/s/n.py", "x/y/z/q.go", "z/q.go", "k/src/lib.rs", "k/src/a.rs", "k/src/a/b.rs")], "path string")
    i = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "./c.js"), ("src/b/index.tsx", "../a"), ("src/a.ts", "@lib/u"), ("src/a.ts", "react")], "importer string, specifier string")
    alias = spark.createDataFrame([("@lib/", "lib")], "prefix string, directory string")
    got = pairs(resolve.resolve_ts(i, files, alias), "importer", "specifier", "target")
    assert got == {("src/a.ts", "./b", "src/b/index.tsx"), ("src/a.ts", "./c.js", "src/c.js"), ("src/b/index.tsx", "../a", "src/a.ts"), ("src/a.ts", "@lib/u", "lib/u.ts")}
    p = spark.createDataFrame([("pkg/s/n.py", "..m", "f"), ("pkg/m.py", ".", "s"), ("pkg/s/n.py", "pkg.m", "f"), ("pkg/s/n.py", "..", "m"), ("pkg/m.py", "os", "x")], "importer string, module string, name string")
    got = pairs(resolve.resolve_python(p, files), "importer", "module", "target")
    assert got == {("pkg/s/n.py", "..m", "pkg/m.py"), ("pkg/s/n.py", "pkg.m", "pkg/m.py"), ("pkg/s/n.py", "..", "pkg/m.py"), ("pkg/m.py", ".", "pkg/__init__.py")}
    g = spark.createDataFrame([("m.go", "example.com/x/y/z"), ("m.go", "fmt")], "importer string, specifier string")
    assert pairs(resolve.resolve_go(g, files), "specifier", "target") == {("example.com/x/y/z", "x/y/z/q.go")}
    r = spark.createDataFrame([("k/src/lib.rs", "crate::a::b::T"), ("k/src/a/b.rs", "super::X"), ("k/src/a.rs", "self::b::f"), ("k/src/a.rs", "std::io")], "importer string, specifier string")
    assert pairs(resolve.resolve_rust(r, files), "specifier", "target") == {("crate::a::b::T", "k/src/a/b.rs"), ("super::X", "k/src/a.rs"), ("self::b::f", "k/src/a/b.rs")}


def test_project_files(spark, tmp_path):
    (tmp_path / "quartzite.toml").write_text('[[rules.custom]]\nid = "my:r"\npattern = "x+"\n[[rules.custom]]\nid = "my:bad"\npattern = "("\n[gate]\nconditions = [{metric = "blocker", op = ">", threshold = 2}]')
    c = config.load_project(str(tmp_path))
    assert [r.rule_id for r in config.custom_rules(c)] == ["my:r"] and config.gate_conditions(spark, c).first().threshold == 2.0
    assert config.gate_conditions(spark, {}).count() == 6 and config.load_project(str(tmp_path / "none")) == {}
    (tmp_path / "base.json").write_text('{"compilerOptions": {"paths": {"@a/*": ["src/a/*"]}}}')
    (tmp_path / "tsconfig.json").write_text('// c\n{"extends": "./base.json", "compilerOptions": {"baseUrl": ".", "paths": {"@b/*": ["src/b/*"]}}}'.replace("// c\n", "  // c\n"))
    assert pairs(config.ts_aliases(spark, str(tmp_path)), "prefix", "directory") == {("@a/", "src/a"), ("@b/", "src/b")}
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "Cargo.toml").write_text('[package]\nname = "my-crate"')
    assert config.rust_crates(str(tmp_path)) == {"my_crate": "k"}
    assert config.exit_code(4, 3, False, 90, None) == 3 and config.exit_code(1, 3, False, 90, 80) == 0 and config.exit_code(None, None, True, None, None) == 3
