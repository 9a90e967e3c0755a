"""Taint through calls and files: every function is summed up by which parameters reach a sink and whether it returns data from a source. What names of a
region hold is closed within it first; then each summary is closed over the call graph by a join a round, and calls that hand such data on are the findings.

Facts are keyed by region: a function's body, or a whole file. A name in a region stands for itself; what comes from a source marker, or from a call
of a function at hand, stands for itself under a name of its own (``@marker``, ``$file#function``), so an assignment, an argument and a
return value are all "x holds y". A call of a sanitizer cleans what stands within it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.operators import token_structure as ts
from quartzite.operators.fixpoints import close
from quartzite.operators.shared import cut


@dataclass(frozen=True)
class Config:
    markers: tuple[str, ...]
    sinks: tuple[str, ...]
    sanitizers: tuple[str, ...]


#: The sources, sinks and sanitizers of owasp:cross-file-injection and owasp:injection.
CROSS_FILE = Config(
    ("process.argv", "process.env", "req.query", "req.body", "req.params", "sys.argv", "os.Args"),
    ("eval", "exec", "execSync", "spawn", "spawnSync", "system", "popen", "query", "Command::new"),
    ("escape", "escapeShellArg"),
)
_WEB = ("process.argv", "req.query", "req.body", "req.params")
INJECTION = Config(_WEB, ("eval", "Function", "exec", "execSync", "query"), ("escape", "escapeShellArg"))
#: Rules on flows within a file of TypeScript; all are blocking vulnerabilities of 10 minutes.
SOURCE_SINK = {
    "owasp:injection": INJECTION,
    "owasp:path-traversal": Config(_WEB, ("readFile", "readFileSync", "writeFile", "writeFileSync", "unlink", "unlinkSync", "open", "openSync", "createReadStream", "createWriteStream"), ("basename", "sanitize")),
    "owasp:ssrf": Config(_WEB, ("fetch", "request", "axios.get", "axios.post", "http.get", "http.request", "https.get", "https.request", "got", "superagent"), ("sanitize", "isAllowedHost")),
    "owasp:xss": Config((*_WEB, "location.hash", "location.search"), ("write", "insertAdjacentHTML", "html"), ("sanitize", "escapeHtml", "encodeURIComponent")),
}


@dataclass(frozen=True)
class Facts:
    """flow: region, target, name | handed: region, site, line, callee, pos, name (callee: its key) | sunk: region, line, sink, name |
    given: region, name (returned) | params: region, pos, name | regions: region, path, key (of the function; null: a file)."""

    flow: DataFrame
    handed: DataFrame
    sunk: DataFrame
    given: DataFrame
    params: DataFrame
    regions: DataFrame


@dataclass(frozen=True)
class Parsed:
    """What the facts of any rule are made from: tokens, brackets, functions, calls with their resolved callees, brackets around each, regions."""

    placed: DataFrame
    brackets: DataFrame
    functions: DataFrame
    calls: DataFrame
    up: DataFrame
    within: DataFrame
    regions: DataFrame


def _region(path: str | Column, at: Column) -> Column:
    return F.concat_ws("#", path, at.cast("string"))


def parse(files: DataFrame) -> Parsed:
    """``files``: path, language, content; languages with braces."""
    p = cut(ts.placed(ts.tokens(files)))
    b = cut(ts.brackets(p))
    fns = cut(ts.functions(b))
    calls = cut(ts.calls(b, fns))
    up = cut(ts.chains(b))
    key = lambda path, name: F.concat(path, F.lit("#"), name)
    paths = files.select(F.col("path").cast("string").alias("path")).distinct()
    bodies = fns.where("name is not null").select("path", F.col("body").alias("above"), "name")
    within = up.join(bodies, ["path", "above"]).select("path", "b", _region("path", F.col("above")).alias("region"))
    within = cut(within.unionByName(up.select("path", "b").distinct().select("path", "b", _region("path", F.lit(ts.FILE)).alias("region"))))  # the regions that each bracket lies in
    names = bodies.select(_region("path", F.col("above")).alias("region"), "path", key(F.col("path"), F.col("name")).alias("key"))
    regions = cut(names.unionByName(paths.select(_region("path", F.lit(ts.FILE)).alias("region"), "path", F.lit(None).cast("string").alias("key"))))

    # callees: what an import names, else a function of the file, else, where a file imports nothing, the first of that name anywhere
    bound, importing = ts.import_bindings(p, paths)
    own = bodies.select("path", F.col("name").alias("callee"), key(F.col("path"), F.col("name")).alias("own")).distinct()
    first = bodies.groupBy(F.col("name").alias("callee")).agg(F.min_by(key(F.col("path"), F.col("name")), F.struct("path", "above")).alias("first"))
    resolved = (
        calls.join(bound.select("path", F.col("local").alias("callee"), key(F.col("target"), F.col("exported")).alias("bound")), ["path", "callee"], "left")
        .join(own, ["path", "callee"], "left").join(importing.withColumn("imports", F.lit(True)), "path", "left").join(first, "callee", "left")
        .withColumn("key", F.coalesce("bound", "own", F.when(F.col("imports").isNull(), F.col("first"))))
    )
    return Parsed(p, b, fns, cut(resolved.select("path", "b", "callee", "whole", "line", "enc", "seg", "key")), up, within, regions)


def facts(files: DataFrame | Parsed, config: Config, whole: bool = False) -> Facts:
    """The facts of ``files`` (path, language, content), or of what ``parse`` made of them, under the names of a rule. With ``whole`` only those of whole files
    are made, flow and sunk; the other relations are left unwritten."""
    parsed = files if isinstance(files, Parsed) else parse(files)
    p, b, fns, resolved, up, within = parsed.placed, parsed.brackets, parsed.functions, parsed.calls, parsed.up, parsed.within
    calls = resolved
    fits = lambda words: F.col("callee").isin(*words) | F.col("whole").isin(*words)
    # the depth of the innermost sanitizer's bracket around each bracket
    clean = calls.where(fits(config.sanitizers)).select("path", F.col("b").alias("above")).join(b.select("path", F.col("b").alias("above"), "depth"), ["path", "above"])
    clean = up.join(clean, ["path", "above"]).groupBy("path", "b").agg(F.max("depth").alias("clean"))

    # what can hold taint: names, markers, calls of functions at hand
    word = p.where(ts.is_name(F.col("text"), F.col("kind")))
    plain = word.where(~F.coalesce(F.col("p1").isin(".", "?."), F.lit(False))).select("path", "i", "enc", "seg", F.col("text").alias("name"))
    marked = word.where(F.concat("p2", "p1", "text").isin(*config.markers)).select("path", "i", "enc", "seg", F.concat(F.lit("@"), "p2", "p1", "text").alias("name"))
    result = resolved.where("key is not null").select("path", F.col("b").alias("i"), "enc", "seg", F.concat(F.lit("$"), "key").alias("name"))
    items = plain.unionByName(marked).unionByName(result).join(clean.withColumnRenamed("b", "enc"), ["path", "enc"], "left").withColumn("clean", F.coalesce("clean", F.lit(0)))
    sanitizer = calls.where(fits(config.sanitizers)).select("path", F.col("b").alias("i"))
    items = items.join(sanitizer, ["path", "i"], "left_anti")
    # at its own place and at that of every bracket around it
    places = up.join(b.select("path", F.col("b").alias("above"), F.col("enc").alias("s_enc"), F.col("seg").alias("s_seg"), F.col("depth").alias("d")), ["path", "above"])
    places = places.select("path", F.col("b").alias("enc"), "above", "s_enc", "s_seg", (F.col("d") - 1).alias("d"))
    deep = items.join(places, ["path", "enc"]).select("path", "i", "name", "clean", F.col("s_enc").alias("enc"), F.col("s_seg").alias("seg"), "d")
    level = b.select("path", F.col("b").alias("enc"), F.col("depth").alias("d"))
    flat = items.join(level, ["path", "enc"], "left").select("path", "i", "name", "clean", "enc", "seg", F.coalesce("d", F.lit(0)).alias("d"))
    held = cut(flat.unionByName(deep).where("clean <= d").select("path", "enc", "seg", "i", "name"))  # no sanitizer between the place and what it holds

    equals = p.where((F.col("kind") == "op") & F.col("text").isin(*ts.ASSIGNS)).groupBy("path", "enc", "seg").agg(F.min("i").alias("eq"))
    firsts = p.where("kind = 'word' and text not in ('const', 'let', 'var', 'export', 'public', 'private', 'static', 'readonly')").groupBy("path", "enc", "seg").agg(F.min_by(F.struct("i", "text", "n1"), "i").alias("f"))
    targets = equals.join(firsts, ["path", "enc", "seg"]).where(F.col("f.n1").isin(*ts.ASSIGNS, ":") & (F.col("f.i") < F.col("eq"))).select("path", "enc", "seg", "eq", F.col("f.text").alias("target"))
    flow = held.join(targets, ["path", "enc", "seg"]).where("i > eq").select("path", "enc", "target", "name")
    returns = p.where("text = 'return' and kind = 'word'").select("path", "enc", "seg", F.col("i").alias("at"))
    given = held.join(returns, ["path", "enc", "seg"]).where("i > at").select("path", "enc", "name")
    args = resolved.select("path", F.col("b").alias("enc"), "callee", "whole", "line", "key", F.col("enc").alias("outer"))
    args = held.join(args, ["path", "enc"]).select("path", "enc", F.col("seg").cast("int").alias("pos"), "callee", "whole", "line", "key", "name")
    of_file = lambda df, *cols: df.select(_region("path", F.lit(ts.FILE)).alias("region"), *cols).distinct()
    of_all = lambda df, *cols: df.join(within.withColumnRenamed("b", "enc"), ["path", "enc"]).select("region", *cols).distinct()
    here = (lambda *a: cut(of_file(*a))) if whole else (lambda *a: cut(of_all(*a)))
    more = of_all if whole else here
    params = ts.parameters(p, fns).select(_region("path", F.col("body")).alias("region"), "pos", "name")
    return Facts(
        here(flow, "target", "name"),
        more(args.where("key is not null"), F.col("enc").alias("site"), "line", "callee", "key", "pos", "name"),
        here(args.where(fits(config.sinks)), "line", F.col("callee").alias("sink"), "name"),
        more(given, "name"),
        params if whole else cut(params),
        parsed.regions,
    )


def summaries(f: Facts) -> DataFrame:
    """``kind, region, origin, name`` closed over calls. taint: the name holds the origin; sink: the origin, a parameter, reaches the sink ``name``;
    returns: the region returns the origin. An origin is ``p<place>`` or a source. First what each name may hold, calls as they are (``via``: the key of
    the function); then which functions return a source, so which calls are one; then which parameters reach a sink, from callee to caller."""
    seen = f.flow.select("region", "name").union(f.handed.select("region", "name")).union(f.sunk.select("region", "name")).union(f.given).distinct()
    keyed = f.regions.where("key is not null").select(F.col("region").alias("of"), "key")
    row = lambda df, origin, via=F.lit(""): df.select("region", origin.alias("origin"), via.alias("via"), "name")
    called = F.substring("name", 2, 10_000)
    start = row(f.params, F.concat(F.lit("p"), F.col("pos"))).union(row(seen.where(F.col("name").startswith("@")), F.substring("name", 2, 1000)))
    start = start.union(row(seen.where(F.col("name").startswith("$")), F.concat(F.substring_index(called, "#", -1), F.lit("()")), called))
    flow = f.flow.select("region", "name", "target")
    held = close(start, lambda new, _: new.join(flow, ["region", "name"]).select("region", "origin", "via", F.col("target").alias("name")))
    param = F.col("origin").rlike("^p[0-9]+$")

    gave = cut(held.join(f.given, ["region", "name"]).select("region", "origin", "via").distinct())
    passed = cut(gave.where("via <> ''").join(keyed.withColumnRenamed("key", "via"), "via").select("of", "region").distinct())
    first = gave.where(F.col("via") == "").where(~param).select(F.col("region").alias("of"))
    back = close(first, lambda new, _: new.join(passed, "of").select(F.col("region").alias("of")))
    alive = cut(keyed.join(back, "of", "left_semi").select(F.col("key").alias("via")).distinct().union(keyed.sparkSession.createDataFrame([("",)], "via string")))

    mine = cut(held.where(param).select("region", "origin", "name").distinct())
    sunk = mine.join(f.sunk, ["region", "name"]).select("region", "origin", F.concat_ws(" in ", F.concat(F.lit("`"), "sink", F.lit("`")), F.substring_index("region", "#", 1)).alias("name"))
    handed = f.handed.join(keyed, "key").select("region", "of", F.concat(F.lit("p"), F.col("pos")).alias("place"), "name").distinct()
    through = cut(mine.join(handed, ["region", "name"]).select("region", "origin", "of", "place").distinct())
    sinks = close(sunk, lambda new, _: new.select(F.col("region").alias("of"), F.col("origin").alias("place"), "name").join(through, ["of", "place"]).select("region", "origin", "name"))

    kind = lambda k, df, name: df.select(F.lit(k).alias("kind"), "region", "origin", name.alias("name"))
    taint = kind("taint", held.join(alive, "via", "left_semi"), F.col("name")).distinct()
    return taint.union(kind("sink", sinks, F.col("name"))).union(kind("returns", gave.join(alive, "via", "left_semi"), F.lit("")).distinct())


def cross_file_flows(f: Facts, closed: DataFrame | None = None) -> DataFrame:
    """``path, line, source, callee, sink``: calls, anywhere in a file, that hand data from a source to a parameter that reaches a sink."""
    s = closed if closed is not None else summaries(f)
    whole = f.regions.where("key is null").select("region", "path")
    t = s.where("kind = 'taint'").select("region", F.col("origin").alias("source"), "name").join(whole, "region")
    keyed = f.regions.where("key is not null").select(F.col("region").alias("of"), "key")
    sink = s.where("kind = 'sink'").select(F.col("region").alias("of"), F.col("origin").alias("place"), F.col("name").alias("sink"))
    asked = f.handed.join(keyed, "key").withColumn("place", F.concat(F.lit("p"), "pos"))
    return t.join(asked, ["region", "name"]).join(sink, ["of", "place"]).select("path", "line", "source", "callee", "sink").distinct()


def _within_files(flow: DataFrame, sunk: DataFrame, *by: str) -> DataFrame:
    """``by, region, line, source, sink``: data from a source that reaches a sink through assignments of a file. ``by`` tells apart facts of several rules."""
    seen = flow.select(*by, "region", "name").union(sunk.select(*by, "region", "name")).where(F.col("name").startswith("@")).distinct()
    start = seen.select(*by, "region", "name", F.substring("name", 2, 1000).alias("source"))
    t = close(start, lambda new, _: new.join(flow, [*by, "region", "name"]).select(*by, "region", F.col("target").alias("name"), "source"))
    return t.join(sunk, [*by, "region", "name"]).select(*by, "region", "line", "source", "sink").distinct()


def injections(f: Facts) -> DataFrame:
    """``path, line, source, sink``: data from a source that reaches a sink within a file, through assignments only."""
    whole = f.regions.where("key is null").select("region", "path")
    found = _within_files(f.flow.join(whole, "region", "left_semi"), f.sunk.join(whole, "region", "left_semi"))
    return found.join(whole, "region").select("path", "line", "source", "sink").distinct()


def source_sink_findings(files: DataFrame) -> DataFrame:
    """``rule_id, path, line, source, sink, severity, issue_type, effort`` of the rules in SOURCE_SINK on files of TypeScript (path, language, content).
    Text is cut into tokens once for all, and the facts of all rules are closed together."""
    parsed = parse(files.where("language = 'typescript'"))
    flows, sunks = [], []
    for rule, config in SOURCE_SINK.items():
        f = facts(parsed, config, whole=True)
        flows.append(f.flow.withColumn("rule_id", F.lit(rule)))
        sunks.append(f.sunk.withColumn("rule_id", F.lit(rule)))
    out = _within_files(reduce(DataFrame.unionByName, flows), reduce(DataFrame.unionByName, sunks), "rule_id")
    out = out.join(parsed.regions.where("key is null").select("region", "path"), "region")
    return out.select("rule_id", "path", "line", "source", "sink", F.lit("Blocker").alias("severity"), F.lit("Vulnerability").alias("issue_type"), F.lit(10).alias("effort")).distinct()
