"""Queries on source text made from the conversations at hand: each is a module whose shape its turns decide, so the text grows with the table, and
the SQL states the result from the same numbers without reading any text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzite.operators import dataflow, findings, incremental, interproc, judge, registered_flows, scopes
from quartzite.operators.shared import cut, folder
from quartzite.plans.bindings import FOUND_SQL, RULES, function_lines, table
from quartzite.plans.catalog import query


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each conversation: how many turns it has, and the total, greatest and least length of their texts."""
    c = table(spark, d, "conversations").where("conv_id is not null")
    n = F.length("text")
    rows = c.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.max(n).alias("longest"), F.min(n).alias("shortest"))
    return rows.select("c", "n", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("total", "longest", "shortest")))


def modules(spark: SparkSession, d: str) -> DataFrame:
    """Module c imports module c/2, hands its parameters on to it, perhaps washed or swapped, and may run a command with them."""
    c = F.col("c").cast("string")
    up = F.floor(F.col("c") / 2).cast("long").cast("string")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    if_ = lambda cond, then, other="": F.when(cond, then).otherwise(F.lit(other))
    pick = lambda col, *options: F.get(F.array(*(F.lit(o) if isinstance(o, str) else o for o in options)), (F.col(col) % len(options)).cast("int"))
    has = F.col("c") > 0
    read = F.when(F.col("total") % 5 == 0, F.lit("req.body.x")).when(has, text("read", up, "()")).otherwise(F.lit("'x'"))
    start = pick("shortest", text("const q = req.query.id; run", c, "(q, 'safe');"), text("run", c, "(read", c, "(), 'safe');"), text("const q = process.argv[2]; const w = q; ", pick("n", "cp.execSync(w, escape(q));", "fs.readFile(w, basename(q));", "fetch(w + isAllowedHost(q));", "document.write(w);")))
    body = text(
        if_(has, text("import { run", up, ", read", up, " } from './m", up, "';")), "\n", start, "\nexport function run", c, "(a: string, b: string) {\n  const v = ", pick("total", "a", "b", "escape(a)", "`x ${a} y`"), ";\n",
        if_(F.col("n") % 3 == 0, F.lit("  cp.execSync(v);\n")), if_(has, text("  run", up, "(v, ", pick("longest", "b", "a"), ");\n")), "}\nexport function read", c, "() {\n  return ", read, ";\n}\n",
    )
    return shapes(spark, d).select(text("m", c, ".ts").alias("path"), F.lit("typescript").alias("language"), body.alias("content"))


_SHAPE_SQL = """m AS (SELECT conv_id AS c, count(*) AS n, coalesce(sum(length(text)), 0) AS total, coalesce(max(length(text)), 0) AS longest, coalesce(min(length(text)), 0) AS shortest
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)"""


@query(f"""WITH RECURSIVE {_SHAPE_SQL},
src(c, k, hit) AS (SELECT c, c, total % 5 = 0 FROM m UNION ALL SELECT s.c, m.c, m.total % 5 = 0 FROM src s JOIN m ON m.c = s.k // 2 WHERE NOT hit AND s.k > 0),
reads AS (SELECT c, bool_or(hit) AS source FROM src GROUP BY c),
walk(c, k, a, b) AS (SELECT m.c, m.c, true, false FROM m JOIN reads USING (c) WHERE shortest % 3 = 0 OR (shortest % 3 = 1 AND source)
  UNION ALL SELECT w.c, up.c, CASE m.total % 4 WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN false ELSE a END, CASE m.longest % 2 WHEN 0 THEN b ELSE a END FROM walk w JOIN m ON m.c = w.k JOIN m up ON up.c = w.k // 2 WHERE w.k > 0 AND (a OR b))
SELECT DISTINCT 'm' || w.c || '.ts' AS path, 2 AS line, CASE own.shortest % 3 WHEN 0 THEN 'req.query' ELSE 'read' || w.c || '()' END AS source, 'run' || w.c AS callee, '`execSync` in m' || w.k || '.ts' AS sink
FROM walk w JOIN m ON m.c = w.k JOIN m own ON own.c = w.c WHERE m.n % 3 = 0 AND CASE m.total % 4 WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN false ELSE a END""")
def cross_file_taint(spark, d):
    return interproc.cross_file_flows(interproc.facts(modules(spark, d), interproc.CROSS_FILE))


@query(f"WITH {_SHAPE_SQL} SELECT 'm' || c || '.ts' AS path, 2 AS line, 'process.argv' AS source, 'execSync' AS sink FROM m WHERE shortest % 3 = 2 AND n % 4 = 0")
def injection_flows(spark, d):
    return interproc.injections(interproc.facts(modules(spark, d), interproc.INJECTION, whole=True))


@query(f"""WITH {_SHAPE_SQL} SELECT ['owasp:injection', 'owasp:path-traversal', 'owasp:ssrf', 'owasp:xss'][n % 4 + 1] AS rule_id, 'm' || c || '.ts' AS path, 2 AS line, 'process.argv' AS source,
['execSync', 'readFile', 'fetch', 'write'][n % 4 + 1] AS sink, 'Blocker' AS severity, 'Vulnerability' AS issue_type, 10 AS effort FROM m WHERE shortest % 3 = 2""")
def source_sink_rules(spark, d):
    return interproc.source_sink_findings(modules(spark, d))


def nested(spark: SparkSession, d: str) -> DataFrame:
    """A function for each conversation, in which each turn opens a block, or a closure, within the one before, declares a name and uses all."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    t = table(spark, d, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("c"), F.row_number().over(order).alias("at"), size.alias("n"))
    own, other = (F.concat(F.lit("x"), ((F.col("n") + k) % 3).cast("string")) for k in (0, 1))
    opened = F.when(F.col("n") % 2 == 1, F.concat(F.lit("const g"), F.col("at").cast("string"), F.lit(" = () => { "))).otherwise("{ ")
    line = F.concat(opened, F.lit("let "), own, F.lit(" = "), other, F.lit("; use(x0, x1, x2);"))
    whole = t.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("l"))
    name = F.col("c").cast("string")
    text = F.concat(F.lit("function f"), name, F.lit("(x0, { x1, k: x2 }) {\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"), F.expr("repeat('}', size(l) + 1)"))
    return whole.select(F.concat(F.lit("f"), name, F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), text.alias("content"))


@query("""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p, coalesce(length(text), 0) AS n FROM conversations WHERE conv_id IS NOT NULL),
ref AS (SELECT c, p, k FROM t, range(3) r(k) UNION ALL SELECT c, p, (n + 1) % 3 FROM t),
u AS (SELECT c, p, k, count(*) AS times FROM ref GROUP BY ALL),
seen AS (SELECT u.*, coalesce((SELECT max(p) FROM t WHERE t.c = u.c AND t.p <= u.p AND t.n % 3 = u.k), 0) AS bound, coalesce((SELECT max(p) FROM t WHERE t.c = u.c AND t.p <= u.p AND t.n % 2 = 1), 0) AS closure FROM u)
SELECT 'f' || c || '.ts' AS path, p + 1 AS line, 'x' || k AS name, bound + 1 AS bound_line, bound < closure AS captured, times FROM seen""")
def scope_resolution(spark, d):
    r = scopes.resolved(scopes.structure(nested(spark, d))).where("name rlike '^x[0-9]$'")
    return r.groupBy("path", F.col("line").cast("long").alias("line"), "name", F.col("bound_line").cast("long").alias("bound_line"), "captured").agg(F.count("*").alias("times"))


@query("""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p, coalesce(length(text), 0) AS n FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT c, p, k, coalesce((SELECT max(p) FROM t s WHERE s.c = t.c AND s.p <= t.p AND s.n % 3 = k), 0) AS bound FROM t, range(3) r(k)),
fn AS (SELECT c, p FROM t WHERE n % 2 = 1)
SELECT 'f' || fn.c || '.ts' AS path, fn.p + 1 AS line, count(DISTINCT k) AS free FROM fn JOIN u ON u.c = fn.c AND u.p >= fn.p AND u.bound < fn.p GROUP BY ALL""")
def free_variables(spark, d):
    s = scopes.structure(nested(spark, d))
    free = scopes.free_names(s, scopes.resolved(s)).where("name rlike '^x[0-9]$'")
    lines = s.functions.select("path", "body", F.col("line").cast("long").alias("line"))
    return free.join(lines, ["path", "body"]).groupBy("path", "line").agg(F.count("*").alias("free"))


def control_flow(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each conversation as a function: turn p goes on to 2p and 2p + 1, to the exit 0 where there are none, back to p / 2 or over to p + 1 as
    its text's length decides; it defines one of three names. Edges ``g, src, dst`` and blocks ``g, block, name, text``."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, d, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("g"), F.row_number().over(order).cast("long").alias("block"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    t = t.withColumn("last", F.count("*").over(Window.partitionBy("g")))
    p, leaf = F.col("block"), 2 * F.col("block") > F.col("last")
    to = [F.when(2 * p <= F.col("last"), 2 * p), F.when(2 * p + 1 <= F.col("last"), 2 * p + 1), F.when(leaf, 0), F.when(leaf & (F.col("n") % 5 == 0) & (p > 1), F.floor(p / 2)), F.when((F.col("n") % 7 == 0) & (p < F.col("last")), p + 1)]
    edges = t.select("g", p.alias("src"), F.explode(F.array_compact(F.array(*(x.cast("long") for x in to)))).alias("dst")).distinct()
    blocks = t.select("g", "block", F.concat(F.lit("v"), (F.col("n") % 3).cast("string")).alias("name"), F.concat(F.lit("v"), (F.col("n") % 3).cast("string"), F.lit(" = v"), (F.col("n") % 2).cast("string"), F.when(F.col("n") % 4 == 0, "_propagated").otherwise("")).alias("text"), "last")
    return edges, blocks


_CFG_SQL = """t AS (SELECT conv_id AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p, coalesce(length(text), 0) AS n, count(*) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE conv_id IS NOT NULL),
edge AS (SELECT g, p AS src, 2 * p AS dst FROM t WHERE 2 * p <= last UNION SELECT g, p, 2 * p + 1 FROM t WHERE 2 * p + 1 <= last UNION SELECT g, p, 0 FROM t WHERE 2 * p > last UNION SELECT g, p, p // 2 FROM t WHERE 2 * p > last AND n % 5 = 0 AND p > 1
  UNION SELECT g, p, p + 1 FROM t WHERE n % 7 = 0 AND p < last),
def AS (SELECT g, p AS block, 'v' || (n % 3) AS name FROM t)"""
#: Dominance by what can be reached without a block.
_DOM_SQL = """node AS (SELECT g, p AS b FROM t UNION SELECT g, 0 FROM t),
avoid(g, d, b) AS (SELECT g, b, 1 FROM node WHERE b <> 1 UNION SELECT a.g, a.d, e.dst FROM avoid a JOIN edge e ON e.g = a.g AND e.src = a.b AND e.dst <> a.d),
dom AS (SELECT x.g, x.b, y.b AS d FROM node x JOIN node y USING (g) WHERE x.b = y.b OR NOT EXISTS (FROM avoid a WHERE a.g = x.g AND a.d = y.b AND a.b = x.b)),
frontier AS (SELECT DISTINCT e.g, dom.d AS x, e.dst AS y FROM edge e JOIN dom ON dom.g = e.g AND dom.b = e.src WHERE NOT EXISTS (FROM dom s WHERE s.g = e.g AND s.b = e.dst AND s.d = dom.d AND s.d <> s.b))"""
_CONTROL_SQL = """node AS (SELECT g, p AS b FROM t UNION SELECT g, 0 FROM t),
avoid(g, d, b) AS (SELECT g, b, 0 FROM node WHERE b <> 0 UNION SELECT a.g, a.d, e.src FROM avoid a JOIN edge e ON e.g = a.g AND e.dst = a.b AND e.src <> a.d),
post AS (SELECT x.g, x.b, y.b AS d FROM node x JOIN node y USING (g) WHERE x.b = y.b OR NOT EXISTS (FROM avoid a WHERE a.g = x.g AND a.d = y.b AND a.b = x.b)),
control AS (SELECT DISTINCT e.g, d AS dependent, e.src AS controller FROM edge e JOIN post ON post.g = e.g AND post.b = e.dst WHERE NOT EXISTS (FROM post s WHERE s.g = e.g AND s.b = e.src AND s.d = post.d AND s.d <> s.b))"""


@query(f"""WITH RECURSIVE {_CFG_SQL},
held(g, block, name, origin) AS (SELECT edge.g, dst, name, src FROM edge JOIN def ON def.g = edge.g AND def.block = edge.src
  UNION SELECT h.g, e.dst, h.name, h.origin FROM held h JOIN edge e ON e.g = h.g AND e.src = h.block WHERE NOT EXISTS (FROM def WHERE def.g = h.g AND def.block = h.block AND def.name = h.name))
SELECT g, block, name, origin FROM held""")
def reaching_definitions(spark, d):
    edges, blocks = control_flow(spark, d)
    return dataflow.reaching_definitions(edges, blocks)


@query(f"""WITH RECURSIVE {_CFG_SQL}, {_DOM_SQL}, size AS (SELECT g, b, count(*) AS n FROM dom GROUP BY ALL)
SELECT dom.g, dom.b AS block, arg_max(dom.d, n) AS idom FROM dom JOIN size ON size.g = dom.g AND size.b = dom.d WHERE dom.d <> dom.b GROUP BY ALL""")
def immediate_dominators(spark, d):
    edges, blocks = control_flow(spark, d)
    return dataflow.immediate(dataflow.dominators(edges, blocks.where("block = 1")))


@query(f"""WITH RECURSIVE {_CFG_SQL}, {_DOM_SQL},
phi(g, block, name) AS (SELECT f.g, y, name FROM frontier f JOIN def ON def.g = f.g AND def.block = f.x UNION SELECT p.g, f.y, p.name FROM phi p JOIN frontier f ON f.g = p.g AND f.x = p.block)
SELECT g, block, name FROM phi""")
def phi_nodes(spark, d):
    edges, blocks = control_flow(spark, d)
    doms = dataflow.dominators(edges, blocks.where("block = 1"))
    return dataflow.phi_nodes(cut(dataflow.frontiers(edges, doms)), blocks)


@query(f"""WITH RECURSIVE {_CFG_SQL}, {_CONTROL_SQL},
slice(g, criterion, block) AS (SELECT g, last, last FROM t WHERE p = 1 UNION SELECT s.g, s.criterion, x.b FROM slice s JOIN (SELECT edge.g, dst AS a, src AS b FROM edge JOIN def ON def.g = edge.g AND def.block = edge.src AND name = 'v0' UNION SELECT g, dependent, controller FROM control) x ON x.g = s.g AND x.a = s.block)
SELECT g, criterion, 'v0' AS name, block FROM slice""")
def program_slices(spark, d):
    """The slice of name v0 at the last block of each function."""
    edges, blocks = control_flow(spark, d)
    control = cut(dataflow.control_dependence(edges, blocks.select("g", F.lit(0).cast("long").alias("block")).distinct()))
    criteria = blocks.where("block = last").select("g", F.col("block").alias("criterion"), F.lit("v0").alias("name"))
    return dataflow.backward_slices(edges, control, blocks, criteria)


@query(f"""WITH RECURSIVE {_CFG_SQL}, body AS (SELECT g, p AS block, 'v' || (n % 3) || ' = v' || (n % 2) || CASE WHEN n % 4 = 0 THEN '_propagated' ELSE '' END AS text FROM t),
reach(g, block, fact) AS (SELECT g, CAST(1 AS BIGINT), unnest([NULL, 'v0', 'v1']) FROM t WHERE p = 1
  UNION SELECT r.g, e.dst, CASE WHEN k = 0 THEN fact ELSE fact || '_propagated' END FROM reach r JOIN edge e ON e.g = r.g AND e.src = r.block LEFT JOIN body b ON b.g = r.g AND b.block = r.block, range(2) z(k) WHERE k = 0 OR contains(b.text, fact))
SELECT g, block, fact FROM reach""")
def exploded_facts(spark, d):
    edges, blocks = control_flow(spark, d)
    seeds = blocks.where("block = 1").select("g", "block", F.explode(F.array(F.lit("v0"), F.lit("v1"))).alias("fact"))
    return dataflow.exploded_reach(edges, blocks, seeds)


def line_analysis(lacking: DataFrame) -> DataFrame:
    """What the line rules find in each content."""
    hits = findings.line_findings(findings.source_lines(lacking, "content_key", "content"), RULES)
    return hits.groupBy(F.col("path").alias("content_key")).agg(F.collect_list(F.struct("rule_id", "line")).alias("results"))


@query(f"""WITH {FOUND_SQL}, before AS (SELECT DISTINCT CASE WHEN n_chars % 2 = 1 THEN regexp_replace(coalesce(text, ''), '\n[^\n]*$', '') ELSE coalesce(text, '') END AS text FROM documents)
SELECT doc_id AS path, coalesce(text, '') IN (SELECT text FROM before) AS hit, coalesce(n, 0) AS findings FROM documents LEFT JOIN (SELECT path, count(*) AS n FROM found GROUP BY path) f ON f.path = doc_id""")
def incremental_findings(spark, d):
    """The documents analysed after an earlier state of them, in which every other one lacked its last line: what didn't change is taken from the store."""
    store = incremental.Store(spark, f"{folder(spark)}/analysis-{uuid.uuid4().hex}", T.ArrayType(T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("line", T.LongType())])))
    now = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"), "n_chars")
    before = now.withColumn("content", F.when(F.col("n_chars") % 2 == 1, F.regexp_replace(F.coalesce("content", F.lit("")), "\n[^\n]*$", "")).otherwise(F.col("content")))
    incremental.analyse(before, store, "line-rules", line_analysis)
    out = incremental.analyse(now, store, "line-rules", line_analysis)
    return out.select("path", "hit", F.size("results").cast("long").alias("findings"))


@query("""WITH e AS (SELECT *, user_id || '/' || CAST(floor(value) AS BIGINT) % 2 AS token, event_type IN ('click', 'purchase') AS soft, event_type = 'error' OR (event_type = 'purchase' AND value >= 50) AS hard FROM events),
a AS (SELECT *, lag(event_type) OVER (PARTITION BY token ORDER BY ts, event_type <> 'signup', event_id) AS last FROM e WHERE event_type = 'signup' OR (soft AND NOT hard))
SELECT e.event_id AS write, CASE WHEN e.hard THEN 'deny' WHEN NOT e.soft THEN 'allow' WHEN a.last = 'signup' THEN 'approved' ELSE 'escalate' END AS verdict FROM e LEFT JOIN a USING (event_id) WHERE e.event_type <> 'signup'""")
def judged_writes(spark, d):
    """Events as writes; signups as approvals. Purchases break a denying rule, unless their old content did already (value under 50)."""
    e = table(spark, d, "events").select(F.col("event_id").alias("write"), F.col("ts").alias("seq"), F.concat(F.col("user_id").cast("string"), F.lit("/"), (F.floor("value") % 2).cast("string")).alias("token"), "event_type", "value")
    kinds = F.when(F.col("event_type") == "error", F.array(F.lit("Deny"))).when(F.col("event_type") == "click", F.array(F.lit("Escalate"))).when(F.col("event_type") == "purchase", F.array(F.lit("Deny"), F.lit("Escalate"))).otherwise(F.array(F.lit("Warn")))
    found = e.select("write", F.explode(kinds).alias("enforcement"), "event_type", "value").withColumn("rule_id", F.concat(F.lit("policy:"), F.lower("enforcement"))).withColumn("message", F.col("event_type"))
    before = found.where("event_type = 'purchase' and enforcement = 'Deny' and value < 50")
    new = judge.new_violations(found.select("write", "rule_id", "message", "enforcement"), before)
    return judge.verdicts(e.where("event_type <> 'signup'"), new, e.where("event_type = 'signup'"))


@query("""WITH step AS (SELECT o_custkey AS flow, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step, o_orderkey AS path, o_orderstatus FROM orders),
ran AS (SELECT l_orderkey AS path, max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS any_hit FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey),
bad AS (SELECT flow, step, path, CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE 'found' END AS status FROM step LEFT JOIN ran USING (path) WHERE o_orderstatus = 'P' OR any_hit = 0)
SELECT flow, min(step) AS step, arg_min(path, step) AS path, 'main' AS function, arg_min(status, step) AS status FROM bad GROUP BY flow""")
def registered_flow_gaps(spark, d):
    """Each customer's orders as the steps of a flow; pending orders have lost their function; the first two lines of an order are its span."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders")
    steps = o.select(F.col("o_custkey").alias("flow"), F.row_number().over(order).cast("long").alias("step"), F.col("o_orderkey").alias("path"), F.lit("main").alias("function"))
    index = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("path"), F.lit("main").alias("function"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    covered = function_lines(spark, d).select(F.col("fn").alias("path"), "line", "hits")
    return registered_flows.first_gaps(registered_flows.evaluated(steps, index, covered))
