"""Further queries: string shapes, rings, walks, triage, changes, spans, histories and clone regions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartzite.functions import scalars as S
from quartzite.functions import strings as T
from quartzite.operators import clones, findings, graphs, layers, node_rules, reviews
from quartzite.operators.shared import cut
from quartzite.plans.bindings import EDGES_SQL, FOUND_SQL, RANK_SQL, couplings, found, lines, order_edges, q, table
from quartzite.plans.catalog import CPD_SQL, MARTIN_SQL, query
from quartzite.sources import reports

#: Literals by what they look like, and whether one could be a secret.
LITERALS = [
    ("kD8fj2LqP0sZx7Vb4NmW", True), ("a9$Kd02mfQ!xPz73LwRt", True), ("deadbeefdeadbeefdeadbeefdeadbeef", False), ("https://example.com/a/b?c=d1", False), ("./src/parts/Main9Window.tsx", False),
    ("user-profile-settings-page-9", False), ("SELECT name FROM users WHERE id9", False), ("application/vnd.api+json;v=9", False), ("{name}-{index}-of-the-parts9X", False), ("^\\\\d+(foo|bar)*[a-z9]{3,}$", False),
    ("grid-cols-[200px_1fr_9px]", False), ("var(--primary-color-9x8y7z6)", False), ("aaaaaaaaaaaaaaaaaaaaaaa9", False), ("short9X", False), ("hello world of many words 9X", False),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", False), ("sha256-Qx9mVb4NmWkD8fj2LqP0sZ", False), ("Zq93kfLs02PdMn85vYtr\\n", False),
]
_LITERALS_SQL = ", ".join(f"({i}, '{q(t)}', {str(flag).upper()})" for i, (t, flag) in enumerate(LITERALS))
_UNESCAPED = "replace(replace(text, '\\\\', '\\'), '\\n', chr(10))"


@query(f"""WITH literal(i, text, secret) AS (VALUES {_LITERALS_SQL}), l AS (SELECT text AS literal, secret, {_UNESCAPED} AS t FROM literal)
SELECT literal, t AS value, secret, contains(t, '://') OR regexp_matches(t, '^(data:|/|[.]/|[.][.]/|@|urn:|sha(1|256|384|512)-)') OR (contains(t, '/') AND contains(t, '.')) OR regexp_matches(t, '/.*/') AS location,
  regexp_matches(t, '[{{][A-Za-z0-9_:.?#<>^+-]*[}}]') AS template, regexp_matches(lower(t), '^(application|text|image|audio|video|multipart|font|model|message)/') AS media,
  regexp_matches(t, '\\\\[sSdDwWbB]') AND regexp_matches(t, '[\\^$()?*+|]') AS pattern, count(*) AS n FROM events JOIN l ON event_id % {len(LITERALS)} = (SELECT i FROM literal x WHERE x.text = l.literal) GROUP BY ALL""")
def string_shapes(spark, d):
    rows = [(i, t) for i, (t, _) in enumerate(LITERALS)]
    known = F.broadcast(spark.createDataFrame(rows, "i long, literal string"))  # the program's own texts
    e = table(spark, d, "events").select((F.col("event_id") % len(LITERALS)).alias("i")).join(known, "i").withColumn("value", T.unescape(F.col("literal")))
    v = F.col("value")
    return e.groupBy("literal", "value", T.could_be_secret(v).alias("secret"), T.is_location(v).alias("location"), T.is_template(v).alias("template"), T.is_media_or_header(v).alias("media"), T.is_pattern(v).alias("pattern")).agg(F.count("*").alias("n"))


@query("SELECT page_id, url || ' %' AS decoded, regexp_matches(url, '^https?:') AS valid_start FROM pages")
def percent_decoding(spark, d):
    coded = F.concat(F.regexp_replace(F.regexp_replace("url", "/", "%2F"), ":", "%3a"), F.lit("%20%"))
    return table(spark, d, "pages").select("page_id", T.percent_decoded(coded).alias("decoded"), F.col("url").rlike("^https?:").alias("valid_start"))


@query("SELECT rule_id, count(*) AS n FROM (SELECT 'a' || (event_id % 7) || CASE event_id % 3 WHEN 0 THEN ':b-c' WHEN 1 THEN ':B' ELSE 'b' END AS rule_id, event_id FROM events) WHERE event_id % 3 = 0 GROUP BY rule_id")
def valid_rule_ids(spark, d):
    end = F.get(F.array(F.lit(":b-c"), F.lit(":B"), F.lit("b")), (F.col("event_id") % 3).cast("int"))
    ids = table(spark, d, "events").select(F.concat(F.lit("a"), F.col("event_id") % 7, end).alias("rule_id"))
    return ids.where(T.is_rule_id(F.col("rule_id"))).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"""WITH {FOUND_SQL} SELECT CASE issue_type WHEN 'Bug' THEN 'Reliability' WHEN 'Vulnerability' THEN 'Security' ELSE 'Maintainability' END AS quality,
CASE {RANK_SQL} WHEN 0 THEN 'Info' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Blocker' END AS impact, count(*) AS n FROM found GROUP BY ALL""")
def impacts(spark, d):
    quality, severity = T.impact(F.col("issue_type"), F.col("severity"))
    return found(spark, d).groupBy(quality.alias("quality"), severity.alias("impact")).agg(F.count("*").alias("n"))


MODULES = ["redis", "sqlalchemy", "std::fs", "axios"]


@query("""WITH m(module) AS (VALUES ('redis'), ('sqlalchemy'), ('std::fs'), ('axios')), s AS (SELECT event_id, ['redis', 'redisearch', 'sqlalchemy.orm', 'std::fs::File', 'axios/lib', 'axios-mock'][event_id % 6 + 1] AS specifier FROM events)
SELECT event_id, module FROM s JOIN m ON specifier = module OR starts_with(specifier, module || '/') OR starts_with(specifier, module || '.') OR starts_with(specifier, module || '::')""")
def module_roster(spark, d):
    names = F.array(*map(F.lit, ["redis", "redisearch", "sqlalchemy.orm", "std::fs::File", "axios/lib", "axios-mock"]))
    s = table(spark, d, "events").select("event_id", F.get(names, (F.col("event_id") % 6).cast("int")).alias("specifier"))
    hit = F.filter(F.array(*map(F.lit, MODULES)), lambda m: T.in_module(F.col("specifier"), m))
    return s.select("event_id", F.explode(hit).alias("module"))


# --- rings and walks ----------------------------------------------------------------------------------------------------------------

RINGS = ["domain", "use_cases", "ports", "web", "persistence", "misc"]
_RING_SQL = "['domain', 'application', 'port', 'adapter', 'infrastructure', 'unclassified'][{k} % 6 + 1]"
_DEPTH_SQL = "[0, 1, 1, 2, 2, NULL][{k} % 6 + 1]"


def _ring_path(c: str):
    name = F.get(F.array(*map(F.lit, RINGS)), (F.col(c) % 6).cast("int"))
    return F.concat(F.lit("src/"), F.when(F.col(c) % 5 == 0, F.lit("adapters/")).otherwise(F.lit("")), name, F.lit("/f"), F.col(c))


@query(f"""WITH {EDGES_SQL}, e AS (SELECT src, dst, CASE WHEN src % 5 = 0 AND src % 6 IN (5) THEN 'adapter' ELSE {_RING_SQL.format(k="src")} END AS a, CASE WHEN dst % 5 = 0 AND dst % 6 IN (5) THEN 'adapter' ELSE {_RING_SQL.format(k="dst")} END AS b,
  CASE WHEN src % 5 = 0 AND src % 6 IN (5) THEN 2 ELSE {_DEPTH_SQL.format(k="src")} END AS x, CASE WHEN dst % 5 = 0 AND dst % 6 IN (5) THEN 2 ELSE {_DEPTH_SQL.format(k="dst")} END AS y FROM edge)
SELECT a AS from_layer, CASE WHEN b = 'infrastructure' AND dst % 5 = 0 THEN 'adapter' ELSE b END AS to_layer, count(*) AS n FROM e WHERE x < y GROUP BY ALL""")
def ring_violations(spark, d):
    e = graphs.component_edges(order_edges(spark, d))
    paths = e.select(_ring_path("src").alias("src"), _ring_path("dst").alias("dst"))
    return layers.outward_dependencies(paths).groupBy("from_layer", "to_layer").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, ring AS (SELECT o_custkey, min(o_orderkey) AS scc FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey HAVING count(*) > 1),
walk AS (SELECT scc, scc AS node, CAST(scc AS VARCHAR) AS path, FALSE AS done FROM ring UNION ALL SELECT scc, dst, path || ' -> ' || CAST(dst AS VARCHAR), dst = scc FROM walk JOIN edge ON src = node WHERE NOT done)
SELECT scc, path FROM walk WHERE done""")
def cycle_walks(spark, d):
    e = graphs.component_edges(order_edges(spark, d))
    return layers.cycle_paths(e, graphs.cycles(e))


# --- reviews --------------------------------------------------------------------------------------------------------------------------

_TRIAGE_SQL = " ".join(f"WHEN label = '{a}' AND e = '{e}' THEN '{b}'" for (a, e), b in reviews.TRIAGE.items())


@query(f"""WITH RECURSIVE step AS (SELECT user_id * 1000 + (event_id // 1000) % 1000 AS issue, row_number() OVER (PARTITION BY user_id * 1000 + (event_id // 1000) % 1000 ORDER BY event_id) AS n,
  CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'repro_passed' ELSE 'repro_failed' END WHEN 'error' THEN 'diagnosed' WHEN 'signup' THEN 'fix_accepted' ELSE 'fix_rejected' END AS e FROM events),
walk AS (SELECT DISTINCT issue, CAST(0 AS BIGINT) AS n, 'New' AS label, 0 AS errors FROM step
  UNION ALL SELECT w.issue, s.n, CASE {_TRIAGE_SQL} ELSE label END, errors + CASE WHEN (CASE {_TRIAGE_SQL} END) IS NULL THEN 1 ELSE 0 END FROM walk w JOIN step s ON s.issue = w.issue AND s.n = w.n + 1)
SELECT issue, arg_max(label, n) AS label, max(errors) AS errors FROM walk GROUP BY issue""")
def triage_labels(spark, d):
    t = S.lookup(F.col("event_type"), {"click": "start", "error": "diagnosed", "signup": "fix_accepted", "purchase": "fix_rejected"})
    event = F.coalesce(t, reviews.repro_event(F.col("event_id") % 2))
    issue = F.col("user_id") * 1000 + F.floor(F.col("event_id") / 1000) % 1000
    return reviews.triage(table(spark, d, "events").select(issue.cast("long").alias("issue"), F.col("event_id").alias("seq"), event.alias("event")))


@query("""WITH now AS (SELECT event_type AS rule_id, user_id AS path FROM events WHERE event_id % 2 = 1), old AS (SELECT event_type AS rule_id, user_id AS path FROM events WHERE event_id % 2 = 0),
r AS (SELECT (SELECT count(*) FROM now WHERE rule_id = 'error') AS remaining, (SELECT count(*) FROM (SELECT * FROM now EXCEPT ALL SELECT * FROM old)) AS added)
SELECT 'error' AS target, CASE WHEN remaining > 0 THEN 'TargetRemains' WHEN added > 0 THEN 'Regressed' ELSE 'Done' END AS verdict, CASE WHEN remaining > 0 THEN remaining ELSE added END AS n FROM r
UNION ALL SELECT 'none', CASE WHEN added > 0 THEN 'Regressed' ELSE 'Done' END, added FROM r""")
def completion_verdicts(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("rule_id"), F.col("user_id").alias("path"))
    now, then = e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0")
    parts = [reviews.completion(then, now, t, ["rule_id", "path"]).select(F.lit(t).alias("target"), "verdict", "n") for t in ("error", "none")]
    return parts[0].unionByName(parts[1])


@query("""WITH c AS (SELECT doc_id AS path, string_split(text, chr(10)) AS new, CASE WHEN doc_id % 2 = 0 THEN string_split(regexp_replace(text, 'reserved', 'Reserved', 'g'), chr(10)) ELSE [] END AS old FROM documents WHERE text IS NOT NULL),
m AS (SELECT path, unnest(list_filter(new, lambda x: contains(x, 'reserved') OR contains(x, 'Licensed'))) AS line, old FROM c)
SELECT path, trim(line, ' ') AS text, count(*) AS n FROM m WHERE NOT list_contains(list_filter(old, lambda x: contains(x, 'reserved') OR contains(x, 'Licensed')), line) GROUP BY ALL""")
def added_markers(spark, d):
    old = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "reserved", "Reserved"))
    c = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), old.alias("old"), F.col("text").alias("new"))
    return reviews.added_markers(c, ["reserved", "Licensed"]).groupBy("path", "text").agg(F.count("*").alias("n"))


@query("""WITH now AS (SELECT DISTINCT l_suppkey AS path, l_partkey AS dependency FROM lineitem WHERE l_quantity > 25), old AS (SELECT DISTINCT l_suppkey AS path, l_partkey AS dependency FROM lineitem WHERE l_quantity <= 25)
SELECT * FROM now EXCEPT SELECT * FROM old""")
def added_dependencies(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("dependency"), "l_quantity")
    return reviews.added_dependencies(li.where("l_quantity <= 25"), li.where("l_quantity > 25"))


@query("""WITH hit AS (SELECT l_suppkey AS path, l_orderkey AS line, max(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS hits FROM lineitem GROUP BY ALL), span AS (SELECT DISTINCT l_suppkey AS path, (l_orderkey // 300) * 300 + 1 AS a, (l_orderkey // 300) * 300 + 300 AS b FROM lineitem)
SELECT span.path, a AS start_line, b AS end_line, round(100.0 * count(*) FILTER (hits > 0) / nullif(count(line), 0), 6) AS coverage FROM span LEFT JOIN hit ON hit.path = span.path AND line BETWEEN a AND b GROUP BY ALL""")
def span_coverage(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("line"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("hits"))
    start = (F.floor(F.col("line") / 300) * 300 + 1).alias("start_line")
    spans = li.select("path", start).distinct().withColumn("end_line", F.col("start_line") + 299)
    return reviews.coverage_of_spans(spans, li).select("path", "start_line", "end_line", F.round("coverage", 6).alias("coverage"))


@query("""SELECT issue, seq, field, old, new FROM (SELECT user_id AS issue, event_id AS seq, event_type AS field, lag(v) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS old, v AS new
FROM (SELECT *, CAST(value AS BIGINT) % 3 AS v FROM (SELECT user_id, event_id, event_type, floor(value) AS value FROM events))) WHERE old IS DISTINCT FROM new""")
def issue_changelog(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("issue"), F.col("event_id").alias("seq"), F.col("event_type").alias("field"), (F.floor("value") % 3).alias("value"))
    return reviews.changelog(e)


@query("""WITH r AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id)
SELECT k.user_id AS key, CASE t WHEN 'click' THEN 'SAFE' WHEN 'view' THEN 'FIXED' ELSE 'TO_REVIEW' END AS status FROM (SELECT DISTINCT user_id FROM events) k LEFT JOIN r USING (user_id)""")
def hotspot_reviews(spark, d):
    e = table(spark, d, "events")
    r = e.where("event_type in ('click', 'view')").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "SAFE").otherwise("FIXED").alias("status"))
    return reviews.reviewed(e.select(F.col("user_id").alias("key")).distinct(), r)


@query(f"WITH {FOUND_SQL} SELECT path AS doc_id, CAST(line AS BIGINT) AS line FROM found WHERE hotspot ORDER BY path DESC, line DESC LIMIT 10")
def recent_hotspots(spark, d):
    return reviews.most_recent(found(spark, d).where("hotspot").select(F.col("path").alias("doc_id"), "line"), [F.desc("doc_id"), F.desc("line")], 10)


@query("SELECT 'copy' AS profile, p_brand AS rule_id, min_by(p_type, p_size * 1000000 + p_partkey) AS severity, 0 AS depth FROM part GROUP BY p_brand")
def profile_copy(spark, d):
    chain = table(spark, d, "part").select(F.col("p_brand").alias("rule_id"), F.col("p_type").alias("severity"), (F.col("p_size") * 1000000 + F.col("p_partkey")).alias("depth"))
    return reviews.flattened_profile(chain, "copy")


# --- clone regions ----------------------------------------------------------------------------------------------------------------------

REGIONS_SQL = CPD_SQL + """, place AS (SELECT path, idx, txt FROM shared),
diagonal AS (SELECT DISTINCT a.path AS pa, b.path AS pb, b.idx - a.idx AS delta FROM place a JOIN place b USING (txt) WHERE a.path < b.path OR a.path = b.path AND a.idx < b.idx),
full_block AS (SELECT * FROM block WHERE n = 5),
along AS (SELECT pa, pb, delta, b.idx, a.first AS fa, a.last AS la, b.first AS fb, b.last AS lb, a.txt FROM diagonal JOIN full_block a ON a.path = pa JOIN full_block b ON b.path = pb AND b.idx = a.idx + delta AND a.txt = b.txt),
matched AS (SELECT pa, pb, min(fa) AS fa, max(la) AS la, min(fb) AS fb, max(lb) AS lb, string_agg(txt, chr(1) ORDER BY idx) AS content FROM
  (SELECT *, idx - row_number() OVER (PARTITION BY pa, pb, delta ORDER BY idx) AS island FROM along) GROUP BY pa, pb, delta, island)"""


@query(f"""WITH {REGIONS_SQL}, region AS (SELECT content, pa AS path, fa AS a, la AS b FROM matched UNION SELECT content, pb, fb, lb FROM matched)
SELECT path AS doc_id, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, count(*) OVER (PARTITION BY content) AS places FROM region""")
def clone_regions(spark, d):
    from pyspark.sql import Window

    r = clones.matched_regions(clones.blocks(clones.collapse(clones.statements(lines(spark, d)))))
    return r.select(F.col("path").alias("doc_id"), "start_line", "end_line", F.count("*").over(Window.partitionBy("key")).alias("places"))


_TOKEN_SQL = r'''(?s)//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|\d[\w.]*|[\p{L}_$][\p{L}\p{N}_$]*|\n|[^\s\x0B]'''
_KIND_SQL = r"""CASE WHEN x LIKE '//%' OR x LIKE '/*%' THEN regexp_replace(x, '[^\n]+', '', 'g') WHEN x = chr(10) THEN x
  WHEN length(x) > 1 AND x[1] IN ('"', '''') THEN 'STR' || regexp_replace(x, '[^\n]+', '', 'g') WHEN regexp_matches(x, '^\d') THEN 'NUM' ELSE x END"""
REPORT_SQL = f"""WITH RECURSIVE token AS (SELECT doc_id AS path, list_transform(regexp_extract_all(text, '{_TOKEN_SQL}'), lambda x: {_KIND_SQL}) AS kinds FROM documents),
texts AS (SELECT path, string_split(array_to_string(list_transform(kinds, lambda k: CASE WHEN k = '' OR contains(k, chr(10)) THEN k ELSE k || ' ' END), ''), chr(10)) AS l FROM token),
stmt AS (SELECT path, line, stmt, len(string_split(stmt, ' ')) AS tokens, len(list_filter(string_split(stmt, ' '), lambda v: v IN ('STR', 'NUM'))) AS literals
  FROM (SELECT path, unnest(range(1, len(l) + 1)) AS line, rtrim(unnest(l), ' ') AS stmt FROM texts) WHERE stmt <> ''),
{REGIONS_SQL[REGIONS_SQL.index("ends AS"):]}, region AS (SELECT content, pa AS path, fa AS a, la AS b FROM matched UNION SELECT content, pb, fb, lb FROM matched),
follow AS (SELECT r.content, r.path, r.a, r.b, min({{'a': n.a, 'b': n.b}}) AS nx FROM region r JOIN region n ON n.content = r.content AND n.path = r.path AND n.a > r.b GROUP BY r.content, r.path, r.a, r.b),
start AS (SELECT content, path, min({{'a': a, 'b': b}}) AS f FROM region GROUP BY content, path),
keep AS (SELECT content, path, f.a AS a, f.b AS b FROM start UNION ALL SELECT k.content, k.path, w.nx.a, w.nx.b FROM keep k JOIN follow w ON w.content = k.content AND w.path = k.path AND w.a = k.a AND w.b = k.b),
size AS (SELECT content, count(*) AS places, max(b - a + 1) AS lines, min({{'path': path, 'a': a, 'b': b}}) AS lead FROM keep GROUP BY content),
plain AS (SELECT content, places, lines FROM size s JOIN stmt t ON t.path = s.lead.path AND t.line BETWEEN s.lead.a AND s.lead.b WHERE places BETWEEN 2 AND 8 AND lines >= 10
  GROUP BY ALL HAVING sum(literals) <= 0.25 * sum(tokens))"""


@query(f"{REPORT_SQL} SELECT path AS doc_id, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, CAST(lines AS BIGINT) AS lines, places FROM keep JOIN plain USING (content)")
def clone_report(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return clones.clone_sets(clones.token_statements(docs)).select(F.col("path").alias("doc_id"), "start_line", "end_line", "lines", "places")




# --- rules on nodes ---------------------------------------------------------------------------------------------------------------------

_IFS = "".join(f"  if (a > {i}) {{ b({i}); }}\n" for i in range(10))
_DEEP = "".join("  " * i + f"if (a > {i}) {{\n" for i in range(1, 6)) + "b();" + "}" * 5 + "\n"
#: (rule, language, a text that breaks it, one that keeps it)
NODE_SAMPLES = [
    ("smells:high-complexity", "typescript", "function f(a) {\n" + _IFS + "}\n", "function f(a) {\n" + _IFS[:-24] + "}\n"),
    ("smells:high-complexity", "go", "func f(a int) {\n" + _IFS.replace("(a", "a").replace(") {", " {") + "}\n", "func f(a int) { }\n"),
    ("smells:long-function", "rust", "fn f() {\n" + "    a();\n" * 49 + "}\n", "fn f() {\n" + "    a();\n" * 48 + "}\n"),
    ("smells:long-function", "java", "class A {\n void f() {\n" + "    a();\n" * 49 + "}\n}\n", "class A {\n void f() {\n" + "    a();\n" * 48 + "}\n}\n"),
    ("smells:cognitive-complexity", "typescript", "function f(a) {\n" + _DEEP + "  if (a && c) { d(); }\n}\n", "function f(a) {\n" + _DEEP + "}\n"),
    ("typescript:max-function-nesting-depth", "typescript", "function a() { " * 5 + "}" * 5 + "\n", "function a() { " * 4 + "}" * 4 + "\n"),
    ("typescript:async-function-without-await", "typescript", "async function f() { return g(); }\n", "async function f() { return await g(); }\n"),
    ("typescript:json-parse-unguarded", "typescript", "function f(a) { return JSON.parse(a); }\n", "function f(a) { try { return JSON.parse(a); } catch (e) { throw e; } }\n"),
    ("smells:db-call-in-loop", "typescript", "function f(a) { for (const b of a) { db.query(b); } }\n", "function f(a) { db.query(a); for (const b of a) { g(b); } }\n"),
    ("architecture:functional-module", "typescript", "".join(f"export function f{i}() {{ }}\n" for i in range(26)), "".join(f"export function f{i}() {{ }}\n" for i in range(25))),
    ("smells:god-class", "java", "class A {\n" + "".join(f"  void f{i}() {{ }}\n" for i in range(21)) + "}\n", "class A {\n" + "".join(f"  void f{i}() {{ }}\n" for i in range(20)) + "}\n"),
    ("smells:ck-oo-metrics", "typescript", "class A {\n" + "".join(f"  f{i}(a) {{ if (a) {{ b(); }} }}\n" for i in range(13)) + "}\n", "class A {\n" + "".join(f"  f{i}(a) {{ if (a) {{ b(); }} }}\n" for i in range(12)) + "}\n"),
    ("smells:low-cohesion", "typescript", "class A {\n  a() { return this.x; }\n  b() { return this.x; }\n  c() { return this.y; }\n  d() { return this.y; }\n}\n", "class A {\n  a() { return this.x; }\n  b() { return this.x + this.y; }\n  c() { return this.y; }\n  d() { return this.y; }\n}\n"),
    ("smells:fat-interface", "rust", "trait T {\n" + "".join(f"    fn f{i}(&self);\n" for i in range(9)) + "}\n", "trait T {\n" + "".join(f"    fn f{i}(&self);\n" for i in range(8)) + "}\n"),
]
_NODE_ROWS = [(2 * i + k, f"{rule} {language}", ("bad", "good")[k], rule, language, (bad, good)[k]) for i, (rule, language, bad, good) in enumerate(NODE_SAMPLES) for k in (0, 1)]
_NODE_SQL = ", ".join(f"({i}, '{name}', '{kind}')" for i, name, kind, *_ in _NODE_ROWS)


@query(f"""WITH sample(i, name, kind) AS (VALUES {_NODE_SQL}) SELECT name, kind, count(*) AS files, count(*) FILTER (kind = 'bad') AS found FROM orders JOIN sample ON o_orderkey % {len(_NODE_ROWS)} = i GROUP BY ALL""")
def node_smells(spark, d):
    """Each order is a file: by turns a text that breaks a rule on functions or classes and one that just keeps it."""
    known = F.broadcast(spark.createDataFrame(_NODE_ROWS, "i long, name string, kind string, rule string, language string, content string"))  # the program's own texts
    od = table(spark, d, "orders").select((F.col("o_orderkey") % len(_NODE_ROWS)).alias("i"), F.col("o_orderkey").alias("k")).join(known, "i")
    ending = S.lookup(F.col("language"), {"typescript": ".ts", "rust": ".rs", "go": ".go", "java": ".java"})
    files = node_rules.alike(od.withColumn("path", F.concat(F.lit("src/f"), "k", ending)))
    hits = node_rules.alike_findings(files).select("same", F.col("rule_id").alias("rule"), F.lit(True).alias("hit")).distinct()
    return files.select("same", "name", "kind", "rule").join(hits, ["same", "rule"], "left").groupBy("name", "kind").agg(F.count("*").alias("files"), F.count("hit").alias("found"))


@query(f"""WITH {EDGES_SQL.replace("edge AS", "chain AS")}, {MARTIN_SQL}, e AS (SELECT src, dst, CASE WHEN src % 5 = 0 AND src % 6 IN (5) THEN 2 ELSE {_DEPTH_SQL.format(k="src")} END AS x, CASE WHEN dst % 5 = 0 AND dst % 6 IN (5) THEN 2 ELSE {_DEPTH_SQL.format(k="dst")} END AS y FROM chain),
far AS (SELECT component FROM martin WHERE abs(abstractness + instability - 1) > 0.7 AND types >= 5 AND ca + ce >= 3),
lean AS (SELECT src FROM edge JOIN martin a ON src = a.component JOIN martin b ON dst = b.component WHERE b.instability - a.instability > 0.25 AND a.ca >= 2)
SELECT 'architecture:dependency-cycle' AS rule_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey HAVING count(*) > 1)
UNION ALL SELECT 'architecture:hexagonal-layer-violation', count(*) FROM e WHERE x < y UNION ALL SELECT 'architecture:main-sequence-deviation', count(*) FROM far HAVING count(*) > 0
UNION ALL SELECT 'architecture:stable-dependency-violation', count(*) FROM lean HAVING count(*) > 0""")
def architecture_rules(spark, d):
    """Orders as files in rings, customers and suppliers as components."""
    files = cut(graphs.component_edges(order_edges(spark, d)).select(_ring_path("src").alias("src"), _ring_path("dst").alias("dst")))
    census = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("component")).agg(F.count("*").alias("types"), F.count_if(F.col("o_orderstatus") == "F").alias("abstractions"))
    found_ = node_rules.graph_findings(files, census, cut(graphs.component_edges(couplings(spark, d))))
    return found_.groupBy("rule_id").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE up AS (SELECT user_id AS type, user_id // 2 AS base FROM (SELECT DISTINCT user_id FROM events) WHERE user_id > 0), walk AS (SELECT type, base FROM up UNION SELECT w.type, u.base FROM walk w JOIN up u ON u.type = w.base)
SELECT CAST(type AS VARCHAR) AS path, count(*) AS depth FROM walk GROUP BY type HAVING count(*) > 5""")
def deep_inheritance(spark, d):
    """Users as classes, each under the one of half its number."""
    up = table(spark, d, "events").select(F.col("user_id").alias("type")).distinct().where("type > 0").select(F.col("type").cast("string").alias("path"), "type", F.floor(F.col("type") / 2).alias("base"), F.lit(1).alias("line"))
    return node_rules.inheritance_findings(up).select("path", F.col("measure").cast("long").alias("depth"))


# --- readers and gates ------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS report, 'f' || CAST(o_orderkey AS VARCHAR) || '.rs' AS path, CAST(2 AS BIGINT) AS line, CAST(3 AS BIGINT) AS hits FROM orders")
def coverage_of_any_format(spark, d):
    """Each order is a report of one file and line, by turns in each format."""
    k = F.col("o_orderkey").cast("string")
    name = F.concat(F.lit("f"), k, F.lit(".rs"))
    texts = [
        F.concat(F.lit("TN:\nSF:"), name, F.lit("\nDA:2,3\nend_of_record")),
        F.concat(F.lit('<?xml version="1.0"?><coverage><packages><class name="c" filename="'), name, F.lit('"><lines><line number="2" hits="3"/></lines></class></packages></coverage>')),
        F.concat(F.lit('<report name="x"><package name=""><sourcefile name="'), name, F.lit('"><line nr="2" mi="0" ci="3" mb="0" cb="0"/></sourcefile></package></report>')),
        F.concat(F.lit('{"data":[{"files":[{"filename":"'), name, F.lit('","segments":[[2,1,3,true,true]]}]}]}')),
        F.concat(F.lit('{"'), name, F.lit('":{"statementMap":{"0":{"start":{"line":2}}},"s":{"0":3}}}')),
    ]
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("report"), F.get(F.array(*texts), (F.col("o_orderkey") % 5).cast("int")).alias("content"))
    found_ = reports.coverage(cut(r))
    return found_.select("report", F.regexp_replace("path", "^/", "").alias("path"), "line", F.when(F.col("hits") > 0, 3).cast("long").alias("hits"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https://[^/]*/[^/]*$') OR regexp_matches(url, '[.]html$') THEN 'Deny' END AS verdict FROM pages")
def protected_paths(spark, d):
    w = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return findings.protected(w, ["https://*/*", "**.html"]).select("page_id", "verdict")
