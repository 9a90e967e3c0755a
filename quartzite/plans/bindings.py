"""The engine's relations on the tables at hand: documents as files, orders as functions, customers and nations as components, users as sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzite.operators import findings as O
from quartzite.operators.findings import LineRule

RULES = [
    LineRule("text:credential", "(?i)(token|secret|password|api_key)[\"' ]*[=:]", "Blocker", "Vulnerability", 30, needs=("=", ":")),
    LineRule("text:email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "Critical", "Vulnerability", 15, needs=("@",)),
    LineRule("text:ipv4", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "Minor", "Vulnerability", 5, True),
    LineRule("text:phone", r"\+[0-9]+ \([0-9]{3}\)", "Major", "Bug", 10, needs=("+",)),
    LineRule("text:shouting", "[A-Z]{4,}!!", "Minor", "CodeSmell", 2, needs=("!!",)),
    LineRule("text:license", "(?i)licensed under|all rights reserved", "Info", "CodeSmell", 1),
]
MARKER = "reserved"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return O.source_lines(table(spark, d, "documents"), keep=("lang", "source"))


def found(spark: SparkSession, d: str) -> DataFrame:
    """Findings with their rule's columns."""
    return O.line_findings(lines(spark, d), RULES).join(O.rule_table(spark, RULES), "rule_id")


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each order to the same customer's next; the last of every third customer goes back to the first."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    back = F.when(F.col("o_custkey") % 3 == 0, F.first("o_orderkey").over(w))
    od = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return od.select(F.col("o_orderkey").alias("src"), F.coalesce(F.lead("o_orderkey").over(w), back).alias("dst")).where("dst is not null")


def couplings(spark: SparkSession, d: str) -> DataFrame:
    """Customer to supplier of every order line, as numbers of one kind of component."""
    li, od = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("dst")), table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("src"))
    return li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst")


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Supplier nation to customer nation of every order line; keys meet before nations do."""
    pairs = couplings(spark, d).distinct()
    cu = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("to"))
    su = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_nationkey").alias("of"))
    return pairs.join(cu, "src").join(su, "dst").select(F.col("of").alias("src"), F.col("to").alias("dst"))


def function_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as functions, their lines as instrumented lines, hit when the quantity is over 25."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("line"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("hits"), "l_partkey"
    )


def q(text: str) -> str:
    return text.replace("'", "''")


LINES_SQL = """line AS (
  SELECT doc_id AS path, lang, source, generate_subscripts(p, 1) AS line, unnest(p) AS text
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))"""
FOUND_SQL = (
    LINES_SQL
    + ", found AS ("
    + " UNION ALL ".join(
        f"SELECT path, lang, source, line, text, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, '{r.issue_type}' AS issue_type, "
        f"{r.effort} AS effort, {str(r.hotspot).upper()} AS hotspot FROM line WHERE regexp_matches(text, '{q(r.pattern)}')"
        for r in RULES
    )
    + ")"
)
EDGES_SQL = """edge AS (SELECT src, dst FROM (SELECT o_orderkey AS src, coalesce(lead(o_orderkey) OVER w, CASE WHEN o_custkey % 3 = 0 THEN first_value(o_orderkey) OVER w END) AS dst
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE dst IS NOT NULL AND src <> dst)"""
COUPLING_SQL = "edge AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey)"
NATION_SQL = """edge AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey)"""
RANK_SQL = "CASE severity WHEN 'Info' THEN 0 WHEN 'Minor' THEN 1 WHEN 'Major' THEN 2 WHEN 'Critical' THEN 3 ELSE 4 END"
