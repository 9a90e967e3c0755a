"""Cross-site boilerplate removal by distinct-site spread of lines.

Lines are compared by their text without surrounding white space, under two 64-bit hashes. Lines of a single site drop out by the least and
greatest site hash. For the rest a HyperLogLog sketch of sites per line is merged by aggregation, map-side first; lines whose estimate lies
within ``band`` (and five standard errors) of their threshold get an exact distinct count. A line on ``min_sites`` or more sites is
boilerplate; a line of under ``short_chars`` characters ("The.", "}") says little by itself and needs ``short_sites``. Boilerplate stays where
it comes first (least doc_id, then position) and is removed everywhere else, so no passage is lost altogether.

Defined results: null text stays null with 0 lines; blank lines are never judged; a null source is a site of its own; rows that repeat
both doc_id and text are one document; an empty table gives an empty table; the columns of the input, and extra ones of any name, are kept
as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import fresh, guarded, materialize

MIN_SITES = 3
SHORT_CHARS = 12
SHORT_SITES = 8
SKETCH_BITS = 12
BAND = 0.5
NEWLINE = "\n"
WHITE = " \t\r\x0b\x0c\u00a0\u3000"


def _document(key: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(key).cast("string"), F.lit("")), F.xxhash64(F.lit(11), F.col(text))]


def line_table(docs: DataFrame, key: str, text: str, site: str, min_sites: int, short_chars: int, short_sites: int) -> DataFrame:
    """``doc, body, key, pos, k1, k2, site, least``: every line that can be judged, and on how many sites it is boilerplate."""
    doc, body = _document(key, text)
    lines = docs.where(F.col(text).isNotNull()).select(
        doc.alias("doc"), body.alias("body"), F.col(key).alias("key"), F.xxhash64(F.lit(12), F.coalesce(F.col(site).cast("string"), F.lit(""))).alias("site"),
        F.posexplode(F.split(F.col(text), NEWLINE)).alias("pos", "raw"),
    )
    line = F.btrim("raw", F.lit(WHITE))
    least = F.when(F.length(line) < short_chars, short_sites).otherwise(min_sites)
    return lines.where(F.length(line) > 0).select("doc", "body", "key", "pos", F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(13), line).alias("k2"), "site", least.alias("least"))


def spread(lines: DataFrame, band: float = BAND) -> DataFrame:
    """``k1, k2, first``: boilerplate lines, and where they come first."""
    line = ["k1", "k2"]
    ends = lines.groupBy(*line).agg(F.min("site").alias("a"), F.max("site").alias("b"), F.max("least").alias("least"))
    several = materialize(ends.where("a <> b or least <= 1").select(*line), "several")
    met = lines.join(guarded(several), line)
    sketched = met.groupBy(*line).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("estimate"), F.min(F.struct("key", "body", "pos")).alias("first"), F.max("least").alias("least")
    )
    sketched = materialize(sketched, "spread")
    margin = F.greatest(F.lit(band), 5 * 1.04 / 2 ** (SKETCH_BITS / 2) * F.col("least"))
    near = sketched.where(F.abs(F.col("estimate") - F.col("least")) <= margin).select(*line, "least")
    exact = lines.drop("least").join(guarded(near), line).groupBy(*line, "least", "site").agg(F.lit(1).alias("one")).groupBy(*line, "least").agg(F.count("*").alias("n"))
    exact = exact.where(F.col("n") >= F.col("least")).select(*line)
    sure = sketched.where(F.col("estimate") - F.col("least") > margin)
    return sure.select(*line, "first").unionByName(sketched.join(exact, line).select(*line, "first"))


def remove_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, short_chars: int = SHORT_CHARS, short_sites: int = SHORT_SITES) -> tuple[DataFrame, str, str]:
    """The rows of ``docs`` with their text cleaned, and two columns more, whose names follow: lines, and lines removed."""
    lines = materialize(line_table(docs, key, text, site, min_sites, short_chars, short_sites), "lines")
    marked = materialize(spread(lines), "marked")
    here = F.col("first.key").eqNullSafe(F.col("key")) & (F.col("first.body") == F.col("body")) & (F.col("first.pos") == F.col("pos"))
    hits = lines.join(guarded(marked), ["k1", "k2"]).where(~here).select("doc", "body", "pos").distinct()
    # the positions to remove as 64 bits a word, so that looking one up stays cheap in a document of many lines
    words = hits.groupBy("doc", "body", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"), F.count("*").alias("n")
    )
    gone = words.groupBy("doc", "body").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("gone"), F.sum("n").alias("n"))
    doc, body, where, removed, total = fresh(docs, "doc", "body", "gone", "removed", "lines")
    gone = materialize(gone.toDF(doc, body, where, removed), "gone")
    split = F.split(F.col(text), NEWLINE)
    bits = lambda i: F.coalesce(F.element_at(where, F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
    kept = F.filter(split, lambda x, i: F.getbit(bits(i), i % 64) == 0)
    out = docs.withColumns(dict(zip((doc, body), _document(key, text), strict=True))).join(gone.hint("shuffle_hash"), [doc, body], "left")
    cleaned = F.when(F.col(where).isNull(), F.col(text)).otherwise(F.array_join(kept, NEWLINE))
    return out.select(
        *(cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long").alias(total),
        F.coalesce(removed, F.lit(0)).cast("long").alias(removed),
    ), total, removed


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", size: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with boilerplate removed from their text and, where there is a column of that name, their new length."""
    out, *_ = remove_boilerplate(docs, key, text, site)
    return out.select(*(F.length(text).cast(docs.schema[c].dataType).alias(c) if c == size else F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """The result of query op2."""
    out, lines, removed = remove_boilerplate(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", F.col(lines).alias("n_lines"), F.col(removed).alias("n_removed"), F.col("text").alias("clean_text"))


_WHITE_SQL = " || ".join(f"chr({ord(c)})" for c in WHITE)
ORACLE_SQL = f"""
WITH line AS (
  SELECT doc_id, text, source, generate_subscripts(parts, 1) AS pos, unnest(parts) AS raw
  FROM (SELECT doc_id, text, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), judged AS (
  SELECT doc_id, pos, trim(raw, {_WHITE_SQL}) AS line, coalesce(source, '') AS site FROM line WHERE length(trim(raw, {_WHITE_SQL})) > 0
), marked AS (
  SELECT line, min((doc_id, pos)) AS first FROM judged GROUP BY line
  HAVING count(DISTINCT site) >= CASE WHEN length(line) < {SHORT_CHARS} THEN {SHORT_SITES} ELSE {MIN_SITES} END
), gone AS (
  SELECT j.doc_id, j.pos FROM judged j JOIN marked m USING (line) WHERE (j.doc_id, j.pos) <> m.first
), kept AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.pos) AS clean_text FROM line l
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.pos = l.pos) GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
  CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.clean_text, '') END AS clean_text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
