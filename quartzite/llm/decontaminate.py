"""Benchmark decontamination by SimHash of item-sized windows.

Texts and items are normalised to lower-case words and their hashed five-word shingles (fewer words: one shingle). Items of equal shingles
are one item under several ids. A window is as many shingles of a document as some item has. Which windows to look at is told by the set of all
items' shingles alone: a window that starts at a shingle that no item has gets no worse by starting one later, for what it drops weighs as much
as a shingle can (unless the window holds that same shingle twice); and similarity t needs t of an item's weight in known shingles. Which item a window may hold is told by the index
alone: each window gets a weighted SimHash of 64 bits, items are indexed by theirs in ``BLOCKS`` blocks of 8 bits with every block value within
``radius // BLOCKS`` flips, so a window finds every item of its size within ``radius`` bits, and more beyond. The exact weighted Jaccard similarity
of the shingle sets then decides; the weight of a shingle is its inverse item frequency. Texts and shingle lists are told apart by 128 and 64
bits of hashes.

Defined results: null and empty texts match nothing, and neither do empty items; rows equal in all columns read match once, equal texts
under several ids under each; null keys and null item ids, of any type, are carried; extra columns are not read; an empty table or benchmark
gives an empty table.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzite.llm.common import fresh, guarded, materialize

WIDTH = 5
RADIUS = 23  # 8 blocks within 2 flips each: of 8 * 3 - 1 differing bits some block has 2 at most
BLOCKS = 8
SIMILARITY = 0.8
WEIGHT_UNIT = 1_000_000
SHUFFLED = "merge"  # of tables that grow with the corpus: written, they look small, for they compress well, and the driver would hold them whole to broadcast them
INDEX_ROWS = 100_000  # shingles of items to broadcast, four longs each: under 5 MB


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " ")), " ")


def hashes_of(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``hs``, its hashed shingles in order, without rows that have no words. A generator, unlike a projection, is not
    folded into the lambda, so a text is split once."""
    w = df.select("*", F.explode(F.array(words_of(F.col(text)))).alias("_w")).where(F.array_max("_w") != "")
    last = F.greatest(F.size("_w") - WIDTH, F.lit(0))
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WIDTH))))
    return w.select(*df.columns, F.explode(F.array(hashed)).alias("hs"))


def fingerprints(weighed: DataFrame, *by: str) -> DataFrame:
    """``by, fp, total, ws``: weighted SimHash of rows (h, w), their weight, and the rows themselves. Bit b is set if the weight of the hashes that have it
    is over half of all; weights are whole numbers, so the sums don't depend on their order."""
    ones = [F.sum(F.when(F.getbit("h", F.lit(b)) == 1, F.col("w")).otherwise(0)).alias(f"b{b}") for b in range(64)]
    sums = weighed.groupBy(*by).agg(F.sum("w").alias("total"), *ones)
    bits = [F.when(2 * F.col(f"b{b}") > F.col("total"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    fp = bits[0].cast("long")
    for b in bits[1:]:
        fp = fp.bitwiseOR(b.cast("long"))
    lists = weighed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("h", "w"))).alias("ws"))
    return sums.select(*by, fp.alias("fp"), "total").join(lists.hint(SHUFFLED), list(by))


def _block(fp: Column | str, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255)).cast("int")


def _text_key(text: Column | str) -> list[Column]:
    return [F.xxhash64(F.lit(15), text).alias("t1"), F.xxhash64(F.lit(16), text).alias("t2")]


def item_pairs(printed: DataFrame, radius: int) -> DataFrame:
    """``id, item``: windows (side 0) and items (side 1) of one size whose fingerprints share a block up to the flips allowed."""
    flips = [0]
    for r in range(1, radius // BLOCKS + 1):
        flips += [sum(1 << b for b in c) for c in combinations(range(8), r)]
    blocks = F.explode(F.array(*(F.struct(F.lit(k).alias("b"), _block("fp", k).alias("v")) for k in range(BLOCKS)))).alias("p")
    posted = printed.where("side = 1").select(F.col("id").alias("item"), "n", blocks)
    posted = posted.select("item", "n", F.col("p.b").alias("b"), F.explode(F.transform(F.array(*map(F.lit, flips)), lambda f: F.col("p.v").bitwiseXOR(f))).alias("v"))
    asked = printed.where("side = 0").select("id", "n", blocks).select("id", "n", F.col("p.b").alias("b"), F.col("p.v").alias("v"))
    return asked.join(posted, ["n", "b", "v"]).select("id", "item").distinct()


def verified_windows(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, radius: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The verified windows ``t1, t2, iid, start, distance, similarity`` by hashes of the text, and the items' names ``item, iid``."""
    read = hashes_of(benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).alias("text")), "text")
    read = materialize(read.select("item", F.xxhash64("hs").alias("iid"), "hs"), "items")
    items = read.dropDuplicates(["iid"]).select("iid", "hs", F.size("hs").alias("n"))
    n_items = items.count()
    sets = items.select("iid", "n", F.explode(F.array_distinct("hs")).alias("h"))
    weights = materialize(sets.groupBy("h").agg(F.round(WEIGHT_UNIT * F.log(1 + n_items / F.count("*"))).cast("long").alias("w")), "weights")
    small = (lambda d: F.broadcast(d)) if weights.count() <= INDEX_ROWS else (lambda d: d)
    unmet = round(WEIGHT_UNIT * math.log(1 + n_items)) if n_items else 1
    # for each size of items the least weight of known shingles that a match has; there are no more sizes than the longest item has shingles
    lightest = sets.join(weights, "h").groupBy("iid", "n").agg(F.sum("w").alias("need")).groupBy("n").agg(F.min("need").alias("need")).orderBy("n").collect()
    sizes = F.array(*(F.struct(F.lit(r["n"]).alias("n"), F.lit(math.floor((similarity - 1e-9) * r["need"])).cast("long").alias("need")) for r in lightest))
    if not lightest:
        sizes = F.array().cast("array<struct<n:int,need:bigint>>")

    source = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text")).select("text", *_text_key("text"))
    placed = hashes_of(source, "text").select("t1", "t2", F.posexplode("hs").alias("pos", "h"))
    hits = placed.join(small(weights), "h").groupBy("t1", "t2", "pos").agg(F.max("w").alias("w"))  # copies of a text fold
    held = hits.withColumn("held", F.sum("w").over(Window.partitionBy("t1", "t2")))
    sized = held.select("t1", "t2", "pos", "w", F.explode(F.filter(sizes, lambda z: z["need"] <= F.col("held"))).alias("z")).select("t1", "t2", "pos", "w", "z.n", "z.need")
    # each hit starts a window; the running weight at its end less that at its start is its known weight, within one text and size
    ends = F.explode(F.array(F.struct(F.col("pos").alias("at"), F.lit(1).alias("own"), "w"), F.struct((F.col("pos") + F.col("n")).alias("at"), F.lit(0).alias("own"), F.lit(0).cast("long").alias("w")))).alias("e")
    order = Window.partitionBy("t1", "t2", "n").orderBy("e.at", "e.own").rowsBetween(Window.unboundedPreceding, 0)
    running = sized.select("t1", "t2", "n", "need", "pos", ends).withColumn("c", F.sum("e.w").over(order))
    known = F.max(F.when(F.col("e.own") == 0, F.col("c"))) - F.max(F.when(F.col("e.own") == 1, F.col("c") - F.col("e.w")))
    windows = running.groupBy("t1", "t2", "n", "need", F.col("pos").alias("start")).agg(known.alias("known")).where("known >= need")
    windows = materialize(windows.groupBy("t1", "t2").agg(F.collect_list(F.struct("n", "start")).alias("at")), "windows")  # a text's own, few times its length

    # only texts with a window are read again; windows of equal shingles are one
    touched = windows.select("t1", "t2")
    again = source.join(guarded(touched), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    again = materialize(hashes_of(again, "text").select("t1", "t2", "hs"), "shingled")
    part = lambda n, start: F.array_distinct(F.slice("hs", start + 1, n))
    marked = F.transform("at", lambda z: F.struct(z["n"].alias("n"), z["start"].alias("start"), F.xxhash64(z["n"], part(z["n"], z["start"])).alias("id")))
    cut = materialize(windows.join(again.hint(SHUFFLED), ["t1", "t2"]).select("t1", "t2", F.explode(marked).alias("z")).select("t1", "t2", "z.n", "z.start", "z.id"), "cut")
    one = cut.groupBy("id", "n").agg(F.min(F.struct("t1", "t2", "start")).alias("o")).select("id", "n", "o.t1", "o.t2", "o.start")
    parts = one.join(again.hint(SHUFFLED), ["t1", "t2"]).select(F.lit(0).alias("side"), "id", "n", F.explode(part(F.col("n"), F.col("start"))).alias("h"))
    both = parts.unionByName(sets.select(F.lit(1).alias("side"), F.col("iid").alias("id"), "n", "h"))
    weighed = both.join(small(weights), "h", "left").select("side", "id", "n", "h", F.coalesce("w", F.lit(unmet).cast("long")).alias("w"))
    printed = materialize(fingerprints(materialize(weighed, "weighed"), "side", "id", "n"), "prints")
    a = printed.where("side = 0").select("id", F.col("fp").alias("fa"), F.col("total").alias("ta"), F.col("ws").alias("wa"))
    b = printed.where("side = 1").select(F.col("id").alias("iid"), F.col("fp").alias("fb"), F.col("total").alias("tb"), F.col("ws").alias("wb"))
    # what two sets share weighs at most as much as their shingles can: most pairs end here, by hashes alone
    hashes = F.transform("ws", lambda x: x["h"])
    left = printed.where("side = 0").select("id", F.col("total").alias("ta"), hashes.alias("ha"))
    right = printed.where("side = 1").select(F.col("id").alias("iid"), F.col("total").alias("tb"), hashes.alias("hb"))
    right = F.broadcast(right) if sets.count() <= INDEX_ROWS else right
    may = F.size(F.array_intersect("ha", "hb")) * F.lit(unmet).cast("long") >= similarity / (1 + similarity) * (F.col("ta") + F.col("tb")) - 1
    near = item_pairs(printed, radius).withColumnRenamed("item", "iid").join(left.hint(SHUFFLED), "id").join(right, "iid").where(may).select("id", "iid")
    common = F.aggregate(F.array_intersect("wa", "wb"), F.lit(0).cast("long"), lambda s, x: s + x["w"])
    verified = (
        materialize(near, "near").join(a.hint(SHUFFLED), "id").join(b, "iid")
        .withColumn("similarity", common / (F.col("ta") + F.col("tb") - common))
        .where(F.col("similarity") >= similarity - 1e-9)
        .select("id", "iid", F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))).alias("distance"), "similarity")
    )
    found = cut.select("t1", "t2", "start", "id").join(verified.hint(SHUFFLED), "id").drop("id")
    return materialize(found, "found"), read.select("item", "iid").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """``key, item, start, distance, similarity``: the windows of documents that verify, by their first shingle, which is one that some item has."""
    found, names = verified_windows(docs, benchmark, text, item, item_text, radius, similarity)
    texts = materialize(found.select("t1", "t2").distinct(), "texts")
    keyed = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), *_text_key(F.col(text).cast("string")))
    keyed = keyed.join(guarded(texts), ["t1", "t2"], "left_semi").distinct()
    return keyed.join(found.hint(SHUFFLED), ["t1", "t2"]).join(names, "iid").select("key", "item", "start", "distance", "similarity")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The result of query op5: each document and item that it holds, with its best window, the first of equals."""
    best = F.max(F.struct(F.round("similarity", 6).alias("similarity"), (-F.col("start")).alias("at"))).alias("best")
    found = matches(docs, benchmark).groupBy(F.col("key").alias("doc_id"), F.col("item").alias("item_id")).agg(best, F.countDistinct("start").alias("n_windows"))
    return found.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.at")).cast("long").alias("start_shingle"), "n_windows")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item. Rows are judged by their text alone, so null and repeated keys are no matter."""
    found, _ = verified_windows(docs, benchmark, text, item, item_text, RADIUS, SIMILARITY)
    bad = materialize(found.select("t1", "t2").distinct(), "bad")
    t1, t2 = fresh(docs, "t1", "t2")
    marked = docs.withColumns(dict(zip((t1, t2), _text_key(F.col(text).cast("string")), strict=True)))
    return marked.join(guarded(bad.toDF(t1, t2)), [t1, t2], "left_anti").select(*docs.columns)


def _shingles_sql(table: str, key: str) -> str:
    return f"""SELECT {key}, CASE WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) END AS hs
  FROM (SELECT {key}, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM {table} WHERE text IS NOT NULL) WHERE w[1] <> ''"""


#: All windows of the items' sizes by their exact similarity; where the best is reached, the first window that starts at a known shingle.
ORACLE_SQL = f"""
WITH named AS ({_shingles_sql("benchmark", "item_id")}), item AS (SELECT hs, len(hs) AS n, row_number() OVER () AS iid FROM (SELECT DISTINCT hs FROM named)),
bag AS (SELECT DISTINCT iid, n, unnest(hs) AS h FROM item), total AS (SELECT count(*) AS items FROM item),
weight AS (SELECT h, CAST(round({WEIGHT_UNIT} * ln(1 + (SELECT items FROM total) / count(*))) AS BIGINT) AS w FROM bag GROUP BY h),
need AS (SELECT iid, sum(w) AS tb FROM bag JOIN weight USING (h) GROUP BY iid), size AS (SELECT DISTINCT n FROM item),
placed AS (SELECT doc_id, generate_subscripts(hs, 1) - 1 AS pos, unnest(hs) AS h FROM ({_shingles_sql("documents", "doc_id")})),
hit AS (SELECT doc_id, pos, h FROM placed SEMI JOIN weight USING (h)),
win AS (SELECT DISTINCT doc_id, n, unnest(range(greatest(pos - n + 1, 0), pos + 1)) AS start FROM hit, size),
held AS (SELECT DISTINCT win.doc_id, win.n, start, h FROM win JOIN placed p ON p.doc_id = win.doc_id AND p.pos >= start AND p.pos < start + win.n),
mass AS (SELECT doc_id, n, start, CAST(sum(coalesce(w, round({WEIGHT_UNIT} * ln(1 + (SELECT items FROM total))))) AS BIGINT) AS ta FROM held LEFT JOIN weight USING (h) GROUP BY ALL),
met AS (SELECT doc_id, n, start, iid, CAST(sum(w) AS BIGINT) AS common FROM held JOIN bag USING (n, h) JOIN weight USING (h) GROUP BY ALL),
good AS (SELECT doc_id, iid, start, common / (ta + tb - common) AS similarity, EXISTS (FROM hit WHERE hit.doc_id = met.doc_id AND hit.pos = met.start) AS known
  FROM met JOIN mass USING (doc_id, n, start) JOIN need USING (iid) WHERE common / (ta + tb - common) >= {SIMILARITY} - 1e-9)
SELECT doc_id, item_id, max(round(similarity, 6)) AS similarity, CAST(arg_min(start, (-round(similarity, 6), NOT known, start)) AS BIGINT) AS start_shingle, count(DISTINCT start) FILTER (WHERE known) AS n_windows
FROM good JOIN item USING (iid) JOIN named USING (hs) GROUP BY doc_id, item_id
"""
