"""Copy-paste detection on statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzite.operators.shared import stored

_TOKEN = r"""(?s)//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|\d[\w.]*+|[\p{L}_$][\p{L}\p{N}_$]*+|\n|[^\s]"""


def token_statements(files: DataFrame, path: str = "path", content: str = "content", rename: bool = False) -> DataFrame:
    """``path, line, stmt, tokens, literals``: the tokens of each line joined by one space, comments gone, strings and numbers (and names, if
    ``rename``) by placeholders; a token stands on the line where it begins. Lines without tokens are left out."""
    parts = files.select(F.col(path).alias("path"), F.explode(F.array(F.regexp_extract_all(F.col(content), F.lit(_TOKEN), F.lit(0)))).alias("parts"))
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    ends = lambda t: F.regexp_replace(t, "[^\n]+", "")
    kind = lambda t: (
        F.when(t.rlike("^(//|/\\*)"), ends(t)).when(t == "\n", t).when(t.rlike("^[\"']") & (F.length(t) > 1), F.concat(F.lit("STR"), ends(t))).when(t.rlike("^\\d"), F.lit("NUM"))
        .when(F.lit(rename) & t.rlike("^[\\p{L}_$]"), F.lit("ID")).otherwise(t)
    )
    spaced = lambda t: F.when((breaks(t) > 0) | (t == ""), t).otherwise(F.concat(t, F.lit(" ")))
    lines = F.split(F.array_join(F.transform(F.transform("parts", kind), spaced), ""), "\n")
    out = parts.select("path", F.posexplode(lines).alias("pos", "text")).select("path", (F.col("pos") + 1).cast("long").alias("line"), F.rtrim("text").alias("stmt")).where("stmt <> ''")
    words = F.split("stmt", " ")
    return out.withColumn("tokens", F.size(words)).withColumn("literals", F.size(F.filter(words, lambda w: w.isin("STR", "NUM"))))


def statements(lines: DataFrame) -> DataFrame:
    """Trimmed lines that aren't blank: ``path, line, stmt``."""
    return lines.select("path", "line", F.trim("text").alias("stmt")).where("stmt <> ''")


def collapse(stmts: DataFrame) -> DataFrame:
    """The first and the last of each run of equal statements, numbered anew from 0 in ``idx``."""
    w = Window.partitionBy("path").orderBy("line")
    ends = stmts.withColumn("a", F.lag("stmt").over(w)).withColumn("b", F.lead("stmt").over(w))
    ends = ends.where("a is null or b is null or a <> stmt or b <> stmt").drop("a", "b")
    return ends.withColumn("idx", F.row_number().over(w).cast("long") - 1)


def blocks(stmts: DataFrame, size: int = 5) -> DataFrame:
    """Every run of ``size`` statements: ``path, idx, first, last, block``; the block is hashed twice, 128 bits in all."""
    w = Window.partitionBy("path").orderBy("idx").rowsBetween(0, size - 1)
    out = stmts.withColumn("parts", F.collect_list("stmt").over(w)).withColumn("last", F.max("line").over(w)).where(F.size("parts") == size)
    joined = F.array_join("parts", "\n")
    return out.select("path", "idx", F.col("line").alias("first"), "last", F.xxhash64(joined).alias("h1"), F.xxhash64(F.lit(1), joined).alias("h2"))


def shared(found: DataFrame) -> DataFrame:
    """Blocks that occur at least twice. Their count joins back, no pair is made."""
    twice = found.groupBy("h1", "h2").agg(F.count("*").alias("occurrences")).where("occurrences > 1")
    return found.join(twice, ["h1", "h2"])


def runs(found: DataFrame) -> DataFrame:
    """Maximal runs of consecutive shared blocks of a file: ``path, start_line, end_line, blocks``."""
    w = Window.partitionBy("path").orderBy("idx")
    island = found.select("path", "idx", "first", "last").distinct().withColumn("island", F.col("idx") - F.row_number().over(w))
    return island.groupBy("path", "island").agg(F.min("first").alias("start_line"), F.max("last").alias("end_line"), F.count("*").alias("blocks")).drop("island")


def duplicated_lines(regions: DataFrame) -> DataFrame:
    """Distinct lines under the regions by file."""
    return regions.select("path", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct().groupBy("path").agg(F.count("*").alias("duplicated_lines"))


def without_overlaps(regions: DataFrame, key: str = "set_id") -> DataFrame:
    """Of each set and file, in order of start and end, the regions that overlap none kept before. A group is one file's part of a set."""
    rest = ["start_line", "end_line", *(c for c in regions.columns if c not in (key, "path", "start_line", "end_line"))]
    row = F.struct(*rest)
    apart = lambda kept, r: F.when(F.coalesce(r["start_line"] > F.element_at(kept, -1)["end_line"], F.lit(True)), F.concat(kept, F.array(r))).otherwise(kept)
    grouped = regions.groupBy(key, "path").agg(F.array_sort(F.collect_list(row)).alias("regions"))
    kept = F.aggregate(F.slice("regions", 2, F.size("regions")), F.slice("regions", 1, 1), apart)
    return grouped.select(key, "path", F.explode(kept).alias("r")).select(key, "path", "r.*").select(*regions.columns)


def _mix(*parts: Column) -> Column:
    """128 bits of hash."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def _branchings(places: DataFrame, levels: int) -> DataFrame:
    """``path, idx, size, cls, n``: for each place the lengths at which the runs of blocks that begin there alike part (or one of them ends), with the
    class of equal runs of that length and how many there are.

    How many places share a run of some length falls as the length grows; the lengths where it falls are searched by halving intervals for all
    places at once. An interval whose ends have equal counts is dropped, for all places of its class alike. So rounds are the logarithm of the
    longest run, and a class is a counted hash however many places it has: no pair is made.
    """
    now = places.select("path", "idx", F.lit(0).cast("long").alias("size"), _mix(F.lit(0)).alias("cls"), F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("beyond"))
    for level in reversed(range(levels)):
        ahead = places.select("path", F.col("idx").alias("at"), F.col(f"g{level}").alias("g"))
        met = now.withColumn("at", F.col("idx") + F.col("size")).join(ahead, ["path", "at"], "left").drop("at")
        met = stored(met.withColumn("longer", F.when(F.col("g").isNotNull(), _mix("cls", "g", F.lit(level)))).drop("g"))
        # the counts are a table of their own, so that a hot class may be split when they are joined
        often = stored(met.where("longer is not null").groupBy("longer").agg(F.count("*").alias("m")).where("m > 1"))
        met = met.join(often, "longer", "left").withColumn("m", F.when(F.col("longer").isNull(), 0).otherwise(F.coalesce("m", F.lit(1))))
        halves = F.array(
            F.struct("size", "cls", "n", F.col("m").alias("beyond")),
            F.struct((F.col("size") + (1 << level)).alias("size"), F.col("longer").alias("cls"), F.col("m").alias("n"), "beyond"),
        )
        now = met.select("path", "idx", F.explode(halves).alias("h")).select("path", "idx", "h.*").where("cls is not null and (n is null or n > 1 and n > beyond)")
    return now.where("size > 0").drop("beyond")


def matched_regions(found: DataFrame) -> DataFrame:
    """``key, path, start_line, end_line``: the regions that two places have in common and that can't be extended at either end in both, by their content.

    A place counts if another one of the same run has a different block (or none) before it and after it, which three counts of the run's neighbours
    tell. Runs of blocks at any number of places are found; no blocks, no rows.
    """
    w = Window.partitionBy("path").orderBy("idx")
    s = Window.partitionBy("path", "island").orderBy("idx")
    own = stored(shared(stored(found))).withColumn("island", F.col("idx") - F.row_number().over(w)).withColumn("g0", _mix("h1", "h2"))
    longest = own.groupBy("path", "island").count().agg(F.max("count")).first()[0] or 0
    levels = longest.bit_length()
    for k in range(1, levels):
        far = F.lead(f"g{k - 1}", 1 << (k - 1)).over(s)
        own = own.withColumn(f"g{k}", F.when(far.isNotNull(), _mix(f"g{k - 1}", far)))
    places = stored(own.withColumn("before", F.lag("g0").over(s)).withColumn("after", F.lead("g0").over(s)).drop("h1", "h2", "occurrences", "island"))
    r = _branchings(places, levels).join(places.select("path", "idx", "before", F.col("first").alias("start_line")), ["path", "idx"])
    ends = places.select("path", F.col("idx").alias("to"), "after", F.col("last").alias("end_line"))
    r = stored(r.withColumn("to", F.col("idx") + F.col("size") - 1).join(ends, ["path", "to"]).select("cls", "n", "path", "start_line", "end_line", "before", "after"))
    kinds = stored(r.groupBy("cls", "n", "before", "after").agg(F.count("*").alias("both")))
    alike = lambda side: kinds.where(F.col(side).isNotNull()).groupBy("cls", side).agg(F.sum("both").alias(f"same_{side}"))
    kinds = kinds.join(alike("before"), ["cls", "before"], "left").join(alike("after"), ["cls", "after"], "left")
    open_ = F.col("before").isNull() | F.col("after").isNull()
    itself = (F.col("before").isNull() & F.col("after").isNull()).cast("long")
    others = F.col("n") - F.coalesce("same_before", F.lit(0)) - F.coalesce("same_after", F.lit(0)) + F.when(open_, 0).otherwise(F.col("both")) - itself
    good = stored(kinds.where(others > 0).select("cls", "before", "after"))
    same = (r["cls"] == good["cls"]) & r["before"].eqNullSafe(good["before"]) & r["after"].eqNullSafe(good["after"])
    return r.join(good, same, "left_semi").select(F.xxhash64("cls").alias("key"), "path", "start_line", "end_line")


def clone_sets(stmts: DataFrame, declarations: DataFrame | None = None, block: int = 5, min_lines: int = 10, max_places: int | None = 8, max_declarations: int = 1, max_literals: float | None = 0.25) -> DataFrame:
    """``key, path, start_line, end_line, lines, places`` of reported clone sets: two places or more that don't overlap, long enough, not at
    too many places (that's an interface, not a copy), spanning few declarations, and not mostly literals in their first place. The widest first.
    ``stmts``: path, line, stmt and, for the last test, tokens and literals; ``declarations``: path, line."""
    stmts = stored(stmts)  # they come from cutting texts into tokens, which is done once
    regions = matched_regions(blocks(collapse(stmts.select("path", "line", "stmt")), block))
    if declarations is not None:
        d = declarations.select("path", "line").distinct()
        spans = regions.join(d, "path", "left").groupBy("key", "path", "start_line", "end_line").agg(F.count_if(F.col("line").between(F.col("start_line"), F.col("end_line"))).alias("n"))
        regions = spans.where(F.col("n") <= max_declarations).drop("n")
    kept = stored(without_overlaps(regions, "key"))
    size = kept.groupBy("key").agg(F.count("*").alias("places"), F.max(F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.min(F.struct("path", "start_line", "end_line")).alias("lead"))
    size = size.where((F.col("places") >= 2) & (F.col("lines") >= min_lines))
    if max_places is not None:
        size = size.where(F.col("places") <= max_places)
    if max_literals is not None and "literals" in stmts.columns:
        lead = size.select("key", "lead.path", "lead.start_line", "lead.end_line").join(stmts.select("path", "line", "tokens", "literals"), "path").where("line between start_line and end_line")
        plain = lead.groupBy("key").agg((F.sum("literals") / F.sum("tokens")).alias("share")).where(F.col("share") <= max_literals)
        size = size.join(plain.select("key"), "key", "left_semi")
    out = kept.join(size.select("key", "lines", "places", "lead"), "key")
    return out.orderBy(F.desc(F.col("lines") * F.col("places")), "lead", "path", "start_line").drop("lead")
