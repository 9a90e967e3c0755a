"""Import specifiers to files: joins on computed keys, the first candidate by rank wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions of modules.
TS_EXTENSIONS = ("ts", "tsx", "js", "jsx")


def normalize(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; a climb above the root is dropped."""
    return F.array_join(
        F.aggregate(
            F.split(path, "/"), F.array().cast("array<string>"),
            lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
        ),
        "/",
    )


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ts_candidates(files: DataFrame) -> DataFrame:
    """``stem, target``: what a file can be imported as: its path without the extension, and its directory if it is an index."""
    own = files.where(F.regexp_extract("path", "\\.([^./]+)$", 1).isin(*TS_EXTENSIONS)).select(F.regexp_replace("path", "\\.[^./]+$", "").alias("stem"), F.col("path").alias("target"))
    return own.unionByName(own.where(F.col("stem").rlike("(^|/)index$")).select(F.regexp_replace("stem", "/?index$", "").alias("stem"), "target"))


def resolve_ts(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``importer, specifier, target`` of relative specifiers and, where none fits, aliases ``prefix, directory`` by the longest prefix;
    of several files that fit, the first in the order of paths."""
    relative = imports.where(F.col("specifier").startswith(".")).withColumn("stem", normalize(F.concat(directory(F.col("importer")), F.lit("/"), "specifier"))).withColumn("weight", F.lit(0))
    asked = relative
    if aliases is not None:
        a = F.broadcast(aliases)  # the paths of one project file
        via = imports.where(~F.col("specifier").startswith(".")).join(a, F.col("specifier").startswith(F.col("prefix")))
        stem = normalize(F.concat("directory", F.lit("/"), F.expr("substring(specifier, length(prefix) + 1)")))
        asked = relative.unionByName(via.withColumn("stem", stem).withColumn("weight", -F.length("prefix")).select(*relative.columns))
    asked = asked.withColumn("stem", F.regexp_replace("stem", "\\.(ts|tsx|js|jsx)$", ""))
    hits = asked.join(ts_candidates(files), "stem")
    return hits.groupBy("importer", "specifier").agg(F.min_by("target", F.struct("weight", "target")).alias("target"))


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``importer, module, name, target``: absolute modules by their path; N leading dots climb N - 1 directories, then the submodule, else
    the imported name beside it, else the package. ``imports``: importer, module, name."""
    dots = F.length(F.regexp_extract("module", "^(\\.*)", 1))
    rest = F.translate(F.regexp_replace("module", "^\\.+", ""), ".", "/")
    climb = F.concat(directory(F.col("importer")), F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0))))
    base = F.when(dots == 0, rest).otherwise(normalize(F.concat(climb, F.lit("/"), rest)))
    asked = imports.withColumn("base", base).select("*", F.posexplode(F.array(F.when(rest != "", F.col("base")), F.concat_ws("/", F.when(F.col("base") != "", F.col("base")), "name"), F.col("base"))).alias("rank", "stem")).where("stem is not null")
    own = files.where(F.col("path").endswith(".py")).select(F.regexp_replace(F.regexp_replace("path", "\\.py$", ""), "/__init__$", "").alias("stem"), F.col("path").alias("target"))
    hits = asked.join(own, "stem").where("target <> importer")
    return hits.groupBy("importer", "module", "name").agg(F.min_by("target", F.struct("rank", "target")).alias("target"))


def resolve_go(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``importer, specifier, target``: the file whose directory shares the longest suffix of at least two segments (one, if the import has
    no more); ties go to the least path."""
    suffixes = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/").alias("suffix")))
    a = imports.withColumn("need", F.least(F.lit(2), F.size(F.split("specifier", "/")))).select("*", F.explode(suffixes(F.split("specifier", "/"))).alias("s")).where("s.n >= need")
    f = files.where(F.col("path").endswith(".go")).select(F.col("path").alias("target"), F.explode(suffixes(F.split(directory(F.col("path")), "/"))).alias("t"))
    hits = a.select("importer", "specifier", F.col("s.n").alias("n"), F.col("s.suffix").alias("suffix")).join(f.select("target", F.col("t.suffix").alias("suffix")), "suffix")
    return hits.groupBy("importer", "specifier").agg(F.min_by("target", F.struct(-F.col("n"), F.col("target"))).alias("target"))


def resolve_rust(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``importer, specifier, target``: crate, self and super paths to the file of the longest prefix that is one; the importer itself is none."""
    own = F.regexp_replace(F.regexp_replace("importer", "\\.rs$", ""), "/(mod|lib|main)$", "")
    crate = F.regexp_extract("importer", "^(.*?src)(/|$)", 1)
    supers = F.regexp_count("specifier", F.lit("(^|::)super(?=::|$)"))
    rest = F.translate(F.regexp_replace(F.regexp_replace("specifier", "^(crate|self)::", ""), "^(super::)+", ""), ":", "/")
    base = F.when(F.col("specifier").startswith("crate::"), crate).otherwise(F.concat(own, F.repeat(F.lit("/.."), supers)))
    full = normalize(F.concat(base, F.lit("/"), F.regexp_replace(rest, "/+", "/")))
    parts = F.split("full", "/")
    asked = imports.where(F.col("specifier").rlike("^(crate|self|super)::")).withColumn("full", full)
    asked = asked.select("importer", "specifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("stem")))).alias("p")).select("importer", "specifier", "p.n", "p.stem")
    found = files.where(F.col("path").endswith(".rs")).select(F.regexp_replace(F.regexp_replace("path", "\\.rs$", ""), "/mod$", "").alias("stem"), F.col("path").alias("target"))
    best = asked.join(found, "stem").groupBy("importer", "specifier").agg(F.max_by("target", F.struct("n", "target")).alias("target"))
    return best.where("target <> importer")
