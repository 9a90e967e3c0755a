"""Incremental analysis: results kept by what they depend on, a file's content and the configuration, so a run analyses only what changed.

A store is a folder of generations, each a Parquet folder of its own that counts once its commit marker stands in it; a run appends one with
what it had to analyse, so a run that dies leaves no half state behind and two runs at once do no harm. A base generation replaces all before it:
``compact`` writes one with the entries that are still asked for, and only then removes the others. Files are listed by Spark's own
file system layer, so a store may lie wherever Spark can write.

Defined results: a missing store is empty, and so is what can't be read of it (its files are analysed again); equal contents are analysed once;
a null content is an empty file; files that the analysis finds nothing in are remembered too.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = re.compile(r"^(gen|base)-(\d{9})-[0-9a-f]+$")


@dataclass(frozen=True)
class Store:
    """Entries ``content_key, config_key, results`` of one schema in a folder."""

    spark: SparkSession
    folder: str
    results: T.DataType

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("content_key", T.StringType()), T.StructField("config_key", T.StringType()), T.StructField("results", self.results)])

    def _fs(self):  # noqa: ANN202
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def generations(self) -> list[tuple[int, str]]:
        """Number and folder of the generations that count, oldest first: the last base and what came after it."""
        fs, path = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        found = []
        for s in fs.listStatus(path(self.folder)):
            m = NAME.match(s.getPath().getName())
            if m and fs.exists(path(s.getPath(), "_SUCCESS")):
                found.append((int(m[2]), m[1], f"{self.folder}/{s.getPath().getName()}"))
        found.sort()
        base = max((n for n, kind, _ in found if kind == "base"), default=0)
        return [(n, f) for n, kind, f in found if n > base or n == base and kind == "base"]

    def read(self, config_key: str | None = None) -> DataFrame:
        """Its entries, one for each key; of one configuration, if that is named."""
        folders = [f for _, f in self.generations()]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(self.schema).option("ignoreCorruptFiles", "true").parquet(*folders)
        if config_key is not None:
            df = df.where(F.col("config_key") == config_key)
        return df.where("content_key is not null and results is not null").groupBy("content_key", "config_key").agg(F.any_value("results").alias("results"))

    def _write(self, entries: DataFrame, kind: str, number: int) -> str:
        folder = f"{self.folder}/{kind}-{number:09d}-{uuid.uuid4().hex}"
        entries.select("content_key", "config_key", "results").write.parquet(folder)
        return folder

    def append(self, entries: DataFrame) -> str:
        return self._write(entries, "gen", max((n for n, _ in self.generations()), default=0) + 1)

    def replace(self, entries: DataFrame) -> str:
        return self._write(entries, "base", max((n for n, _ in self.generations()), default=0) + 1)

    def compact(self, asked: DataFrame) -> None:
        """One base generation with the entries whose content_key and config_key are in ``asked``; the others go."""
        old = self.generations()
        if not old:
            return
        kept = self.read().join(asked.select("content_key", "config_key").distinct(), ["content_key", "config_key"], "left_semi")
        self.replace(kept)
        fs, path = self._fs()
        for _, f in old:
            fs.delete(path(f), True)


def content_key(content: Column) -> Column:
    return F.sha2(F.coalesce(content.cast("string"), F.lit("")).cast("binary"), 256)


def analyse(files: DataFrame, store: Store, config_key: str, analysis: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``path, content_key, hit, results`` of ``files`` (path, content). ``analysis`` takes the contents that the store lacks (content_key, content),
    each once, and gives ``content_key, results``; what it doesn't name has empty results. hit: the store had it before this run."""
    keyed = files.select("path", F.col("content"), content_key(F.col("content")).alias("content_key"))
    known = store.read(config_key)
    lacking = keyed.join(known.select("content_key"), "content_key", "left_anti").dropDuplicates(["content_key"]).select("content_key", F.coalesce("content", F.lit("")).alias("content"))
    found = analysis(lacking).select("content_key", F.col("results").cast(store.results).alias("results"))
    none = F.array().cast(store.results)
    entries = lacking.select("content_key").join(found, "content_key", "left").select("content_key", F.lit(config_key).alias("config_key"), F.coalesce("results", none).alias("results"))
    fresh = store.append(entries)
    new = store.spark.read.schema(store.schema).parquet(fresh).select("content_key", "results", F.lit(False).alias("hit"))
    both = known.select("content_key", "results", F.lit(True).alias("hit")).unionByName(new)
    return keyed.select("path", "content_key").join(both, "content_key").select("path", "content_key", "hit", "results")


#: The columns of a tracked issue in a stored baseline, and of its display form.
ENTRY = "rule_file decimal(20,0), fingerprint decimal(20,0), line_hash decimal(20,0), summary struct<rule:string,severity:string,file:string,line:int,message:string>"
SEVERITIES = ("Info", "Minor", "Major", "Critical", "Blocker")


def save_baseline(issues: DataFrame, folder: str) -> None:
    """The issues of an analysis, columns as in ENTRY, as the next baseline; the one before stays readable until this one is whole."""
    schema = T.StructType.fromDDL(ENTRY)
    store = Store(issues.sparkSession, folder, T.ArrayType(schema))
    entries = issues.select(F.lit("all").alias("config_key"), F.hash("fingerprint").cast("string").alias("content_key"), F.array(F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))).alias("results"))
    store.replace(entries)


def load_baseline(spark: SparkSession, at: str) -> DataFrame | None:
    """The issues of the newest whole baseline of a folder, or of a JSON file: entries, entries without a display form, or bare fingerprints. None if
    there is none or it can't be read. A display form of unknown severity is left out."""
    schema = T.StructType.fromDDL(ENTRY)
    if at.endswith(".json"):
        try:
            text = spark.read.option("wholetext", "true").text(at)
            text.limit(1).count()
        except Exception:  # noqa: BLE001  a store of any kind may fail in its own way; no baseline then
            return None
        whole = F.from_json("value", f"array<struct<{ENTRY}>>", {"mode": "PERMISSIVE"})
        bare = F.from_json("value", "array<decimal(20,0)>")
        first = F.regexp_extract("value", r"^\s*\[\s*(.)", 1)
        read = text.select(F.when(first == "{", whole).otherwise(F.transform(bare, lambda x: F.struct(F.lit(None).cast("decimal(20,0)").alias("rule_file"), x.alias("fingerprint"), F.lit(None).cast("decimal(20,0)").alias("line_hash"), F.lit(None).cast(schema["summary"].dataType).alias("summary")))).alias("results"))
        if read.where("results is null or exists(results, r -> r.fingerprint is null)").limit(1).count():
            return None
        rows = read.select(F.inline("results"))
    else:
        s = Store(spark, at, T.ArrayType(schema))
        folders = [f for _, f in s.generations()]
        if not folders:
            return None
        rows = spark.read.schema(s.schema).option("ignoreCorruptFiles", "true").parquet(folders[-1]).select(F.inline("results"))
    return rows.withColumn("summary", F.when(F.col("summary.severity").isin(*SEVERITIES), F.col("summary")))
