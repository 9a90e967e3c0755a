"""Source trees as a relation: path, language, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.functions import scalars as S

#: File extensions by language.
EXTENSIONS = {
    "bash": ("sh", "bash"), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh"), "csharp": ("cs",), "css": ("css",), "dockerfile": ("dockerfile", "docker"),
    "elixir": ("ex", "exs"), "go": ("go",), "groovy": ("groovy", "gvy", "gy", "gsh"), "hcl": ("tf", "hcl"), "html": ("html", "htm"), "java": ("java",), "json": ("json",),
    "kotlin": ("kt", "kts"), "lua": ("lua",), "php": ("php",), "python": ("py",), "ruby": ("rb",), "rust": ("rs",), "scala": ("scala", "sc"), "swift": ("swift",),
    "typescript": ("ts", "tsx", "js", "jsx"), "xml": ("xml",), "yaml": ("yaml", "yml"),
}
#: Directories of other people's or built code, anywhere in a path.
VENDORED_DIRS = (
    "vendor", "vendors", "node_modules", "bower_components", "dist", "build", "third_party", "third-party", "3rdparty", "public/assets", "public/external", "public/demo",
)


def language_of(path: Column) -> Column:
    """NULL for an unknown extension."""
    ext = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    return S.lookup(ext, {e: lang for lang, es in EXTENSIONS.items() for e in es})


def is_vendored(path: Column) -> Column:
    p = F.lower(path)
    return p.rlike("\\.(min\\.js|min\\.css|bundle\\.js)$") | F.concat(F.lit("/"), p).rlike(f"/({'|'.join(VENDORED_DIRS)})/")


def source_files(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files under ``root`` of a known language, that match an inclusion glob if there are any and no exclusion, are UTF-8 and not
    vendored. ``path`` is relative to the root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.regexp_replace("path", f"^[a-z]+:/*{root.rstrip('/').lstrip('/')}/", "")
    files = raw.select(at.alias("path"), "content").withColumn("language", language_of(F.col("path"))).where("language is not null")
    matches = lambda globs: F.exists(F.array(*(F.col("path").rlike(S.glob_to_regex(g)) for g in globs)), lambda x: x)
    if include:
        files = files.where(matches(include))
    if exclude:
        files = files.where(~matches(exclude))
    text = F.decode("content", "UTF-8")
    files = files.where(F.expr("is_valid_utf8(content)") & ~is_vendored(F.col("path")))
    return files.select("path", "language", text.alias("content"), S.is_test_path(F.col("path")).alias("is_test_path"))
