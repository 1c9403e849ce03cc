"""Source trees as tables (S-01 to S-07, S-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import ENDINGS

# Directories that are never read; file names that hold manifests.
IGNORED = [".git", ".idea", ".vscode", "node_modules", "target", "dist", "build", "out", "coverage"]
MANIFESTS = ["package.json", "pyproject.toml", "requirements.txt", "cargo.toml", "go.mod", "pom.xml", "build.gradle", "pubspec.yaml"]
CPP_HEADER = r"(?m)^\s*(namespace |class |template\s*<|using namespace )|#\s*include\s*<(iostream|string|vector|memory|map)>"


def read_tree(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """path (relative), name, content, size, modified of all files under root; listing and reading are distributed."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    start = root.split("://")[-1].rstrip("/")
    relative = F.regexp_replace(base, f"^.*?{_quoted(start)}/", "")
    out = rows.select(relative.alias("path"), F.substring_index("path", "/", -1).alias("name"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    parts = F.split("path", "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    out = out.where(~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in IGNORED])))
    return out if hidden else out.where(~F.exists(parts, lambda p: F.startswith(p, F.lit("."))))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def with_language(files: DataFrame) -> DataFrame:
    """files with their language; `.h` files with marks of C++ are C++ (S-04, S-05). Others than known ones go."""
    end = F.lower(F.substring_index("name", ".", -1))
    known = F.create_map(*[F.lit(x) for lang, ends in ENDINGS.items() for e in ends for x in (e, lang)])
    head = F.substring(F.col("content").cast("string"), 1, 262144)
    language = F.when((end == "h") & head.rlike(CPP_HEADER), "cpp").otherwise(F.try_element_at(known, end))
    return files.withColumn("language", language).where("language is not null")


def inventory(files: DataFrame, largest: int = 10_485_760) -> tuple[DataFrame, DataFrame]:
    """Files with text, lines and content hash, and diagnostics for those that are too large (S-03)."""
    text = F.col("content").cast("string")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    file_id = F.concat(F.lit("file_"), F.substring(F.sha2("path", 256), 1, 24))
    small = files.where(F.col("size") <= largest).select(file_id.alias("file_id"), "path", "language", "size", lines.alias("lines"), F.sha2("content", 256).alias("content_hash"), text.alias("text"))
    big = files.where(F.col("size") > largest).select(F.lit("warning").alias("severity"), F.lit("FILE_TOO_LARGE").alias("code"), F.concat(F.col("size").cast("string"), F.lit(" bytes")).alias("message"), "path")
    return small, big


def manifests(files: DataFrame) -> DataFrame:
    """Files whose name is a manifest's (S-07)."""
    return files.where(F.lower("name").isin(MANIFESTS))


def fingerprint(files: DataFrame) -> Column:
    """Aggregate: one hash over the ordered (path, content hash) rows (S-06)."""
    rows = F.array_sort(F.collect_list(F.struct("path", "content_hash")))
    return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat(r["path"], F.lit("\0"), r["content_hash"], F.lit("\0"))), ""), 256)


def labels(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Label documents of a folder (S-17)."""
    return spark.read.schema(schema).option("multiLine", "true").json(folder)
