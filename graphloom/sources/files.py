"""Readers and writers of project files: source trees, manifests, logs and keyed tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Folders that a scan leaves out.
IGNORED = (".git", ".runtime", ".next", ".nuxt", "build", "coverage", "dist", "node_modules", "out")


def ignored(path: Column, more: tuple = ()) -> Column:
    """Whether a path within a root has a folder that is left out, or a part of ``more``."""
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    found = F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(x) for x in IGNORED]))
    for part in more:
        found = found | F.contains(low, F.lit(part.lower()))
    return found


def scan(spark: SparkSession, root: str, globs: tuple = ("**",), more: tuple = ()) -> DataFrame:
    """path (within ``root``), size, mtime_ms, content of the files below ``root`` that match a glob.

    Ignored folders are those within the root, whatever the root itself is called.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    place = re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", root).rstrip("/") + "/"
    within = F.regexp_replace("path", rf"^.*?\Q{place}\E", "")
    files = files.withColumn("path", within).where(~ignored(F.col("path"), more) & T.any_glob(F.col("path"), list(globs)))
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")


def signatures(files: DataFrame) -> DataFrame:
    """path, size, mtime_ms, content_hash."""
    return files.select("path", "size", "mtime_ms", F.sha2("content", 256).alias("content_hash"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; a line that does not parse is kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Appends to a log of JSON lines (K5)."""
    df.write.mode("append").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str, kept: tuple = (), counted: str | None = None) -> DataFrame:
    """Rows by ``key``: new values win, columns ``kept`` stay as first written, ``counted`` sums writes (K4, K6, K8)."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")

    def value(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == counted:
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return F.coalesce(a, b) if c in kept else F.coalesce(b, a)

    return joined.select(*[value(c).alias(c) for c in old.columns])


def vue_scripts(pages: DataFrame, text: str = "text") -> DataFrame:
    """The non-empty script blocks of each row's markup, joined by a blank line."""
    blocks = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1)), lambda b: F.trim(b) != "")
    return pages.withColumn("script", F.array_join(blocks, "\n\n"))


def headings(docs: DataFrame, text: str = "text") -> DataFrame:
    """The first '#' heading of each document."""
    return docs.withColumn("heading", F.regexp_extract(text, r"(?m)^#\s+(.*)$", 1))


def changed_in_diff(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """The files that a unified diff writes (X32), one row each."""
    return diffs.withColumn("file", F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^\+\+\+ b/(.+)$"), F.lit(1))))
