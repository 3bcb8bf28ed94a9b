"""Snapshots: what changed between two lists of file signatures, and what that means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 2


def diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path, change: added, deleted, changed or same; generated files are compared by hash, others by time."""
    s, c = stored.alias("s"), current.alias("c")
    j = s.join(c, F.col("s.path") == F.col("c.path"), "full_outer")
    generated = F.coalesce(F.col("c.generated"), F.lit(False))
    differs = F.when(generated, (F.col("s.hash") != F.col("c.hash")) | (F.col("s.size") != F.col("c.size"))).otherwise((F.col("s.size") != F.col("c.size")) | (F.col("s.mtime") != F.col("c.mtime")))
    change = F.when(F.col("s.path").isNull(), "added").when(F.col("c.path").isNull(), "deleted").when(differs, "changed").otherwise("same")
    time_only = (F.col("s.size") == F.col("c.size")) & (F.col("s.mtime") != F.col("c.mtime"))
    return j.select(F.coalesce("c.path", "s.path").alias("path"), change.alias("change"), F.coalesce(time_only, F.lit(False)).alias("mtime_only"))


def status(changes: DataFrame) -> DataFrame:
    """One row: counts and fresh or stale (V3)."""
    g = changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "deleted", "changed", "same")])
    return g.withColumn("status", F.when(F.col("added") + F.col("deleted") + F.col("changed") > 0, "stale").otherwise("fresh"))


#: Why a table is not fresh, in this order.
REASONS = ("missing-kb", "missing-kb-config", "missing-source-snapshot", "source-snapshot-version-unsupported", "source-files-added", "source-files-deleted", "source-files-changed", "tool-version-changed")


def states(tables: DataFrame, changes: DataFrame, tool: str = "") -> DataFrame:
    """key, status, stale, reasons, action of knowledge tables (V3): missing, unknown, stale or fresh.

    ``tables``: key, built (boolean), configured (boolean), snapshot (the version of its snapshot, null if it has none),
    tool (the version it was built with); ``changes``: key, path, change as ``diff`` gives it. One that was never built is
    missing. Without its configuration, without a snapshot, or with one of another version than ``VERSION``, it is
    unknown; else it is stale if a file was added, deleted or changed. One built by another version than ``tool``, if both
    are told, is stale in any case.
    """
    g = changes.groupBy("key").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "deleted", "changed")])
    j = tables.join(g, "key", "left")
    has = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    built, configured = F.coalesce("built", F.lit(False)), F.coalesce("configured", F.lit(False))
    known = built & configured & F.col("snapshot").eqNullSafe(VERSION)
    other = built & F.lit(tool != "") & (F.coalesce("tool", F.lit("")) != "") & (F.coalesce("tool", F.lit("")) != tool)
    tests = (~built, built & ~configured, built & configured & F.col("snapshot").isNull(), built & configured & (F.coalesce("snapshot", F.lit(VERSION)) != VERSION), known & has("added"), known & has("deleted"), known & has("changed"), other)
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS, strict=True)]))
    source = F.when(~built, "missing").when(~known, "unknown").when(has("added") | has("deleted") | has("changed"), "stale").otherwise("fresh")
    found = j.select("key", F.when(other, "stale").otherwise(source).alias("status"), reasons.alias("reasons"))
    return found.select("key", "status", (F.col("status") != "fresh").alias("stale"), "reasons", F.when(F.col("status") == "fresh", "").otherwise("rebuild").alias("action"))


def fingerprint(files: DataFrame, digits: int = 3) -> DataFrame:
    """bucket, files, fingerprint: hashes of the sorted signatures in buckets by the first ``digits`` of the path's hash.

    No task sorts the whole list: what is hashed together is one bucket.
    """
    sig = F.concat_ws("|", "path", F.col("size").cast("string"), "hash")
    return files.groupBy(F.substring(F.md5("path"), 1, digits).alias("bucket")).agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(sig)), "\n"), 256).alias("fingerprint"))


#: Signatures that a bucket holds on average at most.
HELD = 256


def whole_fingerprint(files: DataFrame, held: float = HELD, digits: int | None = None) -> DataFrame:
    """One row: files, fingerprint: a tree of hashes (V1). The leaves are buckets of about ``held`` files, as many digits as
    that takes, three at least; each level above hashes the 4096 buckets below it, in order. With ``digits``, a multiple of
    three, the tree is as deep whatever the number of files, so that fingerprints compare while a project grows."""
    if digits is None:
        digits, n = 3, files.count()
        while n > held * 16**digits:
            digits += 3
    level = fingerprint(files, digits)
    for up in range(digits - 3, -1, -3):
        lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "fingerprint"))), "\n")
        level = level.groupBy(F.substring("bucket", 1, up).alias("bucket")).agg(F.sum("files").alias("files"), F.sha2(lines, 256).alias("fingerprint"))
    # An empty list has a fingerprint too.
    return level.agg(F.coalesce(F.max("files"), F.lit(0)).alias("files"), F.coalesce(F.max("fingerprint"), F.sha2(F.lit("").cast("binary"), 256)).alias("fingerprint"))


def gate(status: str, policy: str = "require_fresh") -> dict:
    """Whether a query may run and whether a rebuild comes first, by freshness and policy.

    'allow_stale' always runs; 'auto_rebuild' rebuilds what is not fresh; 'require_fresh' refuses it.
    """
    if policy not in ("allow_stale", "auto_rebuild", "require_fresh"):
        raise ValueError(f"unknown policy: {policy}")
    fresh = status == "fresh"
    return {"status": status, "stale": not fresh, "run": fresh or policy != "require_fresh", "rebuild": not fresh and policy == "auto_rebuild"}
