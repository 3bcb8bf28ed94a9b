"""Rebuilding what a change touches: dependencies of files, the files affected, and facts of which only some partitions are
written anew (V11, K2, E29).

Facts lie in folders by a hash of their file. A version's pointer says in which version's folder each part of the facts
is, so a version that follows a change holds only the parts that the change touches and refers to the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import walk

#: Parts of the facts; a larger graph takes more.
PARTS = 64


def part_of(file: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(parts)).cast("int")


def dependencies(*links: DataFrame) -> DataFrame:
    """file, needs: which file needs which other, from links (file, target) such as resolved imports, references and
    nested prefabs; links without a target, and of a file to itself, are left out."""
    every = None
    for df in links:
        rows = df.select("file", F.col("target").alias("needs"))
        every = rows if every is None else every.union(rows)
    return every.where("file IS NOT NULL AND needs IS NOT NULL AND file <> needs").distinct()


def tracked(found: DataFrame, files: DataFrame) -> DataFrame:
    """file: the files of a scan and all that they need, each once."""
    return files.select("file").union(found.select("needs")).distinct()


def affected(found: DataFrame, changed: DataFrame) -> DataFrame:
    """file, depth: the changed files and all that need them, however far, each with its least distance."""
    step = found.select(F.col("needs").alias("from_id"), F.col("file").alias("to_id"))
    return walk(step, changed.select(F.col("file").alias("id")), None).select(F.col("id").alias("file"), "depth")


def _pointer(spark: SparkSession, root: str, version: int, places: dict[int, int]) -> None:
    rows = sorted(places.items())
    spark.createDataFrame([(version, p, v) for p, v in rows] or [(version, -1, version)], "version int, part int, held_in int").coalesce(1).write.mode("errorifexists").json(f"{root}/pointers/{version}")


def places(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """The newest version (or the one asked for) and, for each part, the version whose folder holds it: at most one row per
    part. A build that did not end has no pointer and counts as never begun."""
    found = spark.read.schema("version int, part int, held_in int").option("recursiveFileLookup", True).json(f"{root}/pointers")
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    if version is None:
        raise ValueError(f"no version below {root}")
    return version, {r["part"]: r["held_in"] for r in found.where(F.col("version") == version).collect() if r["part"] >= 0}


def _write(facts: DataFrame, root: str, version: int, parts: int) -> None:
    dealt = facts.withColumn("part", part_of(F.col("file"), parts)).repartition("part")
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{root}/version={version}")


def build(facts: DataFrame, root: str, version: int = 1, parts: int = PARTS) -> None:
    """Writes all facts (with a column ``file``) as a version."""
    _write(facts, root, version, parts)
    held = facts.sparkSession.read.parquet(f"{root}/version={version}").select("part").distinct()
    _pointer(facts.sparkSession, root, version, {r["part"]: version for r in held.collect()})


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The facts of the newest version (or of the one asked for), each part from the folder that holds it."""
    version, held = places(spark, root, version)
    schema = spark.read.parquet(*[f"{root}/version={v}" for v in sorted(set(held.values()) or {version})][:1]).drop("part").schema
    paths = [f"{root}/version={v}/part={p}" for p, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def rebuild(spark: SparkSession, root: str, touched: DataFrame, texts: DataFrame, extract: Callable[[DataFrame], DataFrame], parts: int = PARTS) -> int:
    """Publishes a next version in which the facts of ``touched`` files (file) are extracted anew from ``texts``, and gives
    the number of parts that were written.

    Only the parts of touched files are written: the facts of the other files of such a part are taken over. A touched
    file without a text is gone, and its facts are. The version before stays as it is.
    """
    version, held = places(spark, root)
    touched = touched.select("file").distinct()
    # At most one row per part.
    dirty = sorted(r["part"] for r in touched.select(part_of(F.col("file"), parts).alias("part")).distinct().collect())
    if dirty:
        fresh = extract(texts.join(touched, "file", "left_semi"))
        old = [f"{root}/version={held[p]}/part={p}" for p in dirty if p in held]
        if old:
            kept = spark.read.schema(fresh.schema).parquet(*old).join(touched, "file", "left_anti")
            fresh = fresh.unionByName(kept)
        _write(fresh, root, version + 1, parts)
        there = {r["part"] for r in spark.read.schema(f"{_ddl(fresh)}, part int").parquet(f"{root}/version={version + 1}").select("part").distinct().collect()}
        held = {p: v for p, v in held.items() if p not in dirty} | {p: version + 1 for p in there}
    _pointer(spark, root, version + 1, held)
    return len(dirty)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
