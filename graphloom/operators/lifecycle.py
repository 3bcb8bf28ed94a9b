"""Builds of knowledge tables: versions that appear whole, reports, indexes, targets of a rebuild and issues of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


_POINTER = "version int, tables array<string>, onto int"


def publish(tables: dict[str, DataFrame], root: str, version: int, onto: int | None = None) -> None:
    """Writes tables as one version below ``root``; readers see it once its last file, the pointer, is there.

    A build that fails leaves no pointer, so the version before it stays the current one; a version that has a pointer
    is never written again. With ``onto``, the tables are what this version adds to that one, whose folders it refers to.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/version={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, sorted(tables), onto)], _POINTER).coalesce(1).write.mode("errorifexists").json(f"{root}/pointers/{version}")


def newest(spark: SparkSession, root: str, *names: str) -> int | None:
    """The newest whole version of these tables, if it is the same for all of them."""
    found = spark.read.schema(_POINTER).option("recursiveFileLookup", True).json(f"{root}/pointers")
    of = {found.where(F.array_contains("tables", n)).agg(F.max("version").alias("v")).first()["v"] for n in names}
    return of.pop() if len(of) == 1 else None


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest whole version."""
    found = spark.read.schema(_POINTER).option("recursiveFileLookup", True).json(f"{root}/pointers").where(F.array_contains("tables", name))
    onto = {r["version"]: r["onto"] for r in found.collect()}
    if not onto:
        raise ValueError(f"no version of {name} below {root}")
    versions = [max(onto)]
    while (before := onto[versions[-1]]) is not None:
        versions.append(before)
    paths = [f"{root}/version={v}/{name}" for v in versions]
    return spark.read.schema(spark.read.parquet(paths[-1]).schema).parquet(*paths)


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what (nodes, edges), type, n of a build; type null for the whole (K9)."""
    n, e = nodes.select(F.lit("nodes").alias("what"), "type"), edges.select(F.lit("edges").alias("what"), "type")
    per = n.union(e).groupBy("what", "type").agg(F.count(F.lit(1)).alias("n"))
    return per.union(per.groupBy("what").agg(F.sum("n").alias("n")).select("what", F.lit(None).cast("string"), "n"))


def refreshed(*groups: DataFrame, key: str = "key", kept: tuple = (), merged: tuple = ()) -> DataFrame:
    """One row for each non-empty key of several indexes; of a column the last group that has the key counts.

    Columns ``kept`` keep the last value that is not empty; map columns ``merged`` keep the last value of each entry.
    Groups are few and each has a key once; repeats of a key within one group count as the greatest row.
    """
    columns = [c for c in groups[0].columns if c != key]
    every = None
    for i, g in enumerate(groups):
        rows = g.select(key, *columns).where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_group", F.lit(i))
        every = rows if every is None else every.unionByName(rows)

    def value(c: str):
        if c in kept:
            return F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("_group")))
        return F.max_by(F.struct(c), "_group")[c]

    once = every.groupBy(key).agg(*[value(c).alias(c) for c in columns if c not in merged])
    for c in merged:
        entries = every.select(key, "_group", F.explode(c).alias("k", "v")).groupBy(key, "k").agg(F.max_by("v", "_group").alias("v"))
        maps = entries.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(c))
        once = once.join(maps, key, "left")
    return once.select(key, *[F.coalesce(c, F.lit("")).alias(c) if c in kept else F.col(c) for c in columns])


def rebuild_targets(registered: DataFrame, present: DataFrame) -> DataFrame:
    """key, path, registered, present: the configurations to rebuild, one for each path.

    ``registered`` and ``present`` have key and path; a path in both is rebuilt once, under its registered key. One that
    is registered and not present is a failure to report, not to build.
    """
    norm = lambda df, flag: df.where("path <> ''").groupBy(T.path_kept(F.col("path")).alias("path")).agg(F.min("key").alias(f"_{flag}"), F.lit(True).alias(flag))
    both = norm(registered, "registered").join(norm(present, "present"), "path", "full_outer")
    return both.select(F.coalesce("_registered", "_present").alias("key"), "path", F.coalesce("registered", F.lit(False)).alias("registered"), F.coalesce("present", F.lit(False)).alias("present"))


#: Fields of a configuration that name paths.
PATH_FIELDS = ("componentRoots", "assetRoots", "methodRoots", "serverRoots", "moduleRoots", "dbRoots", "prefabs")


def path_issues(configs: DataFrame, files: DataFrame, required: DataFrame) -> DataFrame:
    """config, severity, issue, path.

    ``configs``: config, text (JSON); ``files``: path of every file below the root; ``required``: path of folders that
    must be there (config is empty for those). A text that is no JSON object is an error; a Windows path is an error and
    a path that no file has or lies below is a warning.
    """
    one = lambda f: F.coalesce(F.from_json(F.get_json_object("text", f"$.{f}"), "array<string>"), F.array(F.get_json_object("text", f"$.{f}")))
    whole = F.from_json("text", "map<string,string>")
    bad = configs.where(whole.isNull()).select("config", F.lit("error").alias("severity"), F.lit("unparsable").alias("issue"), F.lit("").alias("path"))
    named = configs.where(whole.isNotNull()).select("config", F.explode(F.array_distinct(F.flatten(F.array(*[one(f) for f in PATH_FIELDS])))).alias("path")).where("path <> ''")
    windows = named.where(F.col("path").rlike(r"^[A-Za-z]:[\\/]")).select("config", F.lit("error"), F.lit("windows-path"), "path")
    tidy = lambda c: F.regexp_replace(F.regexp_replace(T.path_kept(c), r"^(\./)+", ""), "/$", "")
    # Every folder above a file is there too; each is made once per file, then distinct.
    parts = F.split(tidy(F.col("path")), "/")
    there = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("_there")).distinct()
    asked = named.unionByName(required.select(F.lit("").alias("config"), "path"))
    gone = asked.withColumn("_there", tidy(F.col("path"))).join(there, "_there", "left_anti").select("config", F.lit("warning"), F.lit("missing"), "path")
    return bad.union(windows).union(gone)


def latest_first(workspaces: DataFrame) -> DataFrame:
    """Workspaces by their last update, the newest first; equal ones by id."""
    return workspaces.orderBy(F.desc_nulls_last("updated_at"), "id")
