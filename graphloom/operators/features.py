"""Features of a workspace: their configurations, where their artifacts are, catalogs merged from several sources, and what
a data root holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What a feature's build puts out, and what older builds called the two that queries read.
OUTPUTS = {"scan": "scan.raw.json", "graph": "chain.graph.json", "lookup": "chain.lookup.json", "report": "build.report.json"}
OLDER = {"graph": "graph.json", "lookup": "lookup.json"}


def configurations(candidates: DataFrame, features_dir: str, configs_dir: str, docs_dir: str) -> DataFrame:
    """key, path, text (JSON) of the configuration of each candidate (B8): key, name, summary, areas and the roots that a
    build scans (arrays; missing ones are empty), its outputs and docs. A candidate without a key has none."""
    none = F.array().cast("array<string>")
    own = lambda c: F.coalesce(F.col(c), none) if c in candidates.columns else none
    of = lambda c: F.coalesce(F.col(c), F.lit("")) if c in candidates.columns else F.lit("")
    at = F.concat_ws("/", F.lit(features_dir), "key")
    docs = F.concat_ws("/", F.lit(docs_dir), "key")
    config = F.struct(
        F.col("key").alias("featureKey"), of("name").alias("featureName"), of("summary").alias("summary"), F.lit("feature").alias("type"), F.lit(True).alias("registerFeature"), own("areas").alias("areas"),
        *[own(c).alias(c) for c in ("methodRoots", "componentRoots", "assetRoots", "prefabs")],
        F.struct(*[F.concat(at, F.lit(f"/{file}")).alias(name) for name, file in OUTPUTS.items()]).alias("outputs"), F.struct(docs.alias("featureDir"), F.concat(docs, F.lit("/FEATURE.md")).alias("featureIndex")).alias("docs"),
    )
    return candidates.where(F.coalesce("key", F.lit("")) != "").select("key", F.concat(F.lit(configs_dir + "/"), "key", F.lit(".json")).alias("path"), F.to_json(config).alias("text"))


def write_candidates(candidates: DataFrame, path: str, least: str = "low") -> DataFrame:
    """Writes candidates (key, score, confidence, ...) of at least the confidence ``least`` as JSON lines below ``path``, the
    earlier ones replaced, and gives them back (K7)."""
    rank = lambda c: F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)
    kept = candidates.where(rank(F.col("confidence")) >= rank(F.lit(least)))
    kept.write.mode("overwrite").json(path)
    return candidates.sparkSession.read.schema(candidates.schema).json(path)


def artifacts(records: DataFrame, files: DataFrame) -> DataFrame:
    """key, graph, lookup, status of registered features (key, dir, graph, lookup) against the files (path) that are there
    (S15, S15b).

    A record's own path comes first, then the usual name below its folder, then the older one; the first that is there
    holds, else the first. 'found': both are there; 'rebuild-lookup': only the graph; 'KB_NOT_FOUND': no graph.
    """
    place = lambda name: F.filter(F.array(*[T.path_kept(c) for c in (F.coalesce(F.col(name), F.lit("")), F.concat_ws("/", "dir", F.lit(OUTPUTS[name])), F.concat_ws("/", "dir", F.lit(OLDER[name])))]), lambda p: p != "")
    each = None
    for name in ("graph", "lookup"):
        rows = records.select("key", F.lit(name).alias("name"), F.posexplode(place(name)).alias("n", "path"))
        each = rows if each is None else each.union(rows)
    there = files.select(T.path_kept(F.col("path")).alias("path")).distinct().withColumn("there", F.lit(True))
    first = each.join(there, "path", "left").groupBy("key", "name").agg(F.min_by(F.struct("path", "there"), F.struct(F.col("there").isNull().alias("gone"), "n")).alias("x"))
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("x")))
    g = first.groupBy("key").agg(of("graph").alias("g"), of("lookup").alias("l"))
    status = F.when(F.col("g.there").isNull(), "KB_NOT_FOUND").when(F.col("l.there").isNull(), "rebuild-lookup").otherwise("found")
    return g.select("key", F.col("g.path").alias("graph"), F.col("l.path").alias("lookup"), status.alias("status"))


def merged_catalog(*sources: DataFrame, key: str = "key") -> DataFrame:
    """One row for each key of several catalogs of the same columns, least important first (J13): of each column the last
    source's value that is not empty, a text, an array or a map."""
    columns = [c for c in sources[0].columns if c != key]
    every = None
    for i, s in enumerate(sources):
        rows = s.select(key, *columns).where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_source", F.lit(i))
        every = rows if every is None else every.unionByName(rows)

    def full(c: str) -> Column:
        kind = every.schema[c].dataType.typeName()
        return (F.size(c) > 0) if kind in ("array", "map") else F.col(c).isNotNull() & (F.col(c).cast("string") != "")

    return every.groupBy(key).agg(*[F.max_by(F.when(full(c), F.col(c)), F.when(full(c), F.col("_source"))).alias(c) for c in columns])


def data_root(registered: DataFrame, manifests: DataFrame, issues: DataFrame) -> DataFrame:
    """One row on a data root (A25, V7): workspaces, registered, manifest_only, issues, errors, warnings, ok and actions.

    ``registered`` and ``manifests``: id; ``issues``: code, severity. A workspace counts once, by either. Actions:
    to register what only a manifest names while nothing is registered, or whose manifest is missing, and to resolve
    identifiers that collide.
    """
    both = registered.select("id").distinct().withColumn("r", F.lit(True)).join(manifests.select("id").distinct().withColumn("m", F.lit(True)), "id", "full_outer")
    w = both.agg(F.count(F.lit(1)).alias("workspaces"), F.count("r").alias("registered"), F.count_if(F.col("r").isNull()).alias("manifest_only"))
    of = lambda c, v: F.count_if(F.col(c) == v)
    i = issues.agg(F.count(F.lit(1)).alias("issues"), of("severity", "error").alias("errors"), of("severity", "warning").alias("warnings"), of("code", "WORKSPACE_ID_COLLISION").alias("_collide"), of("code", "MANIFEST_MISSING").alias("_missing"))
    actions = F.array_compact(F.array(F.when(((F.col("registered") == 0) & (F.col("workspaces") > 0)) | (F.col("_missing") > 0), F.lit("register_workspace")), F.when(F.col("_collide") > 0, F.lit("resolve_workspace"))))
    one = w.crossJoin(F.broadcast(i))  # a row each
    return one.select("workspaces", "registered", "manifest_only", "issues", "errors", "warnings", (F.col("errors") == 0).alias("ok"), actions.alias("actions"))
