"""Search operators: facets, tiers of selectors, ambiguity, term scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What a node's type adds to its score.
TYPE_BONUS = {"endpoint": 3, "request": 3, "method": 2, "table": 1, "external-service": 1}
#: Order of the recommendation groups.
GROUP = {"endpoint": 1, "route": 3, "request": 5, "method": 6, "binding": 7, "ui-node": 7, "component": 7, "asset": 7, "event": 8, "message": 8, "state": 9, "table": 9}


def area_of(path: Column, declared: Column) -> Column:
    """The area that a path tells, else the declared one."""
    p = T.path(path)
    return F.when(p.rlike("cms-client|xy-client|assets/script"), "frontend").when(p.rlike("cms-server|qy-server|app/http|app/servers"), "backend").otherwise(declared)


def search(nodes: DataFrame, name: str = "", kind: str | None = None, area: str | None = None, module: str = "", without: str = "", limit: int | None = None) -> DataFrame:
    """Nodes by type, area, module, excluded module and name; ``limit`` by name and id."""
    df = nodes.where(T.contains(F.concat_ws(" ", "name", "id"), name))
    if kind:
        df = df.where(F.col("type") == kind)
    if area:
        df = df.where((F.col("area") == area) | (area_of(F.col("file"), F.col("area")) == area))
    if module:
        df = df.where(T.path_matches(F.col("file"), module))
    if without:
        df = df.where(~T.path_matches(F.col("file"), without))
    return df.orderBy("name", "id").limit(limit) if limit else df


def having_edge(nodes: DataFrame, edges: DataFrame, kind: str, needle: str) -> DataFrame:
    """Nodes with an outgoing edge of a type whose target contains ``needle`` (F8)."""
    e = edges.where((F.col("type") == kind) & T.contains(F.col("dst"), needle)).select(F.col("src").alias("id"))
    return nodes.join(e, "id", "left_semi")


def resolve(nodes: DataFrame, selector: str) -> DataFrame:
    """The nodes of the best tier: id, exact name, part of the name or file; several are ambiguous."""
    s = selector.strip().lower()
    tier = F.when(F.col("id") == selector, 1).when(T.normal(F.col("name")) == s, 2).when(T.contains(F.concat_ws(" ", "name", "file"), selector), 3)
    hits = nodes.withColumn("tier", tier).where("tier IS NOT NULL")
    best = hits.agg(F.min("tier").alias("tier"))  # one row
    return hits.join(F.broadcast(best), "tier").select("id", "type", "name", "tier")


def recommend(candidates: DataFrame, per_group: int = 5) -> DataFrame:
    """The first candidates by name of each type group, groups in their order."""
    rank = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in GROUP.items()], F.lit(99))
    w = Window.partitionBy("type").orderBy("name", "id")
    return candidates.withColumn("priority", rank).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_group).select("priority", "type", "place", "id", "name")


def terms_of(text: str) -> list[str]:
    """Distinct terms of two letters or more."""
    import re

    return sorted({t for t in re.split(r"[^a-z0-9_./:-]+", text.lower()) if len(t) >= 2})


def score_nodes(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """id, name, score: 12 for a term that is the name, 8 or 5 for one in the text, and the type's bonus.

    Terms are few and literal, so the sum is one expression per node: no join, no shuffle.
    """
    text = F.lower(F.concat_ws(" ", "type", "name", "file", "area"))
    hit = F.lit(0)
    for t in terms:
        hit = hit + F.when(T.normal(F.col("name")) == t, 12).when(F.contains(text, F.lit(t)), 8 if "/" in t else 5).otherwise(0)
    bonus = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in TYPE_BONUS.items()], F.lit(0))
    return nodes.select("id", "name", (hit + bonus).alias("score")).where("score > 0")


def top(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best by score, ties by the columns given (T1-T4): one TakeOrdered, no full sort."""
    return scored.orderBy(F.desc("score"), *ties).limit(k)


def longest_prefix(items: DataFrame, roots: list[tuple[str, str]], path: str = "path") -> DataFrame:
    """Adds ``area``: that of the longest root that is the path or a folder above it; 'unknown' without one.

    Roots come from configuration, so they are literals of one expression; of equal lengths the first holds.
    """
    p, area = T.path(F.col(path)), None
    for root, name in sorted(roots, key=lambda r: -len(r[0])):
        r = root.lower().rstrip("/")
        hit = (p == r) | p.startswith(r + "/")
        area = F.when(hit, name) if area is None else area.when(hit, name)
    return items.withColumn("area", area.otherwise("unknown") if area is not None else F.lit("unknown"))


def suffixes(path: Column) -> Column:
    """A path and all that is left of it after a slash, the longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def suffix_matches(nodes: DataFrame, files: DataFrame, file: str = "file", changed: str = "changed") -> DataFrame:
    """Pairs of a node's file and a changed file where one is the other or ends with it at a slash.

    The join is by whole paths: a node's file, or what is left of it after a slash, is a changed file; or what is left of
    a changed file is a node's. A last part that most paths share is no key by itself, so it is no hot key either.
    """
    longer = nodes.withColumn("_key", F.explode(suffixes(F.col(file)))).join(files.withColumn("_key", F.col(changed)), "_key")
    left = F.explode(F.filter(suffixes(F.col(changed)), lambda s, i: i > 0))
    shorter = nodes.withColumn("_key", F.col(file)).join(files.withColumn("_key", left), "_key")
    return longer.unionByName(shorter).drop("_key")
