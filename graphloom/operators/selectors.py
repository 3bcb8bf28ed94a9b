"""What a selector means: facets, tiers of starts, suggestions, and the shape of a traversal.

Nodes have id, type, name, file, area, tags (array) and meta (map); a missing key is as an empty value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import GROUP, area_of

#: What a fuzzy match looks at besides name, file and tags.
FUZZY = ("methodName", "statePath", "route", "path", "importPath", "kind", "protocol", "serviceKind", "target", "host", "packageName")
#: What a search by name looks at besides those.
SEARCHED = (*FUZZY, "transport", "callee", "httpMethod", "sourceKind", "scriptPath", "prefabPath", "assetPath", "summary")
#: Selectors that must name a node, and those that may also find one by a part of it.
EXACT, LOOSE = ("method", "event", "message", "state"), ("request", "endpoint")
#: Types that are suggested where nothing is found.
SUGGESTED = ("method", "request", "endpoint", "route", "script", "message")


def meta(key: str) -> Column:
    return F.coalesce(F.try_element_at("meta", F.lit(key)), F.lit(""))


def _any(columns: list[Column], needle: str) -> Column:
    hit = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: T.contains(t, needle))
    for c in columns:
        hit = hit | T.contains(c, needle)
    return hit


def facets(nodes: DataFrame, area: str = "", module: str = "", without: str = "", protocol: str = "", path: str = "") -> DataFrame:
    """Nodes by area (told or declared), module, excluded module, protocol and path."""
    file = F.coalesce(F.nullif(F.col("file"), F.lit("")), F.nullif(meta("scriptPath"), F.lit("")), meta("prefabPath"))
    http = F.when((F.col("type") == "endpoint") | ((F.col("type") == "request") & (meta("httpMethod") != "")), "http").otherwise("")
    found = nodes.where(T.contains(F.concat_ws(" ", "area", area_of(file, F.col("area"))), area))
    if module:
        found = found.where(T.in_module(file, module))
    if without:
        found = found.where(~T.in_module(file, without))
    found = found.where(T.contains(F.concat_ws(" ", meta("protocol"), meta("transport"), meta("kind"), http), protocol))
    return found.where(T.contains(F.concat_ws(" ", "name", *[meta(k) for k in ("path", "route", "target", "host", "packageName", "serviceKind", "prefabPath", "assetPath")]), path))


def search(nodes: DataFrame, edges: DataFrame | None = None, kind: str = "", name: str = "", tag: str = "", file: str = "", handler: str = "", limit: int | None = None, **facet: str) -> DataFrame:
    """Nodes by type, facets, name (in any field or tag), tag, file and handler; ``limit`` by name and id."""
    found = facets(nodes, **facet)
    if kind:
        found = found.where(F.col("type") == kind)
    if name:
        found = found.where(_any([F.col("name"), F.col("file"), *[meta(k) for k in SEARCHED]], name))
    if tag:
        found = found.where(F.exists("tags", lambda t: T.contains(t, tag)))
    if file:
        found = found.where(T.path_matches(F.col("file"), file))
    if handler:
        bound = edges.where((F.col("type") == "binds") & T.contains(F.col("dst"), handler)).select(F.col("src").alias("id"))
        found = found.join(bound, "id", "left_semi")
    return found.orderBy("name", "id").limit(limit) if limit else found


def ranked(nodes: DataFrame, query: str) -> DataFrame:
    """``tier``: 1 the id, 2 the name or state path, 3 a method's own name, 4 a part of a field or a tag."""
    exact = (F.col("name") == query) | (meta("statePath") == query)
    own = (F.col("type") == "method") & (meta("methodName") == query)
    tier = F.when(F.col("id") == query, 1).when(exact, 2).when(own, 3).when(_any([F.col("name"), F.col("file"), *[meta(k) for k in FUZZY]], query), 4)
    return nodes.withColumn("tier", tier).where("tier IS NOT NULL")


def start(nodes: DataFrame, query: str, kind: str | None = None, **facet: str) -> DataFrame:
    """id, type, name, tier, ambiguous of the best tier (G4-G6): nothing if none matches; several are ambiguous.

    With a type, methods, events, messages and states must be named; requests and endpoints may be found by a part.
    """
    if kind is not None and kind not in EXACT + LOOSE:
        raise ValueError(f"unknown selector: {kind}")
    hits = ranked(facets(nodes if kind is None else nodes.where(F.col("type") == kind), **facet), query)
    if kind in EXACT:
        hits = hits.where("tier < 4")
    best = hits.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct("tier", "n")).alias("b")).select("b.*")  # one row
    return hits.join(F.broadcast(best), "tier").select("id", "type", "name", "tier", (F.col("n") > 1).alias("ambiguous"))


def spec(upstream: bool = False, downstream: bool = False, origin: str | None = None, direction: str | None = None, **typed: str) -> dict:
    """What to traverse: one typed selector with upstream or downstream, else ``origin`` and ``direction``."""
    named = {k: v for k, v in typed.items() if v}
    if len(named) > 1 or set(named) - set(EXACT + LOOSE):
        raise ValueError(f"one selector of {', '.join(EXACT + LOOSE)} is needed")
    if upstream and downstream:
        raise ValueError("upstream and downstream exclude each other")
    if named and not origin:
        kind, query = next(iter(named.items()))
        return {"kind": kind, "query": query, "direction": "upstream" if upstream else "downstream"}
    if not origin:
        raise ValueError("nothing to start from")
    return {"kind": None, "query": origin, "direction": direction or ("upstream" if upstream else "downstream")}


def suggestions(nodes: DataFrame, query: str, kinds: tuple = SUGGESTED, most: int = 3) -> DataFrame:
    """type, place, id, name: the first nodes of each type that a search for the name finds."""
    found = search(nodes.where(F.col("type").isin(*kinds)), name=query)
    place = F.row_number().over(Window.partitionBy("type").orderBy("name", "id"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("type", "place", "id", "name")


def business_group(nodes: DataFrame, roots: tuple[tuple[str, bool], ...], most: int = 5) -> DataFrame:
    """group, priority, place, id, name: the first nodes of each group.

    ``roots``: folders in order of priority and whether their HTTP nodes form a group of their own; what lies in none
    is grouped by type, ten places later.
    """
    http = (F.col("type") == "endpoint") | (meta("httpMethod") != "") | (meta("protocol") == "http")
    where = T.path(F.concat_ws(" ", "file", meta("path"), "name"))
    group, priority = F.col("type"), 10 + F.coalesce(*[F.when(F.col("type") == k, v) for k, v in GROUP.items()], F.lit(99))
    for i, (root, apart) in reversed(list(enumerate(roots))):
        hit = F.contains(where, F.lit(f"/{root}/"))
        group = F.when(hit & http, root + "-http" if apart else root).when(hit, root).otherwise(group)
        priority = F.when(hit, i + 1).otherwise(priority)
    w = Window.partitionBy("group").orderBy("name", "id")
    return nodes.select(group.alias("group"), priority.alias("priority"), "id", "name").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def resolved_only(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Traversed edges but those of unresolved calls."""
    unresolved = nodes.where("type = 'unresolved-call'").select(F.col("id").alias("dst"))
    return found.where("type <> 'unresolved_calls'").join(unresolved, "dst", "left_anti").select(*found.columns)


def http_mainline(found: DataFrame, nodes: DataFrame, start_file: str = "") -> DataFrame:
    """Traversed edges that lead to requests, endpoints and routes, or to methods of another file."""
    kept = F.col("type").isin("request", "endpoint", "route") | ((F.col("type") == "method") & ~F.coalesce(T.same_path(F.col("file"), F.lit(start_file)), F.lit(False)))
    return found.join(nodes.where(kept).select(F.col("id").alias("dst")), "dst", "left_semi").select(*found.columns)


def semantic(methods: DataFrame, operation: str = "", flow_from: str = "", flow_to: str = "", least: str = "low", limit: int | None = None) -> DataFrame:
    """Methods (id, operations array<struct<type,detail>>, flows array<struct<from,to>>, complexity) that fit all tests,
    with up to five matched operations and ``total``, most complex first (F9)."""
    order = lambda c: F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)
    matched = F.filter("operations", lambda o: T.contains(o["type"], operation))
    found = methods.where((F.size(matched) > 0) | F.lit(not operation)).where(order(F.col("complexity")) >= order(F.lit(least)))
    if flow_from or flow_to:
        found = found.where(F.exists("flows", lambda x: T.contains(x["from"], flow_from) & T.contains(x["to"], flow_to)))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    out = found.select("id", "complexity", F.slice(matched, 1, 5).alias("matched")).crossJoin(F.broadcast(total))  # one row
    out = out.orderBy(F.desc(order(F.col("complexity"))), "id")
    return out.limit(limit) if limit else out


def protocol_search(patterns: DataFrame, needle: str) -> DataFrame:
    """Rows of learned patterns where any scalar, array or map value holds the needle."""
    hit = F.lit(False)
    for f in patterns.schema:
        kind, c = f.dataType.typeName(), F.col(f.name)
        if kind == "array":
            hit = hit | F.exists(c, lambda x: T.contains(x.cast("string"), needle))
        elif kind == "map":
            hit = hit | F.exists(F.map_values(c), lambda x: T.contains(x.cast("string"), needle))
        else:
            hit = hit | T.contains(c.cast("string"), needle)
    return patterns.where(F.coalesce(hit, F.lit(False)))
