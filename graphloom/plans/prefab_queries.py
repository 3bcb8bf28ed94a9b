"""Queries on prefabs that Spark derives from the tables: one per customer, with a node and a component per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prefab as P
from ..sources.storage import written
from ..sources.tables import table

ZEROS = "00000000-0000-4000-8000-"


def _priorities(spark, d):
    """The first characters of priorities, stored, as otherwise what is asked of these few is asked of each order first."""
    return written(table(spark, d, "orders").select(F.left("o_orderpriority", F.lit(1)).alias("p")).distinct().coalesce(1), "priorities")


def derived_prefabs(spark, d):
    """file, text: of each customer with orders, a root with a node per order by key; the order's component is a button
    if it is finished, else the script of its priority, and names the root and the priority's icon."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("f"), F.left("o_orderpriority", F.lit(1)).alias("p"))
    # Ids of scripts are made once for each priority. Texts are much longer than rows, so they are dealt over as many tasks
    # as a shuffle has, however few bytes the rows are.
    ids = _priorities(spark, d).select(F.col("p").alias("_p"), P.short_id(F.concat(F.lit(ZEROS + "00000000000"), "p")).alias("s"))
    o = o.join(F.broadcast(ids), F.col("p").eqNullSafe(F.col("_p"))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    per = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("k", "f", "p", "s"))).alias("orders"))
    num = lambda c: c.cast("string")
    node = lambda x, i: F.concat(F.lit('{"__type__":"cc.Node","_name":"o'), num(x["k"]), F.lit('","_parent":{"__id__":1},"_components":[{"__id__":'), num(2 * i + 3), F.lit("}]}"))
    kind = lambda x: F.when(x["f"], "cc.Button").otherwise(x["s"])
    part = lambda x, i: F.concat(F.lit('{"__type__":"'), kind(x), F.lit('","node":{"__id__":'), num(2 * i + 2), F.lit('},"root":{"__id__":1},"label":{"__id__":0},"size":3,"icon":{"__uuid__":"icon'), x["p"], F.lit('@a"}}'))
    rows = F.flatten(F.transform("orders", lambda x, i: F.array(node(x, i), part(x, i))))
    start = F.array(F.lit('{"__type__":"cc.Prefab","data":{"__id__":1}}'), F.concat(F.lit('{"__type__":"cc.Node","_name":"c'), num(F.col("o_custkey")), F.lit('","_parent":null}')))
    return per.select(F.concat(F.lit("ui/c"), "o_custkey", F.lit(".prefab")).alias("file"), F.concat(F.lit("["), F.array_join(F.concat(start, rows), ","), F.lit("]")).alias("text"))


def derived_catalog(spark, d):
    """The scripts and icons of the priorities; those of priority 5 are missing."""
    p = _priorities(spark, d).where("p <> '5'")
    meta = lambda path, uuid: p.select(path.alias("path"), F.concat(F.lit('{"uuid":"'), uuid, F.lit('"}')).alias("text"))
    return P.catalog(meta(F.concat(F.lit("s/P"), "p", F.lit(".ts.meta")), F.concat(F.lit(ZEROS + "00000000000"), "p")).union(meta(F.concat(F.lit("i/"), "p", F.lit(".png.meta")), F.concat(F.lit("icon"), "p"))))


def _objects(spark, d):
    return P.objects(derived_prefabs(spark, d))


def prefab_tree(spark, d):
    """The paths of all nodes."""
    return P.tree(_objects(spark, d))


def prefab_components(spark, d):
    """Components with their node's path, script and class."""
    return P.components(_objects(spark, d), derived_catalog(spark, d)).select("file", "path", "script", "class")


def prefab_references(spark, d):
    """What the fields of components refer to."""
    return P.references(_objects(spark, d), derived_catalog(spark, d)).groupBy("file", "field", "kind").agg(F.count(F.lit(1)).alias("n"))


def prefab_graph(spark, d):
    """Edges of the prefabs' graph by type."""
    found = _objects(spark, d)
    _, edges = P.graph(found, P.components(found, derived_catalog(spark, d)))
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("ends"))


def component_classes(spark, d):
    """Instances and nodes of each class and script."""
    return P.components(_objects(spark, d), derived_catalog(spark, d)).groupBy("class", F.coalesce("script", "type").alias("key")).agg(F.count(F.lit(1)).alias("instances"), F.count_distinct("path").alias("paths")).drop("key")


def component_counts(spark, d):
    """The least detail on the components of each prefab."""
    return P.component_groups(P.components(_objects(spark, d), derived_catalog(spark, d)), "counts")


def component_details(spark, d):
    """The first two groups of each prefab's classes, their first three nodes and their first instance."""
    g = P.component_groups(P.components(_objects(spark, d), derived_catalog(spark, d)), "full", groups=2, paths=3, instances=1)
    return g.select("file", "class", "component", "instances", "group", "truncated", F.array_join("node_paths", ",").alias("node_paths"), F.col("each")[0]["place"].alias("first"))


def binding_statuses(spark, d):
    """Statuses of parts' fields by brand, against what lines hold and override."""
    p, line = table(spark, d, "part"), table(spark, d, "lineitem")
    fields = p.select(F.col("p_brand").alias("script"), F.col("p_partkey").alias("field"), F.when(F.col("p_size") <= 25, "primitive").when(F.col("p_size") > 48, "unknown").otherwise("reference").alias("kind"))
    used = line.select(F.col("l_partkey").alias("field"), "l_returnflag", "l_linenumber").join(p.select(F.col("p_partkey").alias("field"), F.col("p_brand").alias("script")), "field")
    return P.audit_counts(P.audit(fields, used.where("l_linenumber = 1"), used.where("l_returnflag = 'R' AND l_linenumber = 2")))


_O = """o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus = 'F' AS f, left(o_orderpriority, 1) AS p, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS i FROM orders)"""
_C = f"""{_O}, c AS (SELECT 'ui/c'||c||'.prefab' AS file, 'c'||c||'/o'||k AS path, CASE WHEN NOT f AND p <> '5' THEN 's/P'||p||'.ts' END AS script, CASE WHEN f THEN 'builtin' WHEN p <> '5' THEN 'custom-script' ELSE 'unresolved' END AS class, CASE WHEN f THEN 'B' ELSE p END AS g, p, 2 * i + 1 AS place FROM o)"""
#: The short id of the script of priority 5.
_SHORT = "'00000AAAABAAIAAAAAAAAAF'"

QUERIES = {
    "prefab_tree": (prefab_tree, f"WITH {_O} SELECT DISTINCT 'ui/c'||c||'.prefab' AS file, 1 AS place, 'c'||c AS path, 1 AS depth FROM o UNION ALL SELECT 'ui/c'||c||'.prefab', 2 * i, 'c'||c||'/o'||k, 2 FROM o"),
    "prefab_components": (prefab_components, f"WITH {_C} SELECT file, path, script, class FROM c"),
    "prefab_references": (prefab_references, f"""WITH {_C}, r AS (SELECT file, 'root' AS field, 'node' AS kind FROM c UNION ALL SELECT file, 'label', 'component' FROM c UNION ALL SELECT file, 'icon', CASE WHEN p = '5' THEN 'missing' ELSE 'asset' END FROM c)
SELECT file, field, kind, count(*) AS n FROM r GROUP BY ALL"""),
    "prefab_graph": (prefab_graph, f"WITH {_C} SELECT 'contains' AS type, count(*) AS n, count(*) AS ends FROM c UNION ALL SELECT 'binds', count(script), count(DISTINCT script) FROM c"),
    "component_classes": (component_classes, f"WITH {_C} SELECT class, count(*) AS instances, count(DISTINCT path) AS paths FROM c GROUP BY class, script"),
    "component_counts": (component_counts, f"WITH {_C} SELECT file, class, count(DISTINCT coalesce(script, g)) AS components, count(*) AS instances FROM c GROUP BY 1, 2"),
    "component_details": (component_details, f"""WITH {_C}, u AS (SELECT *, CASE WHEN class = 'builtin' THEN 'cc.Button' WHEN script IS NOT NULL THEN script ELSE {_SHORT} END AS component FROM c),
g AS (SELECT file, class, component, count(*) AS instances, array_to_string(list_sort(list(DISTINCT path))[1:3], ',') AS node_paths, min(place) AS first FROM u GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY file, class ORDER BY instances DESC, component) AS INTEGER) AS "group", count(*) OVER (PARTITION BY file, class) > 2 AS truncated FROM g)
SELECT file, class, component, instances, "group", truncated, node_paths, CAST(first AS INTEGER) AS first FROM r WHERE "group" <= 2"""),
    "binding_statuses": (binding_statuses, """WITH l AS (SELECT l_partkey AS k, bool_or(l_linenumber = 1) AS s, bool_or(l_returnflag = 'R' AND l_linenumber = 2) AS o FROM lineitem GROUP BY 1),
x AS (SELECT p_brand AS script, CASE WHEN o THEN 'o' WHEN s AND p_size <= 25 THEN 'c' WHEN s THEN 'b' WHEN p_size <= 25 THEN 'd' WHEN p_size > 48 THEN 'u' ELSE 'm' END AS st FROM part LEFT JOIN l ON k = p_partkey)
SELECT script, """ + ", ".join(f"count(*) FILTER (WHERE st = '{c}') AS {n}" for c, n in (("o", "override_bound"), ("c", "configured"), ("b", "bound"), ("d", "script_default"), ("u", "unsupported"), ("m", "missing"))) + " FROM x GROUP BY 1"),
}
