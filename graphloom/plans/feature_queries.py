"""Queries on features, catalogs, data roots, learned shares and routing over the given tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import discovery as D
from ..operators import features as FE
from ..operators import learn as L
from ..sources.storage import shared_dir
from ..sources.tables import outcomes, table


def feature_configs(spark, d):
    """The configurations of brands as candidates, those that are at least of medium confidence."""
    p = table(spark, d, "part")
    c = p.groupBy(F.lower(F.regexp_replace("p_brand", "#", "-")).alias("key")).agg(F.max("p_brand").alias("name"), F.count(F.lit(1)).alias("score"), F.array_sort(F.collect_set(F.substring_index("p_type", " ", 1))).alias("methodRoots"))
    c = c.withColumn("confidence", F.when(F.col("score") % 3 == 0, "high").when(F.col("score") % 3 == 1, "medium").otherwise("low"))
    kept = FE.write_candidates(c, shared_dir(spark, "candidates"), "medium")
    x = FE.configurations(kept, "kb/features", "kb/configs", "docs/features")
    get = lambda k: F.get_json_object("text", f"$.{k}")
    return x.select("key", "path", get("featureName").alias("name"), get("outputs.graph").alias("graph"), get("docs.featureIndex").alias("docs"), F.size(F.from_json(get("methodRoots"), "array<string>")).alias("roots"), get("prefabs").alias("prefabs"))


def feature_artifacts(spark, d):
    """Where the customers' graphs and lookups are: at their own path, under the usual or the older name, or not."""
    c = table(spark, d, "customer").withColumn("k", F.col("c_custkey")).withColumn("at", F.concat(F.lit("kb/c"), "c_custkey"))
    records = c.select(F.col("c_name").alias("key"), F.col("at").alias("dir"), F.when(F.col("k") % 4 == 0, F.concat(F.lit("own//g"), "k", F.lit(".json"))).alias("graph"), F.lit("").alias("lookup"))
    when = lambda test, path: c.where(test).select(path.alias("path"))
    files = when("k % 8 = 0", F.concat(F.lit("own/g"), "k", F.lit(".json"))).union(when("k % 3 = 0", F.concat("at", F.lit("/chain.graph.json")))).union(when("k % 5 = 0", F.concat("at", F.lit("/graph.json"))))
    files = files.union(when("k % 2 = 0", F.concat("at", F.lit("/chain.lookup.json")))).union(when("k % 7 = 0", F.concat("at", F.lit("/lookup.json"))))
    return FE.artifacts(records, files)


def merged_catalog(spark, d):
    """Customers as candidates, configured and registered features: the last value that is not empty."""
    c = table(spark, d, "customer").withColumn("k", F.col("c_custkey"))
    none = F.array().cast("array<string>")
    row = lambda df, title, summary, roots: df.select(F.col("c_name").alias("key"), title.alias("title"), summary.alias("summary"), roots.alias("roots"))
    first = row(c, F.lit("candidate"), F.col("c_mktsegment"), F.array(F.concat(F.lit("n"), "c_nationkey")))
    second = row(c.where("k % 2 = 0"), F.lit("configured"), F.when(F.col("k") % 4 == 0, F.lit("own")).otherwise(""), none)
    third = row(c.where("k % 3 = 0"), F.lit(None).cast("string"), F.lit(""), F.when(F.col("k") % 9 == 0, F.array(F.lit("r"))).otherwise(none))
    return FE.merged_catalog(first, second, third).withColumn("roots", F.array_join("roots", ","))


def data_root_summary(spark, d):
    """What a data root of the nations' and suppliers' workspaces holds."""
    registered = table(spark, d, "nation").select(F.concat(F.lit("w"), "n_nationkey").alias("id"))
    manifests = table(spark, d, "supplier").select(F.concat(F.lit("w"), F.col("s_suppkey") % 40).alias("id"))
    issues = table(spark, d, "customer").where("c_acctbal < 0").select(F.when(F.col("c_custkey") % 2 == 0, "WORKSPACE_ID_COLLISION").otherwise("ROOT_MISSING").alias("code"), F.when(F.col("c_custkey") % 5 == 0, "error").otherwise("warning").alias("severity"))
    return FE.data_root(registered, manifests, issues).withColumn("actions", F.array_join("actions", ","))


def learned_events(spark, d):
    """Events by kind of source, target and component: how often, their share of the kind, handlers and evidence."""
    line = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("source_kind"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("n"), F.col("l_linenumber"))).alias("target"), F.concat(F.lit("C"), F.col("l_suppkey") % 3).alias("component"), F.concat(F.lit("on"), F.col("l_partkey") % 4).alias("handler"), F.concat(F.lit("p"), "l_orderkey", F.lit(".prefab")).alias("file"))
    found = L.learned_shares(line, ["source_kind"], ["target", "component"], "file", "handler")
    return found.withColumn("handler", F.array_join("handler", ",")).withColumn("evidence", F.array_join("evidence", ","))


def learned_bindings(spark, d):
    """Kinds of bindings of each component's field, placements of components, kinds of assets by folder."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("component"), F.concat(F.lit("f"), F.col("p_size") % 4).alias("field"), F.substring_index("p_type", " ", 1).alias("kind"), F.col("p_partkey").alias("file"))
    one = lambda df, name, *c: df.select(F.lit(name).alias("pattern"), F.concat_ws("|", *c).alias("key"), "n", "confidence", F.array_join("evidence", ",").alias("evidence"))
    fields = one(L.learned_shares(p, ["component", "field"], ["kind"], "file"), "field", "component", "field", "kind")
    placed = one(L.learned_shares(p, ["component"], ["field"], "file"), "placement", "component", "field")
    assets = one(L.learned_shares(p, [], ["kind"], "file"), "asset", "kind")
    return fields.union(placed).union(assets)


def routing_patterns(spark, d):
    """Routes and requests by kind and protocol, and by protocol, transport and callee."""
    e = table(spark, d, "events")
    return L.routing(e.select(F.col("event_type").alias("kind"), F.when(F.col("value") < 50, "http").otherwise("ws").alias("protocol"), F.concat(F.lit("t"), F.col("user_id") % 2).alias("transport"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("callee")))


def compact_outcomes(spark, d):
    """The users' turns as compact records, with files relative to the workspace."""
    o = outcomes(spark, d)
    many = lambda c, n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(c), i))
    r = o.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "task", "outcome", F.timestamp_seconds(F.col("conv_id")).alias("recorded"), F.transform(many("/Work/App/f", F.col("conv_id") % 15 + 1), lambda f: T.workspace_relative(f, "/work/app")).alias("changed"), many("v", F.col("turn") % 10 + 1).alias("validation"), F.lit(None).cast("array<string>").alias("observations"))
    scores = o.select(F.concat_ws("-", "conv_id", "turn").alias("id"), (F.col("conv_id") % 30).cast("int").alias("score"))
    x = C.compact_outcomes(r, scores)
    return x.select("id", F.size("changed").alias("files"), F.col("changed")[0].alias("first"), F.size("validation").alias("validations"), F.size("observations").alias("observations"), "score", "confidence")


def app_candidates(spark, d):
    """Features that addresses and the pages of an app folder tell, and the folders next to them."""
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey")).withColumn("b", F.lower(F.regexp_replace("p_brand", "#", "")))
    empty = F.create_map().cast("map<string,string>")
    n = p.select(F.concat(F.lit("e"), "k").alias("id"), F.lit("endpoint").alias("type"), F.concat(F.lit("GET /api/"), "b", F.when(F.col("k") % 2 == 0, "/list").otherwise("/deep/:id/get")).alias("name"), F.lit("").alias("file"), F.lit("backend").alias("area"), empty.alias("meta"))
    pages = p.where("p_size % 4 = 0").select(F.concat(F.lit("a"), "k").alias("id"), F.lit("method").alias("type"), F.lit("Page").alias("name"), F.concat(F.lit("web/app/"), "b", F.when(F.col("k") % 2 == 0, "/page.tsx").otherwise("/x/route.ts")).alias("file"), F.lit("frontend").alias("area"), empty.alias("meta"))
    per, _ = D.candidates(D.seeds(n).unionByName(D.app_seeds(pages)))
    return per.select("key", "score", "nodes", "confidence")


_P = "p AS (SELECT p_partkey AS k, lower(replace(p_brand, '#', '')) AS b, p_size FROM part)"

QUERIES = {
    "feature_configs": (feature_configs, """WITH c AS (SELECT lower(replace(p_brand, '#', '-')) AS key, max(p_brand) AS name, count(*) AS score, count(DISTINCT split_part(p_type, ' ', 1)) AS roots FROM part GROUP BY 1)
SELECT key, 'kb/configs/'||key||'.json' AS path, name, 'kb/features/'||key||'/chain.graph.json' AS graph, 'docs/features/'||key||'/FEATURE.md' AS docs, CAST(roots AS INTEGER) AS roots, '[]' AS prefabs FROM c WHERE score % 3 < 2"""),
    "feature_artifacts": (feature_artifacts, """WITH c AS (SELECT c_custkey AS k, c_name AS key, 'kb/c'||c_custkey AS dir FROM customer)
SELECT key, CASE WHEN k % 8 = 0 THEN 'own/g'||k||'.json' WHEN k % 3 = 0 THEN dir||'/chain.graph.json' WHEN k % 5 = 0 THEN dir||'/graph.json' WHEN k % 4 = 0 THEN 'own/g'||k||'.json' ELSE dir||'/chain.graph.json' END AS graph,
 CASE WHEN k % 2 <> 0 AND k % 7 = 0 THEN dir||'/lookup.json' ELSE dir||'/chain.lookup.json' END AS lookup, CASE WHEN NOT (k % 8 = 0 OR k % 3 = 0 OR k % 5 = 0) THEN 'KB_NOT_FOUND' WHEN k % 2 = 0 OR k % 7 = 0 THEN 'found' ELSE 'rebuild-lookup' END AS status FROM c"""),
    "merged_catalog": (merged_catalog, """SELECT c_name AS key, CASE WHEN c_custkey % 2 = 0 THEN 'configured' ELSE 'candidate' END AS title, CASE WHEN c_custkey % 4 = 0 THEN 'own' ELSE c_mktsegment END AS summary, CASE WHEN c_custkey % 9 = 0 THEN 'r' ELSE 'n'||c_nationkey END AS roots FROM customer"""),
    "data_root_summary": (data_root_summary, """WITH r AS (SELECT 'w'||n_nationkey AS id FROM nation), m AS (SELECT DISTINCT 'w'||(s_suppkey % 40) AS id FROM supplier), i AS (SELECT c_custkey % 2 = 0 AS col, c_custkey % 5 = 0 AS err FROM customer WHERE c_acctbal < 0)
SELECT (SELECT count(*) FROM (SELECT id FROM r UNION SELECT id FROM m)) AS workspaces, (SELECT count(*) FROM r) AS registered, (SELECT count(*) FROM m WHERE id NOT IN (SELECT id FROM r)) AS manifest_only, count(*) AS issues, count(*) FILTER (WHERE err) AS errors, count(*) FILTER (WHERE NOT err) AS warnings,
 count(*) FILTER (WHERE err) = 0 AS ok, CASE WHEN count(*) FILTER (WHERE col) > 0 THEN 'resolve_workspace' ELSE '' END AS actions FROM i"""),
    "learned_events": (learned_events, """WITH l AS (SELECT l_returnflag AS source_kind, CASE WHEN l_linestatus = 'O' THEN 'n'||l_linenumber END AS target, 'C'||(l_suppkey % 3) AS component, 'on'||(l_partkey % 4) AS handler, 'p'||l_orderkey||'.prefab' AS file FROM lineitem),
g AS (SELECT source_kind, target, component, count(*) AS n, string_agg(DISTINCT handler, ',' ORDER BY handler) AS handler, array_to_string(list_sort(list(file))[1:10], ',') AS evidence FROM l GROUP BY 1, 2, 3)
SELECT source_kind, target, component, n, round(n / sum(n) OVER (PARTITION BY source_kind), 4) AS confidence, evidence, handler FROM g"""),
    "learned_bindings": (learned_bindings, """WITH p AS (SELECT p_brand AS c, 'f'||(p_size % 4) AS f, split_part(p_type, ' ', 1) AS k, p_partkey AS file FROM part),
a AS (SELECT 'field' AS pattern, c||'|'||f||'|'||k AS key, c||f AS w, count(*) AS n, array_to_string(list_sort(list(file))[1:10], ',') AS evidence FROM p GROUP BY c, f, k UNION ALL SELECT 'placement', c||'|'||f, c, count(*), array_to_string(list_sort(list(file))[1:10], ',') FROM p GROUP BY c, f
 UNION ALL SELECT 'asset', k, '', count(*), array_to_string(list_sort(list(file))[1:10], ',') FROM p GROUP BY k) SELECT pattern, key, n, round(n / sum(n) OVER (PARTITION BY pattern, w), 4) AS confidence, evidence FROM a"""),
    "routing_patterns": (routing_patterns, """WITH e AS (SELECT event_type AS kind, CASE WHEN value < 50 THEN 'http' ELSE 'ws' END AS protocol, 't'||(user_id % 2) AS transport, 'c'||(user_id % 3) AS callee FROM events)
SELECT 'kind' AS "grouping", kind, protocol, NULL AS transport, NULL AS callee, count(*) AS n FROM e GROUP BY kind, protocol UNION ALL SELECT 'callee', NULL, protocol, transport, callee, count(*) FROM e GROUP BY protocol, transport, callee"""),
    "compact_outcomes": (compact_outcomes, """SELECT conv_id||'-'||turn AS id, CAST(least(12, conv_id % 15 + 1) AS INTEGER) AS files, 'f1' AS first, CAST(least(8, turn % 10 + 1) AS INTEGER) AS validations, 0 AS observations, CAST(conv_id % 30 AS INTEGER) AS score, CASE WHEN conv_id % 30 >= 20 THEN 'high' WHEN conv_id % 30 >= 8 THEN 'medium' ELSE 'low' END AS confidence FROM conversations WHERE role = 'user'"""),
    "app_candidates": (app_candidates, f"""WITH {_P}, e AS (SELECT CASE WHEN k % 2 = 0 THEN regexp_replace(b, '([a-z])([0-9])', '\\1\\2') ELSE b||'-deep' END AS key, 45 AS w FROM p), a AS (SELECT b AS key, count(*) AS n FROM p WHERE p_size % 4 = 0 GROUP BY 1),
g AS (SELECT key, sum(w) AS w, count(*) AS n FROM e GROUP BY 1) SELECT key, CAST(coalesce(g.w, 0) + CASE WHEN a.n > 0 THEN 50 + least(6 * a.n, 40) ELSE 0 END AS BIGINT) AS score, coalesce(g.n, 0) + coalesce(a.n, 0) AS nodes, 'high' AS confidence FROM g FULL JOIN a USING (key)"""),
}
