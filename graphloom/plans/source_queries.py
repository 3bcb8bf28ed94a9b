"""Queries on source facts, summaries and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as X
from ..operators import graph as G
from ..operators import search as S
from ..sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table
from ..streaming import events as E


def page_facts(spark, d):
    """Facts in the pages' markup and scripts."""
    return X.facts(table(spark, d, "pages"), "page_id", "html").withColumnRenamed("file", "page_id")


def page_complexity(spark, d):
    """E22, A26 over the pages' scripts."""
    p = table(spark, d, "pages")
    return X.complexity(X.facts(p, "page_id", "html", ("call",)), p, "page_id", "html").withColumnRenamed("file", "page_id")


def page_call_graph(spark, d):
    """How many pages call what."""
    _, e = X.graph(X.facts(table(spark, d, "pages"), "page_id", "html"))
    return e.groupBy("dst", "type").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"))


def request_targets(spark, d):
    """Targets of links, normalised."""
    h = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))
    return h.groupBy(T.target(F.col("href")).alias("target")).agg(F.count(F.lit(1)).alias("n"))


def search_grouped(spark, d):
    """How many nodes of each type a search finds, and how many of them a limit of 20 shows."""
    found = S.search(nodes(spark, d), name="1").groupBy("type").agg(F.count(F.lit(1)).alias("total"))
    return found.select("type", "total", F.least("total", F.lit(20)).alias("returned"), (F.col("total") > 20).alias("truncated"))


def edge_summary(spark, d):
    """The first eight edges of each node by type and target, with the ends' names."""
    w = Window.partitionBy("src").orderBy("type", "dst")
    first = edges(spark, d).groupBy("src", "type", "dst").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(w)).where("place <= 8")
    names = nodes(spark, d).select("id", "name")
    joined = first.join(names.toDF("src", "src_name"), "src", "left").join(names.toDF("dst", "dst_name"), "dst", "left")
    return joined.select("src", "type", "dst", "n", "place", F.coalesce("src_name", "src").alias("src_name"), F.coalesce("dst_name", "dst").alias("dst_name"))


def node_degrees(spark, d):
    """Incoming and outgoing edges of every node that has any."""
    return G.degrees(edges(spark, d))


def tag_union(spark, d):
    """The tags of all parts of a brand, each once."""
    tags = table(spark, d, "part").select("p_brand", F.explode(T.search_tags(F.col("p_name"), F.col("p_type"))).alias("tag")).distinct()
    return tags.groupBy("p_brand").agg(F.count(F.lit(1)).alias("tags"), F.min("tag").alias("first"), F.max("tag").alias("last"))


def event_windows_stream(spark, d):
    """Tumbling hours of the event stream (extension)."""
    # A pattern, as a stream's plain path must be a folder and the table can be one file.
    counts = E.window_counts(E.event_stream(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema))
    return E.drained(counts, "event-windows").withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


def external_services(spark, d):
    """E19 over the pages: their own addresses and the requests, imports and texts of their scripts."""
    p = table(spark, d, "pages")
    f = X.facts(p, "page_id", "html", ("import", "request"))
    asked = f.where("kind = 'request'").select("file", F.col("detail").alias("target"), F.lit("request").alias("source"))
    asked = asked.union(p.select("page_id", "url", F.lit("page")))
    found = X.external_services(p, asked, f.where("kind = 'import'").select("file", F.col("detail").alias("specifier")), "page_id", "html")
    return found.withColumnRenamed("file", "page_id")


def node_paths(spark, d):
    """The way from region to nation, customer and order."""
    named = lambda t, own, parent, name: table(spark, d, t).select(F.concat(F.lit(t + ":"), own).alias("id"), parent.alias("parent"), F.col(name).cast("string").alias("name"))
    up = lambda t, c: F.concat(F.lit(t + ":"), c)
    tree = named("region", "r_regionkey", F.lit(None).cast("string"), "r_name").union(named("nation", "n_nationkey", up("region", "n_regionkey"), "n_name"))
    tree = tree.union(named("customer", "c_custkey", up("nation", "c_nationkey"), "c_name")).union(named("orders", "o_orderkey", up("customer", "o_custkey"), "o_orderkey"))
    return G.node_paths(tree)


_KEYWORDS = ", ".join(f"'{k}'" for k in X.KEYWORDS)
_FACTS = "f AS (" + " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, trim(subject) AS subject, detail FROM (SELECT page_id, unnest(regexp_extract_all(html, $p${p}$p$, 1)) AS subject, unnest(regexp_extract_all(html, $p${p}$p$, 2)) AS detail FROM pages)" for k, p in X.RULES.items()) + f"), g AS (SELECT page_id, kind, subject, detail, count(*) AS n FROM f WHERE kind <> 'call' OR subject NOT IN ({_KEYWORDS}) GROUP BY ALL)"
_EDGE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.EDGES.items()) + " END"
_TOK = lambda c: f"list_filter(string_split_regex(lower(trim(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_./:@-]', ' ', 'g'))), '\\s+'), lambda t: t <> '')"
_SYN = lambda c: "list_concat(" + ", ".join(f"CASE WHEN contains(lower(trim({c})), '{k}') THEN [" + ", ".join(f"'{t}'" for t in tags) + "] ELSE [] END" for k, tags in T.SYNONYMS.items()) + ")"

QUERIES = {
    "page_facts": (page_facts, f"WITH {_FACTS} SELECT * FROM g"),
    "page_complexity": (page_complexity, f"""WITH {_FACTS}, c AS (SELECT page_id, sum(n) AS calls FROM g WHERE kind = 'call' GROUP BY 1),
x AS (SELECT p.page_id, len(regexp_extract_all(html, '\\b(if|switch|case|catch)\\b')) AS branches, len(regexp_extract_all(html, '\\b(for|while)\\b')) AS loops, CAST(coalesce(calls, 0) AS BIGINT) AS calls FROM pages p LEFT JOIN c ON p.page_id = c.page_id)
SELECT page_id, CAST(branches AS INTEGER) AS branches, CAST(loops AS INTEGER) AS loops, calls, CASE WHEN branches + 2 * loops + 0.5 * calls <= 2 THEN 'low' WHEN branches + 2 * loops + 0.5 * calls <= 5 THEN 'medium' ELSE 'high' END AS level FROM x"""),
    "page_call_graph": (page_call_graph, f"""WITH {_FACTS}, e AS (SELECT page_id, kind||':'||CASE WHEN kind IN ('state-write', 'call', 'model-access') THEN subject ELSE detail END AS dst, {_EDGE} AS type, sum(n) AS n FROM g WHERE {_EDGE} IS NOT NULL GROUP BY 1, 2, 3)
SELECT dst, type, count(*) AS pages, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY 1, 2"""),
    "request_targets": (request_targets, r"""WITH h AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT regexp_replace(regexp_replace(regexp_replace(replace(href, '${API_BASE}', '/api'), '\$\{[^}]*\}', '', 'g'), '\?.*$', '', 'g'), '(^|[^:])/{2,}', '\1/', 'g') AS target, count(*) AS n FROM h GROUP BY 1"""),
    "search_grouped": (search_grouped, f"WITH {NODES_SQL} SELECT type, count(*) AS total, least(count(*), 20) AS returned, count(*) > 20 AS truncated FROM n WHERE contains(lower(name||' '||id), '1') GROUP BY 1"),
    "edge_summary": (edge_summary, f"""WITH {NODES_SQL}, {EDGES_SQL}, g AS (SELECT src, type, dst, count(*) AS n FROM e GROUP BY 1, 2, 3),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY type, dst) AS INTEGER) AS place FROM g QUALIFY place <= 8)
SELECT f.*, coalesce(a.name, src) AS src_name, coalesce(b.name, dst) AS dst_name FROM f LEFT JOIN n a ON a.id = src LEFT JOIN n b ON b.id = dst"""),
    "node_degrees": (node_degrees, f"WITH {EDGES_SQL} SELECT id, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id"),
    "external_services": (external_services, rf"""WITH {_FACTS}, r AS (SELECT page_id, detail AS target, 'request' AS source FROM g WHERE kind = 'request' UNION ALL SELECT page_id, url, 'page' FROM pages),
t AS (SELECT page_id, source, trim(regexp_replace(regexp_replace(regexp_replace(replace(target, '${{API_BASE}}', '/api'), '\$\{{[^}}]*\}}', '', 'g'), '\?.*$', '', 'g'), '(^|[^:])/{{2,}}', '\1/', 'g')) AS target FROM r),
h AS (SELECT *, regexp_replace(lower(regexp_extract(target, '^https?://(?:[^/?#@]*@)?([^/?#]+)', 1, 'i')), ':(80|443)$', '') AS host FROM t),
i AS (SELECT page_id, trim(detail) AS spec, html FROM g JOIN pages USING (page_id) WHERE kind = 'import' AND trim(detail) <> '' AND NOT regexp_matches(trim(detail), '^(\.|/|@/|~/)|:')),
k AS (SELECT page_id, CASE WHEN spec = '@anthropic-ai/sdk' AND regexp_matches(html, '\b(Anthropic|messages\.create)\b') THEN 'Anthropic Claude' WHEN spec = '@prisma/client' OR regexp_matches(html, '\bPrismaClient\b') THEN 'Prisma ORM'
  WHEN starts_with(spec, 'next/') THEN 'Next.js Runtime' WHEN spec = 'next-auth' OR starts_with(spec, 'next-auth/') OR starts_with(spec, '@auth/') THEN 'NextAuth' END AS name, CASE WHEN starts_with(spec, '@') THEN split_part(spec, '/', 1)||'/'||split_part(spec, '/', 2) ELSE split_part(spec, '/', 1) END AS package FROM i),
u AS (SELECT page_id, 'Facebook Graph API' AS name, 'http-api' AS service_kind, 'https://graph.facebook.com' AS target, 'graph.facebook.com' AS host, '' AS package, 'literal' AS source, 0 AS place FROM pages WHERE regexp_matches(html, '\bFACEBOOK_GRAPH_API_BASE\b|graph\.facebook\.com|www\.facebook\.com/v\d+\.\d+', 'i')
  UNION ALL SELECT page_id, 'Prisma ORM', 'orm', '', '', '', 'prisma-call', 0 FROM pages WHERE regexp_matches(html, '\b(prisma|tx)\.[A-Za-z_$][\w$]*\.')
  UNION ALL SELECT page_id, name, CASE name WHEN 'Anthropic Claude' THEN 'ai-sdk' WHEN 'Prisma ORM' THEN 'orm' WHEN 'NextAuth' THEN 'auth' ELSE 'framework' END, '', '', package, 'import', 1 FROM k WHERE name IS NOT NULL
  UNION ALL SELECT page_id, CASE WHEN contains(lower(target), 'facebook.com') THEN 'Facebook Graph API' WHEN regexp_matches(lower(target), 'anthropic\.com|claude') THEN 'Anthropic Claude' WHEN host <> '' THEN host ELSE target END, CASE WHEN NOT contains(lower(target), 'facebook.com') AND regexp_matches(lower(target), 'anthropic\.com|claude') THEN 'ai-api' ELSE 'http-api' END,
    target, host, '', source, 2 FROM h WHERE regexp_matches(lower(target), '^https?://|facebook\.com|anthropic\.com|claude'))
SELECT page_id, name, service_kind, target, package, first.host AS host, first.source AS source FROM (SELECT page_id, name, service_kind, target, package, min({{'place': place, 'host': host, 'source': source}}) AS first FROM u GROUP BY ALL)"""),
    "node_paths": (node_paths, """SELECT 'region:'||r_regionkey AS id, r_name AS path, 1 AS depth FROM region UNION ALL SELECT 'nation:'||n_nationkey, r_name||'/'||n_name, 2 FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'customer:'||c_custkey, r_name||'/'||n_name||'/'||c_name, 3 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'orders:'||o_orderkey, r_name||'/'||n_name||'/'||c_name||'/'||o_orderkey, 4 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""),
    "tag_union": (tag_union, f"""WITH t AS (SELECT DISTINCT p_brand, unnest(list_concat([lower(trim(p_name)), lower(trim(p_type))], list_concat({_TOK('p_name')}, {_TOK('p_type')}, {_SYN('p_name')}, {_SYN('p_type')}))) AS tag FROM part)
SELECT p_brand, count(*) AS tags, min(tag) AS first, max(tag) AS last FROM t WHERE tag <> '' GROUP BY 1"""),
    "event_windows_stream": (event_windows_stream, "SELECT strftime(ts, '%Y-%m-%d %H') AS start, event_type, count(*) AS n, max(value) AS highest FROM events GROUP BY 1, 2"),
}
