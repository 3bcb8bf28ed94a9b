"""Queries on source texts that Spark derives from the tables: a file per supplier, so that every kind of fact occurs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import execution as E
from ..operators import extract as X
from ..operators import graph as G
from ..operators import linking as L
from ..operators import selectors as S
from ..sources import files as S_files
from ..sources.tables import NODES_SQL, edges, message_facts, nodes, table
from .graph_queries import START, _bfs_sql, _starts

#: What is written for each supplier: kind of fact, line (with {k}, {n}, {m} for key, nation and key modulo 3), and
#: the fact's subject and detail as SQL.
LINES = (
    ("import", 'import {{ Part, Kind as K{m} }} from "./lib/n{n}";', "'{{ Part, Kind as K'||m||' }}'", "'./lib/n'||n"),
    ("import", 'import Net, * as All from "@/net/n{n}";', "'Net, * as All'", "'@/net/n'||n"),
    ("import", 'import "side-effects";', "''", "'side-effects'"),
    ("subscribe", 'bus.on("opened{m}", x);', "'on'", "'opened'||m"),
    ("dispatch", 'bus.emit("closed{m}", 1);', "'emit'", "'closed'||m"),
    ("view-model", 'vm.bindPath("part{m}", x);', "'bindPath'", "'part'||m"),
    ("notify", 'room.notify("moved{n}", 1);', "'notify'", "'moved'||n"),
    ("timing", "setTimeout(tick{m}, 10);", "'setTimeout'", "'tick'||m"),
    ("state-write", "this.state.count{m} = 1;", "'state.count'||m", "'='"),
    ("request", 'fetch("/api/suppliers/{k}");', "'fetch'", "'/api/suppliers/'||k"),
    ("endpoint", 'router.get("/suppliers/{k}", x);', "'get'", "'/suppliers/'||k"),
    ("route-handler", "export async function POST (r) {{}}", "'POST'", "''"),
    ("function", None, "'POST'", "'r'"),
    ("model-access", "prisma.supplier{m}.findMany();", "'supplier'||m", "'findMany'"),
    ("table-access", "db.from(orders{m}, 1);", "'from'", "'orders'||m"),
    ("function", "function load{k} (a, b) {{}}", "'load'||k", "'a, b'"),
    ("callable", "const pick{m} = (x, y) => 1;", "'pick'||m", "'x, y'"),
    ("export", "export class Supplier{k} {{}}", "''", "'Supplier'||k"),
    ("export", None, "''", "'POST'"),
)
KINDS = tuple(k for k in X.RULES if k != "call")
MARKUP = "<template>t</template>\n<script lang=\"ts\">\n"


def _parts(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 3).alias("m"))


def derived_sources(spark, d):
    """file, text: a source file for each supplier."""
    filled = lambda line: F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p.replace("{{", "{").replace("}}", "}")) for i, p in enumerate(re.split(r"(?<!\{)\{([knm])\}(?!\})", line))])
    text = F.concat_ws("\n", *[filled(line) for _, line, _, _ in LINES if line])
    return _parts(spark, d).select(F.concat(F.lit("src/n"), "n", F.lit("/s"), "k", F.lit(".ts")).alias("file"), text.alias("text"))


def _targets(spark, d):
    """Files that imports can mean: of even nations a module, of others a folder with an index; the network for some."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"))
    lib = n.select(F.when(F.col("n") % 2 == 0, F.concat(F.lit("src/n"), "n", F.lit("/lib/n"), "n", F.lit(".ts"))).otherwise(F.concat(F.lit("src/n"), "n", F.lit("/lib/n"), "n", F.lit("/index.js"))).alias("file"))
    return lib.union(n.where("n % 3 <> 0").select(F.concat(F.lit("src/net/n"), "n", F.lit(".tsx"))))


def source_facts(spark, d):
    """Every kind of fact but calls, in the derived sources."""
    return X.facts(derived_sources(spark, d), kinds=KINDS)


def source_imports(spark, d):
    """What the imports of the derived sources mean."""
    return X.resolved_imports(X.facts(derived_sources(spark, d), kinds=("import",)), _targets(spark, d))


def import_stats_resolved(spark, d):
    """Resolved, unresolved and outside imports and the rate of the resolved."""
    i = source_imports(spark, d)
    g = i.agg(F.count(F.lit(1)).alias("total"), F.count("target").alias("resolved"), F.count_if(~F.col("specifier").rlike(r"^(\.|@/)")).alias("outside"))
    return g.withColumn("rate", F.round(100 * F.col("resolved") / F.greatest("total", F.lit(1)), 0).cast("long"))


def import_bindings(spark, d):
    """The names that import clauses bind."""
    i = X.facts(derived_sources(spark, d), kinds=("import",)).select("file", F.col("subject").alias("clause"), F.col("detail").alias("specifier"))
    return L.import_names(i).groupBy("identifier", "imported", "kind").agg(F.count(F.lit(1)).alias("n"))


def source_graph(spark, d):
    """The edges of the graph of the derived sources."""
    return X.graph(X.facts(derived_sources(spark, d), kinds=KINDS))[1]


def source_scripts(spark, d):
    """Script blocks of markup, first headings and the files of diffs, from the derived sources."""
    s = derived_sources(spark, d).select("file", F.concat(F.lit(MARKUP), F.col("file"), F.lit("\n</script>\n<script></script>\n# Title "), F.col("file")).alias("text"))
    diff = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/"), F.col("file"), F.lit("\n@@\n+++ no\n"))
    return S_files.changed_in_diff(S_files.headings(S_files.vue_scripts(s)).withColumn("diff", diff).withColumnRenamed("file", "source")).select("source", F.regexp_replace("script", r"^\s+|\s+$", "").alias("script"), "heading", "file")


def schema_tables(spark, d):
    """Accesses of what is imported from the schema, by parts and suppliers."""
    line = table(spark, d, "lineitem")
    access = line.select(F.concat(F.lit("f"), "l_suppkey").alias("file"), F.concat(F.lit("T"), F.col("l_partkey") % 40).alias("identifier"), F.when(F.col("l_returnflag") == "R", "insert").otherwise("select").alias("operation")).distinct()
    names = line.where("l_linenumber = 1").select(F.concat(F.lit("f"), "l_suppkey").alias("file"), F.when(F.col("l_partkey") % 2 == 0, "../db/schema").otherwise("./other").alias("specifier"), F.concat(F.lit("T"), F.col("l_partkey") % 40).alias("identifier"), F.concat(F.lit("table"), F.col("l_partkey") % 40).alias("imported"), F.lit("named").alias("kind"))
    return L.schema_tables(access, names).groupBy("table", "operation").agg(F.count(F.lit(1)).alias("n"))


def handler_states(spark, d):
    """How many states the handlers of each message touch."""
    m = message_facts(spark, d)
    state = F.concat(F.lit("s"), F.col("state"))
    handlers = m.where("role = 'handler'").select("message", F.col("actor").alias("file"), F.col("message").alias("method")).distinct()
    raw = m.where("state IS NOT NULL").select(F.col("actor").alias("file"), F.col("message").alias("method"), F.when(F.col("value") < 50, F.array(state)).alias("reads"), F.when(F.col("value") >= 50, F.array(state)).alias("writes"))
    return L.handler_states(handlers, raw).select("message", F.size("states").alias("states"))


def ambiguous_candidates(spark, d):
    """Nodes of candidates 'type:name', exact or by their normal form."""
    s = table(spark, d, "supplier")
    c = s.select(F.concat(F.lit("external-service:"), F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.col("s_name"))).alias("candidate"))
    return L.split_candidate(c, nodes(spark, d))


def semantic_search(spark, d):
    """actors by the kinds of their operations, the flow of their values and their complexity."""
    e = table(spark, d, "events").withColumn("high", F.col("value") >= 50)
    m = e.groupBy(F.col("user_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.struct(F.col("event_type").alias("type"), F.lit("x").alias("detail")))).alias("operations"), F.array_sort(F.collect_set(F.struct(F.lit("in").alias("from"), F.when(F.col("high"), "store").otherwise("view").alias("to")))).alias("flows"), F.count(F.lit(1)).alias("n"),
    )
    m = m.withColumn("complexity", F.when(F.col("n") <= 4, "low").when(F.col("n") <= 7, "medium").otherwise("high"))
    return S.semantic(m, "click", flow_to="store", least="medium").select("id", "complexity", F.size("matched").alias("matched"), "total")


def protocol_search(spark, d):
    """message patterns of the events that hold a word in any field."""
    p = message_facts(spark, d).groupBy("message").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.count(F.lit(1)).alias("n"))
    return S.protocol_search(p, "HANDL").select("message", "n")


def access_entries(spark, d):
    """Who reads and writes the tables of a customer's graph, in order."""
    return C.access_entries(G.traverse(edges(spark, d, repeated=True), _starts(spark, START), 4), nodes(spark, d)).drop("operation")


def health_checks(spark, d):
    """Scores of nations from the checks of their suppliers' balances."""
    s = table(spark, d, "supplier")
    result = F.when(F.col("s_acctbal") < 0, "fail").when(F.col("s_acctbal") <= 1000, "warn").otherwise("ok")
    return E.health(s.select(F.col("s_nationkey").alias("id"), F.col("s_name").alias("check"), result.alias("result")))


def needed_actions(spark, d):
    """V9: the first action that each nation's suppliers need."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 7
    action = F.when(k == 0, "restart_codex_mcp").when(k == 1, "rebuild_project_kb").when(k == 2, "reinstall_skill").otherwise("none")
    return E.next_actions(s.select(F.col("s_nationkey").alias("id"), action.alias("action")))


def evidence_rows(spark, d):
    """All nodes as evidence."""
    return C.node_evidence(nodes(spark, d), "seen", "low").drop("reason")


_S = "s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 3 AS m, 'src/n'||s_nationkey||'/s'||s_suppkey||'.ts' AS file FROM supplier)"
_F = " UNION ALL ".join(f"SELECT file, '{kind}' AS kind, {subject} AS subject, {detail} AS detail FROM s" for kind, _, subject, detail in LINES).replace("{{", "{").replace("}}", "}")
_EDGE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.EDGES.items()) + " END"
_IMPORTS = """i AS (SELECT file, './lib/n'||n AS specifier, 'src/n'||n||'/lib/n'||n||CASE WHEN n % 2 = 0 THEN '.ts' ELSE '/index.js' END AS target FROM s
 UNION ALL SELECT file, '@/net/n'||n, CASE WHEN n % 3 <> 0 THEN 'src/net/n'||n||'.tsx' END FROM s UNION ALL SELECT file, 'side-effects', NULL FROM s)"""

QUERIES = {
    "source_facts": (source_facts, f"WITH {_S}, f AS ({_F}) SELECT file, kind, subject, detail, count(*) AS n FROM f GROUP BY ALL"),
    "source_imports": (source_imports, f"WITH {_S}, {_IMPORTS} SELECT * FROM i"),
    "import_stats_resolved": (import_stats_resolved, f"WITH {_S}, {_IMPORTS} SELECT count(*) AS total, count(target) AS resolved, count(*) FILTER (WHERE specifier = 'side-effects') AS outside, CAST(round(100 * count(target) / count(*), 0) AS BIGINT) AS rate FROM i"),
    "import_bindings": (import_bindings, f"""WITH {_S}, b AS (SELECT 'Part' AS identifier, 'Part' AS imported, 'named' AS kind FROM s UNION ALL SELECT 'K'||m, 'Kind', 'named' FROM s UNION ALL SELECT 'Net', 'default', 'default' FROM s UNION ALL SELECT 'All', '*', 'namespace' FROM s)
SELECT identifier, imported, kind, count(*) AS n FROM b GROUP BY ALL"""),
    "source_graph": (source_graph, f"WITH {_S}, f AS ({_F}) SELECT file AS src, kind||':'||CASE WHEN kind IN ('state-write', 'call', 'model-access') THEN subject ELSE detail END AS dst, {_EDGE} AS type, count(*) AS n FROM f WHERE {_EDGE} IS NOT NULL GROUP BY ALL"),
    "source_scripts": (source_scripts, f"WITH {_S} SELECT file AS source, file AS script, 'Title '||file AS heading, file FROM s"),
    "schema_tables": (schema_tables, """WITH a AS (SELECT DISTINCT l_suppkey AS f, l_partkey % 40 AS t, CASE WHEN l_returnflag = 'R' THEN 'insert' ELSE 'select' END AS operation FROM lineitem), i AS (SELECT DISTINCT l_suppkey AS f, l_partkey % 40 AS t FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 2 = 0)
SELECT 'table'||t AS "table", operation, count(*) AS n FROM a JOIN i USING (f, t) GROUP BY 1, 2"""),
    "handler_states": (handler_states, """SELECT event_type AS message, CAST(count(DISTINCT json_extract_string(props, '$.k')) AS INTEGER) AS states FROM events WHERE event_type IN ('view', 'click') AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1"""),
    "ambiguous_candidates": (ambiguous_candidates, "SELECT 'external-service:'||CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS candidate, 'supplier:'||s_suppkey AS id, s_suppkey % 2 <> 0 OR upper(s_name) = s_name AS exact FROM supplier"),
    "semantic_search": (semantic_search, """WITH g AS (SELECT user_id AS id, count(*) AS n, bool_or(event_type = 'click') AS click, bool_or(value >= 50) AS store FROM events GROUP BY 1),
f AS (SELECT id, CASE WHEN n <= 7 THEN 'medium' ELSE 'high' END AS complexity FROM g WHERE n > 4 AND click AND store) SELECT id, complexity, 1 AS matched, count(*) OVER () AS total FROM f"""),
    "protocol_search": (protocol_search, "SELECT event_type AS message, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1"),
    "access_entries": (access_entries, _bfs_sql((START,), 4, (("downstream", "src", "dst"),)) + """, a AS (SELECT DISTINCT dst AS "table", src AS method, type, operation, depth FROM x WHERE type IN ('reads', 'writes'))
SELECT "table", method, type, depth, CAST(row_number() OVER (PARTITION BY "table", type ORDER BY method, operation, depth) AS INTEGER) AS place FROM a"""),
    "health_checks": (health_checks, """WITH g AS (SELECT s_nationkey AS id, count(*) FILTER (WHERE s_acctbal < 0) AS fail, count(*) FILTER (WHERE s_acctbal BETWEEN 0 AND 1000) AS warn FROM supplier GROUP BY 1)
SELECT *, greatest(0, least(100, 100 - 30 * fail - 10 * warn)) AS score, CASE WHEN fail > 0 THEN 'blocked' WHEN warn > 0 THEN 'needs_action' ELSE 'ready' END AS status FROM g"""),
    "needed_actions": (needed_actions, "SELECT s_nationkey AS id, CASE min(CASE s_suppkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 5 END) WHEN 0 THEN 'restart_codex_mcp' WHEN 3 THEN 'rebuild_project_kb' WHEN 4 THEN 'reinstall_skill' ELSE 'proceed' END AS action FROM supplier GROUP BY 1"),
    "evidence_rows": (evidence_rows, f"WITH {NODES_SQL} SELECT 'node' AS kind, id, type, name, file, CASE WHEN type = 'method' THEN name ELSE '' END AS method, CASE WHEN type IN ('endpoint', 'request') THEN name ELSE '' END AS endpoint, 'low' AS confidence FROM n"),
}
