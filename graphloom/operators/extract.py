"""Facts from source texts by patterns: imports, events, requests, timing, state, database access, endpoints, calls.

All patterns run on the JVM in one pass over each text; the facts of a text are exploded once and counted. Resolution of
imports is a join of candidate paths with the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Kind of fact to a pattern with two groups: subject and detail.
RULES = {
    "import": r"""\bimport\s+([\w*{}\s,$]*?)\s*(?:from\s+)?["']([^"'\n]+)["']""",
    "subscribe": r"""\.(on|once)\(\s*["']([^"'\n]+)["']""",
    "dispatch": r"""\.(emit|emitAsync|dispatchEvent)\(\s*["']([^"'\n]+)["']""",
    "view-model": r"""\.(bindPath|setValue|addValue)\(\s*["']([^"'\n]+)["']""",
    "notify": r"""\.(notify|NotifyAll|pushMessageByUids)\(\s*["']([^"'\n]+)["']""",
    "timing": r"""\b(setTimeout|setInterval|scheduleOnce)\(\s*([\w.$]*)""",
    "state-write": r"""\bthis\.([\w$]+(?:\.[\w$]+)*)\s*([-+*/]?=)[^=]""",
    "request": r"""\b(fetch|fetchJSON|EventSource|axios\.\w+)\(\s*["'`]([^"'`\n]+)["'`]""",
    "endpoint": r"""\b(?:app|router)\.(get|post|put|delete|use)\(\s*["'](/[^"'\n]*)["']""",
    "route-handler": r"""\bexport\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE)\b()""",
    "model-access": r"""\bprisma\.(\w+)\.(\w+)\(""",
    "table-access": r"""\.(from|insert|update|delete|innerJoin|leftJoin)\(\s*(\w+)\s*[,)]""",
    "function": r"""\bfunction\s+(\w+)\s*\(([^)]*)\)""",
    "callable": r"""\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>""",
    "export": r"""\bexport\s+(default\s+|)(?:async\s+)?(?:class|function|const|let|var|interface|type|enum)\s+(\w+)""",
    "call": r"""\b([A-Za-z_$][\w$]*(?:\.[\w$]+)*)\(()""",
}
#: Words before a bracket that are not calls.
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "function", "typeof", "super")
#: Kind of fact to the type of edge that it makes from its file; the other kinds describe the file itself.
EDGES = {"import": "imports", "subscribe": "listens", "dispatch": "emits", "notify": "notifies", "request": "requests", "endpoint": "serves", "model-access": "accesses", "table-access": "accesses", "state-write": "writes", "call": "calls"}
#: Endings that an import may leave out, best first.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".vue", "/index.ts", "/index.tsx", "/index.js", "/index.vue")


def facts(files: DataFrame, file: str = "file", text: str = "text", kinds: tuple = tuple(RULES)) -> DataFrame:
    """file, kind, subject, detail, n: distinct facts of each text and how often they occur."""

    def of(kind: str) -> Column:
        p = RULES[kind]
        return F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("kind"), F.trim(F.regexp_extract(m, p, 1)).alias("subject"), F.regexp_extract(m, p, 2).alias("detail")))

    found = files.select(F.col(file).alias("file"), F.explode(F.concat(*[of(k) for k in kinds])).alias("f")).select("file", "f.*")
    found = found.where((F.col("kind") != "call") | ~F.col("subject").isin(*KEYWORDS))
    return found.groupBy("file", "kind", "subject", "detail").agg(F.count(F.lit(1)).alias("n"))


def folded(path: Column) -> Column:
    """A path without '.', '..' and empty parts."""
    step = lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolved_imports(found: DataFrame, files: DataFrame, aliases: tuple[tuple[str, str], ...] = (("@/", "src/"),), file: str = "file") -> DataFrame:
    """file, specifier, target (null if none): relative and aliased imports against the files.

    Each specifier gives one candidate path per ending; the join is by path, and the first ending that exists holds.
    """
    spec = F.col("specifier")
    base = F.when(spec.startswith("."), F.concat_ws("/", F.regexp_replace("file", r"[^/]*$", ""), spec))
    for start, root in aliases:
        base = base.when(spec.startswith(start), F.concat(F.lit(root), F.substring(spec, len(start) + 1, 1 << 20)))
    imports = found.where("kind = 'import'").select("file", F.col("detail").alias("specifier")).distinct().withColumn("base", folded(base))
    ends = F.posexplode(F.array(*[F.lit(s) for s in SUFFIXES])).alias("place", "ending")
    candidates = imports.where("base IS NOT NULL").select("file", "specifier", "base", ends).withColumn("target", F.concat("base", "ending"))
    hits = candidates.join(files.select(F.col(file).alias("target")).distinct(), "target").groupBy("file", "specifier").agg(F.min_by("target", "place").alias("target"))
    return imports.select("file", "specifier").join(hits, ["file", "specifier"], "left")


def graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of facts: a node per file and per thing a fact names, an edge per fact kind."""
    kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in EDGES.items()])
    named = F.when(F.col("kind").isin("state-write", "call", "model-access"), F.col("subject")).otherwise(F.col("detail"))
    edges = found.withColumn("type", kind).where("type IS NOT NULL").select(F.col("file").alias("src"), F.concat_ws(":", "kind", named).alias("dst"), "type", "n")
    edges = edges.groupBy("src", "dst", "type").agg(F.sum("n").alias("n"))
    ends = found.select(F.col("file").alias("id"), F.lit("script").alias("type")).union(edges.select(F.col("dst").alias("id"), F.split("dst", ":")[0].alias("type")))
    return ends.distinct(), edges


def complexity(found: DataFrame, files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, branches, loops, calls, level: branches + 2 loops + half the calls."""
    branches = F.regexp_count(text, F.lit(r"\b(if|switch|case|catch)\b")).alias("branches")
    loops = F.regexp_count(text, F.lit(r"\b(for|while)\b")).alias("loops")
    calls = found.where("kind = 'call'").groupBy("file").agg(F.sum("n").alias("calls"))
    x = files.select(F.col(file).alias("file"), branches, loops).join(calls, "file", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    weight = F.col("branches") + 2 * F.col("loops") + 0.5 * F.col("calls")
    return x.withColumn("level", F.when(weight <= 2, "low").when(weight <= 5, "medium").otherwise("high"))


#: Name, kind and pattern of services known by the lower-cased target of a request, first match holds.
HOST_SERVICES = (("Facebook Graph API", "http-api", r"facebook\.com"), ("Anthropic Claude", "ai-api", r"anthropic\.com|claude"))
#: Name, kind, pattern of the import, pattern of the text, and whether both must match (else either).
IMPORT_SERVICES = (
    ("Anthropic Claude", "ai-sdk", r"^@anthropic-ai/sdk$", r"\b(new\s+Anthropic|Anthropic|messages\.create)\b", True),
    ("Prisma ORM", "orm", r"^@prisma/client$", r"\bPrismaClient\b", False),
    ("Next.js Runtime", "framework", r"^next/", None, True),
    ("NextAuth", "auth", r"^(next-auth$|next-auth/|@auth/)", None, True),
)
#: Name, kind, target, source and pattern of services known by the text itself.
TEXT_SERVICES = (
    ("Facebook Graph API", "http-api", "https://graph.facebook.com", "literal", r"(?i)\bFACEBOOK_GRAPH_API_BASE\b|graph\.facebook\.com|www\.facebook\.com/v\d+\.\d+"),
    ("Prisma ORM", "orm", "", "prisma-call", r"\b(prisma|tx)\.[A-Za-z_$][\w$]*\."),
)


def external_services(files: DataFrame, requests: DataFrame, imports: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, name, service_kind, target, host, package, source: each service once a file, by text, import or request.

    ``requests``: file, target, source; ``imports``: file, specifier. Null and empty texts, targets and specifiers name
    no service. Texts meet imports by file only where the file has external imports.
    """
    body = F.coalesce(text, F.lit(""))
    empty = F.lit("")
    service = lambda name, kind, target=empty, host=empty, package=empty, source=empty: F.struct(*[x.alias(a) for a, x in zip(("name", "service_kind", "target", "host", "package", "source"), (F.lit(name), F.lit(kind), target, host, package, source), strict=True)])
    host_of = lambda c: F.regexp_replace(F.lower(F.regexp_extract(c, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#]+)", 1)), r":(80|443)$", "")

    said = F.array_compact(F.array(*[F.when(body.rlike(p), service(n, k, F.lit(t), host_of(F.lit(t)), empty, F.lit(s))) for n, k, t, s, p in TEXT_SERVICES]))
    by_text = files.select(F.col(file).alias("file"), F.explode(said).alias("s"))

    spec = F.trim("specifier")
    outside = imports.select("file", spec.alias("specifier")).where((F.length("specifier") > 0) & ~F.col("specifier").rlike(r"^(\.|/|@/|~/)|:")).distinct()
    spec, chosen = F.col("specifier"), F.lit(None)
    for name, kind, of_import, of_text, both in reversed(IMPORT_SERVICES):
        hit = spec.rlike(of_import)
        if of_text:
            hit = hit & F.col("body").rlike(of_text) if both else hit | F.col("body").rlike(of_text)
        chosen = F.when(hit, service(name, kind, package=T.package(spec), source=F.lit("import"))).otherwise(chosen)
    by_import = outside.join(files.select(F.col(file).alias("file"), body.alias("body")), "file").select("file", chosen.alias("s"))

    target = F.col("target")
    known = F.when(target.rlike(r"(?i)^https?://"), service(F.when(host_of(target) != "", host_of(target)).otherwise(target), "http-api", target, host_of(target), empty, F.col("source")))
    for name, kind, pattern in reversed(HOST_SERVICES):
        known = F.when(F.lower(target).rlike(pattern), service(name, kind, target, host_of(target), empty, F.col("source"))).otherwise(known)
    by_request = requests.select("file", F.trim(T.target(F.col("target"))).alias("target"), "source").select("file", known.alias("s"))

    found = by_text.withColumn("place", F.lit(0)).unionByName(by_import.withColumn("place", F.lit(1))).unionByName(by_request.withColumn("place", F.lit(2))).where("s IS NOT NULL").select("file", "s.*", "place")
    first = F.min(F.struct("place", "host", "source")).alias("first")
    return found.groupBy("file", "name", "service_kind", "target", "package").agg(first).select("file", "name", "service_kind", "target", "first.host", "package", "first.source")
