"""Text expressions of the graph: slugs, paths, routes, tokens, keyword classes. All are JVM-side column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(c: Column) -> Column:
    """Trimmed, runs of other characters as one '-', one leading and trailing '-' dropped, lower case."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"[^\w.-]+", "-"), "-+", "-")
    return F.lower(F.regexp_replace(s, "^-|-$", ""))


def normal(c: Column) -> Column:
    return F.lower(F.trim(c))


def path(c: Column) -> Column:
    """Lower case, backslashes as slashes, runs of slashes as one."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\\", "/"), "/+", "/")


def contains(c: Column, needle: str) -> Column:
    """Case-blind substring; an empty needle matches everything."""
    return F.lit(True) if not needle.strip() else F.contains(normal(F.coalesce(c, F.lit(""))), F.lit(needle.strip().lower()))


def path_matches(c: Column, needle: str) -> Column:
    p = path(F.lit(needle))
    return (path(c) == p) | F.contains(path(c), p)


def tokens(c: Column) -> Column:
    """Lower-case words, cut at camel case and at _ . / : @ - and blanks; no empty ones."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "[_./:@-]", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), r"\s+"), lambda t: t != "")


#: Words in a value to the tags that they add.
SYNONYMS = {
    "loadmore": ["loadmore", "load-more", "load_more", "分页", "分页加载", "加载更多", "滚动加载"],
    "page": ["page", "pages", "pagination", "分页"],
    "record": ["record", "records", "记录"],
    "list": ["list", "列表"],
    "scroll": ["scroll", "滚动"],
    "refresh": ["refresh", "刷新"],
    "click": ["click", "点击"],
    "request": ["request", "请求"],
    "loading": ["loading", "加载中"],
    "state": ["state", "状态"],
}


def search_tags(*columns: Column) -> Column:
    """Whole values, their tokens and the synonyms of the words in them, distinct and sorted."""
    none = F.array().cast("array<string>")
    every = [F.array(normal(c)) for c in columns] + [tokens(c) for c in columns]
    every += [F.when(F.contains(normal(c), F.lit(k)), F.array(*[F.lit(t) for t in tags])).otherwise(none) for c in columns for k, tags in SYNONYMS.items()]
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*every)), lambda t: t != "")))


def join_path(base: Column, sub: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit("/"), base, F.lit("/"), sub), "/+", "/")


def route(c: Column) -> Column:
    """An HTTP path as it is matched: lower case, single slashes, leading one, no trailing one, no /api before a slash."""
    p = F.regexp_replace(F.concat(F.lit("/"), F.lower(F.trim(c))), "/+", "/")
    p = F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)
    return F.regexp_replace(p, "^/api/", "/")


def target(c: Column) -> Column:
    """A request target: ${API_BASE} as /api, other ${...} and queries dropped, slashes single but after a colon."""
    t = F.regexp_replace(F.regexp_replace(c, r"\$\{API_BASE\}", "/api"), r"\$\{[^}]*\}", "")
    return F.regexp_replace(F.regexp_replace(t, r"\?.*$", ""), "(^|[^:])/{2,}", "$1/")


def segment(c: Column) -> Column:
    """A route folder: [x] as :x, [...x] and [[...x]] as :x*."""
    s = F.regexp_replace(c, r"\[\[?\.\.\.(\w+)\]\]?", ":$1*")
    return F.regexp_replace(s, r"\[(\w+)\]", ":$1")


def package(c: Column) -> Column:
    """The package of an import specifier: two parts if scoped, else one."""
    return F.when(c.startswith("@"), F.array_join(F.slice(F.split(c, "/"), 1, 2), "/")).otherwise(F.split(c, "/")[0])


def external(c: Column) -> Column:
    """Whether a specifier names a package: not relative, absolute, aliased or with a scheme."""
    return ~c.rlike(r"^(\.|/|@/|~/|#|[a-z]+:)")


def host(c: Column) -> Column:
    """Host and port of a URL, empty if there is none."""
    return F.regexp_extract(c, r"^[a-z]+://([^/?#]+)", 1)


def same_path(a: Column, b: Column) -> Column:
    """Whether two paths are the same one; an empty path is none."""
    return (path(a) == path(b)) & (a != "") & (b != "")


def in_module(c: Column, module: str) -> Column:
    """Whether a path has a folder or a part of that name."""
    return F.contains(path(c), path(F.lit(module)))


def glob_pattern(glob: str) -> str:
    """A pattern for ``rlike``: '**/' any folders, '**' anything, '*' and '?' within one part."""
    import re

    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(t) or re.escape(t) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]", glob)) + "$"


def glob_column(glob: Column) -> Column:
    """As ``glob_pattern``, for globs in a column; '[...]' is a set of characters."""
    p = F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1")
    for a, b in ((r"\*\*/", "\x01"), (r"\*\*", "\x02"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", ".*")):
        p = F.regexp_replace(p, a, b)
    return F.concat(F.lit("^"), p, F.lit("$"))


def any_glob(c: Column, globs: list[str]) -> Column:
    """Equality with, or a match of, any of the globs."""
    found = F.lit(False)
    for g in globs:
        found = found | (c == g) | c.rlike(glob_pattern(g))
    return found


def dynamic_target(c: Column) -> Column:
    """Whether a request's target is an expression and not an address: a template or a bare name."""
    return c.contains("${") | c.rlike(r"^[A-Za-z_$][\w$.]*$")


def ignored_import(c: Column) -> Column:
    """Imports of the engine, of assets, of the runtime and of installed packages."""
    return c.rlike(r"^(cc(/|$)|cc[.\w-]*$|db://|node:)") | c.contains("node_modules")


def reads_like_a_question(c: Column) -> Column:
    """Whether a selector is prose: blanks or punctuation in it, or ten Chinese characters."""
    return c.rlike(r"[\s,;!?，。；！？]") | (F.regexp_count(c, F.lit("[\u4e00-\u9fff]")) >= 10)


def component_class(name: Column, raw_type: Column, file: Column, prefab: Column) -> Column:
    """custom-script, builtin or unresolved."""
    script = file.rlike(r"\.(ts|tsx|js|jsx|mjs|cjs)$") & (file != prefab)
    own = r"^(cc|sp|dragonBones|jsb|ccui)\."
    return F.when(script, "custom-script").when(raw_type.rlike(own) | F.split(name, "@")[0].rlike(own), "builtin").otherwise("unresolved")


#: Roots too broad to tell a feature by.
BROAD = (".", "app", "src", "lib", "components", "server", "assets")


def specific_root(c: Column) -> Column:
    """Roots of two parts or more that are not broad ones."""
    r = F.regexp_replace(normal(c), "/+$", "")
    return (F.size(F.filter(F.split(r, "/"), lambda x: x != "")) >= 2) & ~r.isin(*BROAD)


def under(file: Column, root: Column) -> Column:
    """Whether a file is the root or lies below it, whatever the case."""
    r = F.regexp_replace(normal(root), "/+$", "")
    return (r != "") & ((normal(file) == r) | F.startswith(normal(file), F.concat(r, F.lit("/"))))


def ends_like(a: Column, b: Column) -> Column:
    """Whether two paths are equal or one ends with the other at a slash."""
    a, b = normal(a), normal(b)
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a)))


def route_endpoint(c: Column) -> Column:
    """The address of an app/api/**/route file, with its bracketed folders as parameters (X10); null for others."""
    inner = F.regexp_extract(path_kept(c), r"(?:^|/)app/api/(?:(.*)/)?route\.[cm]?[jt]sx?$", 1)
    hit = path_kept(c).rlike(r"(?:^|/)app/api/(?:.*/)?route\.[cm]?[jt]sx?$")
    return F.when(hit, F.regexp_replace(F.concat(F.lit("/api/"), segment(inner)), "/$", ""))


def path_kept(c: Column) -> Column:
    """Slashes as in ``path``, the case kept."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/+", "/")


def routes_base(c: Column) -> Column:
    """/x/y of a file .../app/http/routes/x/y.ts, without a last 'index' (X11); empty for others."""
    base = F.regexp_extract(path_kept(c), r"/app/http/routes/(.+)\.[^./]+$", 1)
    return F.when(base == "", "").otherwise(F.regexp_replace(F.concat(F.lit("/"), base), "(^|/)index$", ""))


def synthetic_name(prefix: str, c: Column) -> Column:
    """A name for a callable without one: the prefix and the text's letters and digits, joined by '_' (X12)."""
    return F.concat(F.lit(prefix + "_"), F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def service_routes(file: Column, method: Column) -> Column:
    """The three spellings of a server method's route, or none."""
    pattern = r"(?:^|/)app/servers/([^/]+)/(handler|remote)/([^/]+)\.[^.]+$"
    server, layer, service = (F.regexp_extract(path_kept(file), pattern, i) for i in (1, 2, 3))
    named = F.concat_ws(".", server, service, method)
    return F.when(server != "", F.array(named, F.concat(F.lit("app.rpc."), named), F.concat_ws(".", layer, named))).otherwise(F.array().cast("array<string>"))


def request_name(protocol: Column, http_method: Column, target: Column, callee: Column) -> Column:
    """METHOD and target of an HTTP request whose target is not the function called, else target or callee."""
    t, m, c = F.trim(F.coalesce(target, F.lit(""))), F.upper(F.trim(F.coalesce(http_method, F.lit("")))), F.coalesce(callee, F.lit(""))
    return F.when((protocol == "http") & (m != "") & (t != "") & (t != c), F.concat_ws(" ", m, t)).when(t != "", t).otherwise(F.trim(c))


def message_name(target: Column) -> Column:
    """X of a target 'cmd:X' (X17)."""
    return F.regexp_extract(target, r"^cmd:(.*)$", 1)


def workspace_id(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))


def workspace_hash(root: Column) -> Column:
    """The first 12 hex digits of the sha1 of the root's path."""
    return F.left(F.sha1(F.regexp_replace(path(root), "(.)/$", "$1").cast("binary")), F.lit(12))


def without_credentials(url: Column) -> Column:
    """A remote's address without user and password."""
    return F.regexp_replace(url, r"^([a-z][a-z0-9+.-]*://)[^/@]*@", "$1")


def words(c: Column) -> Column:
    """Words of Latin letters, digits and Chinese characters, cut at camel case."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9\u4e00-\u9fa5]+", " ")
    return F.filter(F.split(F.trim(spaced), " "), lambda w: w != "")


def title(key: Column) -> Column:
    return F.array_join(F.transform(words(key), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))), " ")


#: What a task or a file is about, by pattern.
SIGNALS = {
    "api": r"(?:^|[\s/])api(?:[\s/]|$)|endpoint|route\.ts|接口|后端|http|request",
    "data": r"prisma|schema\.prisma|database|db|sql|table|model|数据表|数据库|读写",
    "auth": r"auth|login|logout|register|oauth|session|token|secret|encrypt|decrypt|登录|鉴权|授权|密钥",
    "external-service": r"facebook|graph|anthropic|claude|stripe|openai|external-service|第三方|外部服务",
    "commerce": r"mall|shop|gift|activity|campaign|order|payment|transaction|商城|交易|订单|支付|活动|赠送",
    "cross-module": r"跨模块|跨端|前后端|全链路|完整链路|联动|影响面|调用链",
}


def has_any(c: Column, pattern: str) -> Column:
    """As ``rlike`` with a pattern of alternatives; those that are plain words are searched as words, which takes less."""
    parts, deep = [""], 0
    for x in re.findall(r"\\.|.", pattern):
        deep += x in ("(", "[")
        deep -= x in (")", "]")
        if x == "|" and not deep:
            parts.append("")
        else:
            parts[-1] += x
    plain = [p for p in parts if re.fullmatch(r"(?:[^\\()\[\]{}*+?.^$|]|\\\.)+", p)]
    rest = "|".join(p for p in parts if p not in plain)
    return reduce(or_, [F.contains(c, F.lit(p.replace("\\.", "."))) for p in plain] + ([c.rlike(rest)] if rest else []))


def signals(c: Column) -> Column:
    """The keys of the signals in a text."""
    return F.transform(F.array(normal(c)), lambda x: F.array_compact(F.array(*[F.when(has_any(x, p), F.lit(k)) for k, p in SIGNALS.items()])))[0]


def file_class(c: Column) -> Column:
    """source, ui, api and data flags of a file."""
    low = F.lower(c)
    return F.struct(
        low.rlike(r"\.(ts|tsx|js|jsx|mjs|cjs|vue)$").alias("source"),
        low.rlike(r"\.(tsx|jsx|vue|css|scss|less)$").alias("ui"),
        low.rlike(r"(?:^|/)app/api/|route\.(ts|js)$|(?:^|/)api/").alias("api"),
        low.rlike(r"(?:^|/)prisma/|schema\.prisma|(?:^|/)db/").alias("data"),
    )


def clamp(c: Column, default: int, most: int) -> Column:
    """A limit: the default without a positive one, never above ``most``."""
    return F.when(F.coalesce(c, F.lit(0)) <= 0, F.lit(default)).otherwise(F.least(c, F.lit(most)))


def area_root(c: Column) -> Column:
    """The first part of a path, or the first two below a folder of packages."""
    parts = F.filter(F.split(path_kept(c), "/"), lambda p: p != "")
    return F.when(F.try_element_at(parts, F.lit(1)).isin("apps", "packages", "services"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")))


def bucket(score: Column, high: int, medium: int) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


#: Keywords that make a change risky, and those that make it worth a look.
HIGH_RISK = "auth|token|password|secret|encrypt|decrypt|external-service|facebook|anthropic|payment|delete|writes"
MEDIUM_RISK = "api/|endpoint|route|prisma|table|write|update|create|upsert"


def risk(c: Column, any_node: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike(HIGH_RISK), "high").when(low.rlike(MEDIUM_RISK), "medium").when(any_node, "low").otherwise("unknown")


def package_version(c: Column) -> Column:
    """(major, minor, patch) of a version, comparable as a struct."""
    parts = F.split(F.regexp_replace(c, "^v", ""), r"[.+-]")
    return F.struct(*[F.coalesce(F.try_element_at(parts, F.lit(i + 1)).try_cast("int"), F.lit(0)).alias(n) for i, n in enumerate(("major", "minor", "patch"))])


def type_name(c: Column) -> Column:
    """The last part of a type's first name, without brackets, generics, null and undefined."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\[\]|[<>{}|&,]", " "), r"\b(?:null|undefined|readonly)\b", " ")
    first = F.regexp_replace(F.split(F.trim(plain), r"\s+")[0], r"[()?:=!]+", "")
    return F.coalesce(F.try_element_at(F.filter(F.split(first, r"\."), lambda p: p != ""), F.lit(-1)), F.lit(""))


def workspace_relative(c: Column, root: str) -> Column:
    """A path without the workspace's root, whatever its case, with single kinds of slashes; others stay as they are."""
    p = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", "/")
    r = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(F.lower(p), F.lit(r.lower())), F.substring(p, len(r) + 1, 1 << 20)).otherwise(p)
