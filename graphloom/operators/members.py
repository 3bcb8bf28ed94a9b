"""What methods do with members: calls and which lookup decided on them, states they read and write, subscriptions that
two passes over a text find.

Methods are rows (file, method, body, ...) as ``lexing.methods`` gives them. A body holds the functions inside it, so what
these do counts for all methods around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import written
from . import lexing
from .bodies import unquoted

#: Owners whose members are no calls to resolve.
OWN_OWNERS = ("this", "super", "console", "Math", "JSON", "Promise", "Array", "Object", "String", "Number", "Boolean")
#: Methods that change what they are called on.
MUTATING = ("push", "pop", "shift", "unshift", "splice", "sort", "reverse", "set", "delete", "clear")
#: What events are subscribed at, and how.
BUSES, MODES = ("eventBus", "oops.message", "director"), ("on", "once")
_ASSIGNS = ("=", "+=", "-=", "*=", "/=", "%=", "++", "--")


def _keyed(methods: DataFrame) -> DataFrame:
    """key, body: one text for each method; ``_unkeyed`` turns the key back."""
    return methods.select(F.to_json(F.struct("file", "method")).alias("key"), "body").groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("body")), "\n;\n").alias("body"))


def _unkeyed(found: DataFrame) -> DataFrame:
    k = F.from_json("file", "file string, method string")
    return found.withColumn("_k", k).withColumn("method_", F.col("_k.method")).withColumn("file", F.col("_k.file")).drop("_k")


def calls(methods: DataFrame, names: DataFrame, fields: DataFrame, known: DataFrame) -> DataFrame:
    """file, caller, callee, owner, kind, decided, reason, specifier, n: each call and which lookup decided.

    In order: 'local', declared in the file and without owner but 'this'; 'imported', the name or the first owner is
    imported; 'field', the owner is a typed field; 'built-in', an owner of ``OWN_OWNERS``; 'signature', the first owner
    and the member are a known signature (file, identifier, member), so it is suppressed; else 'unresolved', with the
    reason: a global's service, a member of the instance, or an owner that isn't resolved. ``kind`` says which of local,
    imported, field, ignored, suppressed and unresolved that makes. Bare names that nothing decides are ignored.
    """
    methods = written(methods.select("file", "method", "body"), "methods")
    ops = _unkeyed(lexing.operations(_keyed(methods), "key", "body")).where("method <> ''").where(~F.col("type").isin("condition", "loop", "return", "assignment", "multi_assignment"))
    owner = F.regexp_replace(F.when(F.col("target") == "global", F.lit("")).otherwise(F.regexp_replace("target", r"\s+", "")), r"\?\.", ".")
    c = ops.select("file", F.col("method_").alias("caller"), F.col("method").alias("callee"), owner.alias("owner")).groupBy("file", "caller", "callee", "owner").agg(F.count(F.lit(1)).alias("n"))
    first = F.when(F.col("owner") == "", F.col("callee")).otherwise(F.regexp_extract("owner", r"^([A-Za-z_$][\w$]*)", 1))
    c = c.withColumn("first", first).withColumn("field", F.regexp_extract("owner", r"^this\.([\w$]+)$", 1))
    own = methods.select("file", F.col("method").alias("callee")).distinct().withColumn("declared", F.lit(True))
    imported = names.groupBy("file", F.col("identifier").alias("first")).agg(F.max("specifier").alias("by_import"))
    typed = fields.groupBy("file", "field").agg(F.max("specifier").alias("by_field"), F.lit(True).alias("typed"))
    signed = known.select("file", F.col("identifier").alias("first"), F.col("member").alias("callee")).distinct().withColumn("signed", F.lit(True))
    c = c.join(own, ["file", "callee"], "left").join(imported, ["file", "first"], "left").join(typed, ["file", "field"], "left").join(signed, ["file", "first", "callee"], "left")
    decided = (
        F.when(F.col("declared") & F.col("owner").isin("", "this"), "local").when(F.col("by_import").isNotNull(), "imported").when(F.col("typed"), "field")
        .when(F.col("first").isin(*OWN_OWNERS) | (F.col("owner") == ""), "built-in").when(F.col("signed"), "signature").otherwise("none")
    )
    kind = F.when(F.col("decided") == "built-in", "ignored").when(F.col("decided") == "signature", "suppressed").when(F.col("decided") == "none", "unresolved").otherwise(F.col("decided"))
    reason = F.when(F.col("first").isin("window", "global"), "dynamic_global_service").when(F.col("first") == "this", "dynamic_instance_member").otherwise("owner_not_resolved_or_external_client")
    c = c.withColumn("decided", decided).withColumn("kind", kind)
    return c.select("file", "caller", "callee", "owner", "kind", "decided", F.when(F.col("kind") == "unresolved", reason).otherwise("").alias("reason"), F.when(F.col("kind") == "imported", F.col("by_import")).when(F.col("kind") == "field", F.col("by_field")).alias("specifier"), "n")


def state_accesses(methods: DataFrame, fields: DataFrame) -> DataFrame:
    """file, method, state, access: fields of 'this' that methods read and write.

    A path is written where an assignment, '++' or '--' follows it or a method of ``MUTATING`` is called on it; every
    path not itself called is read, the written ones too; of one that is called, what is before the last name is read.
    Two anti-joins leave out what is no state: paths that begin with a method of the file, and with a field whose type
    is imported (``fields``: file, field, specifier; null or 'cc' is no import). A comparison writes nothing.
    """
    methods = written(methods.select("file", "method", "body"), "methods")
    g = lexing.once(_keyed(methods), "key", "body", _paths)
    g = _unkeyed(g).withColumn("path", F.transform("names", lambda x: x["t"])).where("size(path) > 0")
    called = F.coalesce((F.col("after.next") == "(") & (F.col("last") != "?."), F.lit(False)) | (F.col("last") == "?.")
    held = F.when(called, F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))).otherwise(F.col("path"))
    changed = F.when(called, F.element_at("path", -1).isin(*MUTATING)).otherwise(F.coalesce(F.col("after.next").isin(*_ASSIGNS) & (F.col("after.next_kind") == "mark"), F.lit(False)) | F.coalesce(F.col("before").isin("++", "--"), F.lit(False)))
    ways = F.when(changed, F.array(F.lit("read"), F.lit("write"))).otherwise(F.array(F.lit("read")))
    s = g.select("file", F.col("method_").alias("method"), held.alias("held"), F.explode(ways).alias("access")).where("size(held) > 0")
    s = s.select("file", "method", F.array_join("held", ".").alias("state"), "access", F.col("held")[0].alias("root")).distinct()
    s = s.join(methods.select("file", F.col("method").alias("root")).distinct(), ["file", "root"], "left_anti")
    typed = fields.where("specifier IS NOT NULL AND specifier <> 'cc'").select("file", F.col("field").alias("root")).distinct()
    return s.join(typed, ["file", "root"], "left_anti").select("file", "method", "state", "access")


def _paths(texts: DataFrame, file: str, text: str) -> DataFrame:
    """file, names, after, last, before: the chains of each text that begin with 'this', and what stands around them."""
    d = lexing.siblings(lexing.nested(lexing.tokens(texts, file, text)))
    order = Window.partitionBy("file", "parent").orderBy(F.desc("n"))
    dot = F.col("t").isin(".", "?.") & (F.col("kind") == "mark")
    joined = dot | F.coalesce(F.col("prev").isin(".", "?.") & (F.col("prev_kind") == "mark"), F.lit(False))
    d = d.withColumn("chain", F.coalesce(F.sum(F.when(joined, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = d.groupBy("file", "parent", "chain").agg(F.min_by("t", "n").alias("root"), F.array_sort(F.collect_list(F.when((F.col("kind") == "word") & F.coalesce(F.col("prev").isin(".", "?."), F.lit(False)), F.struct("n", "t")))).alias("names"), F.max_by(F.struct("next", "next_kind"), "n").alias("after"), F.max_by("t", "n").alias("last"), F.min_by("prev", "n").alias("before"))
    return g.where("root = 'this'").select("file", "names", "after", "last", "before")


def touched(accesses: DataFrame) -> DataFrame:
    """file, method, reads, writes: arrays of states, as ``linking.handler_states`` takes methods."""
    of = lambda a: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("access") == a, F.col("state")))))
    return accesses.groupBy("file", "method").agg(of("read").alias("reads"), of("write").alias("writes"))


def located(texts: DataFrame, pattern: str, file: str = "file", text: str = "text") -> DataFrame:
    """file, hit, at, until: the matches of a pattern (without groups of its own meaning) and their places in the text."""
    e = texts.select(F.col(file).alias("file"), F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    e = e.select("file", F.posexplode(F.arrays_zip("between", "hits")).alias("i", "x")).select("file", "i", "x.between", "x.hits")
    upto = Window.partitionBy("file").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.sum(F.length("between") + F.coalesce(F.length("hits"), F.lit(0))).over(upto)
    return e.withColumn("until", until).where("hits IS NOT NULL").select("file", F.col("hits").alias("hit"), (F.col("until") - F.length("hits")).alias("at"), "until")


#: Characters of the cells by which intervals meet.
CELL = 256


def merged(better: DataFrame, other: DataFrame, keys: tuple) -> DataFrame:
    """The rows of ``better``, and of ``other`` those that overlap none of them with equal keys.

    Both have the same columns, with ``at`` and ``until``, ``until`` beyond the last character. Intervals meet by the
    cells of ``CELL`` characters that they touch.
    """
    cells = F.explode(F.sequence((F.col("at") / CELL).cast("long"), (F.greatest(F.col("until") - 1, F.col("at")) / CELL).cast("long"))).alias("_cell")
    b = better.select(*keys, F.col("at").alias("_b_at"), F.col("until").alias("_b_until"), cells)
    hit = other.select(*keys, "at", "until", cells).join(b, [*keys, "_cell"]).where("at < _b_until AND _b_at < until").select(*keys, "at", "until").distinct()
    return better.unionByName(other.join(hit, [*keys, "at", "until"], "left_anti").select(*better.columns))


#: Calls that ask a server, and the verbs that a client's own methods stand for.
FETCHERS, VERBS = ("fetch", "fetchJSON", "EventSource"), ("get", "post", "put", "delete", "patch")
_RPC = r"^(?:this\.app|app|global\.App)\.rpc\.([A-Za-z_$][\w$]*)\.([A-Za-z_$][\w$]*)$"


def requests(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, callee, target, protocol, http_method, transport, line: what calls ask of servers.

    Messages of tables and requests of the net ('Net.inst'), with a table's command as 'cmd:x'; remote calls through
    'rpc', by their route; ``FETCHERS``, with the method of their second argument, else GET; 'axios' and its verbs,
    and calls of 'request' on it with an address in an object; and the verbs of a client of one's own, a class that
    hands a base path to its parent: 'this.get(path)' asks for the two joined. A target is as ``text.target`` makes it.
    """
    ops = lexing.operations(texts, file, text).where(F.col("type") == "method_call")
    owner = F.regexp_replace(F.regexp_replace(F.when(F.col("target") == "global", F.lit("")).otherwise(F.col("target")), r"\s+", ""), r"\?\.", ".")
    callee = F.concat_ws(".", F.nullif(owner, F.lit("")), F.col("method"))
    base = F.regexp_extract(text, r"""\bsuper\s*\(\s*["']([^"']*)["']""", 1)
    o = ops.select("file", "line", "method", owner.alias("owner"), callee.alias("callee"), F.trim("arguments").alias("a")).join(texts.select(F.col(file).alias("file"), base.alias("base")), "file")
    first = F.regexp_extract("a", r"""^("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|[^,]*)""", 1)
    said = lambda key: F.regexp_extract("a", rf"""[{{,]\s*["']?{key}["']?\s*:\s*["'`]([^"'`]*)["'`]""", 1)
    low, verb = F.lower("method"), F.lower("callee")
    net = F.col("callee").isin("Net.inst.tableMsg", "Net.inst.request")
    cmd = F.regexp_extract("a", r"""\bcmd\s*:\s*['"]([^'"]+)['"]""", 1)
    rpc = F.col("owner").rlike(_RPC)
    fetched = F.col("callee").isin(*FETCHERS)
    axios = (F.col("owner") == "axios") & low.isin(*VERBS)
    configured = (F.col("callee") == "axios") | ((F.col("owner") == "axios") & (F.col("method") == "request"))
    wrapped = verb.isin(*[f"this.{v}" for v in VERBS]) & (F.col("base") != "") & (F.trim(first) != "")
    plain = unquoted(first)
    target = (
        F.when(net & (F.col("method") == "tableMsg") & (cmd != ""), F.concat(F.lit("cmd:"), cmd)).when(net, plain).when(rpc, F.concat_ws(".", F.regexp_extract("owner", _RPC, 1), F.regexp_extract("owner", _RPC, 2), "method"))
        .when(configured, F.when(said("url") != "", T.target(said("url"))).otherwise(F.col("callee"))).when(wrapped, T.join_path(F.col("base"), plain)).otherwise(F.coalesce(F.nullif(T.target(plain), F.lit("")), F.col("callee")))
    )
    method = F.when(net | rpc, "").when(fetched | configured, F.upper(F.when(said("method") != "", said("method")).otherwise("GET"))).otherwise(F.upper("method"))
    protocol = F.when(net, "").when(rpc, "pinus-rpc").otherwise("http")
    transport = F.when(net, "net").when(rpc, "pinus-rpc").when(fetched, F.lower("method")).when(wrapped, "http-client").otherwise("axios")
    found = o.where(net | rpc | fetched | axios | configured | wrapped)
    return found.select("file", F.when(rpc, "pinus.rpc").otherwise(F.col("callee")).alias("callee"), target.alias("target"), protocol.alias("protocol"), method.alias("http_method"), transport.alias("transport"), "line")


def _bus(c: Column) -> Column:
    return F.coalesce(*[F.when((c == b) | F.endswith(c, F.lit("." + b)), F.lit(b)) for b in BUSES])


def subscriptions_by_pattern(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, bus, mode, event, handler, via, at, until: subscriptions of an event in quotes, or of a name, as one pattern
    sees them, in comments too (E9)."""
    bus = "|".join(b.replace(".", r"\.") for b in BUSES)
    p = rf"""\b(?:{bus})\.(?:once|on)\s*\(\s*(?:"[^"\n]*"|'[^'\n]*'|[\w.$]+)\s*,\s*(?:this\.)?[\w$]*"""
    part = rf"""^({bus})\.(once|on)\s*\(\s*("[^"\n]*"|'[^'\n]*'|[\w.$]+)\s*,\s*(?:this\.)?([\w$]*)"""
    got = lambda i: F.regexp_extract("hit", part, i)
    return located(texts, p, file, text).select("file", got(1).alias("bus"), got(2).alias("mode"), unquoted(got(3)).alias("event"), F.when(got(4).isin("function", "async"), "").otherwise(got(4)).alias("handler"), F.lit("pattern").alias("via"), "at", "until")


def subscriptions_by_tokens(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """As ``subscriptions_by_pattern``, from calls as tokens show them: also over line breaks and comments, at any owner
    that ends with a bus; the handler of a function in place is empty (E9, E9c)."""
    o = lexing.calls(texts, file, text).where(F.col("method").isin(*MODES))
    o = o.withColumn("bus", _bus(F.regexp_replace("target", r"\s+", ""))).where("bus IS NOT NULL")
    quoted = r"""^("[^"\n]*"|'[^'\n]*'|[\w.$]+)"""
    event, rest = F.regexp_extract("detail", quoted, 1), F.regexp_extract("detail", quoted + r"\s*,\s*(.*)$", 2)
    handler = F.when(rest.rlike(r"^(?:async\b|function\b|\(|[\w$]+\s*=>)"), "").otherwise(F.regexp_extract(rest, r"^(?:this\.)?([\w$]+)", 1))
    return o.select("file", "bus", F.col("method").alias("mode"), unquoted(event).alias("event"), handler.alias("handler"), F.lit("tokens").alias("via"), "at", "until").where("event <> ''")


def subscriptions(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, bus, mode, event, handler, via, n: subscriptions by both passes, each once, tokens before patterns."""
    t, p = subscriptions_by_tokens(texts, file, text), subscriptions_by_pattern(texts, file, text)
    # A call's place is its name, which lies inside the pattern's match.
    found = merged(t, p, ("file", "bus", "mode", "event"))
    return found.groupBy("file", "bus", "mode", "event", "handler").agg(F.max("via").alias("via"), F.count(F.lit(1)).alias("n"))
