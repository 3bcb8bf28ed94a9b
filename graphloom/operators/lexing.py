"""Source texts as rows of tokens, with their brackets matched, and what methods and operations the rows make.

A text is cut by one pattern on the JVM that tells comments, strings, templates and regular expressions apart; brackets
are matched by running depth over a file's tokens; what belongs together is then found among siblings, the tokens
directly inside one pair of brackets, by windows over them. Texts are dealt by file before they are cut, so that no
window moves their tokens, and equal texts are looked at once for operations (``once``), equal pieces of texts for
methods (``methods``). What a template holds between '${' and '}' is part of the template.

An unclosed bracket, string or comment ends with the text and spoils nothing before it; null and empty texts give nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

_STRING = r"""\"[^\"\\\n]*+(?:\\(?s:.)[^\"\\\n]*+)*+\"?|'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'?"""
_WHOLE_TEMPLATE = r"""`(?:[^`\\$]++|\\(?s:.)|\$(?!\{)|\$\{(?:[^{}`"']++|"[^"\n]*+"|'[^'\n]*+'|\{[^{}]*+\}|`[^`]*+`)*+\})*+`"""
_TEMPLATE = _WHOLE_TEMPLATE + r"""|`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`?"""
_REGEX = r"""/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"""
_WORDS_BEFORE_REGEX = "return|typeof|case|in|of|delete|void|throw|else|do|yield|await"
_PUNCTUATION = r"=>|\?\.(?!\d)|\.\.\.|>>>=|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<"
#: One token with the white space before it.
TOKEN = (
    r"[\s\uFEFF]*+(?://[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|" + _STRING + "|" + _TEMPLATE
    + r"|(?<![\w$)\]}\"'`.]\s{0,9})" + _REGEX + rf"|(?<=\b(?:{_WORDS_BEFORE_REGEX})\s{{0,9}})" + _REGEX
    + r"|0[xXbBoO][\da-fA-F_]++n?|\d[\d_]*+(?:\.[\d_]++)?(?:[eE][+-]?\d++)?n?|[#]?[\p{L}_$][\p{L}\p{N}_$]*+|" + _PUNCTUATION + r"|\S)"
)
OPEN, CLOSE = ("(", "[", "{"), (")", "]", "}")
#: Words before a bracket that are neither calls nor names of methods.
KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "async", "new", "super", "constructor", "with", "do", "else", "throw", "delete", "void", "yield", "in", "of", "import", "instanceof")
#: What stands before a brace that is a type and no body.
_BEFORE_TYPE = (":", "|", "&", "<", ",", "=>", "extends", "is", "keyof", "readonly", "=")
#: What no list of type arguments holds.
_NO_TYPE = (";", "=", "&&", "||", "??", "+", "-", "*", "/", "?", ":", "!", "==", "===", "!=", "!==", "<=", ">=")
_MODIFIERS = ("const", "let", "var", "public", "private", "protected", "static", "readonly", "export", "default", "declare", "override", "abstract")
_OPERATORS = ("=", "+", "-", "*", "/", "%", "&", "|", "^", "?", ":", ",", ".", "?.", "=>", "<", "&&", "||", "??", "==", "===", "!=", "!==", "<=", ">=", "+=", "-=", "!", "...", "**", "<<", "return", "new", "typeof", "await", "of", "in")
#: Methods of arrays that are operations of their own, by lower-cased name; forEach is none of them there.
ARRAY_METHODS = ("filter", "map", "reduce", "find", "some", "every", "sort")


#: Characters of texts that a task cuts on average: what a window sorts stays the same however many texts there are.
DEALT = 1 << 21


def _stored(texts: DataFrame, file: str, text: str) -> DataFrame:
    """file, text: texts that are written, as they are read more than once."""
    return written(texts.select(F.col(file).alias("file"), F.col(text).alias("text")), "code-texts")


def _spread(t: DataFrame) -> DataFrame:
    """Stored texts dealt by file, in as many parts as their length takes."""
    size = t.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return t.repartition(int(size // DEALT) + 1, "file")


def _dealt(texts: DataFrame, file: str, text: str) -> DataFrame:
    return _spread(_stored(texts, file, text))


def once(texts: DataFrame, file: str, text: str, of: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """The rows that ``of(texts, "file", "text")`` finds in each text, by ``file``; equal texts are looked at once."""
    same = _same(text).alias("file")
    t = written(texts.select(F.col(file).alias("_file"), F.col(text).alias("text"), same).where("text <> ''"), "code-once")
    found = of(t.groupBy("file").agg(F.any_value("text").alias("text")), "file", "text")
    return t.select("_file", "file").join(found, "file").drop("file").withColumnRenamed("_file", "file").select(*found.columns)


def tokens(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, n, kind, t, at, until, line: the tokens of each text but its comments, in order; ``at`` and ``until`` count
    characters from 0. Kinds: word, number, string, template, regex, mark."""
    return _cut(_dealt(texts, file, text))


def _cut(dealt: DataFrame) -> DataFrame:
    """``tokens`` of texts that are dealt by file."""
    each = dealt.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("n", "raw"))
    t = F.regexp_replace("raw", r"^[\s\uFEFF]+", "")
    kind = (
        F.when(t.rlike(r"^/[/*]"), "comment").when(t.rlike("^[\"']"), "string").when(t.startswith("`"), "template").when(t.startswith("/") & (F.length(t) > 1) & (t != "/="), "regex")
        .when(t.rlike(r"^\d"), "number").when(t.rlike(r"^#?[\p{L}_$]"), "word").otherwise("mark")
    )
    upto = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    breaks = F.regexp_count("raw", F.lit("\n"))
    each = each.select("file", "n", t.alias("t"), kind.alias("kind"), F.sum(F.length("raw")).over(upto).alias("until"), (F.sum(breaks).over(upto) - F.regexp_count(t, F.lit("\n")) + 1).cast("int").alias("line"))
    return each.where("kind <> 'comment' AND t <> ''").select("file", "n", "kind", "t", (F.col("until") - F.length("t")).alias("at"), "until", "line")


def nested(found: DataFrame) -> DataFrame:
    """Tokens (``tokens``) but closing brackets, with ``parent``, the number of the bracket around them (-1: none), and
    ``parent_t``, that bracket, ``parent_end``, where it closes, and ``end``, where they end with all they enclose; never closed: the last
    token's end."""
    file = Window.partitionBy("file")
    opens, closes = F.col("t").isin(*OPEN) & (F.col("kind") == "mark"), F.col("t").isin(*CLOSE) & (F.col("kind") == "mark")
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(file.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = found.withColumn("opens", opens).withColumn("closes", closes).withColumn("depth", depth).withColumn("last", F.max("until").over(file))
    # A bracket stands on the level that it opens or closes; the next bracket of that level is its partner.
    level = F.when(F.col("closes"), F.col("depth") + 1).otherwise(F.col("depth"))
    d = d.withColumn("level", level)
    place = Window.partitionBy("file", "level", F.col("opens") | F.col("closes")).orderBy("n")
    partner = F.when(F.col("opens"), F.when(F.lead("closes").over(place), F.lead("at").over(place)))
    d = d.withColumn("inner_end", F.when(F.col("opens"), F.coalesce(partner, F.col("last")))).where(~F.col("closes"))
    # An opening bracket is a sibling on the level outside it and the scope of all on its own, until the next one there.
    scope = F.struct(F.col("n").alias("n"), F.col("inner_end").alias("end"), F.col("t").alias("t"))
    roles = F.when(F.col("opens"), F.array(F.struct((F.col("depth") - 1).alias("outer"), F.lit(None).cast("struct<n:int,end:bigint,t:string>").alias("scope")), F.struct(F.col("depth").alias("outer"), scope.alias("scope"))))
    roles = F.coalesce(roles, F.array(F.struct(F.col("depth").alias("outer"), F.lit(None).cast("struct<n:int,end:bigint,t:string>").alias("scope"))))
    d = d.withColumn("role", F.explode(roles)).select("*", "role.outer", "role.scope")
    before = Window.partitionBy("file", "outer").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("around", F.last("scope", ignorenulls=True).over(before)).where("scope IS NULL")
    end = F.coalesce(F.when(F.col("opens"), F.least(F.col("inner_end") + 1, F.col("last"))), F.col("until"))
    return d.select("file", "n", "kind", "t", "at", "until", "line", F.coalesce("around.n", F.lit(-1)).alias("parent"), F.coalesce("around.t", F.lit("")).alias("parent_t"), F.coalesce("around.end", "last").alias("parent_end"), "inner_end", end.alias("end"))


def _back() -> Window:
    """Siblings from the last to the first: one order for all that is asked of them, so they are sorted once."""
    return Window.partitionBy("file", "parent").orderBy(F.desc("n"))


def _after(c: Column | str, k: int = 1) -> Column:
    """``c`` of the ``k``-th following sibling."""
    return F.lag(c, k).over(_back())


def _before(c: Column | str, k: int = 1) -> Column:
    """``c`` of the ``k``-th sibling before."""
    return F.lead(c, k).over(_back())


def _next(c: Column | str, when: Column) -> Column:
    """``c`` of the nearest following sibling where ``when`` holds."""
    return F.last(F.when(when, c if isinstance(c, Column) else F.col(c)), ignorenulls=True).over(_back().rowsBetween(Window.unboundedPreceding, -1))


def siblings(found: DataFrame) -> DataFrame:
    """Rows of ``nested`` with the tokens before and after each among its siblings, and whether a statement begins there:
    after ';' or a block, or on a new line where neither token asks for more."""
    d = found.select("*", _before("t").alias("prev"), _before("kind").alias("prev_kind"), _before("line").alias("prev_line"), _after("t").alias("next"), _after("kind").alias("next_kind"))
    goes_on = F.col("t").isin(*_OPERATORS, ";", "(", "[") & (F.col("kind") == "mark")
    asks = F.col("prev").isin(*_OPERATORS)
    new = F.col("prev").isNull() | (F.col("prev") == ";") | ((F.col("line") > F.col("prev_line")) & ~goes_on & ~asks) | ((F.col("prev") == "{") & (F.col("kind") == "word") & ~F.col("t").isin("else", "catch", "finally", "of", "in", "as"))
    return d.withColumn("begins", new)


def methods(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, method, form, params, line, body, at, until of functions, methods and functions that a variable, field or
    property holds (E5, E6, E6b, E6c, S18): with type parameters, return types, one bare parameter or an expression as body.

    ``form``: declared, arrow or function; ``at`` and ``until`` are the place of the body in the text, between its braces
    if it has any. A declaration without a body, and a head in a comment, string or regular expression, gives nothing.
    """
    t = _stored(texts, file, text).where("file IS NOT NULL AND text <> ''")
    found = written(_of_pieces(_dealt(_distinct_pieces(t), "file", "text")), "code-pieces")
    placed = written(_placed(t, found.withColumn("has", F.col("methods").isNotNull())), "code-placed")
    columns = ["method", "form", "params", "line", "body", "at", "until"]
    inside = found.select(F.col("file").alias("piece"), F.inline("methods")).select("piece", *columns)
    rows = placed.where("apart").join(inside, "piece").select("file", "method", "form", "params", (F.col("line") + F.col("lines")).cast("int").alias("line"), "body", *[(F.col(c) + F.col("place")).alias(c) for c in ("at", "until")])
    whole = placed.where("NOT apart").select("file").distinct()
    if whole.isEmpty():
        return rows
    return rows.unionByName(once(t.join(whole, "file", "left_semi"), "file", "text", lambda x, f, c: _of_texts(_dealt(x, f, c))).select(*rows.columns))


#: A piece of a text: up to a line that begins near the margin with a word or a comment, or with a closing brace. A cut holds (``_placed``) if no token crosses it, a word that begins a statement comes next, and nothing that
#: makes a method before it depends on what comes after it; else the text is looked at as a whole.
PIECE = r"[^\n]*+(?:\n(?![ \t]{0,2}(?:[A-Za-z_$]|/[/*])|\})[^\n]*+)*+\n?"
#: What a token before a cut is not, besides an operator.
_NOT_LAST = (*_OPERATORS, "extends", "keyof", "as", "async")


def _same(text: Column | str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _key(text: str) -> list[Column]:
    """Two hashes by which a text finds its equal, cheaper than ``_same``."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _pieces(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _distinct_pieces(t: DataFrame) -> DataFrame:
    return t.select(F.explode(_pieces("text")).alias("text")).where("text <> ''").distinct().select(_same("text").alias("file"), "text")


def _of_pieces(pieces: DataFrame) -> DataFrame:
    """file, k1, k2, size, breaks, starts, ends, stops, step, low, methods of texts that are dealt by file: their hashes, characters
    and lines, whether they may begin after a cut and end before one, by how much the brackets at their end are deeper than at their begin (null: in no way that other pieces
    could go on from) and whether they close what they have not opened."""
    raw = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    # A template that ends at the first backtick, for want of a better end, could end elsewhere in a longer text.
    odd = F.exists(raw, lambda r: r.rlike(r"^[\s\uFEFF]*+`") & ~r.rlike(r"^[\s\uFEFF]*+(?:" + _WHOLE_TEMPLATE + r")\z"))
    left = F.length("text") > F.aggregate(raw, F.lit(0), lambda n, r: n + F.length(r))
    tokens = _cut(pieces)
    opens, closes = _mark(*OPEN), _mark(*CLOSE)
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shape = tokens.withColumn("depth", depth).groupBy("file").agg(F.count(F.lit(1)).alias("tokens"), F.min("depth").alias("least"), F.max_by("depth", "n").alias("deep"), F.min_by(F.struct("t", "kind"), "n").alias("first"), F.max_by(F.struct("t", "kind"), "n").alias("last"))
    heads = _heads(pieces)
    looks_on = heads.where("looks_on").select("file").distinct().withColumn("looks_on", F.lit(True))
    of = _of_texts(pieces, heads).groupBy("file").agg(F.collect_list(F.struct("method", "form", "params", "line", "body", "at", "until")).alias("methods"))
    d = pieces.select("file", *_key("text"), F.length("text").alias("size"), F.regexp_count("text", F.lit("\n")).alias("breaks"), (left & ~odd).alias("whole")).join(shape, "file", "left").join(looks_on, "file", "left").join(of, "file", "left")
    closing = (F.col("first.t") == "}") & (F.col("first.kind") == "mark") & ((F.col("tokens") == 1) | ((F.col("tokens") == 2) & (F.col("last.t") == ";")))
    opening = (F.col("least") >= 0) & (F.col("deep") == 1) & (F.col("last.t") == "{") & (F.col("last.kind") == "mark") & F.col("methods").isNull()
    step = F.when(F.col("tokens").isNull() | ((F.col("least") >= 0) & (F.col("deep") == 0)), 0).when(closing, -1).when(opening, 1)
    no = F.lit(False)
    starts = F.col("tokens").isNull() | F.coalesce(closing | (F.col("first.kind") == "word"), no)
    ends = F.col("whole") & F.col("looks_on").isNull() & ~F.coalesce(F.col("last.t").isin(*_NOT_LAST), no)
    # What only looks up to the next ';' may end there, whatever is a method before it.
    stops = F.col("whole") & (F.col("tokens").isNull() | F.coalesce((F.col("least") >= 0) & (F.col("deep") == 0) & (F.col("last.t") == ";") & (F.col("last.kind") == "mark"), no))
    return d.select("file", "k1", "k2", "size", "breaks", starts.alias("starts"), ends.alias("ends"), stops.alias("stops"), step.alias("step"), F.coalesce((F.col("least") < 0) & ~closing, no).alias("low"), "methods")


def _placed(t: DataFrame, found: DataFrame) -> DataFrame:
    """file, piece, place, lines, apart of the pieces of stored texts that have what is looked for (``has``), and of one piece of each text that
    must be looked at as a whole (``apart`` is false): characters and lines before them."""
    # What is left at a text's end is empty.
    pieces = _spread(t).select("file", F.posexplode(_pieces("text")).alias("i", "text")).where("text <> ''")
    pieces = pieces.select("file", "i", *_key("text"))
    pieces = pieces.join(found.select("k1", "k2", F.col("file").alias("piece"), "size", "breaks", "starts", "ends", "step", "low", "has"), ["k1", "k2"])
    order = Window.partitionBy("file").orderBy("i")
    before, upto, text = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = pieces.select("*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("place"), F.coalesce(F.sum("breaks").over(before), F.lit(0)).alias("lines"), F.sum(F.coalesce("step", F.lit(0))).over(upto).alias("deep"), F.max("i").over(text).alias("last"))
    cut = (F.col("starts") | (F.col("i") == 0)) & ((F.col("ends") & F.col("step").isNotNull()) | (F.col("i") == F.col("last"))) & ~F.col("low") & (F.col("deep") >= 0)
    d = d.withColumn("apart", F.min(cut | (F.col("last") == 0)).over(text))
    return d.where("(apart AND has) OR (NOT apart AND i = 0)").select("file", "piece", "place", "lines", "apart")


def _heads(texts: DataFrame) -> DataFrame:
    """file, n, t, line, m, looks_on of texts that are dealt by file: the tokens that name a method, with its form and the
    places of its parameters and body as ``m``, and those that would look on into a text that follows."""
    d = siblings(nested(_cut(texts)))
    is_paren = _mark("(")
    block = F.struct("n", (F.col("at") + 1).alias("at"), F.col("inner_end").alias("until"))
    d = d.select("*", _next(block, _mark("{") & ~F.col("prev").isin(*_BEFORE_TYPE)).alias("f_body"), _next("n", _mark(";", "=")).alias("f_stop"), _next("n", _mark(";")).alias("f_semicolon"), _before("end").alias("prev_end"), _after("at").alias("next_at"), _after("inner_end").alias("next_inner"))
    # Where an expression that begins after this token ends.
    d = d.withColumn("expression_end", F.coalesce(_next("prev_end", _mark(",", ";") | F.col("begins")), F.max("end").over(Window.partitionBy("file", "parent"))))
    arrow = F.struct("n", F.when(F.col("next") == "{", F.col("next_at") + 1).otherwise(F.col("next_at")).alias("at"), F.when(F.col("next") == "{", F.col("next_inner")).otherwise(F.col("expression_end")).alias("until"))
    d = d.withColumn("f_arrow", _next(arrow, F.col("t") == "=>"))
    params = F.struct("n", (F.col("at") + 1).alias("at"), F.col("inner_end").alias("until"), "next", "f_body", "f_arrow", "f_stop")
    d = d.withColumn("paren", F.when(is_paren, params))
    d = d.select("*", _after("paren").alias("direct"), _next("paren", is_paren & (F.col("prev") == ">")).alias("generic"), _next("paren", is_paren).alias("any_paren"))
    # Type parameters end at the nearest '>(' if no statement and no body lies before it.
    before_stop = lambda what: what.isNull() | (what > F.col("generic.n"))
    after_types = before_stop(F.col("f_semicolon")) & before_stop(F.col("f_body.n"))
    of_type = F.coalesce(F.col("prev").isin(":", "|", "&", "extends", "keyof", "typeof", "as", "<"), F.lit(False))
    head = F.when(F.col("next") == "(", F.col("direct")).when((F.col("next") == "<") & after_types & ~of_type, F.col("generic"))
    ends_before = lambda p, what: p[what].isNotNull() & (p["f_stop"].isNull() | (p["f_stop"] > p[what]["n"]))
    open_to = lambda p, what, first: (p["next"] == first) | ((p["next"] == ":") & ends_before(p, what))
    form = lambda name, p, body: F.struct(F.lit(name).alias("form"), p["at"].alias("p_at"), p["until"].alias("p_until"), body["at"].alias("at"), body["until"].alias("until"))
    name_ok = (F.col("kind") == "word") & ~F.col("t").isin(*KEYWORDS) & ~F.coalesce(F.col("prev").isin(".", "?.", "new"), F.lit(False))
    declared = F.when(name_ok & open_to(head, "f_body", "{"), form("declared", head, head["f_body"]))
    # A function as a value that begins at this token.
    p = F.when(is_paren, F.col("paren")).when((F.col("t") == "<") & after_types, F.col("generic"))
    bare = (F.col("kind") == "word") & (F.col("next") == "=>")
    value = F.when(p.isNotNull() & open_to(p, "f_arrow", "=>"), form("arrow", p, p["f_arrow"]))
    value = F.coalesce(value, F.when(bare, F.struct(F.lit("arrow").alias("form"), F.col("at").alias("p_at"), F.col("until").alias("p_until"), F.col("f_arrow.at").alias("at"), F.col("f_arrow.until").alias("until"))))
    value = F.coalesce(value, F.when((F.col("t") == "function") & F.col("any_paren.f_body").isNotNull(), form("function", F.col("any_paren"), F.col("any_paren")["f_body"])))
    d = d.withColumn("declared", declared).withColumn("value", value)
    d = d.withColumn("value", F.coalesce(F.when(F.col("t") == "async", _after("value")), "value"))
    d = d.withColumn("given", F.when(_mark("=", ":"), _after("value")))
    d = d.select("*", _after("given").alias("own"), _next(F.struct("n", "given"), _mark("=")).alias("typed"), _next("n", _mark(";")).alias("next_stop"), _next("n", _mark(",")).alias("next_comma"), _next("n", _mark("<")).alias("next_types"))
    at_head = F.coalesce(F.col("prev").isin(*_MODIFIERS), F.lit(False)) | F.col("begins")
    named = F.col("kind").isin("word") & ~F.col("t").isin(*KEYWORDS) & ~F.coalesce(F.col("prev").isin(".", "?."), F.lit(False))
    # A comma ends a type unless it is one of type arguments.
    free = lambda c: F.col(c).isNull() | (F.col(c) > F.col("typed.n"))
    after_type = F.when((F.col("next") == ":") & at_head & free("next_stop") & (free("next_comma") | F.coalesce(F.col("next_types") < F.col("next_comma"), F.lit(False))), F.col("typed.given"))
    # A conditional expression's second part is no property.
    plain = F.when(((F.col("next") == "=") & ~of_type) | ((F.col("next") == ":") & F.coalesce(F.col("prev").isin(",", "{"), F.lit(True)) | ((F.col("next") == ":") & F.col("begins"))), F.col("own"))
    # Parameters and patterns with a function as their default are none.
    found = F.coalesce("declared", F.when(named & F.col("parent_t").isin("", "{"), F.coalesce(plain, after_type)))
    # What would look on into a text that follows this one; see ``PIECE``.
    none = lambda *c: reduce(and_, [F.col(x).isNull() for x in c])
    given_after = F.col("prev").isin("=", ":", "async")
    looks_on = [
        F.col("t") == "function",
        is_paren & (F.col("next") == ":") & none("f_stop") & (none("f_body") | (none("f_arrow") & given_after)),
        (F.col("t") == "<") & given_after & (F.col("generic.next") == ":") & none("generic.f_stop", "generic.f_arrow"),
        ((F.col("t") == "<") | (F.col("next") == "<")) & none("generic", "f_semicolon", "f_body"),
        (F.col("kind") == "word") & (F.col("next") == ":") & none("typed", "next_stop"),
    ]
    looks_on = (F.col("parent") == -1) & reduce(or_, [F.coalesce(c, F.lit(False)) for c in looks_on])
    return d.select("file", "n", "t", "line", found.alias("m"), looks_on.alias("looks_on")).where("m IS NOT NULL OR looks_on")


def _of_texts(texts: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``methods`` of texts that are dealt by file, each as a whole."""
    heads = (_heads(texts) if heads is None else heads).where("m IS NOT NULL").select("file", "n", F.col("t").alias("method"), "line", "m.*")
    whole = heads.join(texts.select("file", F.col("text").alias("_text")), "file")
    cut = lambda a, b: F.substring("_text", (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int"))
    return whole.select("file", "method", "form", F.trim(F.regexp_replace(cut("p_at", "p_until"), r"\s+", " ")).alias("params"), "line", cut("at", "until").alias("body"), "at", "until")


def _mark(*t: str) -> Column:
    return F.col("t").isin(*t) & (F.col("kind") == "mark")


def _short(c: Column) -> Column:
    """One line of 50 characters at most."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > 50, F.concat(F.left(flat, F.lit(47)), F.lit("..."))).otherwise(flat)


def _chains(texts: DataFrame, file: str, text: str) -> DataFrame:
    """Siblings with the chain that each belongs to, what follows them, and the nearest bodies, stops and ends after them."""
    d = siblings(nested(tokens(texts, file, text)))
    brace, no = _mark("{"), F.lit(False)
    # What hangs together by dots, calls and indices is a chain; chains count from the last.
    value_before = (F.col("prev_kind").isin("word", "template", "string", "regex") & ~F.coalesce(F.col("prev").isin(*KEYWORDS), no)) | F.col("prev").isin("(", "[")
    joined = F.coalesce(_mark(".", "?.") | (F.col("prev").isin(".", "?.") & (F.col("prev_kind") == "mark")) | (_mark("(", "[") & value_before & ~F.col("begins")), no)
    chain = F.coalesce(F.sum(F.when(joined, 0).otherwise(1)).over(_back().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("chain")
    # A bracket as who stands before it sees it: what follows it, and where the nearest body and the nearest stop are.
    d = d.select("*", chain, _next("n", brace & ~F.col("prev").isin(*_BEFORE_TYPE)).alias("f_body_n"), _next("n", _mark(";", "=")).alias("f_stop_n"), _next("n", _mark(*_NO_TYPE) | (brace & ~F.col("prev").isin(*_BEFORE_TYPE)) | (_mark("(") & (F.col("prev") != ">")) | F.col("begins")).alias("f_stop"), _before("at").alias("prev_at"), _before("prev").alias("prev2"))
    d = d.withColumn("self", F.struct("n", "t", "at", "inner_end", "next", "end", "f_body_n", "f_stop_n"))
    ends = _mark(";") | F.col("begins")
    d = d.select(
        "*", _after("self").alias("after"), _after("self", 2).alias("after2"), _next("self", _mark("(") & (F.col("prev") == ">")).alias("f_generic"), F.coalesce(_next("at", ends), F.col("parent_end")).alias("statement_end"),
        _next(F.struct("n", "end"), _mark("=")).alias("f_equals"), _next("n", _mark(",")).alias("f_comma"), _next("n", ends).alias("f_end"), _next("n", _mark("??")).alias("f_fallback"),
    )
    chained = Window.partitionBy("file", "parent", "chain").orderBy("n")
    whole = chained.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(F.struct("at", "prev", "begins")).over(whole), F.last(F.struct("n", "next", "end")).over(whole)
    calls_before = F.coalesce(F.sum(F.when(_mark("("), 1).otherwise(0)).over(chained.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.select("*", first.alias("chain_first"), last.alias("chain_last"), calls_before.alias("calls_before"))
    d = d.select("*", F.col("chain_first.at").alias("chain_at"), F.col("chain_first.prev").alias("chain_prev"), F.col("chain_first.begins").alias("chain_begins"), F.col("chain_last.n").alias("last_in_chain"), F.col("chain_last.next").alias("chain_next"), F.col("chain_last.end").alias("chain_end"))
    # Read below in several ways, so it is written once.
    d = written(d.drop("self", "chain_first", "chain_last", "prev_line", "until"), "code-tokens")
    return d


def _in_chain() -> Column:
    return F.coalesce(F.col("prev").isin(".", "?.") & (F.col("prev_kind") == "mark"), F.lit(False))


def _kinds(d: DataFrame) -> DataFrame:
    """Rows of ``_chains`` with ``bracket``, the brackets of a call, ``what`` they begin, if anything, and ``assigns``."""
    no, in_chain = F.lit(False), _in_chain()
    # A call: a name or chain before a bracket, directly, after '?.', or after type arguments.
    bracket = F.when(F.col("next") == "(", F.col("after")).when((F.col("next") == "?.") & (F.col("after2.t") == "("), F.col("after2")).when((F.col("next") == "<") & (F.coalesce(F.col("f_stop"), F.col("f_generic.n") + 1) > F.col("f_generic.n")), F.col("f_generic"))
    word = (F.col("kind") == "word") & bracket.isNotNull()
    call = word & (in_chain | ~F.col("t").isin(*KEYWORDS)) & ~((F.col("chain_prev") == "new") & (F.col("calls_before") == 0) & F.col("chain_prev").isNotNull()) & ~F.coalesce(F.col("chain_prev").isin("function", "*"), no)
    # A method's own head is no call: a body follows its bracket, or a type and a body.
    d = d.withColumn("bracket", bracket).withColumn("call", F.coalesce(call, no))
    typed = (F.col("bracket.next") == ":") & (F.col("chain_begins") | F.coalesce(F.col("chain_prev").isin(",", *_MODIFIERS), no)) & F.col("bracket.f_body_n").isNotNull() & (F.col("bracket.f_stop_n").isNull() | (F.col("bracket.f_stop_n") > F.col("bracket.f_body_n")))
    d = d.withColumn("call", F.col("call") & (in_chain | ~F.coalesce((F.col("bracket.next") == "{") | typed, no)))
    kinds = F.when(F.col("call"), "call").when((F.col("t") == "if") & (F.col("next") == "(") & ~in_chain, "condition")
    do_block = (F.col("t") == "while") & (F.col("prev") == "{") & (F.col("prev2") == "do")
    kinds = kinds.when(F.col("t").isin("for", "while") & ~in_chain & F.col("next").isin("(", "await") & ~F.coalesce(do_block, no), "loop").when((F.col("t") == "return") & (F.col("kind") == "word") & ~in_chain & ~F.coalesce(F.col("next") == ":", no), "return")
    kinds = kinds.when(F.col("t").isin("const", "let", "var") & (F.col("kind") == "word") & ~in_chain & (F.col("begins") | F.coalesce(F.col("prev").isin("export", "declare"), no)), "declaration")
    simple = F.col("begins") & (F.col("kind") == "word") & ~F.col("t").isin(*KEYWORDS, *_MODIFIERS)
    return d.withColumn("what", kinds).withColumn("assigns", simple)


def _statements(d: DataFrame) -> DataFrame:
    """The rows of ``_kinds`` that are operations, with what their brackets hold: the word of a loop's head, an early return."""
    brace = _mark("{")
    # What directly lies in a bracket, for its own row: the first token, how many statements, and the words of a loop's head.
    inside = d.groupBy("file", F.col("parent").alias("bracket")).agg(F.min_by("t", "n").alias("first_in"), F.count_if(F.col("begins") & ~_mark(";")).alias("statements"), F.max(F.when((F.col("kind") == "word") & F.col("t").isin("of", "in"), F.struct("n", "t", "end"))).alias("each"))
    # A statement that begins with a chain and '=' right after it assigns.
    rows = d.where("what IS NOT NULL OR (assigns AND chain_next = '=')")
    head = F.when(F.col("next") == "await", F.col("after2")).otherwise(F.col("after"))
    rows = rows.withColumn("head", F.when(F.col("what").isin("condition", "loop"), head)).withColumn("key", F.when(F.col("what").isin("condition", "loop"), F.col("head.n")))
    of_head = inside.select("file", F.col("bracket").alias("key"), "each")
    rows = rows.join(of_head, ["file", "key"], "left")
    d2 = d.where(_mark("(")).select("file", F.col("n").alias("key"), F.col("next").alias("then"), F.col("after.n").alias("then_n")).where("then IN ('{', 'return')")
    blocks = inside.select("file", F.col("bracket").alias("then_n"), "first_in", "statements")
    early = d2.join(blocks, ["file", "then_n"], "left").select("file", "key", ((F.col("then") == "return") | ((F.col("first_in") == "return") & (F.col("statements") == 1))).alias("early"))
    rows = rows.join(early, ["file", "key"], "left")
    earlier = Window.partitionBy("file", "parent").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    last_n = lambda c: F.coalesce(F.last(F.when(c, F.col("n")), ignorenulls=True).over(earlier), F.lit(-1))
    # Heads of loops, whose declarations are no statements, and bodies of classes, whose fields are none.
    heads = d.withColumn("class_n", last_n(F.col("t") == "class")).withColumn("block_n", last_n(_mark("{", ";"))).where((_mark("(") & F.col("prev").isin("for", "await")) | (brace & (F.col("class_n") > F.col("block_n"))))
    rows = rows.join(heads.select("file", F.col("n").alias("parent"), F.lit(True).alias("in_head")), ["file", "parent"], "left").where("in_head IS NULL OR (what IS NOT NULL AND what <> 'declaration')")
    return rows


def operations(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, type, target, method, detail, flag, times, line, at, until, arguments of the operations of each text (E22, X29,
    X36).

    Calls have their owner's text as ``target`` ('global' if none), their ``arguments`` whole and, on one line of 50
    characters at most, as ``detail``; those of
    ``ARRAY_METHODS`` are types of their own. A call that is a whole statement counts twice, as
    statement and as expression. Conditions have ``flag`` if all they do is return; loops have their kind, for_of,
    for_in, for or while, as ``method``, and what they run over; declarations of one name and assignments their target
    and source, and ``flag`` for a fallback; a statement of several declarations or of a pattern is one
    'multi_assignment'. Constructors, do-while loops and compound assignments are none.
    """
    return once(texts, file, text, _operations)


def calls(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """The calls among ``operations``, but those of ``ARRAY_METHODS``. Equal pieces of texts are looked at once where every
    piece (``PIECE``) ends with a statement's ';', as no call looks further; other texts as a whole."""
    t = _stored(texts, file, text).where("text <> ''")
    pieces = written(_distinct_pieces(t), "code-pieces")
    found = _of_pieces(_dealt(pieces, "file", "text"))
    found = written(found.withColumns({"ends": F.col("stops"), "step": F.when(F.col("stops"), 0), "has": F.lit(True)}), "code-pieces")
    placed = written(_placed(t, found), "code-placed")
    inside = _operations(pieces, "file", "text").where("type = 'method_call'")
    rows = placed.where("apart").join(inside.withColumnRenamed("file", "piece").withColumnsRenamed({"line": "_line"}), "piece")
    rows = rows.withColumns({"line": (F.col("_line") + F.col("lines")).cast("int"), "at": F.col("at") + F.col("place"), "until": F.col("until") + F.col("place")}).select(*inside.columns)
    whole = placed.where("NOT apart").select(F.col("file").alias("_file")).distinct()
    if whole.isEmpty():
        return rows
    rest = t.join(whole, F.col("file").eqNullSafe(F.col("_file")), "left_semi")
    return rows.unionByName(once(rest, "file", "text", _operations).where("type = 'method_call'"))


def _operations(texts: DataFrame, file: str, text: str) -> DataFrame:
    no, in_chain = F.lit(False), _in_chain()
    rows = _statements(_kinds(_chains(texts, file, text)))
    rows = rows.join(texts.select(F.col(file).alias("file"), F.col(text).alias("_text")), "file")
    cut = lambda a, b: F.substring("_text", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    owner = F.when(in_chain, cut(F.col("chain_at"), F.col("prev_at"))).otherwise("global")
    arguments = cut(F.col("bracket.at") + 1, F.col("bracket.inner_end"))
    low = F.lower("t")
    array = F.col("what").eqNullSafe("call") & low.isin(*ARRAY_METHODS)
    single = (F.col("what") == "declaration") & (F.col("f_comma").isNull() | (F.coalesce(F.col("f_end"), F.col("f_comma") + 1) < F.col("f_comma"))) & (F.col("next_kind") == "word")
    equals_ok = F.col("f_equals").isNotNull() & (F.col("f_end").isNull() | (F.col("f_end") > F.col("f_equals.n")))
    kind = F.when(array, low).when(F.col("what") == "call", "method_call").when(F.col("what") == "declaration", F.when(single, "assignment").otherwise("multi_assignment")).when(F.col("what").isNull(), "assignment").otherwise(F.col("what"))
    target = F.when(F.col("what") == "call", owner).when((F.col("what") == "loop") & F.col("each").isNotNull(), _short(cut(F.col("each.end"), F.col("head.inner_end")))).when(single, F.col("next")).when(F.col("what").isNull(), _short(cut(F.col("at"), F.col("chain_end")))).otherwise("")
    method = F.when(F.col("what") == "call", F.col("t")).when(F.col("what") == "loop", F.when((F.col("t") == "for") & F.col("each").isNotNull(), F.concat(F.lit("for_"), F.col("each.t"))).otherwise(F.col("t"))).otherwise("")
    source = F.when(equals_ok, _short(cut(F.col("f_equals.end"), F.col("statement_end"))))
    detail = F.when(F.col("what") == "call", _short(arguments)).when(F.col("what") == "condition", _short(cut(F.col("head.at") + 1, F.col("head.inner_end")))).when(F.col("what") == "return", _short(cut(F.col("end"), F.col("statement_end")))).when(single, F.coalesce(source, F.lit("undefined"))).when(F.col("what").isNull(), source).otherwise("")
    whole_call = (F.col("what") == "call") & F.col("chain_begins") & ((F.col("last_in_chain") == F.col("bracket.n")) | ((F.col("next") == "<") & (F.col("last_in_chain") == F.col("n")))) & F.coalesce(F.col("bracket.end") >= F.col("statement_end"), no)
    fallback = single & F.col("f_fallback").isNotNull() & (F.col("f_end").isNull() | (F.col("f_end") > F.col("f_fallback")))
    flag = F.when(F.col("what") == "condition", F.coalesce("early", no)).otherwise(F.coalesce(fallback, no))
    return rows.select("file", kind.alias("type"), target.alias("target"), method.alias("method"), detail.alias("detail"), flag.alias("flag"), F.when(F.coalesce(whole_call, no), 2).otherwise(1).alias("times"), "line", "at", F.coalesce(F.col("bracket.end"), F.col("statement_end")).alias("until"), F.when(F.col("what") == "call", arguments).otherwise("").alias("arguments"))


def summaries(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, branches, loops, calls, flows, complexity, operations array<struct<type, detail>>, steps array<struct<from,
    to>> of each text with an operation (E22, A26); as ``selectors.semantic`` takes methods (F9)."""
    o = operations(texts, file, text)
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("times"))), F.lit(0))
    flowing = F.col("type").isin("filter", "assignment")
    step = F.struct(F.when(F.col("type") == "filter", F.col("target")).otherwise(F.col("detail")).alias("from"), F.col("target").alias("to"))
    g = o.groupBy("file").agg(
        n("condition").alias("branches"), n("loop").alias("loops"), n("method_call").alias("calls"), F.coalesce(F.sum(F.when(flowing, F.col("times"))), F.lit(0)).alias("flows"),
        F.array_sort(F.collect_list(F.struct("at", "type", F.concat_ws(".", F.nullif("target", F.lit("")), F.nullif("method", F.lit(""))).alias("detail")))).alias("operations"), F.array_sort(F.collect_list(F.when(flowing, F.struct("at", step.alias("s"))))).alias("steps"),
    )
    weight = F.col("branches") + 2 * F.col("loops") + 0.5 * F.col("calls")
    return g.select("file", "branches", "loops", "calls", "flows", F.when(weight <= 2, "low").when(weight <= 5, "medium").otherwise("high").alias("complexity"), F.transform("operations", lambda x: F.struct(x["type"].alias("type"), x["detail"].alias("detail"))).alias("operations"), F.transform("steps", lambda x: x["s"]).alias("steps"))
