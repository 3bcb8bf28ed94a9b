"""What lies inside source texts: documentation, bracketed parts, operations, inline and mapped events, members.

Where brackets and quotes must be matched, a small Arrow-batched helper walks each text once; the rest are joins and
expressions. A regular expression is told from a division by what stands before it. Null and empty texts give nothing.
A worker remembers what it has found in pieces of texts (``_by_pieces``) and looks at equal ones once.
``lexing`` finds methods and operations from rows of tokens instead.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import written

_QUOTED = r""""[^"\\]*(?:\\.[^"\\]*)*"?|'[^'\\]*(?:\\.[^'\\]*)*'?|`[^`\\]*(?:\\.[^`\\]*)*`?"""
#: A quoted part, a comment or a slash; and these or a bracket or comma. All begin with a fixed character, so that the
#: search passes over whatever lies between.
_PLAIN = re.compile(rf"{_QUOTED}|//[^\n]*\n?|/\*.*?(?:\*/|\Z)|/", re.DOTALL)
_TOKEN = re.compile(rf"\(|\)|\[|\]|\{{|\}}|,|{_PLAIN.pattern}", re.DOTALL)
#: A regular expression; what stands before it tells it from a division.
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.DOTALL)
_BEFORE_REGEX, _WORDS_BEFORE_REGEX = frozenset("=(,:[!&|?{};>"), ("return", "typeof", "case")
_NAMED = re.compile(r"(?:(?<![\w$.])((?:[A-Za-z_$][\w$]*\s*\.\s*)*)|(?<=[)\]])(\s*\.\s*))([A-Za-z_$][\w$]*)\s*\(")
_EARLY = re.compile(r"\s*(?:return\b|\{\s*return\b[^;{}]*;?\s*\})")
_DECLARED = re.compile(r"\s*(?::[^{}();=]*)?\{")
_EACH = re.compile(r"\s*(?:(?:const|let|var)\s+)?[^;]*?\s(of|in)\s+(.*)", re.DOTALL)
_ASSIGNED = re.compile(r"(?<![\w$.])(?:(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?|((?:[A-Za-z_$][\w$]*\.)+[A-Za-z_$][\w$]*)\s*)=(?![=>])\s*([^;\n]*)")
_RETURNED = re.compile(r"(?<![\w$.])return\b[ \t]*([^;\n}]*)")
#: Methods of arrays that are operations of their own.
ARRAY_METHODS = ("filter", "map", "reduce", "find", "some", "every", "foreach", "sort")
_NO_CALLS = frozenset("switch catch function return typeof await async new constructor super".split())
METHOD = "array<struct<method: string, params: string, line: int, body: string>>"
_NO_METHODS = frozenset("if for while switch catch function return typeof await async new super".split())
OPERATION = "array<struct<type: string, target: string, detail: string, line: int, flag: boolean>>"
BRACKETED = "array<struct<name: string, head: string, inside: string, parts: array<string>>>"
DOC = "struct<description: string, params: map<string, struct<type: string, description: string>>, returns: string, returns_type: string, examples: array<string>, see: array<string>, since: string, deprecated: boolean>"


def _regex_end(text: str, at: int, last: int) -> int:
    """Where the regular expression that the slash at ``at`` begins ends, or 0 for a division; what ends at ``last`` was
    quoted, a comment or a regular expression and tells nothing."""
    i = at
    while i > last and text[i - 1].isspace():
        i -= 1
    if i == last:
        return 0
    if text[i - 1] not in _BEFORE_REGEX:
        word = next((w for w in _WORDS_BEFORE_REGEX if i - len(w) >= last and text.startswith(w, i - len(w))), "")
        before = text[i - len(word) - 1 : i - len(word)] if i > len(word) else ""
        if not word or before == "_" or before.isalnum():
            return 0
    m = _REGEX.match(text, at)
    return m.end() if m else 0


def _passed(text: str, at: int = 0, last: int = 0, pattern: re.Pattern = _PLAIN) -> Iterator[tuple[int, int]]:
    """Start and end of what ``pattern`` finds from ``at``, without divisions; see ``_regex_end`` for ``last``."""
    while m := pattern.search(text, at):
        start, at = m.span()
        if text[start] in "()[]{},":
            yield start, at
        elif text[start] != "/" or at - start > 1:
            yield start, (last := at)
        elif end := _regex_end(text, start, last):
            at = last = end
            yield start, at


def _pairs(text: str, tokens: list[tuple[int, int]] | None = None) -> dict[int, tuple[int, list[int]]]:
    """Where each closed bracket opens, to where it closes and the commas directly inside."""
    found, open_ = {}, []
    for at, _ in _passed(text, pattern=_TOKEN) if tokens is None else tokens:
        c = text[at]
        if c in "([{":
            open_.append((at, []))
        elif open_ and c == ",":
            open_[-1][1].append(at)
        elif open_ and c in ")]}":
            start, commas = open_.pop()
            found[start] = (at, commas)
    return found


def _pairs_at(text: str, asked: list[int]) -> dict[int, tuple[int, list[int]]]:
    """What ``_pairs`` has for the brackets at the places asked for, which are in order: up to them only quotes, comments
    and regular expressions are passed, and brackets are matched inside them only."""
    found, passed = {}, _passed(text)
    last, (start, end) = 0, next(passed, (len(text), len(text)))
    for place in asked:
        while end <= place and start < len(text):
            last, (start, end) = end, next(passed, (len(text), len(text)))
        if start <= place:
            continue
        deep, commas = 0, []
        for at, _ in _passed(text, place, last, _TOKEN):
            c = text[at]
            if c in "([{":
                deep += 1
            elif c == "," and deep == 1:
                commas.append(at)
            elif c in ")]}":
                deep -= 1
                if not deep:
                    found[place] = (at, commas)
                    break
    return found


def _uncommented(text: str, shown: Callable[[str], str]) -> str:
    """The text with what ``shown`` makes of its comments."""
    out, kept = [], 0
    for at, end in _passed(text):
        if text.startswith(("//", "/*"), at):
            out += text[kept:at], shown(text[at:end])
            kept = end
    return "".join(out) + text[kept:] if out else text


def _masked(text: str) -> str:
    """The text with blanks for its comments, so that places and lines stay as they are."""
    return _uncommented(text, lambda c: re.sub(r"[^\n]", " ", c))


def _short(text: str) -> str:
    """One line of 50 characters at most."""
    flat = " ".join(text.split())
    return flat if len(flat) <= 50 else flat[:47] + "..."


#: A piece of a text: up to a line that begins near the margin with a word, a decorator or a comment, or with a closing
#: brace.
_PIECE = re.compile(r"[^\n]*(?:\n(?![ \t]{0,2}(?:[A-Za-z_$@]|/[/*])|\})[^\n]*)*\n?")
#: How many pieces a worker remembers for each thing it looks for, and how long they are at most.
REMEMBERED, LONGEST = 1 << 14, 1 << 12


def _closed(piece: str, tokens: list[tuple[int, int]]) -> bool:
    """Whether nothing in a piece reaches beyond its end: quotes and comments end there, its last statement or block does,
    and all its brackets are closed, but for a brace at its end after a head without brackets, or one that it closes."""
    deep, kept, masked = 0, 0, []
    for at, end in tokens:
        c = piece[at]
        if c in "([{":
            deep += 1
        elif c in ")]}":
            deep -= 1
            if deep < 0 and piece.strip() not in ("}", "};"):
                return False
        elif c != "," and end == len(piece) and not (piece.startswith("//", at) and piece.endswith("\n")):
            return False
        elif piece.startswith(("//", "/*"), at):
            masked.append(piece[kept:at])
            kept = end
    last = ("".join(masked) + piece[kept:]).rstrip()
    if deep > 0 and not (deep == 1 and last.endswith("{") and not set("()[]").intersection(last)):
        return False
    return not last or last[-1] in ";{}"


def _by_pieces(of: Callable[[str, list | None], list[dict]], kind: str) -> Callable[[str], list[tuple[int, list[list]]]]:
    """Of a text, for each of its pieces the lines before it and, column by column as in ``kind``, what ``of`` finds in it; a
    text of which a piece but the last is not closed (``_closed``) is one piece."""
    names = _names_of(kind)
    told = lambda found: [[x[n] for x in found] for n in names]

    def both(piece: str) -> tuple[bool, int, list[list]]:
        tokens = list(_passed(piece, pattern=_TOKEN))
        # Without comments the tokens are those that ``of`` looks for.
        plain = "//" not in piece and "/*" not in piece
        return _closed(piece, tokens), piece.count("\n"), told(of(piece, tokens if plain else None))

    remembered = lru_cache(REMEMBERED)(both)

    def run(text: str) -> list[tuple[int, list[list]]]:
        pieces = _PIECE.findall(text)
        if not pieces[-1]:
            pieces.pop()
        out, lines = [], 0
        for i, p in enumerate(pieces, 1):
            closed, breaks, found = remembered(p) if len(p) <= LONGEST else both(p)
            if not closed and i < len(pieces):
                return [(0, told(of(text, None)))]
            if found[0]:
                out.append((lines, found))
            lines += breaks
        return out

    return run


def _names_of(kind: str) -> list[str]:
    return [x.split(":")[0] for x in kind.removeprefix("array<struct<").split(", ")]


def _found(texts: pa.Array, run: Callable[[str], list[tuple[int, list[list]]]], kind: str) -> pa.Array:
    """What ``_by_pieces`` finds in each text, with the lines of the whole."""
    names, ends = _names_of(kind), [0]
    columns: list[list] = [[] for _ in names]
    at = names.index("line")
    for text in texts.to_pylist():
        for lines, found in run(text) if text else ():
            for c, x in zip(columns, found):
                c += x
            if lines:
                columns[at][-len(found[at]) :] = [n + lines for n in found[at]]
        ends.append(len(columns[0]))
    types = {"line": pa.int32(), "flag": pa.bool_()}
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, columns)], names))


def _operations_of(text: str, tokens: list[tuple[int, int]] | None) -> list[dict]:
    text = _masked(text) if tokens is None else text
    if not ("(" in text or "=" in text or "return" in text):
        return []
    breaks, pairs, found = [m.start() for m in re.finditer("\n", text)], _pairs(text, tokens), []

    def add(at: int, kind: str, target: str, detail: str, flag: bool = False) -> None:
        found.append((at, {"type": kind, "target": target, "detail": _short(detail), "line": bisect_left(breaks, at) + 1, "flag": flag}))

    for m in _NAMED.finditer(text):
        pair = pairs.get(m.end() - 1)
        owner, name = (m[1] or m[2] or "").strip(), m[3]
        if pair is None or (not owner and name in _NO_CALLS):
            continue
        inside = text[m.end() : pair[0]]
        if not owner and name == "if":
            add(m.start(), "condition", "", inside, bool(_EARLY.match(text, pair[0] + 1)))
        elif not owner and name in ("for", "while"):
            each = _EACH.fullmatch(inside) if name == "for" else None
            add(m.start(), "loop", f"for_{each[1]}" if each else name, each[2] if each else "")
        elif owner or not _DECLARED.match(text, pair[0] + 1):
            kept = "".join(owner.split()).rstrip(".")
            kind = name.lower() if name.lower() in ARRAY_METHODS and owner else "method_call"
            first = text[m.end() : pair[1][0]] if pair[1] else inside
            add(m.start(), kind, (kept or "()" if owner else "global") + ("" if kind != "method_call" else f".{name}" if owner else f":{name}"), first if kind != "method_call" else inside)
    for m in _ASSIGNED.finditer(text):
        add(m.start(), "assignment", m[1] or m[2], m[3], "??" in m[3])
    for m in _RETURNED.finditer(text):
        add(m.start(), "return", "", m[1])
    return [x for _, x in sorted(found, key=lambda x: x[0])]


_operations_by_pieces = _by_pieces(_operations_of, OPERATION)


def _operations(texts: pa.Array) -> pa.Array:
    return _found(texts, _operations_by_pieces, OPERATION)


_VARIABLE = re.compile(r"(?<![\w$.])(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(")
_ARROW = re.compile(r"\s*(?::[^{}();=]*)?=>\s*\{")


def _methods_of(text: str, tokens: list[tuple[int, int]] | None) -> list[dict]:
    """Functions, methods and variables that hold an arrow function, with what is between their braces."""
    whole, text = text, _masked(text) if tokens is None else text
    if "(" not in text:
        return []
    breaks, pairs, found = [m.start() for m in re.finditer("\n", text)], _pairs(text, tokens), []
    heads = [(m.start(3), m.end() - 1, m[3], _DECLARED) for m in _NAMED.finditer(text) if not (m[1] or m[2]) and m[3] not in _NO_METHODS]
    heads += [(m.start(1), m.end() - 1, m[1], _ARROW) for m in _VARIABLE.finditer(text)]
    for at, bracket, name, after in sorted(heads):
        pair = pairs.get(bracket)
        brace = after.match(text, pair[0] + 1) if pair else None
        body = pairs.get(brace.end() - 1) if brace else None
        if body:
            found.append({"method": name, "params": " ".join(text[bracket + 1 : pair[0]].split()), "line": bisect_left(breaks, at) + 1, "body": whole[brace.end() : body[0]]})
    return found


_methods_by_pieces = _by_pieces(_methods_of, METHOD)


def _methods(texts: pa.Array) -> pa.Array:
    return _found(texts, _methods_by_pieces, METHOD)


def _doc(block: str | None) -> dict | None:
    if block is None:
        return None
    lines = [re.sub(r"^\s*\*\s?", "", x).strip() for x in re.sub(r"\*/$", "", re.sub(r"^/\*\*", "", block)).splitlines()]
    parts, out = [["", []]], {"params": {}, "returns": "", "returns_type": "", "examples": [], "see": [], "since": ""}
    for line in filter(None, lines):
        tag = re.fullmatch(r"@(\w+)(?:\s+(.*))?", line)
        if tag:
            parts.append([tag[1], [tag[2]] if tag[2] else []])
        else:
            parts[-1][1].append(line)
    for tag, said in parts[1:]:
        whole = " ".join(said)
        kind, rest = re.fullmatch(r"(?:\{([^}]+)\}\s*)?(.*)", whole).groups()
        if tag == "param" and (named := re.fullmatch(r"(\w+)\s*-?\s*(.*)", rest)):
            out["params"][named[1]] = {"type": kind or "", "description": named[2]}
        elif tag in ("returns", "return"):
            out["returns"], out["returns_type"] = rest, kind or ""
        elif tag == "example":
            out["examples"].append("\n".join(said))
        elif tag == "see":
            out["see"].append(whole)
        elif tag == "since":
            out["since"] = whole
    return out | {"description": " ".join(parts[0][1]), "deprecated": any(t == "deprecated" for t, _ in parts)}


def without_comments(text: Column | str) -> Column:
    """Source without comments; what looks like one in quotes stays."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else _uncommented(t, lambda c: "\n" if c.startswith("//") else ""))

    # Not marked as ``operations`` is: what looks into this in Python can run in the same batch.
    return F.pandas_udf(run, "string")(text)


def operations(text: Column | str) -> Column:
    """Conditions, loops, calls, methods of arrays, assignments and returns of a text, in order.

    ``flag``: a condition that returns at once, an assignment with a fallback. A call's target is owner and name.
    """

    def run(texts: pa.Array) -> pa.Array:
        return _operations(texts)

    # Marked so that filters and unnesting above it don't run it again.
    return F.arrow_udf(run, OPERATION).asNondeterministic()(text)


def _docs(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = ["description", "params", "returns", "returns_type", "examples", "see", "since", "deprecated"]
    for block in blocks:
        yield pd.DataFrame([[(_doc(b) or {}).get(n) for n in names] for b in block], columns=names)


def parsed_doc(block: Column | str) -> Column:
    """Description and tags of a documentation block (X27). The last tag counts whatever it is."""
    return F.pandas_udf(_docs, DOC)(block)


def bracketed(text: Column | str, pattern: str) -> Column:
    """name (group 1), head (the match), inside and parts between top-level commas of each match of ``pattern``, which
    must end with an opening bracket; one that is never closed gives nothing (X29, X29b)."""
    compiled = re.compile(pattern)

    def of(text: str | None) -> list[dict]:
        heads, out = list(compiled.finditer(text or "")), []
        pairs = _pairs_at(text, [m.end() - 1 for m in heads]) if heads else {}
        for m in heads:
            if (pair := pairs.get(m.end() - 1)) is not None:
                cuts = [m.end() - 1, *pair[1], pair[0]]
                parts = [text[a + 1 : b].strip() for a, b in zip(cuts, cuts[1:])]
                out.append({"name": m[1], "head": m[0], "inside": text[m.end() : pair[0]], "parts": parts if parts[-1] else parts[:-1]})
        return out

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    return F.pandas_udf(run, BRACKETED)(text)


def unquoted(c: Column) -> Column:
    """An expression on one line, without its quotes."""
    flat = F.array(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.transform(flat, lambda x: F.when(x.rlike("""^(["'`]).*\\1$"""), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))[0]


def property_of(c: Column, key: str) -> Column:
    """The value of ``key`` in an object literal, as written; empty if there is none."""
    return F.trim(F.regexp_extract(c, rf"""(?:[{{,]|^)\s*["']?\Q{key}\E["']?\s*:\s*("[^"]*"|'[^']*'|[^,}}]+)""", 1))


def summaries(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, operations, flows, branches, loops, calls, complexity of each text.

    A filter flows from its target to itself, an assignment from its source to its target.
    """
    ops = texts.select(F.col(file).alias("file"), operations(text).alias("operations"))
    n = lambda kind: F.size(F.filter("operations", lambda o: o["type"] == kind))
    flowing = F.filter("operations", lambda o: o["type"].isin("filter", "assignment"))
    flow = F.transform(flowing, lambda o: F.struct(F.when(o["type"] == "filter", o["target"]).otherwise(o["detail"]).alias("from"), o["target"].alias("to"), F.when(o["type"] == "filter", "filter").otherwise("transform").alias("stage")))
    weight = F.col("branches") + 2 * F.col("loops") + 0.5 * F.col("calls")
    found = ops.select("file", "operations", flow.alias("flows"), n("condition").alias("branches"), n("loop").alias("loops"), n("method_call").alias("calls"))
    return found.withColumn("complexity", F.when(weight <= 2, "low").when(weight <= 5, "medium").otherwise("high"))


def documentation(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, name, doc: each documentation block and what it stands before."""
    block = r"(?s)/\*\*.*?\*/\s*(?:(?:export|default|public|private|protected|static|async|function|class|const|let|var)\s+)*[\w$]*"
    each = texts.select(F.col(file).alias("file"), F.explode(F.regexp_extract_all(text, F.lit(block), F.lit(0))).alias("b"))
    return each.select("file", F.regexp_extract("b", r"([\w$]*)$", 1).alias("name"), parsed_doc(F.regexp_extract("b", r"(?s)^(/\*\*.*?\*/)", 1)).alias("doc"))


#: What a snippet shows, in this order: methods of arrays, heads, declarations, own fields, returns, calls.
SHOWN = (
    r"\.(?:filter|map|reduce|find|some|every)\s*\([^)]+\)", r"\b(?:if|for|while|switch)\s*\([^)]+\)", r"\b(?:let|const|var)\s+\w+\s*=\s*[^;]+",
    r"this\.\w+\s*=\s*[^;]+", r"return\s+[^;]+", r"\w+\([^)]*\)",
)


def snippet(text: Column, most: int = 500) -> Column:
    """The first five of each kind of ``SHOWN``, once each; what is below 50 characters gives way to the text."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?m)//.*$", ""), r"(?s)/\*.*?\*/", ""), r"\s+", " "))
    found = F.array_join(F.array_distinct(F.concat(*[F.slice(F.regexp_extract_all(flat, F.lit(p), F.lit(0)), 1, 5) for p in SHOWN])), "; ")
    chosen = F.when((F.length(found) < 50) & (flat != ""), F.left(flat, F.lit(most))).otherwise(found)
    return F.when(F.length(chosen) > most, F.concat(F.left(chosen, F.lit(most)), F.lit("..."))).otherwise(chosen)


#: What events are subscribed at.
BUS = r"(eventBus|oops\.message|director)\.(?:on|once)\s*\("


def inline_events(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, bus, mode, event, calls: subscriptions with a function written in place, and what it calls."""
    each = texts.select(F.col(file).alias("file"), F.explode(bracketed(text, rf"\b{BUS}")).alias("b"))
    callback = F.col("b.parts")[1]
    inline = each.where((F.size("b.parts") >= 2) & callback.rlike(r"=>|\bfunction\b")).select("file", "b.*", callback.alias("callback"))
    inline = inline.select("file", F.col("name").alias("bus"), F.regexp_extract("head", r"\.(once|on)\s*\($", 1).alias("mode"), unquoted(F.col("parts")[0]).alias("event"), operations("callback").alias("o"))
    called = F.array_sort(F.array_distinct(F.transform(F.filter("o", lambda o: o["type"] == "method_call"), lambda o: o["target"])))
    return inline.where("event <> ''").select("file", "bus", "mode", "event", called.alias("calls"))


def handler_maps(texts: DataFrame, file: str = "file", text: Column | str = "text") -> DataFrame:
    """file, map, event, handler: fields that name a method of the object for each event."""
    field = r"(?m)^[ \t]*(?:(?:public|private|protected|readonly)[ \t]+)*([A-Za-z_$][\w$]*)[ \t]*(?::[^=\n]+)?=\s*\{"
    each = texts.select(F.col(file).alias("file"), F.explode(bracketed(text, field)).alias("b"))
    entry = r"(?s)^(.*\S)\s*:\s*this\.([A-Za-z_$][\w$]*)$"
    key = lambda p: F.regexp_replace(F.trim(F.regexp_extract(p, entry, 1)), r"^\[\s*(.*?)\s*\]$", "$1")
    # Entries are read before they are unnested, so that no filter on them reads them again.
    entries = F.transform(F.filter("b.parts", lambda p: p.rlike(entry)), lambda p: F.struct(unquoted(key(p)).alias("event"), F.regexp_extract(p, entry, 2).alias("handler")))
    return each.select("file", F.col("b.name").alias("map"), F.explode(entries).alias("x")).select("file", "map", "x.*").where("event <> ''").distinct()


def mapped_events(texts: DataFrame, maps: DataFrame, file: str = "file", text: Column | str = "text") -> DataFrame:
    """file, bus, mode, event, handler, map: subscriptions of every entry of a handler map."""
    each = texts.select(F.col(file).alias("file"), F.explode(bracketed(text, r"\bObject\.entries\(this\.([A-Za-z_$][\w$]*)\)\.forEach\(")).alias("b"))
    names = r"(?s)^\(\s*\[\s*([\w$]+)\s*,\s*([\w$]+)\s*\]\s*\)\s*=>"
    on = r"\b(eventBus|oops\.message)\.(on|once)\(\s*([\w$]+)\s*,\s*([\w$]+)\s*,\s*this\s*\)"
    # A body is read before it is unnested, so that no filter reads it again.
    one = lambda m: F.struct(*[F.regexp_extract(m, on, i).alias(n) for i, n in enumerate(("bus", "mode", "e", "h"), 1)])
    read = lambda x: F.struct(F.regexp_extract(x, names, 1).alias("e"), F.regexp_extract(x, names, 2).alias("h"), F.transform(F.regexp_extract_all(x, F.lit(on), F.lit(0)), one).alias("uses"))
    body = F.explode(F.transform(F.array(F.array_join(F.col("b.parts"), ",")), read))
    each = each.select("file", F.col("b.name").alias("map"), body.alias("x")).where("x.e <> ''").select("file", "map", "x.e", "x.h", F.explode("x.uses").alias("s"))
    used = each.where("s.e = e AND s.h = h").select("file", "map", "s.bus", "s.mode")
    return used.join(maps, ["file", "map"]).select("file", "bus", "mode", "event", "handler", "map")


def namespaces(texts: DataFrame, names: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, identifier, member, target, kind, specifier: members of exported objects that stand for an identifier, and
    where it is imported from (null if it isn't) (E20b). ``names`` as ``linking.import_names``."""
    each = texts.select(F.col(file).alias("file"), F.explode(bracketed(text, r"\bexport\s+const\s+([A-Za-z_$][\w$]*)\s*=\s*\{")).alias("b"))
    each = each.select("file", F.col("b.name").alias("identifier"), F.explode("b.parts").alias("p"))
    getter, plain = r"\bget\s+([A-Za-z_$][\w$]*)\s*\(\)\s*\{\s*return\s+([A-Za-z_$][\w$]*)\s*;?\s*\}$", r"^([A-Za-z_$][\w$]*)\s*:\s*([A-Za-z_$][\w$]*)$"
    kind = F.when(F.col("p").rlike(getter), "getter").when(F.col("p").rlike(plain), "property")
    part = lambda i: F.when(F.col("kind") == "getter", F.regexp_extract("p", getter, i)).otherwise(F.regexp_extract("p", plain, i))
    members = each.withColumn("kind", kind).where("kind IS NOT NULL").select("file", "identifier", part(1).alias("member"), part(2).alias("target"), "kind").distinct()
    sources = names.groupBy("file", F.col("identifier").alias("target")).agg(F.max("specifier").alias("specifier"))
    return members.join(sources, ["file", "target"], "left").select("file", "identifier", "member", "target", "kind", "specifier")


def field_types(texts: DataFrame, names: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, field, raw, base, specifier, via: types of fields by annotation, else by decorator (E20d, X28).

    Fields that begin with '_' are left out. ``specifier``: where the type is imported from; the engine's own name for
    its types and for decorated ones; else null.
    """
    member = r"(?m)^[ \t]*(?:@(?:property|type)\s*\(([^)]*)\)\s*)?(?:(?:public|private|protected|readonly|static)[ \t]+)*([A-Za-z$][\w$]*)[ \t]*[!?]?[ \t]*(?::[ \t]*([^=\n;]+?))?[ \t]*(?:=[^;\n]*)?;"
    # A member is cut into its parts once, before it is unnested, so that no filter on them cuts it again. Neither the name
    # nor what the decorator says holds a closing bracket.
    parts = F.transform(F.regexp_extract_all(text, F.lit(member), F.lit(0)), lambda m: F.split(F.regexp_replace(m, member, "$2)$1)$3"), r"\)", 3))
    each = texts.select(F.col(file).alias("file"), F.explode(parts).alias("m"))
    given, said = F.trim(F.col("m")[2]), F.trim(F.col("m")[1])
    decorated = F.when(said.startswith("{"), property_of(said, "type")).otherwise(said)
    raw = F.when(given != "", given).otherwise(decorated)
    found = each.select("file", F.col("m")[0].alias("field"), raw.alias("raw"), T.type_name(raw).alias("base"), F.when(given != "", "annotation").otherwise("decorator").alias("via")).where("raw <> '' AND field NOT IN ('return', 'case', 'default')")
    sources = names.groupBy("file", F.col("identifier").alias("base")).agg(F.max("specifier").alias("imported"))
    own = F.when(F.col("raw").startswith("cc.") | (F.col("via") == "decorator"), "cc")
    return found.distinct().join(sources, ["file", "base"], "left").select("file", "field", "raw", "base", F.coalesce("imported", own).alias("specifier"), "via")


def methods(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, method, params, line, body: functions, methods and callable variables, with their place in the file (E5,
    E6, S18). Comments hold none. A body that never closes gives none; a method inside another's body has a row of its own."""

    def run(found: pa.Array) -> pa.Array:
        return _methods(found)

    return texts.select(F.col(file).alias("file"), F.arrow_udf(run, METHOD).asNondeterministic()(text).alias("ms")).select("file", F.explode("ms").alias("m")).select("file", "m.*")


def method_calls(found: DataFrame, names: DataFrame, fields: DataFrame) -> DataFrame:
    """file, caller, callee, owner, kind, specifier, n: what methods call.

    A call is local if its file declares the name and it has no owner but 'this'; imported if its name or its first
    owner is imported; field if its owner is a typed field of the object; else unresolved. ``specifier`` is where
    the callee comes from, null for local and unresolved ones.
    """
    # Equal bodies are looked at once, and equal calls of a method are counted before they are joined.
    ops = found.select("body").distinct().select("body", operations("body").alias("os")).select("body", F.explode("os").alias("o")).where("o.type = 'method_call'").select("body", F.regexp_replace("o.target", "^global:", "").alias("t"))
    callee, owner = F.regexp_extract("t", r"([^.]*)$", 1), F.regexp_replace("t", r"\.?[^.]*$", "")
    ops = written(ops.select("body", callee.alias("callee"), owner.alias("owner")).groupBy("body", "callee", "owner").agg(F.count(F.lit(1)).alias("n")), "body-calls")
    calls = found.select("file", F.col("method").alias("caller"), "body").join(ops, "body").groupBy("file", "caller", "callee", "owner").agg(F.sum("n").alias("n"))
    calls = calls.withColumn("first", F.when(F.col("owner") == "", F.col("callee")).otherwise(F.split("owner", r"\.")[0])).withColumn("field", F.regexp_extract("owner", r"^this\.([^.]+)$", 1))
    own = found.select("file", F.col("method").alias("callee")).distinct().withColumn("declared", F.lit(True))
    imported = names.groupBy("file", F.col("identifier").alias("first")).agg(F.max("specifier").alias("by_import"))
    typed = fields.groupBy("file", "field").agg(F.max("specifier").alias("by_field"), F.lit(True).alias("typed"))
    c = calls.join(own, ["file", "callee"], "left").join(imported, ["file", "first"], "left").join(typed, ["file", "field"], "left")
    kind = F.when(F.col("declared") & F.col("owner").isin("", "this"), "local").when(F.col("by_import").isNotNull(), "imported").when(F.col("typed"), "field").otherwise("unresolved")
    c = c.withColumn("kind", kind)
    return c.select("file", "caller", "callee", "owner", "kind", F.when(F.col("kind") == "imported", F.col("by_import")).when(F.col("kind") == "field", F.col("by_field")).alias("specifier"), "n")


def method_graph(found: DataFrame, calls: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of methods (B1, B2, B5): a node for each method of a file, synthetic if only calls name it; an
    edge for each call that is local or whose specifier is a file. ``resolved`` as ``extract.resolved_imports``."""
    to = resolved.where("target IS NOT NULL").select("file", "specifier", "target")
    name = lambda file, method: F.concat_ws("#", file, method)
    c = calls.where("kind <> 'unresolved'").join(to, ["file", "specifier"], "left").withColumn("at", F.when(F.col("kind") == "local", F.col("file")).otherwise(F.col("target"))).where("at IS NOT NULL")
    edges = c.groupBy(name("file", "caller").alias("src"), name("at", "callee").alias("dst"), "kind").agg(F.sum("n").alias("n"))
    known = found.select(name("file", "method").alias("id"), F.lit(0).alias("synthetic")).union(edges.select("dst", F.lit(1)))
    return known.groupBy("id").agg((F.min("synthetic") == 1).alias("synthetic")), edges
