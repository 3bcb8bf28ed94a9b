"""Tokens, methods, operations, calls, states and subscriptions of short programs."""

import itertools

import pytest
from test_queries import spark  # noqa: F401

from graphloom.operators import lexing as X
from graphloom.operators import members as M


def texts(spark, *programs):
    return spark.createDataFrame([(f"f{i}", p) for i, p in enumerate(programs)], "file string, text string")


def methods(spark, program):
    return [(r.method, r.form, r.params, r.line, r.body.strip()) for r in X.methods(texts(spark, program)).orderBy("at").collect()]


@pytest.mark.parametrize(
    ("program", "want"),
    [
        ("a() { const r = /[{(]/; }\nb() { return 1; }", [("a", "declared", "", 1, "const r = /[{(]/;"), ("b", "declared", "", 2, "return 1;")]),
        ("const f = x => { go(x) }", [("f", "arrow", "x", 1, "go(x)")]),
        ("async go<T>(x: T): Promise<{a:number}> { return 1 }", [("go", "declared", "x: T", 1, "return 1")]),
        ("const h = async (x) => g(x)\nconst z = 1", [("h", "arrow", "x", 1, "g(x)")]),
        ("const k: Fn<A, B> = (a, b = {}) => a + b;", [("k", "arrow", "a, b = {}", 1, "a + b")]),
        ("class A { x = 1; run = async <T,>(p: T) => { this.x += 2; }; get v() { return `a${b(1)}c`; } static mk(): A { return new A(); } }", [("run", "arrow", "p: T", 1, "this.x += 2;"), ("v", "declared", "", 1, "return `a${b(1)}c`;"), ("mk", "declared", "", 1, "return new A();")]),
        ("export const api = { load(x) { return 1 / 2 / x; }, save: function () { s(); }, t: y => y.z() };", [("load", "declared", "x", 1, "return 1 / 2 / x;"), ("save", "function", "", 1, "s();"), ("t", "arrow", "y", 1, "y.z()")]),
        ("function top(a: number[]): void {\n  if (a) return;\n}\ndeclare function no(x: {a: 1}): void;", [("top", "declared", "a: number[]", 1, "if (a) return;")]),
        ("cond ? f(1) : { a: 1 };\n// no() { }\nlet s = '() => {', t = `m() { ${x ? `y` : '}'} `;\nok() { }", [("ok", "declared", "", 4, "")]),
        ("a(( { b", []),
        ("m() { n() { ", [("m", "declared", "", 1, "n() {"), ("n", "declared", "", 1, "")]),
        ("", []),
    ],
)
def test_methods(spark, program, want):  # noqa: F811
    assert methods(spark, program) == want


def operations(spark, program):
    found = X.operations(texts(spark, program)).orderBy("at", "type").collect()
    return [(r.type, r.target, r.method, r.detail, r.flag, r.times) for r in found]


@pytest.mark.parametrize(
    ("program", "want"),
    [
        ("return data.filter(x => x > 0);", [("return", "", "", "data.filter(x => x > 0)", False, 1), ("filter", "data", "filter", "x => x > 0", False, 1)]),
        ("if (!x) {\n return null;\n }\n if (y) { a = 1; return; }", [("condition", "", "", "!x", True, 1), ("return", "", "", "null", False, 1), ("condition", "", "", "y", False, 1), ("assignment", "a", "", "1", False, 1), ("return", "", "", "", False, 1)]),
        ("this.service.fetchData();", [("method_call", "this.service", "fetchData", "", False, 2)]),
        ("a.b?.c(1); x += 2; new Foo(1); new Foo(2).bar(3);", [("method_call", "a.b", "c", "1", False, 2), ("method_call", "Foo(2)", "bar", "3", False, 1)]),
        ("do { q(); } while (z);\nwhile (w) { }\nfor (const k in o) { }\nfor await (const v of s.t()) { }", [("method_call", "global", "q", "", False, 2), ("loop", "", "while", "", False, 1), ("loop", "o", "for_in", "", False, 1), ("loop", "s.t()", "for_of", "", False, 1), ("method_call", "s", "t", "", False, 1)]),
        ("const x = this.get(), y = 2; let z = x ?? d;\nconst { p } = z;", [("multi_assignment", "", "", "", False, 1), ("method_call", "this", "get", "", False, 1), ("assignment", "z", "", "x ?? d", True, 1), ("multi_assignment", "", "", "", False, 1)]),
        ("const re = /if (a) { b( }/g, s = 'c(1)'; // d()\nlist.map(f)", [("multi_assignment", "", "", "", False, 1), ("map", "list", "map", "f", False, 2)]),
        ("call<T>(a); if (a < b && c > (d)) { }", [("method_call", "global", "call", "a", False, 2), ("condition", "", "", "a < b && c > (d)", False, 1)]),
        ("class Q { f = 1; m(): void { this.f = 2; } }", [("assignment", "this.f", "", "2", False, 1)]),
    ],
)
def test_operations(spark, program, want):  # noqa: F811
    assert operations(spark, program) == want


def test_summaries(spark):  # noqa: F811
    found = {r.file: (r.branches, r.loops, r.calls, r.flows, r.complexity) for r in X.summaries(texts(spark, "return 1;", "if (x > 0) { return 1; } for (let i = 0; i < 10; i++) { console.log(i); }", "const filtered = data.filter(x => x > 0); return filtered;")).collect()}
    assert found == {"f0": (0, 0, 0, 0, "low"), "f1": (1, 1, 2, 0, "medium"), "f2": (0, 0, 0, 2, "low")}


def test_calls_keep_which_lookup_decided(spark):  # noqa: F811
    m = X.methods(texts(spark, "class A { run() { this.go(); Net.send(1); this.api.load(); console.log(2); window.svc.x(); known.y(); other.z(); bare(); } go() { } }"))
    names = spark.createDataFrame([("f0", "Net", "./net")], "file string, identifier string, specifier string")
    fields = spark.createDataFrame([("f0", "api", "./api")], "file string, field string, specifier string")
    known = spark.createDataFrame([("f0", "known", "y")], "file string, identifier string, member string")
    got = {r.callee: (r.owner, r.kind, r.decided, r.reason, r.specifier) for r in M.calls(m, names, fields, known).collect()}
    assert got == {
        "go": ("this", "local", "local", "", None), "send": ("Net", "imported", "imported", "", "./net"), "load": ("this.api", "field", "field", "", "./api"), "log": ("console", "ignored", "built-in", "", None),
        "x": ("window.svc", "unresolved", "none", "dynamic_global_service", None), "y": ("known", "suppressed", "signature", "", None), "z": ("other", "unresolved", "none", "owner_not_resolved_or_external_client", None), "bare": ("", "ignored", "built-in", "", None),
    }


def test_states(spark):  # noqa: F811
    m = X.methods(texts(spark, "class A { run() { this.a = this.b.c; this.d?.push(1); ++this.n; this.m--; if (this.e === 1) { this.go(); } this.typed.x = 1; const s = 'this.no'; this.f += this.g[0]; } go() { } }"))
    fields = spark.createDataFrame([("f0", "typed", "./t"), ("f0", "d", None)], "file string, field string, specifier string")
    got = {(r.state, r.access) for r in M.state_accesses(m, fields).where("method = 'run'").collect()}
    written = {"a", "d", "n", "m", "f"}
    assert got == {(s, "write") for s in written} | {(s, "read") for s in written | {"b.c", "e", "g"}}


def test_union_of_two_passes(spark):  # noqa: F811
    program = "eventBus.on('a', this.x);\neventBus\n .once(\"b\", m => { eventBus.on('a', y); });\n// eventBus.on('c', z)\nthis.ui.director.on(EV.D, function () { })"
    got = {(r.bus, r.mode, r.event, r.handler, r.via, r.n) for r in M.subscriptions(texts(spark, program)).collect()}
    assert got == {("eventBus", "on", "a", "x", "tokens", 1), ("eventBus", "once", "b", "", "tokens", 1), ("eventBus", "on", "a", "y", "tokens", 1), ("eventBus", "on", "c", "z", "pattern", 1), ("director", "on", "EV.D", "", "tokens", 1)}


def test_merged_by_overlap(spark):  # noqa: F811
    schema = "file string, k string, at long, until long, via string"
    a = spark.createDataFrame([("f", "x", 10, 2000, "a"), ("f", "y", 0, 5, "a")], schema)
    b = spark.createDataFrame([("f", "x", 1999, 2005, "b"), ("f", "x", 2000, 2005, "b"), ("f", "y", 700, 705, "b"), ("g", "x", 10, 20, "b")], schema)
    got = {(r.file, r.k, r.at, r.via) for r in M.merged(a, b, ("file", "k")).collect()}
    assert got == {("f", "x", 10, "a"), ("f", "y", 0, "a"), ("f", "x", 2000, "b"), ("f", "y", 700, "b"), ("g", "x", 10, "b")}


def test_places_of_matches(spark):  # noqa: F811
    t = texts(spark, "ab--abab", "", None, "x")
    assert {(r.file, r.hit, r.at, r.until) for r in M.located(t, "ab").collect()} == {("f0", "ab", 0, 2), ("f0", "ab", 4, 6), ("f0", "ab", 6, 8)}


def test_equal_texts_are_looked_at_once(spark):  # noqa: F811
    seen = []

    def of(t, file, text):
        seen.append(t.count())
        return t.select(file, text)

    found = X.once(texts(spark, "a()", "a()", "b()", "", None), "file", "text", of)
    assert seen == [2] and sorted((r.file, r.text) for r in found.collect()) == [("f0", "a()"), ("f1", "a()"), ("f2", "b()")]


MEMBERS = ["  a(x) {\n    if (x) { return; }\n  }\n", "  b = (y) => y + 1\n", "  /* c() { } */\n  c<T extends {a: 1}>(z: T): Promise<{a: 1}> { go(); }\n", "  f: F;\n"]


def test_equal_pieces_are_looked_at_once(spark, monkeypatch):  # noqa: F811
    """Classes of the same members in any order make a piece for each member; their methods keep their places."""
    programs = ["import { B } from './b';\nclass A extends B {\n" + "".join(p) + end for p in itertools.permutations(MEMBERS) for end in ("}\n", "")]
    seen, of = [], X._of_pieces
    monkeypatch.setattr(X, "_of_pieces", lambda p: seen.append(p.count()) or of(p))
    t = texts(spark, *programs)
    found = X.methods(t).collect()
    assert seen == [8] and len(found) == 3 * len(programs)
    for r in found:
        text = programs[int(r.file[1:])]
        assert r.body == text[r.at : r.until] and r.line == text[: text.index(f"  {r.method}{'<' if r.method == 'c' else ' ' if r.method == 'b' else '('}")].count("\n") + 1


def test_pieces_that_hang_together_are_not_cut(spark):  # noqa: F811
    """What a token, a bracket or a head goes on from one line to the next is found as in the whole text."""
    programs = [
        "class A {\n  t = `a\n  b(x) { }\n`;\n  c() { }\n}\n", "class A {\n  /* a\n  b(x) { }\n*/\n  c() { }\n}\n", "class A {\n  foo(a): void\n  bar() { a(); }\n}\n", "class A {\n  z: {a: 1}\n  y = x => { w(); }\n}\n", "function f(a);\nb(c) { d(); }\n",
        "x = (a) =>\n  b + c\nd(e) { }\n", "a < b\nc<T>(x) { y(); }\n", "x = async\n  y => z\n", "f(a) {\n  g(b) { c(); }\n}\nh() { }\n", "}\n}\nf(a) {\n  g(b) { c(); }\n", "q = \"a\\\n  b(x) { }\";\nc() { }\n", "x = `a ${ `b\n  c(x) { } ` } d`;\ne() { }\n",
    ]
    t = texts(spark, *programs)
    told = lambda df: sorted(tuple(r) for r in df.select("file", "method", "form", "params", "line", "body", "at", "until").collect())
    assert told(X.methods(t)) == told(X._of_texts(X._dealt(t, "file", "text")))


def test_calls_of_equal_pieces_are_found_once(spark, monkeypatch):  # noqa: F811
    """Scripts of the same statements make a piece for each; calls keep their places, and what hangs together is not cut."""
    lines = ["a.b(1);\n", "// c(2);\n", "d\n  .e(\"x\", () => { f(3); });\n"]
    programs = ["".join(p) for p in itertools.permutations(lines)]
    seen, of = [], X._operations
    monkeypatch.setattr(X, "_operations", lambda t, f, c: seen.append(t.count()) or of(t, f, c))
    odd = ["g(\n1);\n", "h\n  (2)\ni(3);\n", "t = `a;\nj(4);\n`;\nk(5);\n", "class A {\nl(6);\n}\n"]
    t = texts(spark, *programs, *odd)
    told = lambda df: sorted(tuple(r) for r in df.where("type = 'method_call'").select("file", "target", "method", "detail", "flag", "times", "line", "at", "until", "arguments").collect())
    assert told(X.calls(t)) == told(X.once(t, "file", "text", of))
    X.calls(texts(spark, *programs)).count()
    assert seen[-1] == len(lines)
