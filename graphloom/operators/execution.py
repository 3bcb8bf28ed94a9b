"""Gates, scopes and reviews of changes, and rules learned from outcomes. All decide many tasks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Signals that keep a change from being small, and top folders of which two make it broad.
HARD = ("api", "data", "auth", "external-service", "cross-module")
BROAD_ROOTS = ("app", "src", "lib", "server", "client", "components", "assets", "prisma")
#: What a critical file must be like to be expected in a change.
EXPECTED = r"api|route|prisma|lib/api-client|settings|chat"
#: Category, tags, pattern of the text and pattern of the files of each inferred rule; none: not asked.
RULES = (
    ("oauth", ("facebook", "oauth", "token"), r"facebook|oauth|graph", r"facebook/oauth"),
    ("security", ("auth", "token", "security"), r"token|auth|session|jwt|secret|encrypt|decrypt", r"auth|token|session"),
    ("data", ("prisma", "database"), r"prisma|database|schema|db", r"prisma|schema\.prisma|db"),
    ("api", ("api", "fullstack"), None, r"(?:^|/)app/api/"),
)


def _files():
    return F.coalesce("files", F.array().cast("array<string>"))


def gated(tasks: DataFrame) -> DataFrame:
    """Adds signals, cross_root and decision to tasks (id, task, files array).

    No task and no files: required. One to four files of user interfaces only, without a hard signal: may be skipped. A
    signal, an API or data file, two broad roots or no files: required. Else recommended. Nulls are as empty.
    """
    files, task = _files(), F.coalesce("task", F.lit(""))
    found = T.signals(F.concat_ws(" ", task, F.array_join(files, " ")))
    kind = F.transform(files, T.file_class)
    sources = F.filter(kind, lambda k: k["source"])
    ui = (F.size(sources) > 0) & F.forall(sources, lambda k: k["ui"])
    api, data = F.exists(kind, lambda k: k["api"]), F.exists(kind, lambda k: k["data"])
    roots = F.array_distinct(F.transform(files, lambda f: F.split(F.lower(F.regexp_replace(f, "^/+", "")), "/")[0]))
    cross = (F.size(roots) > 1) & (F.size(F.filter(roots, lambda r: r.isin(*BROAD_ROOTS))) > 1)
    hard = F.arrays_overlap(found, F.array(*[F.lit(h) for h in HARD]))
    small = F.size(files).between(1, 4) & ui & ~api & ~data & ~hard
    nothing = (F.trim(task) == "") & (F.size(files) == 0)
    decision = F.when(nothing, "required").when(small, "optional_skip_allowed").when((F.size(found) > 0) | api | data | cross | (F.size(files) == 0), "required").otherwise("recommended")
    return tasks.withColumn("signals", found).withColumn("cross_root", cross).withColumn("decision", decision)


def within_boundary(changes: DataFrame, boundary: DataFrame) -> DataFrame:
    """Changes (id, file) with ``within``: the file is, or ends like, a primary file of its task, or lies below a
    related root (F23). ``boundary``: id, primary array, roots array."""
    # Roots are made comparable once for a task, not for each of its changes.
    roots = F.filter(F.transform("roots", lambda r: F.regexp_replace(T.normal(r), "/+$", "")), lambda r: r.isNull() | (r != ""))
    joined = changes.join(boundary.select("id", "primary", roots.alias("roots")), "id", "left")
    primary, roots = (F.coalesce(c, F.array().cast("array<string>")) for c in ("primary", "roots"))
    below = F.exists(F.array(T.normal(F.col("file"))), lambda f: F.exists(roots, lambda r: (f == r) | F.startswith(f, F.concat(r, F.lit("/")))))
    hit = F.exists(primary, lambda p: T.ends_like(F.col("file"), p)) | below
    return joined.select("id", "file", hit.alias("within"))


def validate(tasks: DataFrame, changes: DataFrame, boundary: DataFrame, critical: DataFrame) -> DataFrame:
    """id, decision, outside, risky, missing, verdict of each task.

    ``changes``: id, file; ``critical``: id, file. A changed file is risky by a hard signal, or by commerce where the
    task may not be skipped; a critical file is missing if it is of an expected kind and not changed, whatever the case.
    A task without boundary has no context: 'pmm_context_unavailable' where context is required.
    """
    gate = gated(tasks).select("id", "decision")
    # Changes move once: repeats are dropped, and boundaries and gates joined, where a task's changes are. A change's signals
    # are found once.
    once = changes.select("id", "file").repartition("id").distinct()
    risk = F.transform(F.array(T.signals(F.col("file"))), lambda s: F.when(F.size(F.array_remove(s, "commerce")) > 0, 2).when(F.array_contains(s, "commerce"), 1).otherwise(0))[0]
    c = within_boundary(once, boundary).withColumn("risk", risk).join(gate, "id")
    per = c.groupBy("id").agg(F.count_if(~F.col("within")).alias("outside"), F.count_if((F.col("risk") == 2) | ((F.col("risk") == 1) & (F.col("decision") != "optional_skip_allowed"))).alias("risky"))
    # Only a file of an expected kind can be one of these.
    of = lambda files: files.where(F.lower("file").rlike(EXPECTED)).select("id", T.normal(F.col("file")).alias("f"))
    gone = of(critical).distinct().join(of(changes), ["id", "f"], "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("missing"))
    known = boundary.select("id", F.lit(True).alias("known")).distinct()
    joined = gate.join(per, "id", "left").join(gone, "id", "left").join(known, "id", "left")
    n = lambda x: F.coalesce(x, F.lit(0))
    deep = F.col("decision") == "required"
    verdict = F.when(F.col("known").isNull() & deep, "pmm_context_unavailable").when((n("outside") > 0) | (n("risky") > 0), "scope_review_needed").when((n("missing") > 0) & deep, "possibly_incomplete").otherwise("within_scope")
    return joined.select("id", "decision", n("outside").alias("outside"), n("risky").alias("risky"), n("missing").alias("missing"), verdict.alias("verdict"))


def reviewed(scopes: DataFrame) -> DataFrame:
    """id, findings, verdict of scopes (id, verdict, risk, rebuild): a finding outside the scope, at high risk, and
    where the graph must be rebuilt; any high one asks for changes (R16)."""
    finding = lambda severity, about: F.struct(F.lit(severity).alias("severity"), F.lit(about).alias("about"))
    scope = F.when(F.col("verdict") == "pmm_context_unavailable", finding("high", "scope")).when(F.col("verdict") != "within_scope", finding("medium", "scope"))
    found = F.array_compact(F.array(scope, F.when(F.col("risk") == "high", finding("high", "risk")), F.when(F.col("rebuild"), finding("low", "rebuild"))))
    return scopes.select("id", found.alias("findings"), F.when(F.exists(found, lambda x: x["severity"] == "high"), "changes_requested").otherwise("review_ready").alias("verdict"))


def inferred_rules(outcomes: DataFrame) -> DataFrame:
    """id, category, tags, files: the rules that outcomes (id, text, files array) suggest."""
    text, files = F.lower(F.coalesce("text", F.lit(""))), _files()
    named = lambda pattern: F.exists(files, lambda f: F.lower(f).rlike(pattern))
    found = []
    for category, tags, of_text, of_files in RULES:
        hit = named(of_files)
        if of_text:
            hit = hit | text.rlike(of_text)
        found.append(F.when(hit, F.struct(F.lit(category).alias("category"), F.array(*[F.lit(t) for t in tags]).alias("tags"))))
    return outcomes.select("id", F.explode(F.array_compact(F.array(*found))).alias("r"), files.alias("files")).select("id", "r.*", "files")


def plan(tasks: DataFrame) -> DataFrame:
    """id, place, step: what to do for each gated task, in order."""
    d = F.col("decision")
    steps = F.array_compact(
        F.array(
            F.when(d != "optional_skip_allowed", "prepare-context"), F.when(F.array_contains("signals", "api"), "check-endpoints"), F.when(F.array_contains("signals", "data"), "check-tables"),
            F.when(F.array_contains("signals", "auth"), "check-credentials"), F.when(F.array_contains("signals", "external-service"), "check-services"), F.lit("edit"), F.lit("validate-scope"), F.when(d == "required", "review-patch"),
        )
    )
    return tasks.select("id", F.posexplode(steps).alias("place", "step"))


def brief(gates: DataFrame, steps: DataFrame, scopes: DataFrame, recalled: DataFrame) -> DataFrame:
    """id, section, place, text: gate, plan, scope and recalled records of each task in one table.

    ``recalled``: id, place, text.
    """
    one = lambda df, section, text: df.select("id", F.lit(section).alias("section"), F.lit(0).alias("place"), text.alias("text"))
    parts = one(gates, "gate", F.col("decision")).union(steps.select("id", F.lit("plan"), "place", "step")).union(one(scopes, "scope", F.col("verdict")))
    return parts.union(recalled.select("id", F.lit("memory"), "place", "text"))


def health(checks: DataFrame) -> DataFrame:
    """id, fail, warn, score, status of checks (id, check, result) (A17, V8, V7): 100 less 30 a failure, 10 a warning."""
    g = checks.groupBy("id").agg(F.count_if(F.col("result") == "fail").alias("fail"), F.count_if(F.col("result") == "warn").alias("warn"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - 30 * F.col("fail") - 10 * F.col("warn")))
    return g.withColumn("score", score).withColumn("status", F.when(F.col("fail") > 0, "blocked").when(F.col("warn") > 0, "needs_action").otherwise("ready"))


#: Actions in order of priority; without any, the work proceeds.
ACTIONS = ("restart_codex_mcp", "init_workspace", "register_workspace", "rebuild_project_kb", "reinstall_skill")


def next_actions(needed: DataFrame) -> DataFrame:
    """id, action: the first of the actions (id, action) that a workspace needs (V9)."""
    place = F.coalesce(*[F.when(F.col("action") == a, i) for i, a in enumerate(ACTIONS)], F.lit(len(ACTIONS)))
    return needed.groupBy("id").agg(F.min_by(F.when(place < len(ACTIONS), F.col("action")).otherwise("proceed"), place).alias("action"))


def resolve_workspace(known: DataFrame, asked: DataFrame) -> DataFrame:
    """ask, id, score, ambiguous of the best matches.

    ``known``: id, hash, root, remote, name; ``asked``: ask, hash, root, remote, name and id under ``want``. The hash or
    root counts 100, the id 80, the remote 60, the name 50, a part of it 25. Each kind of match is a join by its key;
    a part of a name is looked up only among names that share their first word.
    """
    word = lambda c: F.try_element_at(T.words(F.lower(c)), F.lit(1))
    k = known.select("id", "hash", "root", "remote", "name", word(F.col("name")).alias("word"))
    hits = None
    for mine, theirs, points in (("hash", "hash", 100), ("root", "root", 100), ("want", "id", 80), ("remote", "remote", 60), ("name", "name", 50)):
        own = "root" if mine in ("hash", "root") else mine
        h = asked.select("ask", F.col(mine).alias("key")).where("key <> ''").join(k.select(F.col(theirs).alias("key"), "id"), "key").select("ask", "id", F.lit(own).alias("kind"), F.lit(points).alias("points"))
        hits = h if hits is None else hits.union(h)
    part = asked.select("ask", F.col("name").alias("n"), word(F.col("name")).alias("word")).where("n <> ''").join(k.select("id", "name", "word"), "word").where((F.col("n") != F.col("name")) & T.normal(F.col("name")).contains(T.normal(F.col("n"))))
    hits = hits.union(part.select("ask", "id", F.lit("name"), F.lit(25))).groupBy("ask", "id", "kind").agg(F.max("points").alias("points")).groupBy("ask", "id").agg(F.sum("points").alias("score"))
    best = hits.groupBy("ask").agg(F.max("score").alias("score"))
    top = hits.join(best, ["ask", "score"])
    n = top.groupBy("ask").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    return top.join(n, "ask").select("ask", "id", "score", "ambiguous")
