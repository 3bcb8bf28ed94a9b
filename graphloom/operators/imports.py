"""What imports mean under the configurations of a tree of projects, and which files a configuration scans.

Paths are relative to the workspace, with single slashes. Configurations are JSON that may hold comments; one that can't
be read says nothing. Everything is joins: of configurations with those they extend, of folders with the configurations
above them, and of candidate paths with the files.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import ignored
from ..sources.storage import written
from .extract import folded

#: Names of configurations, the one that holds first.
CONFIGS = ("tsconfig.json", "jsconfig.json")
#: Endings that an import may leave out, best first.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".vue", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
#: First folders of specifiers that begin at the workspace.
ROOTED = ("app", "src", "config", "types", "lib", "shared", "common", "utils", "services", "models", "components", "pages", "api", "db")
#: Folders of an area's root that are scanned, and for what.
KNOWN_ROOTS = (("component", "assets"), ("asset", "assets"), ("method", "assets"), ("method", "app"), ("method", "src"), ("method", "lib"), ("method", "server"))
#: Keys of a scan configuration, and what they list.
TARGET_KEYS = (("component", "componentRoots"), ("asset", "assetRoots"), ("method", "methodRoots"), ("method", "serverRoots"), ("method", "moduleRoots"), ("method", "dbRoots"), ("prefab", "prefabs"))

_JSON = {"allowComments": "true"}
_OPTIONS = "extends string, compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"


def folder(path: Column) -> Column:
    """The folder of a path; of one without a slash, the empty one."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def above(path: Column) -> Column:
    """Every folder that a path lies in, the empty one too."""
    parts = F.split(folder(path), "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))


def _beside(base: Column, path: Column) -> Column:
    """A relative path from a folder; one with a leading slash is from the workspace."""
    return folded(F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", base, path)))


def configurations(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """config, folder, base, patterns array<struct<alias, targets>>: the import configuration of each folder that has one,
    with what it inherits along its chain of ``extends`` (E3).

    ``base`` and ``patterns`` are each those of the nearest configuration of the chain that says them; a base is relative
    to the configuration that says it, and without any it is the folder of the one whose patterns hold. An ``extends``
    may leave out '.json'; one that names no file, and the rest of a circle, say nothing. The known part of a chain
    doubles with each join.
    """
    parsed = files.select(F.col(file).alias("config"), F.from_json(F.regexp_replace(text, "^\uFEFF", ""), _OPTIONS, _JSON).alias("o"))
    own = F.transform(F.map_entries("o.compilerOptions.paths"), lambda e: F.struct(F.trim(F.regexp_replace(e["key"], r"\\", "/")).alias("alias"), F.filter(F.transform(e["value"], lambda t: F.trim(F.regexp_replace(t, r"\\", "/"))), lambda t: t != "").alias("targets")))
    own = F.filter(own, lambda p: (p["alias"] != "") & (F.size(p["targets"]) > 0))
    at = folder(F.col("config"))
    up = F.when(F.coalesce(F.col("o.extends"), F.lit("")) != "", _beside(at, F.col("o.extends")))
    known = parsed.select("config", up.alias("up"), F.when(F.coalesce(F.col("o.compilerOptions.baseUrl"), F.lit("")) != "", _beside(at, F.col("o.compilerOptions.baseUrl"))).alias("base"), own.alias("patterns"), F.when(own.isNotNull(), at).alias("said_in"))
    # A name without its ending means the configuration of that name.
    names = known.select("config", F.explode(F.array("config", F.regexp_replace("config", r"\.json$", ""))).alias("up")).distinct()
    names = names.groupBy("up").agg(F.max("config").alias("parent"))
    known = written(known.join(names, "up", "left").select("config", F.col("parent").alias("up"), "base", "patterns", "said_in"), "configurations")
    for _ in range(ceil(log2(max(known.count(), 1))) + 1):
        if known.where("up IS NOT NULL AND (base IS NULL OR patterns IS NULL)").isEmpty():
            break
        parent = known.select(F.col("config").alias("up"), F.col("up").alias("next"), F.col("base").alias("base_"), F.col("patterns").alias("patterns_"), F.col("said_in").alias("said_in_"))
        known = written(known.join(parent, "up", "left").select("config", F.col("next").alias("up"), F.coalesce("base", "base_").alias("base"), F.coalesce("patterns", "patterns_").alias("patterns"), F.coalesce("said_in", "said_in_").alias("said_in")), "configurations")
    name = F.substring_index("config", "/", -1)
    place = F.coalesce(*[F.when(name == n, F.lit(i)) for i, n in enumerate(CONFIGS)])
    chosen = known.withColumn("folder", folder(F.col("config"))).withColumn("place", place).where("place IS NOT NULL")
    found = chosen.groupBy("folder").agg(F.min_by(F.struct("config", F.coalesce("base", "said_in", "folder").alias("base"), "patterns"), "place").alias("c"))
    return found.select("c.config", "folder", "c.base", F.coalesce("c.patterns", F.array().cast("array<struct<alias:string,targets:array<string>>>")).alias("patterns"))


def candidates(imports: DataFrame, configs: DataFrame, source_roots: tuple = ("src",), longest: bool = False) -> DataFrame:
    """file, specifier, place, base: what an import can mean, in order.

    A relative import means a path beside its file. Any other means, first, what the patterns of the nearest
    configuration above the file make of it, in the order they are written (``longest``: by the longest part before the
    star), each target in turn; then, after '@/' or '~/', a path below ``source_roots``; then, if its first folder is one
    of ``ROOTED``, a path of the workspace. A pattern's star takes what is between its two sides; a target without a star
    gets it as a further folder.
    """
    spec = F.regexp_replace("specifier", r"\\", "/")
    i = imports.select("file", "specifier").distinct().withColumn("spec", spec).withColumn("in", folder(F.col("file")))
    relative = F.col("spec").rlike(r"^\.\.?/")
    beside = i.where(relative).select("file", "specifier", F.lit(0).alias("place"), _beside(F.col("in"), F.col("spec")).alias("base"))
    i = i.where(~relative)
    # Folders are far fewer than files; each meets the configurations above it by equality.
    nearest = i.select("in").distinct().select("in", F.explode(above(F.concat_ws("/", F.nullif("in", F.lit("")), F.lit("x")))).alias("folder")).join(configs.select("folder", "base", "patterns"), "folder")
    nearest = nearest.groupBy("in").agg(F.max_by(F.struct("base", "patterns"), F.length("folder")).alias("c"))
    p = i.join(nearest, "in").select("file", "specifier", "spec", F.col("c.base").alias("from"), F.posexplode("c.patterns").alias("n", "p"))
    star = F.instr("p.alias", "*")
    before, after = F.when(star > 0, F.substring(F.col("p.alias"), F.lit(1), star - 1)).otherwise(F.col("p.alias")), F.when(star > 0, F.substring(F.col("p.alias"), star + 1, F.length("p.alias"))).otherwise("")
    p = p.select("file", "specifier", "spec", "from", "n", F.col("p.targets").alias("targets"), before.alias("before"), after.alias("after"), (star > 0).alias("star"))
    p = p.where(F.when(F.col("star"), F.startswith("spec", "before") & F.endswith("spec", "after")).otherwise(F.col("spec") == F.col("before")))
    wild = F.when(F.col("star"), F.substring(F.col("spec"), F.length("before") + 1, F.greatest(F.length("spec") - F.length("before") - F.length("after"), F.lit(0)))).otherwise("")
    order = (F.lit(10_000) - F.length("before") if longest else F.col("n")) * 1000
    p = p.select("file", "specifier", "from", wild.alias("wild"), order.alias("order"), F.posexplode("targets").alias("t", "target"))
    put = F.when(F.contains("target", F.lit("*")), F.replace("target", F.lit("*"), F.col("wild"))).when(F.col("wild") != "", F.concat_ws("/", "target", "wild")).otherwise(F.col("target"))
    by_pattern = p.select("file", "specifier", (1 + F.col("order") + F.col("t")).alias("place"), _beside(F.col("from"), put).alias("base"))
    late = 100_000_000
    roots = F.posexplode(F.array(*[F.lit(r) for r in source_roots])).alias("n", "root")
    marked = i.where(F.col("spec").rlike("^[@~]/")).select("file", "specifier", F.substring("spec", 3, 1 << 20).alias("rest"), roots).select("file", "specifier", (late + F.col("n")).alias("place"), _beside(F.col("root"), F.col("rest")).alias("base"))
    rooted = i.where(F.col("spec").rlike(rf"^({'|'.join(ROOTED)})/")).select("file", "specifier", F.lit(2 * late).alias("place"), folded(F.col("spec")).alias("base"))
    return beside.unionByName(by_pattern).unionByName(marked).unionByName(rooted)


def resolved(imports: DataFrame, configs: DataFrame, files: DataFrame, file: str = "file", **options) -> DataFrame:
    """file, specifier, target (null if none): the first candidate, with the first ending, that is a file."""
    ends = F.posexplode(F.array(*[F.lit(s) for s in SUFFIXES])).alias("ending", "end")
    c = candidates(imports, configs, **options).select("file", "specifier", "place", "base", ends).withColumn("target", F.concat("base", "end"))
    hits = c.join(files.select(F.col(file).alias("target")).distinct(), "target").groupBy("file", "specifier").agg(F.min_by("target", F.struct("place", "ending")).alias("target"))
    return imports.select("file", "specifier").distinct().join(hits, ["file", "specifier"], "left")


def _listed(c: Column) -> Column:
    """JSON of a value or of an array as an array of texts; nothing is an empty one."""
    c = F.trim(c)
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c != "", F.array(F.regexp_replace(c, '^"|"$', ""))), none)


def targets(configs: DataFrame, config: str = "config", text: str = "text") -> DataFrame:
    """config, kind, target: what a scan configuration lists (S3): components, assets, methods and prefabs, by its own keys
    and by those of ``scanTargets``, of which all but components and assets are methods."""
    key = lambda k: _listed(F.get_json_object(text, f"$.{k}"))
    of_kind = lambda kind, values: F.transform(values, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))
    own = F.flatten(F.array(*[of_kind(kind, key(k)) for kind, k in TARGET_KEYS]))
    kind = lambda k: F.when(k.rlike("(?i)^components?$"), "component").when(k.rlike("(?i)^assets?$"), "asset").otherwise("method")
    more = F.flatten(F.transform(F.map_entries(F.from_json(F.get_json_object(text, "$.scanTargets"), "map<string,string>")), lambda e: F.transform(_listed(e["value"]), lambda t: F.struct(kind(e["key"]).alias("kind"), t.alias("target")))))
    none = F.array().cast("array<struct<kind:string,target:string>>")
    found = configs.select(F.col(config).alias("config"), F.explode(F.concat(own, F.coalesce(more, none))).alias("t")).select("config", "t.kind", folded(F.trim("t.target")).alias("target"))
    return found.where("target <> ''").distinct()


def expanded(listed: DataFrame, files: DataFrame, file: str = "file") -> DataFrame:
    """config, kind, path: the files and folders that targets (``targets``) mean (S2, S3). Without prefabs of its own a
    configuration has those below its assets.

    A target is a path that is there, or has wildcards in its parts; '**' is any number of folders. Ignored folders are
    left out. Targets meet paths by the part before their first wildcard.
    """
    f = files.select(F.col(file).alias("file")).distinct().where(~ignored(F.col("file")))
    paths = f.select(F.col("file").alias("path")).union(f.select(F.explode(above(F.col("file"))).alias("path")).where("path <> ''")).distinct()
    wild = F.col("target").rlike(r"[*?\[]")
    plain = listed.where(~wild).join(paths, listed["target"] == paths["path"]).select("config", "kind", "path")
    fixed = F.regexp_replace(F.regexp_extract("target", r"^([^*?\[]*)", 1), r"/?[^/]*$", "")
    globs = listed.where(wild).withColumn("start", fixed).withColumn("pattern", T.glob_column(F.col("target")))
    below = paths.select("path", F.explode(above(F.col("path"))).alias("start"))
    found = globs.join(below, "start").where(F.regexp_like("path", F.col("pattern"))).select("config", "kind", "path")
    found = plain.union(found).distinct()
    named = listed.where("kind = 'prefab'").select("config").distinct()
    assets = found.where("kind = 'asset'").join(named, "config", "left_anti").select("config", F.col("path").alias("start"))
    seen = below.where(F.endswith("path", F.lit(".prefab"))).union(paths.where(F.endswith("path", F.lit(".prefab"))).select("path", F.col("path").alias("start")))
    return found.union(assets.join(seen, "start").select("config", F.lit("prefab"), "path").distinct())


def scan_roots(areas: DataFrame, files: DataFrame, file: str = "file", excluded: tuple = ()) -> DataFrame:
    """area, kind, path: the folders of an area's roots (area, root) that a build scans (S4): the known ones that are
    there, a glob for prefabs below assets, and else the root itself. Roots below ``excluded`` folders and ignored ones
    are left out."""
    there = files.select(F.explode(above(F.col(file))).alias("path")).where("path <> ''").distinct()
    left_out = ignored(F.col("path"))
    for e in excluded:
        left_out = left_out | (F.col("path") == e) | F.startswith("path", F.lit(e + "/"))
    roots = areas.select("area", folded(F.col("root")).alias("root")).distinct()
    probes = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, n in KNOWN_ROOTS])).alias("p")
    known = roots.select("area", "root", probes).select("area", "root", "p.kind", F.concat_ws("/", F.nullif("root", F.lit("")), "p.name").alias("path"))
    # A folder of assets counts as known even if it is left out.
    known = known.join(there, "path", "left_semi").select("area", "root", "kind", "path")
    prefabs = known.where("kind = 'asset'").select("area", "root", F.lit("prefab").alias("kind"), F.concat("path", F.lit("/**/*.prefab")).alias("path"))
    kept = known.where(~left_out).unionByName(prefabs)
    bare = roots.join(kept.select("area", "root").distinct(), ["area", "root"], "left_anti").select("area", "root", F.lit("method").alias("kind"), F.col("root").alias("path"))
    bare = bare.join(there, "path", "left_semi").where(~left_out).select("area", "root", "kind", "path")
    return kept.unionByName(bare).select("area", "kind", "path").distinct()
