"""Prefab trees: a JSON array of objects that name each other by place, as tables of nodes, components and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import written
from .graph import node_paths

#: Digits of the short form of a script's id.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Fields of a component that are no bindings.
OWN_FIELDS = ("__type__", "_name", "_objFlags", "__editorExtras__", "node", "_enabled", "__prefab", "_id", "_parent", "_children", "_components", "_prefab")


def short_id(uuid: Column) -> Column:
    """A script's id as components name it: five hex digits, then two digits of 64 for each three of the rest."""
    hexa = F.lower(F.regexp_replace(uuid, "-", ""))
    digit = lambda n: F.substring(F.lit(DIGITS), n + 1, F.lit(1))
    pair = lambda i: F.conv(F.substring(hexa, 6 + 3 * i, F.lit(3)), 16, 10).cast("int")
    rest = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.concat(digit(F.shiftright(pair(i), 6)), digit(pair(i).bitwiseAND(F.lit(63)))))
    return F.when(F.length(hexa) == 32, F.concat(F.left(hexa, F.lit(5)), F.array_join(rest, ""))).otherwise(uuid)


def catalog(files: DataFrame) -> DataFrame:
    """path, uuid, kind, short of files whose .meta (path, text) gives a uuid (S8, S9, S10): script, prefab or asset."""
    path = F.regexp_replace("path", r"\.meta$", "")
    kind = F.when(path.rlike(r"\.(ts|js)$") & ~path.endswith(".d.ts"), "script").when(path.endswith(".prefab"), "prefab").otherwise("asset")
    uuid = F.get_json_object("text", "$.uuid")
    return files.where(F.col("path").endswith(".meta")).select(path.alias("path"), uuid.alias("uuid"), kind.alias("kind"), short_id(uuid).alias("short")).where("uuid IS NOT NULL")


def objects(prefabs: DataFrame) -> DataFrame:
    """file, place, type, name, parent, node, fields (map to JSON) of each object of prefabs (file, text).

    A text that is no JSON array gives none. Each text is parsed once: the objects are written to shared storage, and
    who needs no fields does not read them.
    """
    each = prefabs.select("file", F.posexplode(F.from_json("text", "array<map<string,string>>")).alias("place", "fields"))
    get = lambda k: F.try_element_at("fields", F.lit(k))
    ref = lambda k: F.regexp_extract(F.coalesce(get(k), F.lit("")), r'"__id__"\s*:\s*(\d+)', 1).try_cast("int")
    return written(each.select("file", "place", get("__type__").alias("type"), F.coalesce(get("_name"), F.lit("")).alias("name"), ref("_parent").alias("parent"), ref("node").alias("node"), "fields"), "prefab-objects")


def tree(found: DataFrame) -> DataFrame:
    """file, place, path, depth of the node objects."""
    nodes = found.where("type = 'cc.Node'").select("file", F.col("place").alias("id"), "parent", "name")
    return node_paths(nodes, ("file",)).select("file", F.col("id").alias("place"), "path", "depth")


def components(found: DataFrame, scripts: DataFrame) -> DataFrame:
    """file, place, node, path, type, script, class of the component objects.

    ``scripts``: a catalog; a component names its script by its short id or its class.
    """
    names = scripts.where("kind = 'script'").select(F.col("short").alias("type"), F.col("path").alias("script"))
    paths = tree(found).select("file", F.col("place").alias("node"), "path")
    c = found.where("node IS NOT NULL AND type <> 'cc.Node'").select("file", "place", "node", "type").join(names, "type", "left").join(paths, ["file", "node"], "left")
    kind = T.component_class(F.col("type"), F.col("type"), F.coalesce("script", F.lit("")), F.col("file"))
    return c.select("file", "place", "node", "path", "type", "script", kind.alias("class"))


#: How much an answer on components tells, from least to most.
DETAILS = ("counts", "summary", "grouped", "full")


def component_groups(parts: DataFrame, detail: str = "full", groups: int | None = None, paths: int | None = None, instances: int | None = None) -> DataFrame:
    """file, class, component, instances, and by ``detail`` more, of the components of prefabs.

    'counts': one row for each file and class, with the number of its components and instances. 'summary': one for each
    component, its script, else its type, most used first. 'grouped': with the paths of its nodes; 'full': also with its
    instances (place, path). ``groups``, ``paths`` and ``instances`` limit what is listed of a file's class or of a
    component, after sorting; the numbers are those of all, and ``truncated`` says whether groups were left out.
    """
    if detail not in DETAILS:
        raise ValueError(f"unknown detail: {detail}")
    c = parts.select("file", "class", F.coalesce("script", "type").alias("component"), "place", "path")
    every = ["file", "class", "component"]
    n = c.groupBy(*every).agg(F.count(F.lit(1)).alias("instances"))
    if detail == "counts":
        return n.groupBy("file", "class").agg(F.count(F.lit(1)).alias("components"), F.sum("instances").alias("instances"))
    place = F.row_number().over(Window.partitionBy("file", "class").orderBy(F.desc("instances"), "component"))
    total = F.count(F.lit(1)).over(Window.partitionBy("file", "class"))
    n = n.withColumn("group", place).withColumn("truncated", total > F.lit(groups if groups else 1 << 30))
    n = n.where(F.col("group") <= groups) if groups else n
    if detail == "summary":
        return n

    def first(of: DataFrame, value: Column, name: str, most: int | None) -> DataFrame:
        if most:
            of = of.withColumn("_n", F.row_number().over(Window.partitionBy(*every).orderBy(value))).where(F.col("_n") <= most)
        return of.groupBy(*every).agg(F.array_sort(F.collect_list(value)).alias(name))

    n = n.join(first(c.select(*every, "path").where("path IS NOT NULL").distinct(), F.col("path"), "node_paths", paths), every, "left")
    if detail == "full":
        n = n.join(first(c, F.struct("place", "path"), "each", instances), every, "left")
    return n


def references(found: DataFrame, assets: DataFrame) -> DataFrame:
    """file, place, field, kind, target of the fields of components (J20, E26): node, component, asset or missing."""
    place = lambda v: F.regexp_extract(v, r'"__id__"\s*:\s*(\d+)', 1).try_cast("int")
    uuid = lambda v: F.regexp_extract(v, r'"__uuid__"\s*:\s*"([^"@]+)', 1)
    # Values are read before they are unnested, so that no filter on what they say reads them again.
    own = F.filter(F.map_entries("fields"), lambda e: ~e["key"].isin(*OWN_FIELDS))
    read = F.transform(own, lambda e: F.struct(e["key"].alias("field"), place(e["value"]).alias("to"), uuid(e["value"]).alias("uuid")))
    field = found.where("node IS NOT NULL").select("file", "place", F.explode(read).alias("x")).select("file", "place", "x.*").where("to IS NOT NULL OR uuid <> ''")
    other = found.select("file", F.col("place").alias("to"), F.col("type").alias("to_type"))
    joined = field.join(other, ["file", "to"], "left").join(assets.select("uuid", F.col("path").alias("asset")), "uuid", "left")
    kind = F.when(F.col("to_type") == "cc.Node", "node").when(F.col("to_type").isNotNull(), "component").when(F.col("asset").isNotNull(), "asset").otherwise("missing")
    return joined.select("file", "place", "field", kind.alias("kind"), F.coalesce("asset", F.col("to").cast("string"), "uuid").alias("target"))


def events(found: DataFrame) -> DataFrame:
    """file, place, target (place of a node), component, handler of the click events."""
    get = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    target = F.regexp_extract(get("target"), r'"__id__"\s*:\s*(\d+)', 1).try_cast("int")
    return found.where("type = 'cc.ClickEvent'").select("file", "place", target.alias("target"), get("component").alias("component"), get("handler").alias("handler"))


def overrides(found: DataFrame) -> DataFrame:
    """file, place, property, value of the property overrides."""
    get = lambda k: F.try_element_at("fields", F.lit(k))
    return found.where("type = 'CCPropertyOverrideInfo'").select("file", "place", F.array_join(F.from_json(get("propertyPath"), "array<string>"), ".").alias("property"), get("value").alias("value"))


def audit(fields: DataFrame, serialized: DataFrame, overridden: DataFrame) -> DataFrame:
    """script, field, status of script fields (script, field, kind) against what prefabs hold.

    ``kind`` is primitive, reference or unknown. An override is best, then what is serialized, a primitive's default;
    an unknown kind is unsupported and the rest missing.
    """
    on = ["script", "field"]
    joined = fields.join(serialized.select(*on).distinct().withColumn("s", F.lit(True)), on, "left").join(overridden.select(*on).distinct().withColumn("o", F.lit(True)), on, "left")
    primitive = F.col("kind") == "primitive"
    status = F.when(F.col("o"), "override-bound").when(F.col("s") & primitive, "configured").when(F.col("s"), "bound").when(primitive, "script-default").when(F.col("kind") == "unknown", "unsupported").otherwise("missing")
    return joined.select(*on, status.alias("status"))


def audit_counts(found: DataFrame) -> DataFrame:
    """script and a column for each status."""
    return found.groupBy("script").agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("override-bound", "configured", "bound", "script-default", "unsupported", "missing")])


def graph(found: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of prefabs: a node for each UI node and component; nodes contain, components bind their script."""
    ui = tree(found).select(F.concat_ws("#", "file", F.col("place").cast("string")).alias("id"), F.lit("ui-node").alias("type"), F.col("path").alias("name"), "file")
    component = parts.select(F.concat_ws("#", "file", F.col("place").cast("string")).alias("id"), F.lit("component").alias("type"), F.concat_ws("@", "type", "path").alias("name"), "file")
    holds = parts.select(F.concat_ws("#", "file", F.col("node").cast("string")).alias("src"), F.concat_ws("#", "file", F.col("place").cast("string")).alias("dst"), F.lit("contains").alias("type"))
    binds = parts.where("script IS NOT NULL").select(F.concat_ws("#", "file", F.col("place").cast("string")).alias("src"), F.col("script").alias("dst"), F.lit("binds").alias("type"))
    return ui.union(component), holds.union(binds)
