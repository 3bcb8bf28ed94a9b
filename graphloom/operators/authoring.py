"""Plans for click events and fields on prefabs, profiles of prefabs and nested overrides. Many requests are planned at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefab as P

#: Types of fields that are built-in components, and those that are assets.
BUILT_IN = ("Button", "Toggle", "Label", "Sprite", "Animation", "EditBox", "ScrollView", "UITransform", "RichText", "ProgressBar", "Slider")
ASSETS = ("Prefab", "SpriteFrame", "AudioClip", "JsonAsset", "Texture2D", "SpriteAtlas", "ImageAsset")


def field_kind(base: Column) -> Column:
    """primitive, node, asset, built-in, script or unknown, by the name of a field's type."""
    b = F.trim(F.coalesce(base, F.lit("")))
    return F.when(b == "", "unknown").when(F.lower(b).isin("number", "string", "boolean"), "primitive").when(b == "Node", "node").when(b.isin(*ASSETS), "asset").when(b.isin(*BUILT_IN), "built-in").otherwise("script")


def _satisfied(c: Column) -> Column:
    return F.when(c.isNotNull(), "already-satisfied").otherwise("required")


def click_plans(asked: DataFrame, parts: DataFrame, methods: DataFrame, events: DataFrame, roots: DataFrame) -> DataFrame:
    """id, step, kind, status, path: the changes that each wanted click event needs, in order (C4).

    ``asked``: id, file, node (path), component, handler, target (path or null); ``parts``: file, path, component;
    ``methods``: component, method; ``events``: file, source, component, handler; ``roots``: file, path. A null target
    is the first node that has the component, else the root. Steps: attach the component, add the method, attach a
    button where the node has none, bind the event. A component that no script declares has no plan.
    """
    first = parts.groupBy("file", "component").agg(F.min("path").alias("first"))
    root = roots.groupBy("file").agg(F.min("path").alias("root"))
    a = asked.join(methods.select("component").distinct(), "component", "left_semi").join(first, ["file", "component"], "left").join(root, "file", "left")
    a = a.withColumn("at", F.coalesce("target", "first", "root"))
    has = parts.select("file", F.col("path").alias("at"), "component").distinct().withColumn("attached", F.lit(True))
    buttons = parts.where("component = 'cc.Button'").select("file", F.col("path").alias("node")).distinct().withColumn("button", F.lit(True))
    known = methods.select("component", F.col("method").alias("handler")).distinct().withColumn("declared", F.lit(True))
    bound = events.select("file", F.col("source").alias("node"), "component", "handler").distinct().withColumn("bound", F.lit(True))
    a = a.join(has, ["file", "at", "component"], "left").join(buttons, ["file", "node"], "left").join(known, ["component", "handler"], "left").join(bound, ["file", "node", "component", "handler"], "left")
    step = lambda kind, flag, path: F.struct(F.lit(kind).alias("kind"), _satisfied(F.col(flag)).alias("status"), path.alias("path"))
    button = F.when(F.col("button").isNull(), F.array(step("attach-built-in-component", "button", F.col("node")))).otherwise(F.array().cast("array<struct<kind:string,status:string,path:string>>"))
    steps = F.concat(F.array(step("attach-component", "attached", F.col("at")), step("add-method", "declared", F.lit(""))), button, F.array(step("bind-event", "bound", F.col("node"))))
    return a.select("id", F.posexplode(steps).alias("step", "s")).select("id", "step", "s.*")


def field_plans(asked: DataFrame, parts: DataFrame, fields: DataFrame, bound: DataFrame, roots: DataFrame) -> DataFrame:
    """id, path, binding, attach, bind: what each wanted binding of a field needs.

    ``asked``: id, file, component, field, node (path or null), target (text that a present binding must hold, or null);
    ``fields``: component, field, base; ``bound``: file, path, component, field, value. A field that is not declared
    has no plan. A null node is the first one with the component, else the root.
    """
    first = parts.groupBy("file", "component").agg(F.min("path").alias("first"))
    root = roots.groupBy("file").agg(F.min("path").alias("root"))
    kinds = fields.groupBy("component", "field").agg(F.min("base").alias("base"))
    a = asked.join(kinds, ["component", "field"]).join(first, ["file", "component"], "left").join(root, "file", "left").withColumn("path", F.coalesce("node", "first", "root"))
    has = parts.select("file", "path", "component").distinct().withColumn("attached", F.lit(True))
    hits = a.select("id", "file", "path", "component", "field", "target").join(bound, ["file", "path", "component", "field"])
    wanted = F.lower(F.trim(F.coalesce("target", F.lit(""))))
    hits = hits.where((wanted == "") | F.contains(F.lower("value"), wanted)).select("id").distinct().withColumn("bound", F.lit(True))
    a = a.join(has, ["file", "path", "component"], "left").join(hits, "id", "left")
    return a.select("id", "path", field_kind(F.col("base")).alias("binding"), _satisfied(F.col("attached")).alias("attach"), _satisfied(F.col("bound")).alias("bind"))


def profiles(found: DataFrame, parts: DataFrame) -> DataFrame:
    """file, nodes, components, scripts, built_in, unresolved, events of each prefab."""
    nodes = found.groupBy("file").agg(F.count_if(F.col("type") == "cc.Node").alias("nodes"), F.count_if(F.col("type") == "cc.ClickEvent").alias("events"))
    kind = lambda k: F.count_if(F.col("class") == k)
    per = parts.groupBy("file").agg(F.count(F.lit(1)).alias("components"), kind("custom-script").alias("scripts"), kind("builtin").alias("built_in"), kind("unresolved").alias("unresolved"))
    return nodes.join(per, "file", "left").select("file", "nodes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("components", "scripts", "built_in", "unresolved")], "events")


def find_prefabs(profiled: DataFrame, features: DataFrame, feature: str = "", name: str = "") -> DataFrame:
    """feature, file and the counts of prefabs whose feature and name hold the texts (C7). ``features``: feature, file."""
    base = F.regexp_extract("file", r"([^/]*?)(?:\.prefab)?$", 1)
    hit = F.contains(F.lower("feature"), F.lit(feature.lower())) & F.contains(F.lower(base), F.lit(name.lower()))
    return features.join(profiled, "file").where(hit).select("feature", *profiled.columns)


def find_nodes(found: DataFrame, features: DataFrame, keyword: str) -> DataFrame:
    """feature, file, path of the nodes whose path holds the keyword, case and all."""
    return features.join(P.tree(found), "file").where(F.contains("path", F.lit(keyword))).select("feature", "file", "path")


def nested_overrides(found: DataFrame, assets: DataFrame, parts: DataFrame) -> DataFrame:
    """file, place, source, property, prefab, path, type, script: references of a prefab into prefabs nested in it.

    A target override names a node of its file and, by id, a component of the prefab nested at that node: node to prefab
    information, to asset, to the component that carries the id. What is not found is null.
    """
    get = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    ref = lambda k: F.regexp_extract(get(k), r'"__id__"\s*:\s*(\d+)', 1).try_cast("int")
    first = lambda k: F.coalesce(F.get_json_object(get(k), "$[0]"), F.lit(""))
    o = found.where("type = 'cc.TargetOverrideInfo'").select("file", "place", ref("source").alias("source"), F.array_join(F.from_json(get("propertyPath"), "array<string>"), ".").alias("property"), ref("target").alias("node"), ref("targetInfo").alias("info"))
    ids = found.where("type = 'cc.TargetInfo'").select("file", F.col("place").alias("info"), first("localID").alias("local"))
    held = found.where("type = 'cc.Node'").select("file", F.col("place").alias("node"), ref("_prefab").alias("held"))
    uuid = F.regexp_extract(get("asset"), r'"__uuid__"\s*:\s*"([^"@]+)', 1)
    nested = found.where("type = 'cc.PrefabInfo'").select("file", F.col("place").alias("held"), uuid.alias("uuid")).where("uuid <> ''")
    where = assets.where("kind = 'prefab'").groupBy("uuid").agg(F.min("path").alias("prefab"))
    carried = found.where("type = 'cc.CompPrefabInfo'").select("file", F.col("place").alias("carrier"), get("fileId").alias("local"))
    owner = found.where("node IS NOT NULL").select("file", "place", ref("__prefab").alias("carrier")).join(carried, ["file", "carrier"])
    inner = owner.join(parts.select("file", "place", "path", "type", "script"), ["file", "place"]).select(F.col("file").alias("prefab"), "local", "path", "type", "script")
    joined = o.join(ids, ["file", "info"], "left").join(held, ["file", "node"], "left").join(nested, ["file", "held"], "left").join(where, "uuid", "left").join(inner, ["prefab", "local"], "left")
    return joined.select("file", "place", "source", "property", "prefab", "path", "type", "script")
