"""Feature candidates from nodes: seeds by address, server and path, evidence, related roots, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import area_of
from .selectors import meta

#: Words that are no part of a feature's key.
STOP_WORDS = (
    "app", "api", "assets", "client", "common", "component", "components", "controller", "controllers", "handler", "http", "index", "lib", "message",
    "method", "node", "project", "request", "response", "route", "routes", "rpc", "script", "server", "service", "services", "src", "state", "utils",
    "view", "views", "workspace",
)
#: Words at which an address stops telling the feature.
ACTION_WORDS = (
    "add", "create", "delete", "fetch", "find", "get", "list", "load", "post", "query", "remove", "save", "set", "sync", "update",
)
#: Parts of paths that tell no feature.
LOW_VALUE = (
    "activity", "api", "app", "assets", "bundle", "common", "commom", "config", "effect", "effects", "game", "handler", "http", "lobby", "listmode",
    "list-mode", "majiang", "mj", "mj-common", "modelmj", "model-mj", "pk-common", "poker", "campaign", "campaigns", "prefab", "prefabs", "remote",
    "routes", "script", "servers", "settlement", "src", "ui", "zp-common", "zipai",
)


def key_of(words: Column) -> Column:
    """Words without the stop words, in lower case, joined by '-' (X23)."""
    return F.array_join(F.filter(F.transform(words, F.lower), lambda w: ~w.isin(*STOP_WORDS)), "-")


def endpoint_key(path: Column) -> Column:
    """The first three or more words of an address before an action word, parts of low value left out."""
    parts = F.filter(F.split(F.regexp_replace(path, r"^[A-Za-z]+\s+", ""), "/"), lambda p: (p != "") & ~p.startswith(":"))
    state = F.struct(F.array().cast("array<string>").alias("words"), F.lit(False).alias("done"))

    def step(a: Column, p: Column) -> Column:
        w = T.words(p)
        low = F.lower(p).isin(*LOW_VALUE) & (F.size(parts) > 1)
        stop = F.coalesce(F.lower(F.try_element_at(w, F.lit(1))).isin(*ACTION_WORDS), F.lit(False))
        more = F.concat(a["words"], w)
        return F.when(a["done"] | low, a).when(stop, F.struct(a["words"].alias("words"), F.lit(True).alias("done"))).otherwise(F.struct(more.alias("words"), (F.size(more) >= 3).alias("done")))

    return key_of(F.aggregate(parts, state, step)["words"])


def server_key(file: Column) -> Column:
    """The folder below 'servers' (D2)."""
    return key_of(T.words(F.regexp_extract(T.path_kept(file), r"(?:^|/)servers/([^/]+)", 1)))


def path_key(file: Column) -> Column:
    """The first folder below 'game' that tells something (D3)."""
    after = F.split(F.regexp_extract(T.path_kept(file), r"(?i)^(?:.*?/)?game/(.*)$", 1), "/")
    folders = F.filter(after, lambda s: (s != "") & ~s.rlike(r"\.[A-Za-z0-9]+$") & ~F.lower(s).isin(*LOW_VALUE) & ~s.rlike(r"^\d+d?$"))
    return key_of(T.words(F.coalesce(F.try_element_at(folders, F.lit(1)), F.lit(""))))


def folder(file: Column) -> Column:
    return F.regexp_replace(T.path_kept(file), r"/?[^/]*$", "")


def seeds(nodes: DataFrame) -> DataFrame:
    """key, weight, reason, id, type, name, file, area: what each node suggests.

    An endpoint's address weighs 45; a server folder 40 for messages, 35 for routes; a game folder 25 for methods and
    scripts, else 12.
    """
    kind, file = F.col("type"), F.coalesce("file", F.lit(""))
    address = F.coalesce(F.nullif(meta("path"), F.lit("")), "name")
    seed = lambda key, weight, reason: F.struct(key.alias("key"), weight.alias("weight"), F.lit(reason).alias("reason"))
    found = F.array(
        F.when(kind == "endpoint", seed(endpoint_key(address), F.lit(45), "endpoint")),
        F.when(kind.isin("message", "route"), seed(server_key(file), F.when(kind == "message", 40).otherwise(35), "server")),
        seed(path_key(file), F.when(kind.isin("method", "script"), 25).otherwise(12), "path"),
    )
    return nodes.select(F.explode(F.filter(found, lambda s: s.isNotNull() & (s["key"] != ""))).alias("s"), "id", "type", "name", "file", "area").select("s.*", "id", "type", "name", "file", "area")


def app_seeds(nodes: DataFrame) -> DataFrame:
    """As ``seeds`` for routes and pages of an app folder, by the first folder below it: 50 for the feature and 6 a
    node, 40 at most (D4); ``candidates`` adds them once a feature."""
    key = key_of(T.words(F.regexp_extract(T.path_kept(F.col("file")), r"(?:^|/)app/(?:api/)?(?:\([^/]*\)/)?([^/\[(]+)/", 1)))
    hit = F.lower("file").rlike(r"/(route|page)\.[cm]?[jt]sx?$")
    return nodes.where(hit).withColumn("key", key).where("key <> ''").select("key", F.lit(6).alias("weight"), F.lit("app").alias("reason"), "id", "type", "name", "file", "area")


def candidates(found: DataFrame, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """(candidates, evidence) of seeds.

    Candidates: key, score, nodes, areas, roots, confidence: high from 40, medium from 25. Evidence: the first ``most``
    seeds of each key by node.
    """
    app = F.count_if(F.col("reason") == "app")
    score = F.sum(F.when(F.col("reason") != "app", F.col("weight")).otherwise(0)) + F.when(app > 0, 50 + F.least(6 * app, F.lit(40))).otherwise(0)
    area = F.nullif(area_of(F.col("file"), F.col("area")), F.lit("unknown"))
    per = found.groupBy("key").agg(score.alias("score"), F.count_distinct("id").alias("nodes"), F.array_sort(F.collect_set(area)).alias("areas"), F.count_distinct(F.nullif(folder(F.col("file")), F.lit(""))).alias("roots"))
    per = per.withColumn("confidence", T.bucket(F.col("score"), 40, 25))
    place = F.row_number().over(Window.partitionBy("key").orderBy("id", "reason"))
    return per, found.withColumn("place", place).where(F.col("place") <= most).select("key", "place", "id", "type", "name", "reason")


def ordered(per: DataFrame) -> DataFrame:
    """Candidates by confidence, score and key (T5)."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    return per.orderBy(F.desc(rank), F.desc("score"), "key")


def roots_of(found: DataFrame) -> DataFrame:
    """key, root: the folders of each feature's nodes, a row each."""
    return found.select("key", folder(F.col("file")).alias("root")).where("root <> ''").distinct()


def related_roots(found: DataFrame, edges: DataFrame, nodes: DataFrame, tops: tuple = ("lib", "components")) -> DataFrame:
    """key, root: folders in ``tops`` of what is one edge away from a feature's nodes."""
    own = found.select("key", "id").distinct()
    near = own.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("other")), "id").union(own.join(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")), "id"))
    other = nodes.select(F.col("id").alias("other"), folder(F.col("file")).alias("root")).where(F.split("root", "/")[0].isin(*tops))
    return near.select("key", "other").distinct().join(other, "other").select("key", "root").distinct()


def fullstack(nodes: DataFrame, front: str, back: str) -> DataFrame:
    """nodes, score of the pair of roots where both have nodes: 80 and one a node, 20 at most; else no row."""
    g = nodes.agg(F.bool_or(T.in_module(F.col("file"), front)).alias("f"), F.bool_or(T.in_module(F.col("file"), back)).alias("b"), F.count_if(T.in_module(F.col("file"), front) | T.in_module(F.col("file"), back)).alias("nodes"))
    return g.where("f AND b").select("nodes", (80 + F.least("nodes", F.lit(20))).alias("score"))
