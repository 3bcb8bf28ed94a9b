"""Stacks, areas and integrations of projects from their manifests and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files that are manifests.
MANIFESTS = ("package.json", "pyproject.toml", "requirements.txt", "pom.xml", "build.gradle", "build.gradle.kts", "go.mod")
#: Packages to the stacks they mean.
PACKAGE_STACKS = (
    (("vite", "@vitejs/plugin-vue", "@vitejs/plugin-react"), ("vite",)),
    (("typescript",), ("typescript",)),
    (("vue",), ("vue",)),
    (("react", "react-dom"), ("react",)),
    (("next",), ("next", "react")),
    (("nuxt",), ("nuxt", "vue")),
    (("nestjs", "@nestjs/core", "@nestjs/common", "@nestjs/platform-express", "@nestjs/platform-fastify"), ("nestjs",)),
    (("express",), ("express",)),
    (("pinus",), ("pinus",)),
    (("koa",), ("koa",)),
    (("fastify",), ("fastify",)),
    (("graphql", "@apollo/server", "apollo-server", "apollo-server-express", "graphql-yoga"), ("graphql",)),
)
#: Pattern of other manifests' names, their stack, and further stacks by pattern of the text.
OTHER_STACKS = (
    (r"^go\.mod$", "go", (("gin", r"gin-gonic/gin"), ("echo", r"labstack/echo"), ("fiber", r"gofiber/fiber"))),
    (r"^(pom\.xml|build\.gradle(\.kts)?)$", "java", (("spring", r"spring-boot|spring-web|org\.springframework"),)),
    (r"^(requirements\.txt|pyproject\.toml)$", "python", (("fastapi", r"\bfastapi\b"), ("django", r"\bdjango\b"), ("flask", r"\bflask\b"))),
)
#: Names of folders that look like a user interface, and stacks that say so already.
FRONT_FOLDER, FRONT_STACKS = r"(^|[-_])(frontend|client|web|ui|site|admin|portal|console|dashboard|mobile)([-_]|$)", ("cocos", "typescript", "vue", "react")
#: Packages of a user interface and of a server.
FRONT = ("vue", "vue-router", "react", "react-dom", "vite", "@vitejs/plugin-vue", "@vitejs/plugin-react", "next", "nuxt")
BACK = ("express", "koa", "fastify", "pinus", "@nestjs/core", "@nestjs/common")
#: Integration, its rank, folders, packages and pattern of other manifests that show it.
INTEGRATIONS = (
    ("websocket", "primary", ("websocket", "websockets", "socket", "sockets", "ws"), ("ws", "socket.io", "sockjs", "websocket", "@nestjs/websockets"), r"\bwebsockets\b|gorilla/websocket|spring-websocket"),
    ("http", "secondary", ("http", "rest"), ("express", "koa", "fastify", "@nestjs/core", "@nestjs/platform-express", "@nestjs/platform-fastify"),
     r"\bfastapi\b|\bdjango\b|\bflask\b|spring-boot-starter-web|spring-webmvc|spring-webflux|org\.springframework:spring-web|github\.com/(gin-gonic/gin|labstack/echo|gofiber/fiber)"),
    ("grpc", "secondary", (), ("@grpc/grpc-js", "grpc"), r"google\.golang\.org/grpc|\bgrpcio\b|\bio\.grpc\b"),
    ("graphql", "secondary", ("graphql",), ("graphql", "@apollo/server", "apollo-server", "apollo-server-express", "graphql-yoga"), r"\bgraphene\b|\bariadne\b|graphql-java|graphql-go/graphql"),
    ("mq", "secondary", ("mq", "queue", "queues", "rabbitmq", "kafka", "pubsub"), ("amqplib", "amqp-connection-manager", "kafkajs", "kafka-node", "bull", "bullmq", "nats", "@aws-sdk/client-sqs", "@google-cloud/pubsub"),
     r"rabbitmq|\bkafka\b|\bpika\b|\bcelery\b|\bnats\b|pubsub|rocketmq"),
    ("rpc", "secondary", ("rpc", "thrift", "dubbo"), ("thrift", "tars", "dubbo", "brpc"), r"\bthrift\b|\bdubbo\b|\btars\b|\bbrpc\b|\brpcx\b"),
)


def _base(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*)$", 1))


def _any(deps: Column, names: tuple) -> Column:
    return F.arrays_overlap(deps, F.array(*[F.lit(n) for n in names]))


def scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, dir, name, deps, text of the manifests among files (S12); a package.json that does not parse has no deps."""
    sections = [F.map_keys(F.from_json(F.get_json_object(text, f"$.{s}"), "map<string,string>")) for s in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")]
    none = F.array().cast("array<string>")
    deps = F.when(_base(F.col(path)) == "package.json", F.array_distinct(F.transform(F.concat(*[F.coalesce(s, none) for s in sections]), F.lower))).otherwise(none)
    return files.where(_base(F.col(path)).isin(*MANIFESTS)).select(F.col(path).alias("path"), F.regexp_replace(path, r"/?[^/]*$", "").alias("dir"), _base(F.col(path)).alias("name"), deps.alias("deps"), F.coalesce(text, F.lit("")).alias("text"))


def stacks(found: DataFrame) -> DataFrame:
    """path, stacks (sorted), area of each manifest."""
    package, low = F.col("name") == "package.json", F.lower("text")
    has = lambda key: F.coalesce(F.get_json_object("text", f"$.{key}"), F.lit("")) != ""
    creator = package & has("creator.version")
    every = [F.when(package, F.lit("nodejs")), F.when(creator, F.lit("cocos")), F.when(creator, F.lit("typescript"))]
    every += [F.when(package & _any(F.col("deps"), names), F.lit(s)) for names, means in PACKAGE_STACKS for s in means]
    for pattern, stack, more in OTHER_STACKS:
        here = F.col("name").rlike(pattern)
        every += [F.when(here, F.lit(stack))] + [F.when(here & low.rlike(p), F.lit(s)) for s, p in more]
    known = F.array_distinct(F.array_compact(F.array(*every)))
    front = package & F.exists(F.split(F.lower("dir"), "/"), lambda p: p.rlike(FRONT_FOLDER)) & ~_any(known, FRONT_STACKS)
    known = F.when(front, F.array_append(known, F.lit("frontend-js"))).otherwise(known)
    shared = _any(F.col("deps"), ("typescript",)) | has("bin") | has("main") | has("type")
    area = F.when(~package, "unknown").when(_any(F.col("deps"), FRONT), "frontend").when(_any(F.col("deps"), BACK), "backend").when(shared, "shared").otherwise("unknown")
    return found.select("path", F.array_sort(known).alias("stacks"), area.alias("area"))


def integrations(files: DataFrame, found: DataFrame, path: str = "path") -> DataFrame:
    """integration, rank, folders, packages, texts: what shows each integration that anything shows.

    ``files`` are all files of a root, ``found`` its manifests; folders are those above a file, and .proto files count as
    a folder of grpc. Each is one pass with sums made before any rows move.
    """
    above = F.filter(F.slice(F.split(F.lower(path), "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda p: p != "")
    plain = F.col("name") != "package.json"
    folder = lambda name, names: (_any(above, names) if names else F.lit(False)) | (F.lower(path).endswith(".proto") if name == "grpc" else F.lit(False))
    seen = files.select(F.array_compact(F.array(*[F.when(folder(n, dirs), F.lit(n)) for n, _, dirs, _, _ in INTEGRATIONS])).alias("n"), F.lit("folders").alias("by"))
    seen = seen.union(found.select(F.array_compact(F.array(*[F.when(_any(F.col("deps"), deps), F.lit(n)) for n, _, _, deps, _ in INTEGRATIONS])), F.lit("packages")))
    seen = seen.union(found.where(plain).select(F.array_compact(F.array(*[F.when(F.lower("text").rlike(p), F.lit(n)) for n, _, _, _, p in INTEGRATIONS])), F.lit("texts")))
    per = seen.select(F.explode("n").alias("integration"), "by").groupBy("integration").agg(*[F.count_if(F.col("by") == b).alias(b) for b in ("folders", "packages", "texts")])
    rank = F.when(F.col("integration").isin(*[n for n, r, *_ in INTEGRATIONS if r == "primary"]), "primary").otherwise("secondary")
    return per.select("integration", rank.alias("rank"), "folders", "packages", "texts")
