"""Learned patterns: counts turned into confidences, each one aggregation with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confidence(cap: float, base: float, *bonuses: tuple[Column, float]) -> Column:
    total = F.lit(base)
    for when, bonus in bonuses:
        total = total + F.when(when, bonus).otherwise(0.0)
    return F.round(F.least(F.lit(cap), total), 2)


def _count(role: str) -> Column:
    return F.count_if(F.col("role") == role)


def message_patterns(facts: DataFrame) -> DataFrame:
    """message, handlers, senders, dispatchers, evidence, confidence (L1)."""
    g = facts.groupBy("message").agg(_count("handler").alias("handlers"), _count("sender").alias("senders"), _count("dispatcher").alias("dispatchers"), F.count(F.lit(1)).alias("evidence"))
    return g.withColumn("confidence", confidence(0.95, 0.35, (F.col("handlers") > 0, 0.3), (F.col("senders") > 0, 0.2), (F.col("dispatchers") > 0, 0.1), (F.col("evidence") > 2, 0.05)))


def dispatcher_patterns(facts: DataFrame) -> DataFrame:
    """actor, messages, confidence of who dispatches (L2)."""
    g = facts.where("role = 'dispatcher'").groupBy("actor").agg(F.count_distinct("state").alias("messages"))
    return g.withColumn("confidence", F.round(0.55 + F.least(F.lit(0.3), 0.05 * F.col("messages")), 2))


def state_patterns(facts: DataFrame) -> DataFrame:
    """message, state, readers, writers, kind, confidence (L3): handlers read, others write."""
    g = facts.groupBy("message", "state").agg(F.count_distinct(F.when(F.col("value") < 50, F.col("actor"))).alias("readers"), F.count_distinct(F.when(F.col("value") >= 50, F.col("actor"))).alias("writers"))
    r, w = F.col("readers") > 0, F.col("writers") > 0
    g = g.withColumn("kind", F.when(r & w, "cycle").when(w, "state-write").otherwise("state-read"))
    return g.withColumn("confidence", confidence(0.9, 0.45, (r, 0.15), (w, 0.2), (r & w, 0.1)))


def timing_patterns(facts: DataFrame) -> DataFrame:
    """actor, waits, writes, handled, confidence: what an actor does next (L4). A gap to the next fact is a delay."""
    w = Window.partitionBy("actor").orderBy("seq")
    f = facts.withColumn("next", F.lead("message").over(w)).withColumn("gap", F.lead("seq").over(w) - F.col("seq"))
    g = f.groupBy("actor", "message").agg(F.count("next").alias("nexts"), F.count_if(F.col("value") >= 50).alias("writes"), F.count_if(F.col("gap") > 100).alias("delays"), _count("handler").alias("handled"))
    return g.withColumn("confidence", confidence(0.92, 0.45, (F.col("nexts") > 0, 0.2), (F.col("writes") > 0, 0.15), (F.col("delays") > 0, 0.1), (F.col("handled") > 0, 0.05)))


def phase_patterns(timing: DataFrame) -> DataFrame:
    """actor, phases, confidence from an actor's timing rows."""
    g = timing.groupBy("actor").agg(F.count(F.lit(1)).alias("phases"), F.sum("nexts").alias("nexts"), F.sum("writes").alias("writes"), F.sum("handled").alias("handled"), F.sum("delays").alias("delays"))
    return g.select("actor", "phases", confidence(0.94, 0.38, (F.col("nexts") > 0, 0.2), (F.col("writes") > 0, 0.16), (F.col("handled") > 0, 0.12), (F.col("delays") > 0, 0.08)).alias("confidence"))


def transition_patterns(facts: DataFrame) -> DataFrame:
    """source, target, n, kind, confidence: which message follows which with an actor."""
    w = Window.partitionBy("actor").orderBy("seq")
    f = facts.withColumn("target", F.lead("message").over(w)).where("target IS NOT NULL")
    g = f.groupBy(F.col("message").alias("source"), "target").agg(F.count(F.lit(1)).alias("n"), _count("handler").alias("handled"))
    kind = F.when(F.col("source") == F.col("target"), "state-cycle").otherwise("state-progress")
    return g.select("source", "target", "n", kind.alias("kind"), confidence(0.95, 0.45, (F.col("n") > 0, 0.18), (F.col("handled") > 0, 0.12), (F.col("source") == F.col("target"), 0.06)).alias("confidence"))


def shares(df: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """group, key, n, share of the group's rows to 4 places."""
    g = df.groupBy(*group, *key).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*group))
    return g.withColumn("share", F.round(F.col("n") / total, 4))


def learned_shares(df: DataFrame, within: list[str], key: list[str], evidence: str, collected: str | None = None, most: int = 10) -> DataFrame:
    """``within``, ``key``, n, confidence, evidence and, if asked for, ``collected`` of patterns.

    n: rows of a pattern; confidence: its share of the rows with the same ``within`` (of all rows without any), to 4
    places; evidence: the first ``most`` values of a column by value; ``collected``: the distinct values of another.
    Events are learned within their kind of source, by target and component, with their handlers; placements within a
    component, by role and path; bindings of fields within component and field, by kind; assets within all, by kind and
    folder. Rows are counted before they are shared out, and evidence is taken from the smallest values of each task.
    """
    g = df.groupBy(*within, *key).agg(F.count(F.lit(1)).alias("n"), *([F.array_sort(F.collect_set(collected)).alias(collected)] if collected else []))
    total = F.sum("n").over(Window.partitionBy(*within))
    g = g.withColumn("confidence", F.round(F.col("n") / total, 4))
    place = F.row_number().over(Window.partitionBy(*within, *key).orderBy(evidence))
    first = df.where(F.col(evidence).isNotNull()).select(*within, *key, evidence).withColumn("_n", place).where(F.col("_n") <= most)
    first = first.groupBy(*[F.col(c).alias(f"_{c}") for c in within + key]).agg(F.array_sort(F.collect_list(evidence)).alias("evidence"))
    on = F.lit(True)
    for c in within + key:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return g.join(first, on, "left").select(*within, *key, "n", "confidence", "evidence", *([collected] if collected else []))


def routing(facts: DataFrame) -> DataFrame:
    """grouping, kind, protocol, transport, callee, n of routes and requests (A10, L7): by kind and protocol, and by protocol,
    transport and callee, in one pass."""
    g = facts.groupingSets([["kind", "protocol"], ["protocol", "transport", "callee"]], "kind", "protocol", "transport", "callee").agg(F.count(F.lit(1)).alias("n"), F.grouping("kind").alias("_by_callee"))
    return g.select(F.when(F.col("_by_callee") == 1, "callee").otherwise("kind").alias("grouping"), "kind", "protocol", "transport", "callee", "n")
