"""Toxicity classifier, counterfactually regularised.

A labelled text with a sentence that names a group is paired with the same text where that sentence is about another
group; the squared change of the score is part of the loss, so a neutral mention of a group costs nothing by itself.
"""

from __future__ import annotations

import re
from functools import partial
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import SLOTS, fit, remainder, sample, scored
from .shared import require, table

TRUE_FROM = 0.7
#: Identity terms; each is swapped for the next of its row, the last for the first.
IDENTITIES = (
    ("man", "woman"),
    ("men", "women"),
    ("boy", "girl"),
    ("male", "female"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "arab"),
    ("immigrant", "citizen", "refugee"),
    ("immigrants", "citizens", "refugees"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("mann", "frau"),
    ("homme", "femme"),
    ("hombre", "mujer"),
)


def swaps(identities: tuple = IDENTITIES) -> dict[str, str]:
    """What each identity term is swapped for."""
    return {w: row[(i + 1) % len(row)] for row in identities for i, w in enumerate(row)}


SWAP = swaps()
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
#: Besides the word itself, its first letters, so that inflected forms count as one.
STEMS = (4, 5, 6)


def _hashed(words: set[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = {w for w in words}
    for k in STEMS:
        parts.update([w[:k] + "\x01" for w in words if len(w) >= k])
    at = np.unique(np.fromiter((crc32(p.encode("utf-8", "surrogatepass")) % SLOTS for p in parts), np.int32, len(parts)))
    return at, np.ones(len(at), dtype=np.float32)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Which words and word beginnings the whole text has, lower-cased; nothing for a text without words."""
    return _hashed(set(_WORD.findall((text or "").lower())))


def with_swaps(text: str | None, swap: dict[str, str] = SWAP) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of the text and, for each of its sentences that names a group, of the text with that sentence about
    another group; texts of equal words count once."""
    sentences = [set(_WORD.findall(s)) for s in _SENTENCE.findall((text or "").lower())]
    words = set().union(*sentences)
    found = {}
    if words & swap.keys():
        counts: dict[str, int] = {}
        for s in sentences:
            for w in s:
                counts[w] = counts.get(w, 0) + 1
        for s in sentences:
            if named := frozenset(s & swap.keys()):
                alone = frozenset(w for w in named if counts[w] == 1)
                found[frozenset((words - alone) | {swap[w] for w in named})] = None
    return [_hashed(words), *(_hashed(x) for x in map(set, found) if x != words)]


def train(docs: DataFrame, labels: DataFrame, swapped_weight: float = 40.0, identities: tuple = IDENTITIES) -> np.ndarray:
    """Weights from labelled rows whose crc32 remainder by 3 is not 1; zeros (score 0.5) if there is none.

    ``swapped_weight`` times the squared change of the score under each swap is added to a row's loss.
    """
    rows = sample(docs, labels, "toxic", remainder(F.col("doc_id"), 3) != 1, partial(with_swaps, swap=swaps(identities)))
    return fit(rows, epochs=10, alpha=0.3, l1=10.0, l2=0.01, positive_weight=8.0, swapped_weight=swapped_weight, evidence_only=True, least_df=3)


def classify(docs: DataFrame, labels: DataFrame, *more: str, **training) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns ``more``: one row per row of ``docs``.

    Only the text enters a score. Null and empty texts get the bias alone; repeated rows are scored alike; whole texts
    are read whatever their length; an empty table gives an empty result. ``training`` is for ``train``.
    """
    require(docs, "doc_id", "text")
    found = scored(docs, train(docs, labels, **training), features, *more)
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TRUE_FROM).cast("int").alias("predicted"), *[c for c in more if c != "doc_id"])


def harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not found toxic, all columns, whatever those besides doc_id and text are called."""
    names = {c: c if c in ("doc_id", "text") else f"__gl_{i}" for i, c in enumerate(docs.columns)}
    found = classify(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), labels, *names.values())
    return found.where("predicted = 0").select(*[F.col(n).alias(c) for c, n in names.items()])


def op3_toxicity(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
