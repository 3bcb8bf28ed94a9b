"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import SLOTS, fit, remainder, sample, scored
from .shared import require, table

TRUE_FROM = 0.3
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- and 2-grams of words with their L2-normed square-root counts; nothing for a text without words.

    A word is a run of letters, digits or punctuation, or a line break. Words in capitals count as one word, as does a
    word that repeats the one before or the one before that.
    """
    counts: Counter = Counter()
    last = before = ""
    tokens = []
    for t in _TOKEN.findall(text or ""):
        tokens.append("<again>" if t in (last, before) and t.isalpha() else "<caps>" if len(t) > 1 and t.isupper() else t)
        last, before = t, last
    counts.update(tokens)
    counts.update(map("\x01".join, zip(tokens, tokens[1:], strict=False)))
    found: dict[int, int] = {}
    for t, n in counts.items():
        k = crc32(t.encode("utf-8", "surrogatepass")) % SLOTS
        found[k] = found.get(k, 0) + n
    at, n = np.fromiter(found.keys(), np.int32, len(found)), np.fromiter(found.values(), np.float64, len(found))
    return at, np.sqrt(n / max(n.sum(), 1)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from labelled rows whose crc32 remainder by 5 is not 0; zeros (score 0.5) if there is none."""
    rows = sample(docs, labels, "quality", remainder(F.col("doc_id"), 5) != 0, features)
    return fit(rows, epochs=12, alpha=2.0, l1=0.05, l2=0.02)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``; only the text enters a score.

    Null and empty texts get the bias alone; repeated rows are scored alike; whole texts are read whatever their
    length; an empty table gives an empty result.
    """
    require(docs, "doc_id", "text")
    found = scored(docs, train(docs, labels), features)
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= TRUE_FROM).cast("int").alias("predicted"))


def op5_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
