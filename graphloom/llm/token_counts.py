"""Token counts under a unigram vocabulary, without the tokens.

Aho-Corasick finds every vocabulary piece that ends at each character of a word; dynamic programming carries the best
score and its number of pieces. Ties follow the tokenizer: candidates are met in order of where they begin, then by
length, and only a strictly better score replaces one, so of equal scores the one that begins first stays. A character
that no single-character piece matches may be unknown, at the lowest score less 10; a run of unknowns is one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import require, table
from .tokens import vocabulary

UNKNOWN_PENALTY = 10.0
MARK = "▁"
#: Distinct words that a worker remembers, and the longest word that it does.
REMEMBERED, LONGEST = 400_000, 64


class Counter:
    """Counts pieces of words; ``pieces`` maps each piece to its score."""

    def __init__(self, pieces: dict[str, float]):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.longest = max(map(len, pieces))
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word; it begins with the mark, and a mark inside begins a part of its own."""
        if MARK in word:
            return sum(self._part(p) for p in re.findall(f"{MARK}[^{MARK}]*", word if word[0] == MARK else MARK + word))
        return self._part(MARK + word)

    def _part(self, text: str) -> int:
        # No piece reaches back further than the longest: scores and counts lie in a ring of one place more.
        ring = self.longest + 1
        score, count, unknown = [0.0] * ring, [0] * ring, False
        matches = self.matches.iter(text)
        last, match = next(matches, (-1, None))
        for end in range(1, len(text) + 1):
            found = []
            while last == end - 1:
                found.append((end - match[0], match[1]))
                last, match = next(matches, (-1, None))
            best, n, single, known = None, 0, False, unknown
            unknown = False
            for begin, s in sorted(found):
                if best is None or score[begin % ring] + s > best:
                    best, n = score[begin % ring] + s, count[begin % ring] + 1
                single |= begin == end - 1
            # A character's unknown candidate begins at it, after all longer pieces that end here.
            before = (end - 1) % ring
            if not single and (best is None or score[before] + self.unknown > best):
                best, n, unknown = score[before] + self.unknown, count[before] + (not known), True
            score[end % ring], count[end % ring] = best, n
        return count[len(text) % ring]

    def text(self, text: str | None) -> int:
        total, known = 0, self.known
        for w in _WORD.findall(text or ""):
            n = known.get(w)
            if n is None:
                n = self.word(w)
                if len(w) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = n
            total += n
        return total


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each worker, from the ordinary pieces and scores of a sentencepiece file."""
    return Counter(pieces_of(path))


def pieces_of(path: str) -> dict[str, float]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens: one row per row of ``docs``, over whole texts.

    Null and empty texts have 0; a word of any length is counted whole, with scores held for the length of a piece
    only; repeated rows are counted each; an empty table gives an empty result.
    """
    require(docs, "doc_id", "text")
    path = path or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = batch.column("text")
            n = [count.text(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(_WORD.findall(t.as_py() or "")) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op9_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
