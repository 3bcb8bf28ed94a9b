"""SentencePiece encoding and decoding of BPE vocabularies with byte fallback, by vectorised merge rounds.

A text is cut where no piece spans the two characters, so no merge crosses a cut. The symbols of all segments lie in one
flat array. A round finds the best pair of each segment, merges its leftmost occurrences at once, and closes the gaps;
segments without a pair leave. This is what merging one pair after another gives, as long as no merge makes a pair
that ranks before the occurrences still to come: a segment's round ends at a merge that does. Segments of more than
``LONG`` symbols, which would take many rounds, are merged pair by pair from a heap, by the same rule.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import require, table
from .tokens import vocabulary

MARK = "▁"
#: Characters that are encoded at once.
AT_ONCE = 1_000_000
#: Distinct words that a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 300_000, 64
#: Symbols of a segment above which pairs come from a heap.
LONG = 2048
_NONE = np.int32(2**31 - 1)


class Pieces:
    """A vocabulary: its pieces, which pairs merge into which piece, and in what order."""

    def __init__(self, path: str, long: int = LONG):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not (norm.precompiled_charsmap or norm.remove_extra_whitespaces)
        if not plain or model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE vocabulary with byte fallback, a leading mark and no other normalisation is needed")
        if kinds & {proto.ModelProto.SentencePiece.USER_DEFINED, proto.ModelProto.SentencePiece.UNUSED}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.library, self.long = sentencepiece.SentencePieceProcessor(model_file=path), long
        self.begin, self.end, self.size = self.library.bos_id(), self.library.eos_id(), len(model.pieces)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == proto.ModelProto.SentencePiece.NORMAL}
        # A character without a piece is size + its code until it becomes bytes at the end.
        self.first = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, (i, _) in pieces.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        self.byte = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=self.dtype)
        place = {s: i for i, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        pairs = {(pieces[p[:k]][0], pieces[p[k:]][0]): (place[s], i) for p, (i, s) in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces}
        keys = np.array([self._key(a, b) for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks, self.made = (np.array([v[j] for v in pairs.values()], dtype=np.int32)[order] for j in (0, 1))
        self.spanned = np.unique(np.array([ord(a) << 21 | ord(b) for p in pieces for a, b in zip(p, p[1:], strict=False)], dtype=np.int64))
        self.known: dict[str, bytes] = {}

    def _key(self, left, right):
        return left * (self.size + 0x110000) + right

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; pairs without a piece rank last."""
        key = self._key(left.astype(np.int64), right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), self.made[at]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word (marks in place of blanks) as little-endian bytes."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        begins = np.zeros(len(points) + 1, dtype=bool)
        begins[0] = True
        begins[ends] = True
        pair = points[:-1].astype(np.int64) << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.spanned, pair), len(self.spanned) - 1)
        begins[1:-1] |= self.spanned[at] != pair
        final = self._rounds(self.first[points], np.diff(np.flatnonzero(begins)))
        left = np.flatnonzero(final >= 0)
        ids, before = final[left], np.searchsorted(left, ends)  # symbols up to the end of each word
        unknown = np.flatnonzero(ids >= self.size)
        if len(unknown):
            raw = [self.byte[list(chr(c).encode())] for c in (ids[unknown] - self.size).tolist()]
            sizes = np.ones(len(ids), dtype=np.int64)
            sizes[unknown] = [len(b) for b in raw]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            spread = np.repeat(np.where(ids < self.size, ids, 0), sizes).astype(self.dtype)
            inside = np.repeat(ids >= self.size, sizes)
            spread[inside] = np.concatenate(raw)
            ids, before = spread, upto[before]
        raw, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        cuts = [0, *(before * size).tolist()]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _rounds(self, sym: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The symbol that is left at the place of each first character, -1 elsewhere; ``counts``: symbols of segments."""
        final, at = np.full(len(sym), -1, dtype=np.int32), np.arange(len(sym))
        far = counts > self.long
        if far.any():
            last = np.cumsum(counts)
            for i, j in zip((last - counts)[far].tolist(), last[far].tolist(), strict=True):
                final[i:j] = self._one_by_one(sym[i:j].tolist())
            near = np.repeat(~far, counts)
            sym, at, counts = sym[near], at[near], counts[~far]
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), dtype=np.int32)
        rank[:-1], made[:-1] = self._look(sym[:-1], sym[1:])
        rank[np.cumsum(counts) - 1] = _NONE
        while len(sym):
            best = np.minimum.reduceat(rank, np.cumsum(counts) - counts)
            if (done := best == _NONE).any():
                gone = np.repeat(done, counts)
                final[at[gone]] = sym[gone]
                sym, at, rank, made, counts, best = sym[~gone], at[~gone], rank[~gone], made[~gone], counts[~done], best[~done]
                if not len(sym):
                    break
            segment = np.repeat(np.arange(len(counts)), counts)
            hit = np.flatnonzero(rank == best[segment])
            # Of pairs that overlap, the first, third and so on are merged.
            number = np.arange(len(hit))
            apart = np.concatenate([[True], np.diff(hit) != 1])
            hit = hit[(number - np.maximum.accumulate(np.where(apart, number, 0))) % 2 == 0]
            hit = hit[self._in_order(hit, sym, made, segment, best)]
            sym[hit] = made[hit]
            stays = np.ones(len(sym), dtype=bool)
            stays[hit + 1] = False
            counts = counts - np.bincount(segment[hit], minlength=len(counts))
            sym, at, rank, made = sym[stays], at[stays], rank[stays], made[stays]
            new = hit - np.arange(len(hit))
            edge = np.zeros(len(sym) + 1, dtype=bool)
            edge[np.cumsum(counts)] = edge[0] = True
            rank[new[edge[new + 1]]] = _NONE
            look = np.concatenate([new[~edge[new + 1]], new[~edge[new]] - 1])
            if len(look):
                rank[look], made[look] = self._look(sym[look], sym[look + 1])
        return final

    def _in_order(self, hit: np.ndarray, sym: np.ndarray, made: np.ndarray, segment: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Which merges can be made at once: in each segment, up to the first that makes a pair to be merged before the next."""
        own, n = segment[hit], len(sym)
        before, after = np.maximum(hit - 1, 0), np.minimum(hit + 2, n - 1)
        joined = np.concatenate([[False], np.diff(hit) == 2])  # the merge before it ends where it begins
        left = np.where(joined, made[np.concatenate([[0], hit[:-1]])], sym[before])
        early = (hit > 0) & (segment[before] == own) & (self._look(left, made[hit])[0] <= best[own])
        early |= (hit + 2 < n) & (segment[after] == own) & (self._look(made[hit], sym[after])[0] <= best[own])
        if not early.any():
            return np.ones(len(hit), dtype=bool)
        past = np.cumsum(early) - early
        first = np.concatenate([[True], np.diff(own) != 0])
        return past == past[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]

    def _one_by_one(self, sym: list[int]) -> np.ndarray:
        """As ``_rounds``, for one long segment: the best pair, leftmost first, from a heap."""
        n = len(sym)
        prev, following = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, made = self._look(np.array(sym[:-1]), np.array(sym[1:]))
        known = {}
        heap = [(r, i, sym[i], sym[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist(), strict=True)) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = following[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], following[i] = m, -1, following[j]
            if following[j] >= 0:
                prev[following[j]] = i
            for x, y in ((prev[i], i), (i, following[i])):
                if x >= 0 and y >= 0:
                    if (pair := (sym[x], sym[y])) not in known:
                        r, p = self._look(np.array([pair[0]]), np.array([pair[1]]))
                        known[pair] = (int(r[0]), int(p[0]))
                    r, p = known[pair]
                    if r != _NONE:
                        heapq.heappush(heap, (r, x, *pair, p))
        return np.array(sym, dtype=np.int32)

    def _cut(self, text: str) -> str:
        """The text with marks for blanks, and NUL where it can be cut: before a run of marks and around line breaks."""
        out = MARK + text.replace(" ", "\0" + MARK)
        while (two := MARK + "\0" + MARK) in out:
            out = out.replace(two, MARK + MARK)
        return out if self.first[10] < self.size else out.replace("\n", "\0\n\0")

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        whole = {i: self.words([MARK + t.replace(" ", MARK)])[0] for i, t in enumerate(texts) if "\0" in t}
        cut = pc.split_pattern(pa.array([self._cut(t) if t and i not in whole else "" for i, t in enumerate(texts)], pa.large_string()), "\0")
        words = cut.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = [self.known.get(w) if w else b"" for w in names]
        new = [w for w, raw in zip(names, found, strict=True) if raw is None]
        fresh = dict(zip(new, self.words(new), strict=True))
        self.known.update((w, raw) for w, raw in fresh.items() if len(w) <= LONGEST)
        ids = pa.array([fresh[w] if raw is None else raw for w, raw in zip(names, found, strict=True)], pa.large_binary()).take(words.indices)
        _, ends, data = ids.buffers()
        bounds = np.frombuffer(ends, np.int64, len(ids) + 1, ids.offset * 8)[cut.offsets.to_numpy()].tolist()
        view = memoryview(data) if data is not None else b""
        for k, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)):
            yield np.concatenate([[self.begin], np.frombuffer(whole.get(k) or view[i:j], self.dtype), [self.end]]).astype("<u4")

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, with begin and end; null is as empty."""
        held, chars = [], 0
        for text in texts:
            held.append(text or "")
            chars += len(held[-1])
            if chars >= AT_ONCE:
                yield from self._encode(held)
                held, chars = [], 0
        if held:
            yield from self._encode(held)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One for each worker."""
    return Pieces(path)


def encode(docs: DataFrame, path: str | None = None, with_decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids: one row per row of ``docs``; ``ids`` are little-endian unsigned 32-bit, with begin and end.

    ``with_decoded`` adds ``decoded`` as ``decode`` gives it, in the same pass. Null and empty texts have the two marks
    only; whole texts of any length are encoded, in memory proportional to the longest; repeated rows are encoded each;
    doc_id may be null; an empty table gives an empty result.
    """
    require(docs, "doc_id", "text")
    path = path or vocabulary("piece_bpe_32k.model")

    def part(model: Pieces, doc_ids: list, texts: list) -> pa.RecordBatch:
        ids = list(model.encode(texts))
        columns = [pa.array(doc_ids, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())]
        more = [pa.array(map(model.decode, ids), pa.string())] if with_decoded else []
        return pa.RecordBatch.from_arrays(columns + more, names=["doc_id", "n_tokens", "ids", "decoded"][: 3 + with_decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            doc_ids, texts, chars = [], [], 0
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc_ids.append(i.as_py())
                texts.append(t.as_py() or "")
                chars += len(texts[-1])
                if chars >= AT_ONCE:
                    yield part(model, doc_ids, texts)
                    doc_ids, texts, chars = [], [], 0
            yield part(model, doc_ids, texts)

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded string" * with_decoded
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``encode`` with their text as the library's decode(ids) gives it; null ids give null."""
    require(encoded, "doc_id", "n_tokens", "ids")
    path = path or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = [None if raw.as_py() is None else model.decode(np.frombuffer(raw.as_py(), "<u4")) for raw in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def op11_sentence_pieces(spark, sf_dir):
    found = encode(table(spark, sf_dir, "documents"), with_decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op11_sentence_pieces": op11_sentence_pieces}
ORACLES: dict[str, str] = {}
