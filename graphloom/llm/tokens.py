"""Tokenizing inside tasks with the tokenizers library, each distinct run of characters once per worker.

A text is cut where the tokenizer's own pre-tokenizer cuts in any case (between a non-space and white space), so the
ids of the pieces, joined, are the ids of the whole text. Texts for which that isn't certain are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that a worker remembers; beyond that it starts anew.
REMEMBERED = 800_000
#: Characters that are encoded at once.
AT_ONCE = 4_000_000
#: Pieces that are encoded as one text, and such texts at once.
TOGETHER, TEXTS = 500, 64
#: A stop or comma before white space that does not end a word.
_RUN = re.compile(r"[.,]\s(?<![^\W_]..)", re.DOTALL)
_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+\Z")
#: White space besides the four above, controls that are white space to some only, and the marks of pieces.
_UNSURE = re.compile("[\x00\x01\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _spread(text: str) -> str:
    """The text in lower case with blanks before full stops and commas that end a word, where neither changes an id.

    For vocabularies that lower-case and drop white space. Left alone: text that isn't in composed form before and
    after, a capital sigma (its lower case depends on the place), and stops and commas that are part of a longer run.
    """
    low = text.lower()
    if not text.isascii() and ("Σ" in text or not (is_normalized("NFC", text) and is_normalized("NFC", low))):
        return text
    return low if _RUN.search(low) else low.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n").replace(",\n", " ,\n")


class Encoder:
    """Ids of texts as little-endian bytes, 2 per id if the vocabulary allows, else 4."""

    def __init__(self, path: str, spaces_count: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.spaces_count, self.known, self.chunks = spaces_count, {}, {}
        # What is put between pieces that are encoded as one text: cut off by every pre-tokenizer of the kind, one id.
        self.between = "\n" if spaces_count else "|"
        ids = self.model.encode(self.between, add_special_tokens=False).ids
        self.mark = ids[0] if len(ids) == 1 else None

    def _bytes(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids, one after another."""
        found = [e.ids for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]
        raw = np.fromiter(chain.from_iterable(found), dtype=self.dtype).tobytes()
        ends = list(accumulate(map(len, found)))
        size = self.dtype.itemsize
        return [raw[(end - len(x)) * size : end * size] for x, end in zip(found, ends, strict=True)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        """As ``_bytes``, for pieces without white space inside: many are encoded as one text, with marks between them.

        Where the marks that come back are not as many as were put in, the pieces are encoded one by one.
        """
        plain = [p for p in pieces if self.between not in p] if self.mark is not None else []
        made: dict[str, bytes] = {}
        join, size = ("\n" if self.spaces_count else " | "), self.dtype.itemsize
        for at in range(0, len(plain), TOGETHER * TEXTS):
            groups = [plain[i : i + TOGETHER] for i in range(at, min(len(plain), at + TOGETHER * TEXTS), TOGETHER)]
            for group, e in zip(groups, self.model.encode_batch_fast([join.join(g) + join.rstrip(" ") for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=self.dtype)
                ends = np.flatnonzero(ids == self.mark)
                if len(ends) == len(group):
                    raw = ids.tobytes()
                    begins = np.concatenate([[0], ends[:-1] + 1])
                    made.update((p, raw[i:j]) for p, i, j in zip(group, (begins * size).tolist(), (ends * size).tolist(), strict=True))
        rest = [p for p in pieces if p not in made]
        if rest:
            made.update(zip(rest, self._bytes(rest), strict=True))
        return [made[p] for p in pieces]

    def _pieces(self, text: str) -> str | list[str] | None:
        """Text whose parts between blanks are the pieces, or the pieces; None for texts that are encoded whole."""
        if not text or "<|" in text or _UNSURE.search(text):
            return None
        if not self.spaces_count:
            return _spread(text).replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if text[0] in " \n" or text[-1] in " \n" or any(two in text for two in ("  ", " \n", "\n ", "\n\n", "\t", "\r")):
            return _PIECE.findall(text)
        # White space is single: a piece has a blank before it, or begins with its line break, or is the first, or is
        # the stop or comma that ends a word.
        low = text.replace("\n", " \n")
        if not _RUN.search(text):
            low = low.replace(". ", " \1. ").replace(", ", " \1, ")
        return "\0" + low

    def _known(self, known: dict[str, bytes], pieces: list[str]) -> list[bytes]:
        """The ids of each piece, from memory or encoded and remembered."""
        if len(known) > REMEMBERED:
            known.clear()
        found = list(map(known.get, pieces))
        missing = list({p for p, raw in zip(pieces, found, strict=True) if raw is None})
        if not missing:
            return found
        whole = missing
        if self.spaces_count and known is self.known:
            whole = [p[1:] if p[0] in "\0\1" else p if p[0] == "\n" else " " + p for p in missing]
        known.update(zip(missing, (self._together if known is self.known else self._bytes)(whole), strict=True))
        return list(map(known.__getitem__, pieces))

    def _split(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are cut at every blank: distinct pieces are looked up once, their ids then gathered."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        pieces = cut.flatten().dictionary_encode()
        raws = self._known(self.known, pieces.dictionary.to_pylist())
        ids = pa.array(raws, pa.large_binary()).take(pieces.indices)
        _, ends, data = ids.buffers()
        if data is None:
            return [b""] * len(texts)
        bounds = np.frombuffer(ends, np.int64, len(ids) + 1, ids.offset * 8)[cut.offsets.to_numpy()].tolist()
        view = memoryview(data)
        return [bytes(view[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; null and empty texts have none."""
        held, chars = [], 0
        for text in texts:
            held.append(text or "")
            chars += len(held[-1])
            if chars >= AT_ONCE:
                yield from self._encode(held)
                held, chars = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._pieces(t) for t in texts]
        split = [c for c in cut if isinstance(c, str)]
        done = iter(self._split(split) if split else [])
        out = []
        for text, c in zip(texts, cut, strict=True):
            if isinstance(c, str):
                out.append(next(done))
            elif c is None:
                out.append(self._bytes([text])[0])
            else:
                out.append(b"".join(self._known(self.chunks, c)))
        return out


@lru_cache(maxsize=4)
def encoder(path: str, spaces_count: bool) -> Encoder:
    """One for each Python worker. ``spaces_count``: white space yields ids of its own (byte-level vocabularies)."""
    return Encoder(path, spaces_count)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
