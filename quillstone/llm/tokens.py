"""Whole texts to token ids with a public tokenizer file, at word speed.

The tokenizer's BPE is context free between white space, so a batch is split into words by Arrow, its distinct words are
looked up in a bounded cache, and only words that are new to the worker go through the tokenizers library.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The two rules of the tokenizer file that a word's pieces depend on.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts with these go whole through the library: special tokens' strings, and separators on which rules differ. White
#: space beyond ASCII inside a chunk parts its pieces anyway.
_ODD = regex.compile("<\\||[\x1c-\x1f᠎]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE uses for each byte: itself if printable, else the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Words:
    """White-space separated chunks of lower-case text and their ids, which lie end to end in one array.

    When ``most`` chunks are held, all are forgotten and learned anew as they come.
    """

    def __init__(self, tokenizer, most: int) -> None:
        self.model, self.most, self.letters = tokenizer.model, most, _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])
        #: Places of chunks whose texts must go whole through the library.
        self.odd: set[int] = set()

    def places(self, chunks: list[str]) -> np.ndarray:
        """The place of each of these distinct chunks among the known ones."""
        found = np.fromiter(map(self.known.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        new = np.flatnonzero(found < 0).tolist()
        if len(self.known) + len(new) > self.most:
            self._forget()
            new = range(len(chunks))
        for i in new:
            found[i] = self._learn(chunks[i])
        return found

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks at these places, end to end, and how many each has."""
        flat, ends = np.array(self.flat, dtype=np.uint32), np.array(self.ends, dtype=np.int64)
        n = (ends[1:] - ends[:-1])[at]
        before = np.cumsum(n) - n
        return flat[np.arange(int(n.sum())) + np.repeat(ends[at] - before, n)], n

    def _learn(self, chunk: str) -> int:
        if chunk in self.known:  # as the head of one before it
            return self.known[chunk]
        head = chunk.rstrip(".,;:!?")
        if chunk.isalpha() and len(chunk) < 1000:
            ids = self._piece(chunk)
        elif head and len(head) < len(chunk) and head.isalpha() and len(head) < 1000:  # a word and its punctuation, which is one piece
            ids = [*self._ids(self._learn(head)), *self._ids(self._learn(chunk[len(head) :]))]
        else:
            ids = [i for x in _PIECE.findall(chunk) for i in self._piece(x)]
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        self.known[chunk] = at = len(self.ends) - 2
        if _ODD.search(chunk):
            self.odd.add(at)
        return at

    def _ids(self, at: int) -> array:
        return self.flat[self.ends[at] : self.ends[at + 1]]

    def _piece(self, text: str) -> list[int]:
        mapped = text if text.isascii() and text.isprintable() else "".join([self.letters[b] for b in text.encode("utf-8", "surrogatepass")])
        return [t.id for t in self.model.tokenize(mapped)]


class Encoder:
    """The ids that the tokenizers library gives with add_special_tokens=False, for batches of whole texts."""

    def __init__(self, path: str, cache_words: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer, cache_words)

    def batch(self, texts: list[str | None], most: int = 8_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has. Taken up in slices of about ``most`` characters."""
        ids, counts, part, size = [], [], [], 0
        for k, text in enumerate(texts, 1):
            part.append(text or "")
            size += len(part[-1])
            if size > most or k == len(texts):
                own, n = self._slice(part)
                ids.append(own)
                counts.append(n)
                part, size = [], 0
        none = [np.empty(0, dtype=np.uint32)], [np.empty(0, dtype=np.int64)]
        return np.concatenate(ids or none[0]), np.concatenate(counts or none[1])

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return self.batch([text])[0].astype("<u4").tobytes()

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = []
        for text in texts:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
                if "Σ" in text:
                    text = text.replace("Σ", "σ")  # the library lower-cases letter by letter
            plain.append(text.lower())
        chunks = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
        offsets, words = np.asarray(chunks.offsets), chunks.flatten().dictionary_encode()
        at = self.words.places(words.dictionary.to_pylist())[words.indices.to_numpy()]
        ids, n = self.words.gather(at)
        upto = np.concatenate([[0], np.cumsum(n)])[offsets - offsets[0]]
        counts = np.diff(upto)
        if self.words.odd:
            where = np.searchsorted(offsets - offsets[0], np.flatnonzero(np.isin(at, list(self.words.odd))), side="right") - 1
            odd = {i: np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32) for i in set(where.tolist())}
            ids = np.concatenate([odd[i] if i in odd else ids[upto[i] : upto[i + 1]] for i in range(len(texts))])
            counts[list(odd)] = [len(x) for x in odd.values()]
        return ids, counts


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_words: int = 800_000) -> Encoder:
    """One encoder per worker process, file and size of cache, so that its cache outlives a task."""
    if (path, cache_words) not in _ENCODERS:
        _ENCODERS[path, cache_words] = Encoder(path, cache_words)
    return _ENCODERS[path, cache_words]
