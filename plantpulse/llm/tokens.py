"""Whole-text ids from a public tokenizer file, each distinct chunk encoded once.

The tokenizers library spends most of its time on words it has seen before. A
text is therefore cut at places no pre-token crosses (single spaces), and a
worker keeps the ids of recent chunks in a bounded two-generation cache; only
new chunks reach the library. As the library does by default, a text is first
cut at the strings of the vocabulary's special tokens, which become their ids.
The result equals encoding whole texts (tests compare both on given and
generated texts).
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from array import array

import numpy as np

from .common import space_chunks, trim

#: Bytes of one cache generation (two are kept, so memory stays bounded), and
#: what an entry takes besides its characters and ids.
GENERATION, ENTRY = 72 << 20, 160
#: Characters looked up together.
TOGETHER = 1 << 20

#: Marks that compose with a letter before them.
_MARK = re.compile("[\u0300-\u036f]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: a
    printable Latin-1 byte for itself, the others counted up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class ChunkTokenizer:
    """``leading_space`` says that the vocabulary keeps spaces in front of
    words (byte-level); otherwise white space is dropped and letters are
    lower-cased by the tokenizer itself."""

    def __init__(self, path: str, leading_space: bool, cache_bytes: int = GENERATION):
        self.cache_bytes = cache_bytes
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in self.tok.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that reach beyond their own string are not supported")
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added_ids = {c: np.array([i], "<u4").tobytes() for c, i in added.items()}
        self.leading_space = leading_space
        self.model = self.tok.model
        self.letters = byte_letters()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of the newer generation
        self.marks = {m: self._plain([m])[0] for m in (".", ",")}

    def _plain(self, parts: list[str]) -> list[bytes]:
        got = self.tok.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _letters_only(self, word: str) -> str | None:
        """``word`` as its one pre-token in the vocabulary's letters, if it is
        letters only, also after the tokenizer's own normalising."""
        if not word.isalpha():
            return None
        if word.isascii():
            return word if self.leading_space else word.lower()
        if not self.leading_space:
            word = unicodedata.normalize("NFC", word)
            # letter by letter: Python alone has a small sigma for the end of a word
            word = "".join([c.lower() for c in word]) if "Σ" in word else word.lower()
            if not word.isalpha():
                return None
        return word.encode("utf-8").decode("latin-1").translate(self.letters)

    def _lower(self, text: str) -> str:
        """``text`` with A-Z lower-cased, as the tokenizer does after composing
        letters with their marks; texts with such marks are left as they are (J
        with a caron is no single letter, but j with a caron is), and those
        that would hold a special token only then."""
        if not text.isascii() and _MARK.search(text):
            return text
        low = text.encode("utf-8").lower().decode("utf-8")
        return text if self.added is not None and self.added.search(low) else low

    def _key(self, chunk: str) -> tuple[str, bytes]:
        """The chunk without a closing mark that is a token of its own behind
        letters, and that mark's ids; lower-cased where the tokenizer does."""
        tail = b""
        if chunk[-1:] in self.marks and self._letters_only(chunk[:-1]) is not None:
            chunk, tail = chunk[:-1], self.marks[chunk[-1]]
        if not self.leading_space and chunk.isascii():
            chunk = self._lower(chunk)
        return chunk, tail

    def _encode_keys(self, keys: list[str]) -> list[bytes]:
        """Ids of new chunks: a word of letters is one pre-token and goes to
        the merges directly, anything else through the whole tokenizer."""
        lead, space = ("Ġ", " ") if self.leading_space else ("", "")
        # keys of ASCII letters are lower-cased already where the tokenizer does
        words = [k if k.isascii() and k.isalpha() else self._letters_only(k) for k in keys]
        mixed = iter(self._plain([space + k for k, w in zip(keys, words) if w is None]))
        tokenize = self.model.tokenize
        return [next(mixed) if w is None else array("I", [t.id for t in tokenize(lead + w)]).tobytes()
                for w in words]

    def _fill(self, chunks: list[str], got: list, lack: list[int]) -> None:
        """Ids of the chunks that the current generation lacks."""
        new, old = self.new, self.old
        ids_of: dict = dict.fromkeys([chunks[i] for i in lack])
        fresh: dict = {}
        forms = []  # chunks that are not their own key
        for c in ids_of:
            if c.isalpha() and c.isascii() and (self.leading_space or c.islower()):
                k = c
            else:
                k, tail = self._key(c)
                if k != c:
                    forms.append((c, k, tail))
                    if k in new:
                        continue
            ids = old.get(k)
            if ids is None:
                fresh[k] = None
            else:
                new[k] = ids
                self.held += len(k) + len(ids) + ENTRY
        if fresh:
            coded = self._encode_keys(list(fresh))
            new.update(zip(fresh, coded))
            self.held += sum(map(len, fresh)) + sum(map(len, coded)) + ENTRY * len(fresh)
        for c, k, tail in forms:
            ids = new[c] = new[k] + tail
            self.held += len(c) + len(ids) + ENTRY
        for i in lack:
            got[i] = new[chunks[i]]
        if self.held >= self.cache_bytes:
            self.old, self.new, self.held = new, {}, 0

    def encode_batch(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``end_id``, and their counts.
        A few texts at a time: the lists of chunks are many times their size."""
        parts, start, size = [], 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= TOGETHER:
                parts.append(self._encode_few(texts[start:i + 1], end_id))
                start, size = i + 1, 0
        parts.append(self._encode_few(texts[start:], end_id))
        ids, sizes = zip(*parts)
        return np.concatenate(ids), np.concatenate(sizes)

    def _encode_few(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        end = np.array([end_id], "<u4").tobytes()
        if self.added is not None and any(map(self.added.search, texts)):
            cut = [self.added.split(text) for text in texts]  # every other piece is a special token
            ids, sizes = self._encode_plain([p for pieces in cut for p in pieces[::2]])
            out, at, i = [], 0, 0
            for pieces in cut:
                own = []
                for j, piece in enumerate(pieces):
                    if j % 2:
                        own.append(self.added_ids[piece])
                    else:
                        own.append(ids[at:at + sizes[i]].tobytes())
                        at, i = at + int(sizes[i]), i + 1
                out.append(b"".join(own) + end)
            return np.frombuffer(b"".join(out), "<u4"), np.array([len(x) >> 2 for x in out], np.int64)
        return self._encode_plain(texts, end)

    def _encode_plain(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Texts without special tokens, each followed by ``end``."""
        flat, heads, edges = [], [], [0]
        for text in texts:
            if self.leading_space:
                chunks = space_chunks(text)
                heads.append(chunks[0] if chunks else "")
                flat += chunks[1:]
            else:  # white space is dropped, so a line break may be a space
                flat += self._lower(text).replace("\n", " ").split(" ")
            edges.append(len(flat))
        got = list(map(self.new.get, flat))
        lack = [i for i, x in enumerate(got) if x is None]
        if lack:
            self._fill(flat, got, lack)
        first = self._plain(heads) if heads else [b""] * len(texts)
        out = [h + b"".join(got[a:b]) + end for h, a, b in zip(first, edges, edges[1:])]
        sizes = np.array([len(x) >> 2 for x in out], np.int64)
        return np.frombuffer(b"".join(out), "<u4"), sizes


_TOKENIZERS: dict[tuple, ChunkTokenizer] = {}


def worker_tokenizer(path: str, leading_space: bool, cache_bytes: int = GENERATION) -> ChunkTokenizer:
    """One per Python worker; the file lies with the workers' Python."""
    key = (path, leading_space, cache_bytes)
    if key not in _TOKENIZERS:
        forget()  # of the other vocabulary
        _TOKENIZERS[key] = ChunkTokenizer(*key)
    return _TOKENIZERS[key]


def forget() -> None:
    """Drop this worker's tokenizers and their caches."""
    if _TOKENIZERS:
        _TOKENIZERS.clear()
        give_back()


def give_back() -> None:
    """Collect what is unreachable and return its memory to the system."""
    gc.collect()
    trim()
