"""Byte-level BPE encoding and decoding by longest-match backtracking.

The vocabulary's byte strings, mapped to Latin-1, form an Aho-Corasick
automaton. Encoding walks a piece from longest match to longest match, and
steps to the next shorter token, or back over the last one, when two adjacent tokens could not
stand side by side in the merged result. Every position is left for good at
most once, so the work is linear in the piece. Whether two tokens may be
neighbours depends on the pair alone: the test undoes their merges along the
boundary and is memoised.

A piece that is itself a token is that token. Repeated chunks of a text are
encoded once per worker (bounded cache). Defined cases: NULL text is empty and
has no ids; whole texts of any length are one row; equal texts have equal ids;
decoding ids outside the vocabulary fails.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, list_column, llm_query, space_chunks, table, texts

#: Entries after which a worker's chunk cache is emptied (memory bound).
CACHE_ENTRIES = 400_000
PAIR_ENTRIES = 1_000_000


class BacktrackingBPE:
    """Encoder over a rank table (token bytes -> rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.split = regex.compile(pattern)
        self.parts = {r: self._last_merge(b) for b, r in ranks.items()}
        self.shorter = {r: self._longest_prefix(b) for b, r in ranks.items()}
        self.machine = ahocorasick.Automaton()
        for b, r in ranks.items():
            if self.parts[r] is not None:  # tokens that merges never form stand alone only
                self.machine.add_word(b.decode("latin-1"), r)
        self.machine.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, list[int]] = {}
        self.pieces: dict[str, list[int]] = {}

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge forms ``token`` (itself twice for a
        single byte), or None if merging its bytes ends elsewhere."""
        if len(token) == 1:
            return self.ranks[token], self.ranks[token]
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] >= self.ranks[token]:
                return None
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _longest_prefix(self, token: bytes) -> int | None:
        for n in range(len(token) - 1, 0, -1):
            r = self.ranks.get(token[:n])
            if r is not None and self.parts[r] is not None:
                return r
        return None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges of ``a`` then ``b`` leave the two side by side:
        no earlier merge may have joined bytes across the boundary."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, bound, ok = a, b, 1 << 60, True
        while True:
            joined = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
            if joined is not None and joined < bound:
                ok = False
                break
            # undo the later of the two merges next; ties undo the right one
            x_single, y_single = len(self.bytes_of[x]) == 1, len(self.bytes_of[y]) == 1
            if x_single and y_single:
                break
            if y_single or (not x_single and x > y):
                bound, x = x, self.parts[x][1]
            else:
                bound, y = y + 1, self.parts[y][0]
        if len(self.fits) >= PAIR_ENTRIES:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, size = piece.decode("latin-1"), len(piece)
        out: list[int] = []
        dead = bytearray(size + 1)
        matches = self.machine.iter_long(text)  # leftmost longest; every byte is a token, so they adjoin
        pos, token = 0, next(matches)[1]
        straight = True  # ``matches`` stands right behind ``token``
        while True:
            end = pos + len(self.bytes_of[token])
            if not dead[end] and (not out or self.may_follow(out[-1], token)):
                out.append(token)
                pos = end
                if pos == size:
                    return out
                if not straight:
                    matches, straight = self.machine.iter_long(text, pos), True
                token = next(matches)[1]
                continue
            straight = False
            short = self.shorter[token]
            if short is not None:
                token = short
                continue
            dead[pos] = 1  # nothing fits here after what stands before
            token = out.pop()
            pos -= len(self.bytes_of[token])

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a space followed by ``chunk`` (cached under ``chunk``)."""
        ids = []
        for piece in self.split.findall(" " + chunk):
            known = self.pieces.get(piece)
            if known is None:
                known = self.encode_piece(piece.encode("utf-8"))
                if len(piece) < 64:
                    if len(self.pieces) >= CACHE_ENTRIES:
                        self.pieces.clear()
                    self.pieces[piece] = known
            ids += known
        if len(chunk) < 64:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[chunk] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        chunks = space_chunks(text)
        if not chunks:
            return []
        first = [i for piece in self.split.findall(chunks[0]) for i in self.encode_piece(piece.encode("utf-8"))]
        del chunks[0]
        lists = list(map(self.cache.get, chunks))
        if None in lists:
            one = self.encode_chunk
            lists = [one(c) if ids is None else ids for ids, c in zip(lists, chunks)]
        first.extend(chain.from_iterable(lists))
        return first

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def worker_encoder(path: str, pattern: str) -> BacktrackingBPE:
    """One encoder per Python worker; the vocabulary is installed with the
    workers' Python, like any library file."""
    return BacktrackingBPE(read_ranks(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids: array<int>) of (doc_id, text)."""
    def run(batches):
        bpe = worker_encoder(ranks_path, pattern)
        for b in batches:
            ids = [np.array(bpe.encode(t or ""), np.int32) for t in b.column("text").to_pylist()]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), list_column(flat, [len(x) for x in ids], pa.int32())],
                                             names=["doc_id", "ids"])
    return arrow_map(docs, run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded: binary) of (doc_id, ids)."""
    def run(batches):
        table_ = worker_encoder(ranks_path, pattern).bytes_of
        for b in batches:
            col = b.column("ids")
            flat, off = col.flatten().to_numpy(), col.offsets.to_numpy() - col.offsets[0].as_py()
            parts = list(map(table_.__getitem__, flat.tolist()))
            out = [b"".join(parts[off[i]:off[i + 1]]) for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), col, pa.array(out, pa.binary())],
                                             names=["doc_id", "ids", "decoded"])
    return arrow_map(encoded, run, "doc_id long, ids array<int>, decoded binary")


@llm_query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    done = decode(encode(texts(table(spark, sf_dir, "documents")), path, pattern), path, pattern)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
