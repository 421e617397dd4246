"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 is the vocabulary: 64-bit word hashes, ranked by value, with their
counts. A node of level k is a k-gram: its parent's number (the (k-1)-gram
before its last word) and its last word. Nodes are sorted by (parent, word), so
a parent's children are neighbours; a level stores per range of parents

* monotone pointers (Elias-Fano): where each parent's children begin,
* the children's words in as many bits as the vocabulary needs, sorted below
  each parent,
* 16-bit logarithms of discounted probabilities and of parents' back-off mass.

Probabilities interpolate absolute discounting over all levels down to the
add-one unigram: P_k(w|h) = max(c - D, 0) / c(h) + D n(h) / c(h) P_(k-1)(w|h'),
with D = n1 / (n1 + 2 n2) of the range. A look-up takes the parent's pointers
and finds the word's successor among its children by bisection.

Spark counts: each task sums its own n-grams, sends every range of parents one
compressed block, and the range's task merges blocks and writes its file to the
shared folder, replaced whole, so a repeated task leaves the same file. Scoring
tasks map the files into memory and look up the distinct n-grams of a batch in
sorted order. Only one row per file reaches the driver. On a file system that
can't be mapped the file is read instead.

Counts have 64 bits. A node's key is parent x (words + 1) + word in 63 bits; a
level whose keys would pass that is refused with an error before it is counted.

Defined cases: NULL text is empty, which is the end token alone; unknown words
get the unigram mass of unseen words and are no context; without training texts
all scores are those of an empty model; rows with equal ids are scored each.
"""

from __future__ import annotations

import mmap
import os
import struct
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, held_out, llm_query, scratch_path, shuffle_parts, table, texts
from .eliasfano import EliasFano, Packed, pack_bits
from .shingles import word_hashes

ORDER = 3
END = np.uint64(0x5EED0F7E47)  # the end token's hash
LOG_STEP = 10 / 65535  # logarithms of ten, 0 to -10, in 16 bits
#: n-grams summed in a task before blocks are sent.
HELD = 2_000_000


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a text column, and tokens per text."""
    words, counts = word_hashes([x or b"" for x in column.cast(pa.binary()).to_pylist()])
    return np.insert(words, np.cumsum(counts), END), counts + 1


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([len(keys) > 0], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their total counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_file(uri: str, data: bytes) -> None:
    """Written beside and moved into place."""
    own = f"{uri}.{TaskContext.get().taskAttemptId()}.tmp"
    if _local(uri) is not None:
        with open(_local(own), "wb") as f:
            f.write(data)
        os.replace(_local(own), _local(uri))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(own)
    with store.open_output_stream(path) as f:
        f.write(data)
    store.move(path, fs.FileSystem.from_uri(uri)[1])


def open_file(uri: str):
    if _local(uri) is not None:
        with open(_local(uri), "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read_buffer()


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-10)) / LOG_STEP), 0, 65535).astype("<u2")


_PROB = 10 ** (-np.arange(65536) * LOG_STEP)


def count_bytes(counts: np.ndarray) -> bytes:
    """Counts in 4 bytes each, or in 8 where one of them needs more."""
    return counts.astype("<u4" if not len(counts) or counts.max() < 1 << 32 else "<u8").tobytes()


def stored_counts(raw, n: int) -> np.ndarray:
    """``n`` counts written by ``count_bytes``, read in place."""
    return np.frombuffer(raw, "<u8" if len(raw) == 8 * n else "<u4", n)


class Words:
    """A range of the vocabulary: hashes and counts."""

    def __init__(self, buffer):
        self.keys = EliasFano(buffer)
        self.counts = stored_counts(memoryview(buffer)[self.keys.end:], self.keys.n)

    @staticmethod
    def build(keys, counts, universe: int) -> bytes:
        return EliasFano.encode(keys, universe) + count_bytes(counts)


class Children:
    """The children of a range of parents."""

    def __init__(self, buffer):
        self.parents, self.n, bits = struct.unpack_from("<QQQ", buffer)
        self.pointers = EliasFano(buffer, 24)
        self.words = Packed(buffer, self.n, bits, self.pointers.end)
        at = self.words.end
        self.prob = np.frombuffer(buffer, "<u2", self.n, at)
        self.back = np.frombuffer(buffer, "<u2", self.parents, at + 2 * self.n)

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray, parents: int, width: int) -> bytes:
        """From sorted (parent * width + word) keys."""
        parent = (keys // np.uint64(width)).astype(np.int64)
        fan = np.bincount(parent, minlength=parents)
        total = np.bincount(parent, counts, minlength=parents)
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        d = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        prob = quantised((counts - d) / total[parent]) if len(keys) else np.zeros(0, "<u2")
        back = quantised(np.where(total > 0, d * fan / np.maximum(total, 1), 1.0))
        pointers = np.concatenate(([0], np.cumsum(fan)))
        bits = max(1, (width - 1).bit_length())
        return (struct.pack("<QQQ", parents, len(keys), bits) + EliasFano.encode(pointers, len(keys) + 1)
                + pack_bits(keys % np.uint64(width), bits) + prob.tobytes() + back.tobytes())

    def look_up(self, parent: np.ndarray, word: np.ndarray):
        """Child number in this range (or -1), its probability (or 0), and the
        back-off mass of the parent (1 if it has no children), for sorted
        (parent, word) pairs."""
        first = np.concatenate(([True], parent[1:] != parent[:-1]))
        expand = np.cumsum(first) - 1
        begin, end = self.pointers.access_pairs(parent[first])
        lo, hi = begin[expand], end[expand]
        last, word = hi.copy(), word.astype(np.uint64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.words[mid] < word[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        at = np.full(len(parent), -1, np.int64)
        some = np.flatnonzero(lo < last)
        some = some[self.words[lo[some]] == word[some]]
        at[some] = lo[some]
        prob = np.zeros(len(parent))
        prob[some] = _PROB[self.prob[lo[some]]]
        return at, prob, _PROB[self.back[parent]]


@dataclass
class Trie:
    """Where the model's files are; a few numbers per file."""

    files: list[list[str]] = field(default_factory=list)  # per level, per range
    sizes: list[np.ndarray] = field(default_factory=list)  # nodes per range
    total: int = 0  # training tokens
    ranges: int = 1

    @property
    def vocabulary(self) -> int:
        return int(self.sizes[0].sum()) if self.sizes else 0

    def parents(self, level: int) -> int:
        """Possible parents of a level's nodes: words and the text's start, or
        the nodes of the level before."""
        return self.vocabulary + 1 if level == 2 else int(self.sizes[level - 2].sum())

    def bounds(self, level: int) -> np.ndarray:
        """First parent of each range, and the end."""
        return np.arange(self.ranges + 1) * self.parents(level) // self.ranges


def hash_range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def hash_floor(r: int, ranges: int) -> int:
    return -(-r * (1 << 32) // ranges) << 32


@lru_cache(maxsize=4096)
def _opened(uri: str, kind):
    return kind(open_file(uri))


def word_numbers(trie: Trie, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number (-1: unknown) and count of each word of a sorted hash array."""
    number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    if not trie.vocabulary:
        return number, count
    base = np.concatenate(([0], np.cumsum(trie.sizes[0])))
    edge = np.searchsorted(hash_range(hashes, trie.ranges), np.arange(trie.ranges + 1))
    for r in np.flatnonzero((edge[1:] > edge[:-1]) & (trie.sizes[0] > 0)):
        own = slice(edge[r], edge[r + 1])
        words = _opened(trie.files[0][r], Words)
        at = words.keys.find(hashes[own] - np.uint64(hash_floor(int(r), trie.ranges)))
        number[own] = np.where(at >= 0, at + base[r], -1)
        count[own] = np.where(at >= 0, words.counts[np.maximum(at, 0)], 0)
    return number, count


def children(trie: Trie, level: int, parent: np.ndarray, word: np.ndarray):
    """Node, probability and back-off mass for each (parent, word); -1, 0 and 1
    where either is unknown. Distinct pairs are looked up once, in order."""
    node, prob, back = np.full(len(parent), -1, np.int64), np.zeros(len(parent)), np.ones(len(parent))
    known = np.flatnonzero((parent >= 0))
    if not len(known) or not trie.sizes[level - 1].sum():
        return node, prob, back
    width = trie.vocabulary + 1
    # an unknown word still takes the parent's back-off mass
    key = parent[known] * width + np.where(word[known] >= 0, word[known], trie.vocabulary)
    order = np.argsort(key)
    first = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    one = key[order][first]
    up, down = one // width, one % width
    got_node, got_prob, got_back = np.full(len(one), -1, np.int64), np.zeros(len(one)), np.ones(len(one))
    bounds, base = trie.bounds(level), np.concatenate(([0], np.cumsum(trie.sizes[level - 1])))
    edge = np.searchsorted(up, bounds)
    for r in np.flatnonzero((edge[1:] > edge[:-1]) & (trie.sizes[level - 1] > 0)):
        own = slice(edge[r], edge[r + 1])
        at, got_prob[own], got_back[own] = _opened(trie.files[level - 1][r], Children).look_up(up[own] - bounds[r], down[own])
        got_node[own] = np.where(at >= 0, at + base[r], -1)
    back_to = np.empty(len(key), np.int64)
    back_to[order] = np.cumsum(first) - 1
    node[known], prob[known], back[known] = got_node[back_to], got_prob[back_to], got_back[back_to]
    return node, prob, back


def walk(trie: Trie, flat: np.ndarray, sizes: np.ndarray, levels: int):
    """Per token of whole texts: count, log-free probability by the levels up
    to ``levels``, and the (parent, word) pair of the next level."""
    distinct, back_to = np.unique(flat, return_inverse=True)
    number, count = word_numbers(trie, distinct)
    number, count = number[back_to], count[back_to]
    starts = np.cumsum(sizes) - sizes
    p = (count + 1) / (trie.total + trie.vocabulary + 1)
    node = number
    for level in range(2, levels + 2):
        parent = np.empty(len(flat), np.int64)
        parent[1:] = node[:-1]
        parent[starts] = trie.vocabulary if level == 2 else -1
        if level == levels + 1:
            return count, p, parent, number
        node, prob, back = children(trie, level, parent, number)
        p = prob + back * p


def _blocks(part: np.ndarray, keys: np.ndarray, counts: np.ndarray, floors, universes):
    """One block per range: (range, keys, counts)."""
    edge = np.searchsorted(part, np.arange(len(floors) + 1))
    rows = [(r, EliasFano.encode(keys[edge[r]:edge[r + 1]] - np.uint64(floors[r]), universes[r]),
             count_bytes(counts[edge[r]:edge[r + 1]])) for r in np.flatnonzero(edge[1:] > edge[:-1]).tolist()]
    for lo in range(0, len(rows), 16):
        r, k, c = zip(*rows[lo:lo + 16])
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())],
                                         names=["range", "keys", "counts"])


def add_level(trie: Trie, train: DataFrame, folder: str) -> None:
    """Count, merge and write the next level of the trie."""
    spark, level, ranges = train.sparkSession, len(trie.files) + 1, trie.ranges
    width = trie.vocabulary + 1
    if level == 1:
        floors = [hash_floor(r, ranges) for r in range(ranges)]
        universes = [hash_floor(r + 1, ranges) - floors[r] for r in range(ranges)]
    else:
        if trie.parents(level) * width >= 1 << 63:
            raise OverflowError(f"level {level}: {trie.parents(level)} parents x {width} words pass 63-bit keys")
        bounds = trie.bounds(level)
        floors = [int(b) * width for b in bounds[:-1]]
        universes = [max(1, int(b - a) * width) for a, b in zip(bounds, bounds[1:])]
    shared = spark.sparkContext.broadcast(trie)

    def count(batches):
        trie_, held, size = shared.value, [], 0

        def send():
            keys, counts = summed(*(np.concatenate(x) for x in zip(*held)))
            part = (hash_range(keys, ranges) if level == 1 else
                    np.searchsorted(bounds, (keys // np.uint64(width)).astype(np.int64), side="right") - 1)
            yield from _blocks(part, keys, counts, floors, universes)
        for b in batches:
            flat, sizes = tokens(b.column("text"))
            if level > 1 and len(flat):
                _, _, parent, word = walk(trie_, flat, sizes, level - 1)
                seen = (parent >= 0) & (word >= 0)
                flat = parent[seen].astype(np.uint64) * np.uint64(width) + word[seen].astype(np.uint64)
            held.append(counted(flat))
            size += len(held[-1][0])
            if size >= HELD:
                yield from send()
                held, size = [], 0
        if size:
            yield from send()

    def merge(batches):
        open_, held = None, []

        def close():
            keys, counts = summed(*(np.concatenate(x) for x in zip(*held)))
            if level == 1:
                data = Words.build(keys, counts, universes[open_])
            else:
                data = Children.build(keys, counts, int(bounds[open_ + 1] - bounds[open_]), width)
            uri = f"{folder}/level{level}-{open_:06d}.bin"
            write_file(uri, data)
            return open_, uri, len(keys), int(counts.sum())
        rows = []
        for b in batches:
            for r, k, c in zip(*(b.column(x).to_pylist() for x in ("range", "keys", "counts"))):
                if r != open_:
                    if held:
                        rows.append(close())
                    open_, held = r, []
                keys = EliasFano(k).decode()
                held.append((keys, stored_counts(c, len(keys)).astype(np.int64)))
                if len(held) > 32:
                    held = [summed(*(np.concatenate(x) for x in zip(*held)))]
        if held:
            rows.append(close())
        r, u, n, t = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(u, pa.string()), pa.array(n, pa.int64()),
                                          pa.array(t, pa.int64())], names=["range", "uri", "n", "total"])

    blocks = arrow_map(train, count, "range int, keys binary, counts binary")
    dealt = blocks.repartition(ranges, "range").sortWithinPartitions("range")
    written = arrow_map(dealt, merge, "range int, uri string, n long, total long").collect()  # a row per file
    files, sizes = [""] * ranges, np.zeros(ranges, np.int64)
    for row in written:
        files[row["range"]], sizes[row["range"]] = row["uri"], row["n"]
        trie.total += row["total"] if level == 1 else 0
    trie.files.append(files)
    trie.sizes.append(sizes)


def train(docs: DataFrame, order: int = ORDER) -> Trie:
    """Count (doc_id, text) and write the trie to the shared folder."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "ngram-trie")
    if _local(folder) is not None:
        os.makedirs(_local(folder), exist_ok=True)
    trie = Trie(ranges=shuffle_parts(spark))
    for _ in range(order):
        add_level(trie, docs.select("text"), folder)
    return trie


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(trie)

    def run(batches):
        trie_ = shared.value
        for b in batches:
            flat, sizes = tokens(b.column("text"))
            if not len(sizes):
                continue
            count, p, _, _ = walk(trie_, flat, sizes, len(trie_.files))
            starts = np.cumsum(sizes) - sizes
            base = np.log10((count + 1) / (trie_.total + trie_.vocabulary + 1))
            sums = [np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), base, np.log10(p))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes), pa.array(sums[0]), pa.array(np.full(len(sizes), trie_.total)),
                 pa.array(sums[1]), pa.array(sums[2])],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return arrow_map(docs, run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@llm_query("op3_ngram_trie")
def op3_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned from the folds whose crc32(doc_id) mod
    7 is not 2."""
    docs = texts(table(spark, sf_dir, "documents"))
    scored = score(docs, train(docs.where(~held_out("doc_id", 7, 2))))
    return scored.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")
