"""Harmonic packing of token sequences.

The capacity C has reciprocal classes: class k takes pieces of exactly
floor(C/k) ids and its bins hold exactly k of them, so a bin is full after a
fixed count and wastes C mod k ids at most. A document is cut into the largest
class size that still fits, again and again; small remainders are class sizes
themselves, so nothing is left over and a document has few pieces (one per
whole C, and mostly two to four for the rest). Every task fills its own bins
and knows no other task: no shuffle, no shared state.

Bins still open when a task ends are taken apart: their pieces are laid end to
end, cut into whole sequences, and the last stretch is cut into sequences whose
lengths are powers of two (these need no padding).

Defined cases: NULL and empty texts are the end id alone; repeated rows are
packed once per row; a text of any length is cut over as many sequences as it
needs; an empty table gives no pieces. A task holds one Arrow batch and fewer
than k pieces of each class at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, llm_query, table, texts
from .tokens import GENERATION, forget, give_back, worker_tokenizer

CAPACITY = 2048
END_ID = 1
SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def class_sizes(capacity: int) -> list[int]:
    return sorted({capacity // k for k in range(1, capacity + 1)}, reverse=True)


def cuts_by_remainder(capacity: int) -> list[list[int]]:
    """For every length below the capacity, its pieces, largest class first."""
    sizes = class_sizes(capacity)
    cuts: list[list[int]] = [[]]
    at = len(sizes) - 1
    for n in range(1, capacity):
        while at and sizes[at - 1] <= n:
            at -= 1
        cuts.append([sizes[at]] + cuts[n - sizes[at]])
    return cuts


class HarmonicPacker:
    """Bins of one task. ``add`` takes cut pieces and returns those whose bin
    is full; ``close`` returns the rest. A piece is (doc_id, start, ids,
    doc_tokens); a row adds (sequence_id, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.cuts = cuts_by_remainder(capacity)
        self.open: dict[int, list] = {}

    def add(self, doc_ids, flat: np.ndarray, sizes: np.ndarray) -> list[tuple]:
        rows, at, raw = [], 0, flat.tobytes()
        for doc, n in zip(doc_ids, sizes.tolist()):
            start = 0
            for size in [self.capacity] * (n // self.capacity) + self.cuts[n % self.capacity]:
                lo = (at + start) * 4
                piece = (doc, start, raw[lo:lo + size * 4], n)
                bin_ = self.open.setdefault(size, [])
                bin_.append(piece)
                if len(bin_) == self.capacity // size:
                    rows.extend((*p, self.sequence, i * size) for i, p in enumerate(bin_))
                    self.sequence += 1
                    bin_.clear()
                start += size
            at += n
        return rows

    def close(self) -> list[tuple]:
        left = [p for size in sorted(self.open, reverse=True) for p in self.open[size]]
        total = sum(len(p[2]) // 4 for p in left)
        rest = total % self.capacity
        lengths = [self.capacity] * (total // self.capacity)
        lengths += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        rows, room, offset, lengths = [], 0, 0, iter(lengths)
        for doc, start, ids, n in left:
            while ids:
                if not room:
                    room, offset = next(lengths), 0
                    self.sequence += 1
                take = min(room, len(ids) // 4)
                rows.append((doc, start, ids[:take * 4], n, self.sequence - 1, offset))
                start, ids, room, offset = start + take, ids[take * 4:], room - take, offset + take
        return rows


def pack(docs: DataFrame, tokenizer_path: str, leading_space: bool = False, end_id: int = END_ID,
         capacity: int = CAPACITY, cache_bytes: int = GENERATION, keep: bool = True) -> DataFrame:
    """Pieces of (doc_id, text), with their ids as little-endian 32-bit bytes.
    ``sequence_id`` is unique: the task's number above its bin counter. A Python
    worker keeps two cache generations of ``cache_bytes``; less costs time only,
    and so does dropping the tokenizer behind each task (not ``keep``)."""
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        doc, start, ids, n, seq, off = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
             pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def run(batches):
        tok = worker_tokenizer(tokenizer_path, leading_space, cache_bytes)
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << 33)
        for b in batches:
            flat, sizes = tok.encode_batch([t or "" for t in b.column("text").to_pylist()], end_id)
            rows = packer.add(b.column("doc_id").to_pylist(), flat, sizes)
            if rows:
                yield batch(rows)
        rows = packer.close()
        if rows:
            yield batch(rows)
        del tok
        if keep:
            give_back()
        else:
            forget()
    return arrow_map(docs, run, SCHEMA, tokenizes=True)


@llm_query("op8_harmonic_packing")
def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids; one row per piece."""
    import public_tokenizers

    pieces = pack(texts(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
