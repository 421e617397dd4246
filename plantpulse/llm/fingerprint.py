"""Document fingerprints by Order MinHash.

A text's k-mers of code points are numbered by occurrence, so every one is
distinct. For each of m hash orders the l smallest are selected, put back into
text order, and their k-mers hashed as a tuple. The share of equal tuples of
two fingerprints falls with edit distance: moved passages change the order
inside the tuples although the set of k-mers is the same.

``edited_pairs`` also fingerprints a text whose tail is replaced by the head of
the next document (descending id, the last one followed by the first). The
documents are dealt once into ranges of ids; the first document of each range
also goes to the range before it, so each task sees every successor it needs.

Defined cases: NULL text is empty; an empty text has one fixed fingerprint and
is like another empty text (1.0) and unlike any other (0.0); a text shorter
than k is one k-mer; fewer than l k-mers are all taken; rows with equal ids are
ordered by text; NULL ids come last; a single document is its own successor.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, llm_query, mix64, shuffle_parts, table, texts

K, M, L = 8, 64, 2
#: k-mers whose m hashes are computed at once (memory bound for long texts).
BLOCK = 8192


class OrderMinHash:
    """Fingerprints with k-mers of ``k`` code points, ``m`` tuples of ``l``."""

    def __init__(self, k: int = K, m: int = M, l: int = L, seed: int = 1):  # noqa: E741
        self.k, self.m, self.l = k, m, l
        draw = mix64(np.arange(1, m + 1, dtype=np.uint64) + np.uint64(seed * 7919))
        self.odd = ((draw >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
        self.orders = np.arange(m)
        self.room = np.empty((m, BLOCK), np.uint32)
        self.empty = mix64(np.arange(m, dtype=np.uint64)).astype(np.uint32)

    def kmers(self, codes: np.ndarray) -> np.ndarray:
        """64-bit hashes of all k-mers, by doubling window lengths."""
        h, width, n = codes.astype(np.uint64) + np.uint64(1), 1, len(codes)
        k = min(self.k, n)
        parts, done = None, 0
        base = 0x9E3779B97F4A7C15
        while True:
            if k >> (width.bit_length() - 1) & 1:
                if parts is None:
                    parts = h[:n - k + 1]
                else:
                    parts = parts * np.uint64(pow(base, width, 1 << 64)) + h[done:done + n - k + 1]
                done += width
            if width * 2 > k:
                return mix64(parts)
            h = h[:len(h) - width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
            width *= 2

    def fingerprint(self, text: str) -> np.ndarray:
        if not text:
            return self.empty
        kmers = self.kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        n = len(kmers)
        bits = n.bit_length()
        low = np.uint64((1 << bits) - 1)
        # one sort by (k-mer, position); the place within a run is the occurrence number
        run = np.sort((kmers & ~low) | np.arange(n, dtype=np.uint64))
        kind = run & ~low
        first = np.ones(n, bool)
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        place = np.arange(n)
        nth = place - np.maximum.accumulate(np.where(first, place, 0))
        where = (run & low).astype(np.int64)
        key = mix64(kind + nth.astype(np.uint64))
        key32 = (key >> np.uint64(32)).astype(np.uint32)
        take = min(self.l, n)
        best, at = [], []
        for lo in range(0, n, BLOCK):
            part = key32[lo:lo + BLOCK]
            h = np.multiply(part[None, :], self.odd, out=self.room[:, :len(part)])
            for _ in range(min(take, len(part))):
                i = h.argmin(axis=1)
                best.append(h[self.orders, i])
                at.append(i + lo)
                h[self.orders, i] = 0xFFFFFFFF
        at = np.stack(at, axis=1)
        if at.shape[1] > take:
            at = np.take_along_axis(at, np.argsort(np.stack(best, axis=1), axis=1, kind="stable")[:, :take], 1)
        by_place = np.take_along_axis(at, np.argsort(where[at], axis=1), 1)
        tuples = np.zeros(self.m, np.uint64)
        for j in range(take):
            tuples = mix64(tuples * np.uint64(0x100000001B3) + kind[by_place[:, j]] + np.uint64(j + 1))
        return (tuples >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(fp: np.ndarray) -> str:
    return fp.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, m: int = M, l: int = L) -> DataFrame:  # noqa: E741
    """(doc_id, fingerprint) of (doc_id, text)."""
    def run(batches):
        omh = OrderMinHash(k, m, l)
        for b in batches:
            fp = [as_text(omh.fingerprint(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.string())],
                                             names=["doc_id", "fingerprint"])
    return arrow_map(docs, run, "doc_id long, fingerprint string")


def ranges_descending(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` with (bucket, is_tail): ranges of descending ids, and in each
    bucket, marked ``is_tail``, the first documents of the next one (of the
    first bucket in the last). Bounds are ``parts`` quantiles of the ids."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    shares = [i / parts for i in range(1, parts)]
    bounds = docs.select(F.percentile_approx(key, shares, 20 * parts).alias("b")).first()["b"] if shares else []
    bounds = sorted(set(bounds or []))
    above = F.lit(len(bounds))
    if bounds:
        # number of bounds below the id, by bisection over the sorted literals
        def bisect(lo: int, hi: int):
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(key > F.lit(bounds[mid]), bisect(mid + 1, hi)).otherwise(bisect(lo, mid))
        above = F.lit(len(bounds)) - (bisect(0, len(bounds)) if len(bounds) <= 64 else
                                      F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < key)))
    # one row per bucket, at most ``parts``
    heads = sorted(r["top"] for r in docs.groupBy(above.alias("bucket")).agg(F.max(key).alias("top")).collect())
    buckets = {h: len(bounds) - bisect_right(bounds, h - 1) for h in heads}
    descending = heads[::-1]
    before = {h: buckets[descending[i - 1]] for i, h in enumerate(descending)}  # -1: the last bucket, for the first
    target = F.lit(None).cast("int")
    if heads:
        target = F.element_at(F.create_map(*[F.lit(x) for h in heads for x in (h, before[h])]), key)
    spots = F.when(target.isNull(), F.array(F.struct(above.cast("int").alias("bucket"), F.lit(False).alias("is_tail")))) \
        .otherwise(F.array(F.struct(above.cast("int").alias("bucket"), F.lit(False).alias("is_tail")),
                           F.struct(target.cast("int").alias("bucket"), F.lit(True).alias("is_tail"))))
    return docs.select("doc_id", "text", F.explode(spots).alias("spot")).select("doc_id", "text", "spot.*")


def edited_pairs(docs: DataFrame, k: int = K, m: int = M, l: int = L) -> DataFrame:  # noqa: E741
    """For each (doc_id, text): n_chars, edited text's digest, both
    fingerprints, and likeness to the edited text and to the next document."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    dealt = (ranges_descending(docs, 4 * parts).repartition(parts, "bucket")
             .sortWithinPartitions("bucket", "is_tail", F.col("doc_id").desc_nulls_last(), "text"))

    def run(batches):
        omh = OrderMinHash(k, m, l)
        held = None  # (bucket, doc_id, text, fingerprint) waiting for its successor
        for b in batches:
            rows = []
            for bucket, tail, doc, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "is_tail", "doc_id", "text"))):
                text = text or ""
                open_ = held is not None and held[0] == bucket
                if tail and not open_:
                    continue  # this bucket's successor has been used
                fp = omh.fingerprint(text)
                if open_:
                    _, own, mine, own_fp = held
                    q = len(mine) // 3
                    edited = mine[:len(mine) - q] + text[:q]
                    edited_fp = omh.fingerprint(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((own, len(mine), digest, as_text(own_fp), as_text(edited_fp),
                                 likeness(own_fp, edited_fp), likeness(own_fp, fp)))
                held = None if tail else (bucket, doc, text, fp)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), *[pa.string()] * 3,
                                                                 *[pa.float64()] * 2))],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                           "near_edited", "near_next"])

    return arrow_map(dealt, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")


@llm_query("op2_order_minhash")
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_pairs(texts(table(spark, sf_dir, "documents")))
