"""Line deduplication over whole texts by two Bloom filters.

Every task hashes the keys of its lines (a key is the line without white space
at its ends, A-Z lower-cased) and marks them in two filters: keys it has seen
once, and keys it has seen in two documents. The filters are cut into segments;
a segment's pieces meet in one place, where a bit that two pieces hold as seen
once becomes seen twice. The twice-seen filter, folded to a fixed size, goes to
every task. Only lines that it suspects leave their documents: they are counted
exactly by their full key, partial sums first, so a line that a third of all
documents hold is one row a task. Lines of confirmed keys are then dropped.

The once-seen filter grows with the number of lines (``BITS_PER_LINE``) and is
never gathered. Folding or overfilling the twice-seen filter lets more lines
through to the exact count and changes no result. Confirmed keys go to every
task while they are at most ``KEY_BYTES`` together; beyond, the suspected lines
are joined with them and each text with its own list of lines.

Defined cases: a row is a document, whatever its id, so repeated rows count each;
NULL and empty texts are one empty line; an empty key is never dropped when
``min_chars`` is 1 or more; texts whose lines all go become empty; lines are cut
at line feeds only and come back as they were; with ``keep_first`` the line of
the smallest (doc_id, line number) stays, NULL ids last, and rows that have that
same id and text all keep it; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, llm_query, mix64, scratch, shuffle_parts, table, texts
from .shingles import _BASE, _BLANK, _INVERSE, _LOWER, _VALUE, _powers

#: Bits of the once-seen filter for every line of the corpus.
BITS_PER_LINE = 16
#: A segment has 2^20 to 2^26 bits: more and smaller ones for small inputs.
SEGMENT_BITS, SEGMENTS = (20, 26), 1024
#: Bits of the folded twice-seen filter that every task holds (16 MB).
FOLDED_BITS = 1 << 27
#: Hashes a task gathers before it hands on its pieces of the filters.
FLUSH = 1 << 20
#: Bytes of confirmed keys that go to every task.
KEY_BYTES = 32 << 20


class Lines:
    """The lines of some texts: bounds, key bounds, key hashes and the text of each."""

    def __init__(self, raw: list[bytes]):
        self.raw = b"\n".join([*raw, b""])
        data = np.frombuffer(self.raw, np.uint8)
        self.end = np.flatnonzero(data == 10)
        self.start = np.concatenate(([0], self.end[:-1] + 1))
        self.low = _LOWER[data]
        solid = np.flatnonzero(~_BLANK[data])
        first, last = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        full = last > first
        self.key_start, self.key_end = self.start.copy(), self.start.copy()
        self.key_start[full], self.key_end[full] = solid[first[full]], solid[last[full] - 1] + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[self.low] * _powers(_BASE, len(data)), out=sums[1:])
        length = (self.key_end - self.key_start).astype(np.uint64)
        back = _powers(_INVERSE, len(data))[self.key_start]
        self.hash = mix64((sums[self.key_end] - sums[self.key_start]) * back + length)
        edges = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw])))
        self.counts = np.diff(np.searchsorted(self.start, edges))
        self.row = np.repeat(np.arange(len(raw)), self.counts)

    def long_enough(self, min_chars: int) -> np.ndarray:
        """Lines whose key has at least so many code points."""
        heads = np.concatenate(([0], np.cumsum((self.low & 0xC0) != 0x80)))
        return heads[self.key_end] - heads[self.key_start] >= min_chars

    def key(self, i: int) -> bytes:
        return self.low[self.key_start[i]:self.key_end[i]].tobytes()

    def line(self, i: int) -> bytes:
        return self.raw[self.start[i]:self.end[i]]


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _once_a_row(lines: Lines, at: np.ndarray) -> np.ndarray:
    """The first of the equal keys of each text, among the lines ``at``."""
    order = at[np.lexsort((at, lines.hash[at], lines.row[at]))]
    h, r = lines.hash[order], lines.row[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return order[new]


class Geometry:
    """Two places of every hash, in one segment of a filter of 2^bits bits."""

    def __init__(self, n_lines: int, folded_bits: int = FOLDED_BITS):
        bits = max(SEGMENT_BITS[0], (max(1, n_lines) * BITS_PER_LINE - 1).bit_length())
        self.segment_bits = min(SEGMENT_BITS[1], max(SEGMENT_BITS[0], bits - SEGMENTS.bit_length() + 1))
        self.bits = bits
        self.folded = min(folded_bits, 1 << bits)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.uint64((1 << self.segment_bits) - 1)
        one = h & np.uint64((1 << self.bits) - 1)
        two = (one & ~inside) | (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(38) & inside)
        return one.astype(np.int64), two.astype(np.int64)

    def fold(self, places: np.ndarray) -> np.ndarray:
        return places & (self.folded - 1)


def _pack(places: np.ndarray) -> bytes:
    """Sorted places as compressed differences."""
    return zstandard.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 3)


def _unpack(payload: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(payload), "<u4"), dtype=np.int64)


def filter_pieces(docs: DataFrame, shape: Geometry, min_chars: int) -> DataFrame:
    """(segment, twice, payload): what each task has seen, segment by segment."""
    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0

        def rows(hashes, twice):
            places = np.unique(np.concatenate(shape.places(hashes)))
            segments = places >> shape.segment_bits
            cuts = np.flatnonzero(np.diff(segments)) + 1
            for part in np.split(places, cuts) if len(places) else []:
                segment = int(part[0]) >> shape.segment_bits
                yield segment, twice, _pack(part & ((1 << shape.segment_bits) - 1))

        def flush():
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            out = [*rows(hashes, False), *rows(hashes[n > 1], True)]
            if out:
                seg, twice, payload = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(seg, pa.int64()), pa.array(twice, pa.bool_()),
                                                  pa.array(payload, pa.binary())], names=["segment", "twice", "payload"])
        for b in batches:
            if not b.num_rows:
                continue
            lines = Lines(_raw(b))
            own = lines.hash[_once_a_row(lines, np.flatnonzero(lines.long_enough(min_chars)))]
            held.append(own)
            size += len(own)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()
    return arrow_map(docs.select("text"), run, "segment long, twice boolean, payload binary")


def twice_seen(pieces: DataFrame, shape: Geometry) -> DataFrame:
    """(p): places of the folded twice-seen filter. Pieces of a segment meet in
    one task and are merged one at a time."""
    def run(batches: Iterator[pa.RecordBatch]):
        segment = once = twice = None

        def close():
            at = np.unique(shape.fold(np.flatnonzero(twice) + (segment << shape.segment_bits)))
            for lo in range(0, len(at), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(at[lo:lo + (1 << 18)], pa.int64())], names=["p"])
        for b in batches:
            for s, is_twice, payload in zip(*(b.column(c).to_pylist() for c in ("segment", "twice", "payload"))):
                if s != segment:
                    if segment is not None:
                        yield from close()
                    segment, once, twice = s, np.zeros(1 << shape.segment_bits, bool), np.zeros(1 << shape.segment_bits, bool)
                at = _unpack(payload)
                if is_twice:
                    twice[at] = True
                else:
                    twice[at[once[at]]] = True
                    once[at] = True
        if segment is not None:
            yield from close()
    parts = shuffle_parts(pieces.sparkSession)
    return arrow_map(pieces.repartition(parts, "segment").sortWithinPartitions("segment"), run, "p long")


def _folded_words(places: DataFrame, shape: Geometry) -> np.ndarray:
    """The folded filter on the driver: at most ``FOLDED_BITS`` / 32 rows come."""
    words = (places.groupBy(F.shiftright("p", 5).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 AS int))")).alias("bits")).toArrow())
    out = np.zeros(max(1, shape.folded >> 5), np.uint32)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _suspects(lines: Lines, words: np.ndarray, shape: Geometry, min_chars: int) -> np.ndarray:
    """Lines of long enough keys that the folded filter holds."""
    at = np.flatnonzero(lines.long_enough(min_chars))
    for which in (0, 1):
        p = shape.fold(shape.places(lines.hash[at])[which])
        at = at[(words[p >> 5] >> (p & 31).astype(np.uint32) & np.uint32(1)).astype(bool)]
    return at


def suspected_keys(docs: DataFrame, shared, shape: Geometry, min_chars: int) -> DataFrame:
    """(key, n, no_id, first_id, first_line): a batch's suspected keys, the
    number of documents with each, and the first place."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            lines = Lines(_raw(b))
            begin = np.concatenate(([0], np.cumsum(lines.counts)))
            ids = b.column("doc_id").to_pylist()
            found: dict[bytes, list] = {}
            for i in _once_a_row(lines, _suspects(lines, shared.value, shape, min_chars)).tolist():
                row = lines.row[i]
                place = (ids[row] is None, ids[row] or 0, i - int(begin[row]))
                seen = found.setdefault(lines.key(i), [0, place])
                seen[0] += 1
                seen[1] = min(seen[1], place)
            if found:
                n, place = zip(*found.values())
                none, first, line = zip(*place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.decode() for k in found], pa.string()), pa.array(n, pa.int64()), pa.array(none, pa.bool_()),
                     pa.array(first, pa.int64()), pa.array(line, pa.int64())],
                    names=["key", "n", "no_id", "first_id", "first_line"])
    return arrow_map(docs, run, "key string, n long, no_id boolean, first_id long, first_line long")


def confirmed_keys(suspected: DataFrame, min_docs: int) -> DataFrame:
    """(key, no_id, first_id, first_line) of the keys found in at least ``min_docs`` documents."""
    first = F.min(F.struct("no_id", "first_id", "first_line")).alias("first")
    return suspected.groupBy("key").agg(F.sum("n").alias("n"), first).where(F.col("n") >= min_docs).select("key", "first.*")


def _text_of(lines: Lines, row: int, begin: np.ndarray, gone: set[int]) -> bytes:
    return b"\n".join([lines.line(i) for i in range(begin[row], begin[row + 1]) if i not in gone])


def _result(b: pa.RecordBatch, lines: Lines, gone: dict[int, set[int]]) -> pa.RecordBatch:
    begin = np.concatenate(([0], np.cumsum(lines.counts))).tolist()
    kept = b.column("text").to_pylist()
    for row, own in gone.items():
        kept[row] = _text_of(lines, row, begin, own).decode()
    dropped = [len(gone.get(i, ())) for i in range(b.num_rows)]
    return pa.RecordBatch.from_arrays(
        [b.column("doc_id"), pa.array(kept, pa.string()), pa.array(lines.counts, pa.int64()), pa.array(dropped, pa.int64())],
        names=["doc_id", "text", "n_lines", "n_dropped"])


RESULT = "doc_id long, text string, n_lines long, n_dropped long"


def _drop_shared(docs: DataFrame, keys: DataFrame, words, shape: Geometry, min_chars: int, keep_first: bool) -> DataFrame:
    """Lines of the confirmed keys dropped where the documents lie; ``keys`` is bounded."""
    got = keys.toArrow()
    first = zip(*(got.column(c).to_pylist() for c in ("no_id", "first_id", "first_line")))
    shared = docs.sparkSession.sparkContext.broadcast(
        {k.encode(): f for k, f in zip(got.column("key").to_pylist(), first)})

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            lines = Lines(_raw(b))
            begin = np.concatenate(([0], np.cumsum(lines.counts)))
            ids = b.column("doc_id").to_pylist() if keep_first else None
            gone: dict[int, set[int]] = {}
            for i in _suspects(lines, words.value, shape, min_chars).tolist():
                first = shared.value.get(lines.key(i))
                if first is None:
                    continue
                row = int(lines.row[i])
                if keep_first and first == (ids[row] is None, ids[row] or 0, i - int(begin[row])):
                    continue
                gone.setdefault(row, set()).add(i)
            yield _result(b, lines, gone)
    return arrow_map(docs, run, RESULT)


def _drop_joined(docs: DataFrame, keys: DataFrame, words, shape: Geometry, min_chars: int, keep_first: bool) -> DataFrame:
    """The same for any number of confirmed keys: suspected lines are joined
    with them, and each text with the numbers of its lines that go."""
    named = docs.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))

    def occurrences(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            lines = Lines(_raw(b))
            begin = np.concatenate(([0], np.cumsum(lines.counts)))
            at = _suspects(lines, words.value, shape, min_chars)
            row = lines.row[at]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), b.column("sha").take(pa.array(row)), pa.array(at - begin[row], pa.int64()),
                 pa.array([lines.key(i).decode() for i in at.tolist()], pa.string())], names=["doc_id", "sha", "line", "key"])

    found = arrow_map(named, occurrences, "doc_id long, sha string, line long, key string").distinct().join(keys, "key")
    if keep_first:
        here = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "line")
        found = found.where(here != F.struct("no_id", "first_id", "first_line"))
    gone = (found.groupBy(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha"))
            .agg(F.collect_set("line").alias("gone")))
    both = named.join(gone, named["doc_id"].eqNullSafe(F.col("gone_id")) & (named["sha"] == F.col("gone_sha")), "left")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            lines = Lines(_raw(b))
            begin = np.concatenate(([0], np.cumsum(lines.counts))).tolist()
            gone = {i: {begin[i] + x for x in own} for i, own in enumerate(b.column("gone").to_pylist()) if own}
            yield _result(b, lines, gone)
    return arrow_map(both.select("doc_id", "text", "gone"), run, RESULT)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False,
                key_bytes: int = KEY_BYTES, folded_bits: int = FOLDED_BITS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of (doc_id, text): lines whose key has
    ``min_chars`` code points or more and is found in ``min_docs`` documents or
    more (2 at least) are dropped, all of them or all but the first."""
    spark = docs.sparkSession
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    feeds = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    n_lines = docs.agg(F.sum(feeds + 1)).first()[0] or 0
    shape = Geometry(n_lines, folded_bits)
    words = spark.sparkContext.broadcast(_folded_words(twice_seen(filter_pieces(docs, shape, min_chars), shape), shape))
    keys = scratch(confirmed_keys(suspected_keys(docs, words, shape, min_chars), min_docs), "line-keys")
    size = keys.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    drop = _drop_shared if size <= key_bytes else _drop_joined
    return drop(docs, keys, words, shape, min_chars, keep_first)


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT r, doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often ON k.key = often.key GROUP BY r, doc_id
"""


@llm_query("op12_line_dedup", SQL)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more, dropped from all of them."""
    out = dedup_lines(texts(table(spark, sf_dir, "documents")), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
