"""Spelling variants of words by a frequency-vector trie.

A word's vector counts its letters group by group. One inserted, deleted or
replaced letter raises at most one count by one (the surplus) and lowers at
most one by one (the deficit). Words are arranged in a trie by successive
counts; a search goes depth first through the children whose count differs by
one at most and spends a budget of one surplus and one deficit. The few words
left at a leaf are verified letter by letter.

Spark deals the trie out by its top levels: a unit is one path of the first
``depth`` counts. A word lies in one unit and visits those units that the
budget can reach and that are not smaller than its own, so every pair is met
once. ``depth`` follows from the vocabulary: the first one whose largest unit
has at most ``UNIT`` words. A unit that is larger even at full depth is cut into
parts, and its visitors go to each part.

Near pairs are never gathered: counts and the best form are partial aggregates.
Forms are followed to the last by pointer doubling; n grows at least by the
ratio with each step, so a few rounds reach the end.

Defined cases: NULL and empty texts have no words; a NULL id counts as an empty
one in the hash; repeated rows count each; words of any length are kept whole;
equal n are settled by code-point order; an empty table gives no rows; other
columns are left behind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, llm_query, scratch, shuffle_parts, table, texts

#: Letter groups, a level of the trie each; letters of no group are the last one's.
GROUPS = ("e", "t", "n", "a", "o", "i", "s", "r", "h", "dl", "ucm", "fgwy")
LEVELS = len(GROUPS) + 1
#: Depths to choose from, and the words one unit may hold.
DEPTHS, UNIT = (3, 4, 6, 8, 10, LEVELS), 60_000
#: Below so many words a node's words are verified without further levels.
LEAF = 12
#: Pairs looked at together, visitors of a unit searched together.
PAIRS, VISITORS = 1 << 20, 50_000
#: Distinct words a task counts before it hands them on.
FLUSH = 400_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GROUP_OF = np.full(0x110000, LEVELS - 1, np.uint8)
for _g, _letters in enumerate(GROUPS):
    for _c in _letters:
        _GROUP_OF[ord(_c)] = _g


def word_counts(docs: DataFrame, min_chars: int = 6, noise: int = 199) -> DataFrame:
    """(word, n) of (doc_id, text): lower-cased letter runs; a run whose hash
    with its document's id is divisible by ``noise`` loses one code point."""
    plain = re.compile(rb"[a-z]{%d,}" % min_chars)
    accented = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % min_chars)

    def run(batches: Iterator[pa.RecordBatch]):
        total: Counter = Counter()

        def flush():
            words, n = [w.decode() for w in total], list(total.values())
            keep = [i for i, w in enumerate(words) if len(w) >= min_chars]
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in keep], pa.string()),
                                              pa.array([n[i] for i in keep], pa.int64())], names=["word", "n"])
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                own = Counter((plain if text.isascii() else accented).findall(text.translate(_LOWER)))
                head = crc32(b"%d:" % doc if doc is not None else b":")
                for w in [w for w in own if crc32(w, head) % noise == 0]:
                    letters = w.decode()
                    at = crc32(w, head) % len(letters)
                    total[(letters[:at] + letters[at + 1:]).encode()] += own.pop(w)
                total.update(own)
                if len(total) >= FLUSH:
                    yield from flush()
                    total.clear()
        yield from flush()
    return arrow_map(docs, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vectors(words: list[str]) -> np.ndarray:
    """Counts of each word's letters by group, at most 255 each (a cut count
    differs by less than the count itself, so no pair is lost)."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(words)), size)
    counts = np.bincount(row * LEVELS + _GROUP_OF[codes], minlength=len(words) * LEVELS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(len(words), LEVELS)


def steps(depth: int) -> list[tuple[np.ndarray, int, int]]:
    """Differences of a path that one surplus and one deficit allow and that
    are not smaller than zero in order: (difference, surplus, deficit)."""
    zero = np.zeros(depth, np.int16)
    out = [(zero, 0, 0)]
    for i in range(depth):
        up = zero.copy()
        up[i] = 1
        out.append((up, 1, 0))
        for j in range(i + 1, depth):
            both = up.copy()
            both[j] = -1
            out.append((both, 1, 1))
    return out


def placed(words: DataFrame) -> DataFrame:
    """(word, n, vec): the whole path of each word."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                vec = vectors(b.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array([v.tobytes() for v in vec], pa.binary())],
                                                 names=["word", "n", "vec"])
    return arrow_map(words, run, "word string, n long, vec binary")


def visits(words: DataFrame, depth: int) -> DataFrame:
    """(word, n, vec, unit, up, down): every unit a word visits, with the
    surplus and the deficit that its path has spent; its own unit comes first."""
    ways = steps(depth)
    delta = np.stack([d for d, _, _ in ways])
    spent = np.array([(u, d) for _, u, d in ways], np.int8)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                top = np.frombuffer(b"".join(part.column("vec").to_pylist()), np.uint8).reshape(-1, LEVELS)[:, :depth]
                unit = top[:, None, :].astype(np.int16) + delta[None]
                row, way = np.nonzero(((unit >= 0) & (unit <= 255)).all(axis=2))
                keys = unit[row, way].astype(np.uint8)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in ("word", "n", "vec")), pa.array([k.tobytes() for k in keys], pa.binary()),
                     pa.array(spent[way, 0]), pa.array(spent[way, 1])], names=["word", "n", "vec", "unit", "up", "down"])
    return arrow_map(words, run, "word string, n long, vec binary, unit binary, up byte, down byte")


def one_edit(x: str, y: str) -> bool:
    """Whether ``y`` is ``x`` with exactly one letter replaced or inserted."""
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    at = next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), len(x))
    return len(y) == len(x) + 1 and x[at:] == y[at + 1:]


def _halves(words: list[str], shorter: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and the last half, of the length less ``shorter``.
    One edit leaves one of the two as it is."""
    head, tail = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        n = len(w) - shorter
        head[i], tail[i] = hash(w[:n // 2]), hash(w[len(w) - n + n // 2:])
    return head, tail


class Unit:
    """The trie below one path of the first ``depth`` counts."""

    def __init__(self, words: list[str], vec: np.ndarray, depth: int):
        order = np.lexsort(vec.T[::-1])
        self.words, self.vec, self.depth = [words[i] for i in order], vec[order].astype(np.int16), depth
        self.order = order
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.same, self.longer = _halves(self.words, 0), _halves(self.words, 1)

    def search(self, words: list[str], vec: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[int, int]]:
        """(visitor, word) pairs with one edit between them, the visitor not
        the longer one, each pair once."""
        self.asked, self.asked_size = words, np.array([len(w) for w in words], np.int64)
        self.asked_halves, self.asked_vec = _halves(words, 0), vec.astype(np.int16)
        self.at_home = (up == 0) & (down == 0)
        yield from self._below(0, len(self.words), self.depth, np.arange(len(words)), up.astype(np.int16), down.astype(np.int16))

    def _below(self, lo: int, hi: int, level: int, alive, up, down):
        if hi - lo <= LEAF or level == LEVELS:
            yield from self._leaf(lo, hi, alive)
            return
        counts = self.vec[lo:hi, level]
        cuts = [lo, *(np.flatnonzero(np.diff(counts)) + lo + 1).tolist(), hi]
        for a, b in zip(cuts, cuts[1:]):
            d = self.vec[a, level] - self.asked_vec[alive, level]
            u, m = up + np.maximum(d, 0), down + np.maximum(-d, 0)
            ok = np.flatnonzero((u <= 1) & (m <= 1))
            if len(ok):
                yield from self._below(a, b, level + 1, alive[ok], u[ok], m[ok])

    def _leaf(self, lo: int, hi: int, alive):
        block = max(1, PAIRS // max(1, len(alive)))
        for a in range(lo, hi, block):
            b = min(hi, a + block)
            for part in np.array_split(alive, max(1, len(alive) * (b - a) // PAIRS)):
                longer = self.size[None, a:b] - self.asked_size[part][:, None]
                head, tail = (h[part][:, None] for h in self.asked_halves)
                hit = (longer == 0) & ((head == self.same[0][None, a:b]) | (tail == self.same[1][None, a:b]))
                hit |= (longer == 1) & ((head == self.longer[0][None, a:b]) | (tail == self.longer[1][None, a:b]))
                for i, j in zip(*(x.tolist() for x in np.nonzero(hit))):
                    q, x, y = int(part[i]), self.asked[part[i]], self.words[a + j]
                    if len(x) == len(y) and self.at_home[q] and x >= y:
                        continue
                    if one_edit(x, y):
                        yield q, int(self.order[a + j])


def unit_pairs(rows: DataFrame, depth: int) -> DataFrame:
    """(word, near, near_n), both ways round, from rows sorted by (unit, part)
    with the words that lie there first (``visit`` false), then the visitors."""
    names = ["word", "n", "vec", "up", "down"]

    def run(batches: Iterator[pa.RecordBatch]):
        key, here, trie, visitors = None, [], None, []

        def answer():
            nonlocal trie, visitors
            if not (here and visitors):
                visitors = []
                return
            if trie is None:
                trie = Unit([r[0] for r in here], np.frombuffer(b"".join(r[2] for r in here), np.uint8).reshape(-1, LEVELS), depth)
            vec = np.frombuffer(b"".join(r[2] for r in visitors), np.uint8).reshape(-1, LEVELS)
            up, down = (np.array([r[k] for r in visitors], np.int16) for k in (3, 4))
            found = list(trie.search([r[0] for r in visitors], vec, up, down))
            for lo in range(0, len(found), PAIRS):
                x, y = zip(*((visitors[q], here[w]) for q, w in found[lo:lo + PAIRS]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in x + y], pa.string()), pa.array([r[0] for r in y + x], pa.string()),
                     pa.array([r[1] for r in y + x], pa.int64())], names=["word", "near", "near_n"])
            visitors = []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("unit", "part", "visit")]
            for unit, part, visit, *row in zip(*cols, *(b.column(c).to_pylist() for c in names)):
                if (unit, part) != key:
                    yield from answer()
                    key, here, trie = (unit, part), [], None
                if visit:
                    visitors.append(row)
                    if len(visitors) >= VISITORS:
                        yield from answer()
                else:
                    here.append(row)
        yield from answer()
    return arrow_map(rows.select("unit", "part", "visit", *names), run, "word string, near string, near_n long")


def near_pairs(words: DataFrame, unit: int = UNIT) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words one edit apart."""
    spark = words.sparkSession
    path = scratch(placed(words), "word-vectors")
    for depth in DEPTHS:
        top = F.substring("vec", 1, depth)
        largest = path.groupBy(top.alias("unit")).count().agg(F.max("count")).first()[0] or 0
        if largest <= unit:
            break
    stored = path.select("word", "n", "vec", F.expr("cast(0 AS byte)").alias("up"), F.expr("cast(0 AS byte)").alias("down"),
                         top.alias("unit"), F.lit(False).alias("visit"))
    asked = visits(path, depth).withColumn("visit", F.lit(True))
    if largest > unit:  # at full depth
        large = stored.groupBy("unit").count().where(F.col("count") > unit).select("unit", F.ceil(F.col("count") / unit).cast("int").alias("parts"))
        stored = (stored.join(large, "unit", "left")
                  .withColumn("part", F.coalesce(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.lit(0))).drop("parts"))
        asked = (asked.join(large, "unit", "left")
                 .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts"))
    else:
        stored, asked = (x.withColumn("part", F.lit(0)) for x in (stored, asked))
        asked = asked.join(path.select(top.alias("unit")).distinct(), "unit", "left_semi")
    rows = (stored.unionByName(asked).repartition(shuffle_parts(spark), "unit", "part")
            .sortWithinPartitions("unit", "part", "visit"))
    return unit_pairs(rows, depth)


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, from (word, form) without NULL."""
    now = scratch(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = scratch(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                              F.col("further").isNotNull().alias("moved")), "roots")
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def group_variants(words: DataFrame, min_count: int = 5, ratio: int = 5, unit: int = UNIT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n): the form of a word is
    its most frequent near word, if that is ``ratio`` times as frequent."""
    words = scratch(words.where(F.col("n") >= min_count), "words")
    near = near_pairs(words, unit).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    found = (words.join(near, "word", "left")
             .withColumn("is_form", -F.col("best.less") >= F.lit(ratio) * F.col("n"))
             .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                     F.when(F.col("is_form"), F.col("best.near")).alias("form"),
                     F.when(F.col("is_form"), -F.col("best.less")).alias("form_n")))
    found = scratch(found, "variants")
    roots = last_forms(found.where("form is not null"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


@llm_query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their near words, forms and roots."""
    found = group_variants(word_counts(texts(table(spark, sf_dir, "documents"))))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
