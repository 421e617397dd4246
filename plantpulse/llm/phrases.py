"""Phrase collocations by stripes.

A stripe belongs to a prefix and counts what follows it: {next word: count},
with the end of a piece as a next word of its own. Tasks build stripes of many
texts at once and hand them on; equal prefixes meet and their stripes are merged
element by element. A merged stripe gives the extensions of its prefix, the
prefix's own count (the sum of the stripe) and the largest extension, which
decides whether the prefix is subsumed.

Stripes of one word come first, then those of two words. A phrase of three words
found ``min_count`` times has two phrases of two words found as often, so only
those extend: a Bloom filter of the frequent ones, sized by their number and
bounded, keeps the others out of the second round. An overfull filter lets more
through and changes no result.

A stripe of a word that holds a large share of all words is cut into segments by
the next word's hash (``SEGMENTS`` at a share of one); the words of such share
are few by their definition and go to every task. Segments are merged apart and
their sums and maxima are added up later. Stripes that only differ by task are
never gathered: a merge holds the open segment and one Arrow batch.

Defined cases: NULL and empty texts have no words; a NULL lang is ``und``;
repeated rows count each; a text without punctuation is one piece of any length;
words are runs without space and tab, whatever else they hold; equal scores are
settled by count, then by the phrase's bytes; an empty table gives no rows;
other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, list_column, llm_query, mix64, scratch, shuffle_parts, table

#: Segments of a stripe whose prefix were every word of the corpus.
SEGMENTS = 1024
#: Tokens, words and langs a task gathers before it hands on its stripes.
TOKENS, WORDS, LANGS = 2_000_000, 600_000, 1000
#: Entries in one batch of stripes.
ENTRIES = 200_000
#: Bits of the filter of frequent pairs, for each of them and at most (32 MB).
BITS_PER_PAIR, MOST_BITS = 16, 1 << 28
#: Of each lang, the ranking first takes the best of so many parts.
PARTS = 32

#: What ends a piece.
STOPS = b".,;:!?\n\v\f\r"
_FOLD = bytes(10 if b in STOPS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Vocabulary(dict):
    """Numbers of words by first sight; number 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b"\n": 0})

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Tokens:
    """The words of some texts as numbers, with their langs, since the last flush."""

    def __init__(self):
        self.words, self.langs = Vocabulary(), {}
        self.ids: list[np.ndarray] = []
        self.tags: list[np.ndarray] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        words = self.words
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if not text:
                continue
            parts = text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
            ids = [0, *[words[w] for w in parts if w], 0]
            self.ids.append(np.array(ids, np.int64))
            self.tags.append(np.full(len(ids), self.langs.setdefault(lang, len(self.langs)), np.int64))
            self.size += len(ids)

    def full(self, tokens: int) -> bool:
        return self.size >= tokens or len(self.words) >= WORDS or len(self.langs) >= LANGS

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(self.ids or empty), np.concatenate(self.tags or empty)

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))


def _gathered(batches: Iterator[pa.RecordBatch], tokens: int = TOKENS) -> Iterator[Tokens]:
    held = Tokens()
    for b in batches:
        held.add(b)
        if held.full(tokens):
            yield held
            held = Tokens()
    if held.size:
        yield held


def pair_hash(first: np.ndarray, second: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix64(first * np.uint64(0x9E3779B97F4A7C15) + second) ^ mix64(lang)


def lang_hash(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(b"lang:" + lang.encode())


def lang_sizes(docs: DataFrame) -> DataFrame:
    """(lang, word, n): a row without word counts all words of a lang; other
    rows count the words that fill a 1/``SEGMENTS`` part of what a task held."""
    def run(batches: Iterator[pa.RecordBatch]):
        for held in _gathered(batches):
            ids, tags = held.arrays()
            real = ids > 0
            langs = list(held.langs)
            total = np.bincount(tags[real], minlength=len(langs))
            keys, n = np.unique(tags[real] * (len(held.words) + 1) + ids[real], return_counts=True)
            some = n * SEGMENTS >= max(1, real.sum())
            names = list(held.words)
            tag, word = np.divmod(keys[some], len(held.words) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs + [langs[t] for t in tag.tolist()], pa.string()),
                 pa.array([None] * len(langs) + [names[w].decode() for w in word.tolist()], pa.string()),
                 pa.array(total.tolist() + n[some].tolist(), pa.int64())], names=["lang", "word", "n"])
    return arrow_map(docs, run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def segments_by_word(sizes: DataFrame, segments: int) -> dict[tuple[str, bytes], int]:
    """Segments of the words that have more than one; a share over
    1/``segments`` each, so they are fewer than ``segments``."""
    total = sizes.where("word is null").agg(F.sum("n")).first()[0] or 0
    own = F.ceil(F.col("n") * segments / F.lit(max(1, total)))
    return {(r.lang, r.word.encode()): r.own for r in
            sizes.where("word is not null").select("lang", "word", own.alias("own")).where("own > 1").collect()}


STRIPE = "lang string, prefix string, segment int, next array<string>, n array<long>"


def _stripes(held: Tokens, prefix: list[bytes], prefix_lang: np.ndarray, shares: np.ndarray, of: np.ndarray,
             following: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stripes from (prefix number, next word) of every occurrence."""
    base = len(held.words) + 1
    keys, n = np.unique(of * base + following, return_counts=True)
    row, nxt = np.divmod(keys, base)
    segment = np.zeros(len(row), np.int64)
    wide = np.flatnonzero(shares[row] > 1)
    if len(wide):
        segment[wide] = (held.hashes()[nxt[wide]] % shares[row[wide]].astype(np.uint64)).astype(np.int64) + 1  # 0: a whole stripe
        order = np.lexsort((segment, row))
        row, nxt, n, segment = row[order], nxt[order], n[order], segment[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])
    start = np.flatnonzero(new)
    names = pa.array([w.decode() if i else None for i, w in enumerate(held.words)], pa.string())
    langs = pa.array(list(held.langs), pa.string())
    step = [0, *(np.flatnonzero(np.diff(start // ENTRIES)) + 1).tolist(), len(start)]
    ends = np.append(start[1:], len(row))
    for a, b in zip(step, step[1:]):
        if a == b:
            continue
        lo, hi = start[a], ends[b - 1]
        rows = row[start[a:b]]
        size = pa.array(np.append(start[a:b], hi) - lo, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(prefix_lang[rows])), pa.array([prefix[r].decode() for r in rows.tolist()], pa.string()),
             pa.array(segment[start[a:b]], pa.int32()), pa.ListArray.from_arrays(size, names.take(pa.array(nxt[lo:hi]))),
             list_column(n[lo:hi], np.diff(np.append(start[a:b], hi)), pa.int64())],
            names=["lang", "prefix", "segment", "next", "n"])


def word_stripes(docs: DataFrame, shares, tokens: int = TOKENS) -> DataFrame:
    """Stripes of one-word prefixes; a NULL next is the end of a piece."""
    def run(batches: Iterator[pa.RecordBatch]):
        for held in _gathered(batches, tokens):
            ids, tags = held.arrays()
            at = np.flatnonzero(ids[:-1] > 0)
            names, langs = list(held.words), list(held.langs)
            keys, of = np.unique(tags[at] * len(names) + ids[at], return_inverse=True)
            tag, word = np.divmod(keys, len(names))
            prefix = [names[w] for w in word.tolist()]
            share = np.array([shares.value.get((langs[t], p), 1) for t, p in zip(tag.tolist(), prefix)], np.int64)
            yield from _stripes(held, prefix, tag, share, of, ids[at + 1])
    return arrow_map(docs, run, STRIPE)


def pair_stripes(docs: DataFrame, shares, frequent, bits: int, tokens: int = TOKENS) -> DataFrame:
    """Stripes of two-word prefixes, of those and with those next words that
    the filter of frequent pairs lets through."""
    def run(batches: Iterator[pa.RecordBatch]):
        for held in _gathered(batches, tokens):
            ids, tags = held.arrays()
            h = held.hashes()
            langs, names = list(held.langs), list(held.words)
            own = np.array([lang_hash(x) for x in langs], np.uint64)
            pair = pair_hash(h[ids[:-1]], h[ids[1:]], own[tags[:-1]]) & np.uint64(bits - 1)
            pair = pair.astype(np.int64)
            ok = (ids[:-1] > 0) & (ids[1:] > 0) & (frequent.value[pair >> 5] >> (pair & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
            at = np.flatnonzero(ok[:-1] & ok[1:])
            if not len(at):
                continue
            keys, of = np.unique((tags[at] * len(names) + ids[at]) * len(names) + ids[at + 1], return_inverse=True)
            first, second = np.divmod(keys, len(names))
            tag, first = np.divmod(first, len(names))
            prefix = [names[a] + b" " + names[b] for a, b in zip(first.tolist(), second.tolist())]
            share = np.array([min(shares.value.get((langs[t], names[a]), 1), shares.value.get((langs[t], names[b]), 1))
                              for t, a, b in zip(tag.tolist(), first.tolist(), second.tolist())], np.int64)
            yield from _stripes(held, prefix, tag, share, of, ids[at + 2])
    return arrow_map(docs, run, STRIPE)


def merged(stripes: DataFrame, min_count: int) -> DataFrame:
    """(lang, prefix, next, n): stripes added up element by element. Elements of
    ``min_count`` or more are returned; a row whose ``next`` is NULL has the sum
    of a stripe, if it is as large, or of one segment, however large."""
    keys = ["lang", "prefix", "segment"]

    def added(t: pa.Table) -> pa.Table:
        return t.group_by([*keys, "next"], use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "next", "n"])

    def flat(b: pa.RecordBatch) -> pa.Table:
        at = pc.list_parent_indices(b.column("next"))
        return pa.table([*(b.column(k).take(at) for k in keys), b.column("next").flatten(), b.column("n").flatten()],
                        names=[*keys, "next", "n"])

    def rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
        total = t.group_by(keys, use_threads=False).aggregate([("n", "sum")])
        total = total.filter(pc.or_(pc.greater_equal(total.column("n_sum"), min_count), pc.greater(total.column("segment"), 0)))
        often = t.filter(pc.and_(pc.greater_equal(t.column("n"), min_count), pc.is_valid(t.column("next"))))
        for x, nxt, n in ((total, pa.nulls(total.num_rows, pa.string()), total.column("n_sum")), (often, often.column("next"), often.column("n"))):
            out = pa.table([x.column("lang"), x.column("prefix"), nxt, n], names=["lang", "prefix", "next", "n"])
            yield from out.combine_chunks().to_batches(max_chunksize=ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]):
        held = None  # the open stripe, merged so far
        for b in batches:
            if not b.num_rows:
                continue
            t = flat(b)
            t = added(pa.concat_tables([held, t]) if held is not None else t)
            last = [b.column(k)[b.num_rows - 1] for k in keys]
            open_ = reduce(pc.and_, [pc.equal(t.column(k), v) for k, v in zip(keys, last)])
            held = t.filter(open_)
            done = t.filter(pc.invert(open_))
            if done.num_rows:
                yield from rows(done)
        if held is not None:
            yield from rows(held)
    parts = shuffle_parts(stripes.sparkSession)
    return arrow_map(stripes.repartition(parts, *keys).sortWithinPartitions(*keys), run,
                     "lang string, prefix string, next string, n long")


def frequent_filter(pairs: DataFrame, bits: int) -> np.ndarray:
    """The filter of the pairs (lang, prefix, next); at most ``MOST_BITS`` / 32
    rows come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            x, y, lang = (np.array([f(v) for v in b.column(c).to_pylist()], np.uint64) for c, f in
                          (("prefix", lambda v: xxhash.xxh3_64_intdigest(v.encode())), ("next", lambda v: xxhash.xxh3_64_intdigest(v.encode())), ("lang", lang_hash)))
            p = (pair_hash(x, y, lang) & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(p)], names=["p"])
    words = (arrow_map(pairs.select("lang", "prefix", "next"), run, "p long").groupBy(F.shiftright("p", 5).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 AS int))")).alias("bits")).toArrow())
    out = np.zeros(bits >> 5, np.uint32)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def score(a, left, right):
    """floor(1000000 a a / (left right)), exact in 38 digits."""
    return F.expr(f"cast(1000000BD * cast({a} AS decimal(16)) * cast({a} AS decimal(16)) AS decimal(38)) "
                  f"div (cast({left} AS decimal(19)) * cast({right} AS decimal(19)))")


def collocations(docs: DataFrame, min_count: int = 10, subsume: int = 50, top: int = 2000,
                 segments: int = SEGMENTS, tokens: int = TOKENS, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text)."""
    spark = docs.sparkSession
    sizes = scratch(lang_sizes(docs), "lang-words")
    shares = spark.sparkContext.broadcast(segments_by_word(sizes, segments))
    langs = sizes.where("word is null").select("lang", "n")

    ones = scratch(merged(word_stripes(docs, shares, tokens), min_count), "word-stripes")
    word = (ones.where("next is null").groupBy("lang", F.col("prefix").alias("w")).agg(F.sum("n").alias("f"))
            .where(F.col("f") >= min_count))
    pairs = ones.where("next is not null").select("lang", "prefix", "next", "n")
    bits = max(1 << 10, min(most_bits, 1 << (max(1, pairs.count() * BITS_PER_PAIR) - 1).bit_length()))
    frequent = spark.sparkContext.broadcast(frequent_filter(pairs, bits))

    threes = scratch(merged(pair_stripes(docs, shares, frequent, bits, tokens), min_count).where("next is not null"), "pair-stripes")
    cut = F.split("prefix", " ")
    three = threes.select("lang", cut[0].alias("x"), cut[1].alias("y"), F.col("next").alias("z"), F.col("n").alias("a"))
    # a pair is subsumed by the largest extension on either side
    covering = (threes.select("lang", cut[0].alias("x"), cut[1].alias("y"), "n")
                .unionByName(three.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), F.col("a").alias("n")))
                .groupBy("lang", "x", "y").agg(F.max("n").alias("most")))
    two = pairs.select("lang", F.col("prefix").alias("x"), F.col("next").alias("y"), F.col("n").alias("a"))

    def first(c):
        return word.select("lang", F.col("w").alias(c), F.col("f").alias(f"f_{c}"))

    def both(x, y):
        return two.select("lang", F.col("x").alias(x), F.col("y").alias(y), F.col("a").alias(f"f_{x}{y}"))
    short = (two.join(covering, ["lang", "x", "y"], "left").where(F.expr(f"most IS NULL OR 100 * most < {subsume} * a"))
             .join(first("x"), ["lang", "x"]).join(first("y"), ["lang", "y"])
             .select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", F.col("f_x").alias("l"), F.col("f_y").alias("r"))
             .withColumn("score", score("a", "l", "r")))
    long = (three.join(first("x"), ["lang", "x"]).join(first("z"), ["lang", "z"])
            .join(both("x", "y"), ["lang", "x", "y"]).join(both("y", "z"), ["lang", "y", "z"])
            .withColumn("s1", score("a", "f_x", "f_yz")).withColumn("s2", score("a", "f_xy", "f_z")))
    early = F.col("s1") <= F.col("s2")
    long = long.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a",
                       F.when(early, F.col("f_x")).otherwise(F.col("f_xy")).alias("l"),
                       F.when(early, F.col("f_yz")).otherwise(F.col("f_z")).alias("r"), F.least("s1", "s2").alias("score"))
    # the best of every part of a lang, then the best of those
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    found = short.unionByName(long).withColumn("part", part)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return found.join(langs, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
f1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(ws) AS x FROM w) GROUP BY ALL),
f2 AS (SELECT lang, g[1] AS x, g[2] AS y, count(*) AS f FROM
       (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]])) AS g FROM w WHERE len(ws) >= 2) GROUP BY ALL),
f3 AS (SELECT lang, g[1] AS x, g[2] AS y, g[3] AS z, count(*) AS f FROM
       (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS g FROM w WHERE len(ws) >= 3) GROUP BY ALL),
big AS (SELECT * FROM f3 WHERE f >= 10),
two AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, u.f AS l, v.f AS r,
        1000000::HUGEINT * f2.f * f2.f // (u.f::HUGEINT * v.f) AS score
        FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.x = f2.x JOIN f1 v ON v.lang = f2.lang AND v.x = f2.y
        WHERE f2.f >= 10 AND NOT EXISTS (SELECT 1 FROM big b WHERE b.lang = f2.lang AND 100 * b.f >= 50 * f2.f
          AND ((b.x = f2.x AND b.y = f2.y) OR (b.y = f2.x AND b.z = f2.y)))),
cuts AS (SELECT b.lang, b.x || ' ' || b.y || ' ' || b.z AS phrase, b.f AS a, u.f AS l1, yz.f AS r1, xy.f AS l2, v.f AS r2,
         1000000::HUGEINT * b.f * b.f // (u.f::HUGEINT * yz.f) AS s1, 1000000::HUGEINT * b.f * b.f // (xy.f::HUGEINT * v.f) AS s2
         FROM big b JOIN f1 u ON u.lang = b.lang AND u.x = b.x JOIN f1 v ON v.lang = b.lang AND v.x = b.z
         JOIN f2 xy ON xy.lang = b.lang AND xy.x = b.x AND xy.y = b.y JOIN f2 yz ON yz.lang = b.lang AND yz.x = b.y AND yz.y = b.z),
every AS (SELECT lang, phrase, a, l, r, score FROM two UNION ALL
          SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT lang, rank, phrase, a, l, r, (SELECT sum(f) FROM f1 WHERE f1.lang = ranked.lang)::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


@llm_query("op13_phrase_stripes", SQL)
def op13_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of two and three words of each lang."""
    docs = table(spark, sf_dir, "documents")
    return collocations(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
