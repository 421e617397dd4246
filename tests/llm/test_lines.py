from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.llm import lines
from plantpulse.llm.common import table, texts
from tests.conftest import SF_SMALL

BLANK = " \t\n\v\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_docs, min_chars, keep_first=False):
    docs, first = Counter(), {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            place = (i is None, i or 0, n)
            first[key(line)] = min(first.get(key(line), place), place)
        docs.update({key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        gone = [docs[key(x)] >= min_docs and len(key(x)) >= min_chars
                and not (keep_first and first[key(x)] == (i is None, i or 0, n)) for n, x in enumerate(own)]
        out.append((i, "\n".join(x for x, g in zip(own, gone) if not g), len(own), sum(gone)))
    return Counter(out)


def run(df, **kw):
    return Counter(tuple(r) for r in lines.dedup_lines(texts(df), **kw).collect())


@pytest.mark.parametrize("kw", [{}, {"key_bytes": 0}, {"folded_bits": 64}, {"keep_first": True},
                                {"keep_first": True, "key_bytes": 0}, {"min_chars": 3}])
def test_odd_lines_against_brute_force(spark, odd_docs, kw):
    rng = np.random.default_rng(3)
    pool = ["Hot line", " hot LINE\t", "é漢 x", "", " ", "ab", "\r", "a ", "k" * 9000] + [f"line {i}" for i in range(40)]
    rows = [(int(i), "\n".join(rng.choice(pool, rng.integers(1, 12)))) for i in range(120)]
    rows += [(7, "Hot line\nline 3"), (7, "Hot line\nline 3"), (None, "hot line\nline 3"), (500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.unionByName(odd_docs.select("doc_id", "text")).withColumn("key", F.lit("x")).withColumn("n", F.lit(1))
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    docs = df.repartition(5)
    want = brute(rows, 10, kw.get("min_chars", 1), kw.get("keep_first", False))
    assert sum(n for r, n in want.items() if r[3]) > 50
    assert run(docs, **kw) == want


def test_two_documents_are_enough(spark):
    rows = [(i, f"own {i}\nshared {i // 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert run(df, min_docs=2) == Counter((i, f"own {i}", 2, 1) for i, _ in rows)
    with pytest.raises(ValueError):
        lines.dedup_lines(df, min_docs=1)


def test_unique_lines_stay_in_their_tasks(spark):
    """Of lines seen once, the filters let few through."""
    docs = texts(spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("only "), F.sha2(F.col("id").cast("string"), 256)).alias("text")))
    shape = lines.Geometry(20000)
    words = spark.sparkContext.broadcast(lines._folded_words(lines.twice_seen(lines.filter_pieces(docs, shape, 1), shape), shape))
    assert lines.suspected_keys(docs, words, shape, 1).count() < 0.05 * 20000


def test_large_geometry_keeps_every_repeat():
    shape = lines.Geometry(10**11)
    h = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)
    one, two = shape.places(h)
    assert (one >> shape.segment_bits == two >> shape.segment_bits).all() and one.max() < 1 << shape.bits
    assert shape.fold(two).max() < lines.FOLDED_BITS and len(np.unique(two & ((1 << shape.segment_bits) - 1))) > 990


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    want = brute(rows, 10, 1)
    assert run(table(spark, SF_SMALL, "documents"), min_docs=10) == want


def test_empty_table(no_docs):
    assert lines.dedup_lines(texts(no_docs)).count() == 0
