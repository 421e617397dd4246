import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.llm import phrases


def brute(rows, min_count=10, subsume=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = set()
    for lang, own in f.items():
        long = {p: a for p, a in own.items() if len(p) == 3 and a >= min_count}
        got = []
        for p, a in own.items():
            if len(p) < 2 or a < min_count:
                continue
            if len(p) == 2 and any(100 * b >= subsume * a and p in (q[:2], q[1:]) for q, b in long.items()):
                continue
            s, k = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            got.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(got)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit(1)).withColumn("prefix", F.lit("p"))
    return df.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).repartition(5)


def run(df, **kw):
    return {tuple(r) for r in phrases.collocations(df, **kw).collect()}


@pytest.fixture()
def odd_rows():
    rng = np.random.default_rng(5)
    word = np.array(["the", "New", "york", "city", "é", "漢字", "a\x1cb", "(x)", "of", "x" * 400], object)
    p = np.array([.35, .1, .1, .1, .05, .05, .05, .05, .1, .05])
    rows = []
    for i in range(300):
        out = []
        for w in rng.choice(word, rng.integers(0, 40), p=p):
            out += [w, rng.choice([" ", "  ", "\t", ", ", ". ", "\n", "\r\n", ";"], p=[.7, .05, .05, .05, .05, .04, .03, .03])]
            if w == "New":
                out += ["York", " "]
        rows.append((["en", "de", None, "und"][i % 4], "".join(out)))
    return rows + [("en", None), ("fr", ""), ("fr", " \t "), ("de", "word " * 3000), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.mark.parametrize("kw", [{}, {"segments": 1}, {"segments": 100_000}, {"top": 3}, {"min_count": 2, "subsume": 100}])
def test_odd_texts_against_brute_force(spark, odd_rows, kw):
    want = brute(odd_rows, **{k: v for k, v in kw.items() if k != "segments"})
    assert len(want) > 8 and any(r[2].count(" ") == 2 for r in want)
    assert run(docs_of(spark, odd_rows), **kw) == want


def test_flushes_and_small_filters_change_nothing(spark, odd_rows):
    """Every batch is a flush of its own, and the filter of pairs is overfull."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert run(docs_of(spark, odd_rows), tokens=1, most_bits=1 << 10) == brute(odd_rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_score_beyond_64_bits(spark):
    big = [(10**13, 10**13, 10**13), (3 * 10**12 + 7, 5 * 10**12 + 1, 4 * 10**12 + 3), (10, 10, 11)]
    df = spark.createDataFrame(big, "a long, l long, r long").withColumn("score", phrases.score("a", "l", "r"))
    assert [r.score for r in df.collect()] == [1000000 * a * a // (x * y) for a, x, y in big]


def test_empty_table(spark, no_docs):
    assert phrases.collocations(no_docs.select("lang", "text")).count() == 0
