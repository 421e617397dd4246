import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.llm import variants
from plantpulse.llm.common import table, texts
from tests.conftest import SF_SMALL


def brute_counts(rows, min_chars=6, noise=199):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= min_chars:
                n[w] += 1
    return n


def brute_near(words):
    """All pairs one edit apart: words that share a form with one letter masked or left out."""
    masked, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masked[w[:i] + "\0" + w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in words:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(counts, min_count=5, ratio=5):
    n = {w: k for w, k in counts.items() if k >= min_count}
    near, form = brute_near(set(n)), {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= ratio * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def result(found):
    return {tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_counts_against_brute_force(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [
        (i, f"Größere ÀÉÎõü×÷ÿ abcdefgh{'x' * (i % 7)} ABCDEFé Straßenbahn l'oiseau naïveté {'z' * 300}漢字abcdef") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(3)).withColumn("word", F.lit("w"))
    got = {r.word: r.n for r in variants.word_counts(texts(docs.repartition(6))).collect()}
    assert got == brute_counts(rows)


@pytest.mark.parametrize("unit", [variants.UNIT, 40, 3])
def test_random_words_against_brute_force(spark, unit):
    """Few letters, so that most words have several near ones; ties of n; long
    words; small units force every depth and cut units into parts."""
    rng = np.random.default_rng(unit)
    words = {"".join(rng.choice(list("etxß"), rng.integers(6, 9))) for _ in range(700)}
    words |= {"a" * 300, "a" * 301, "a" * 299 + "e", "q" * 256 + "e", "q" * 257 + "e", "éàüöçñ", "éàüöçn", "ÿ" * 6, "ÿ" * 7}
    counts = {w: int(5 * 5 ** rng.integers(0, 4)) for w in sorted(words)} | {"seldom": 4}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute(counts)
    assert sum(r[1] is not None for r in want) > 100 and max(r[4] for r in want) > 3
    assert any(r[1] is not None and r[1] != r[2] for r in want)
    assert result(variants.group_variants(df, unit=unit)) == want


def test_one_edit():
    assert variants.one_edit("abcdef", "abcxef") and variants.one_edit("abcdef", "abcdefg") and variants.one_edit("bcdefg", "abcdefg")
    assert not variants.one_edit("abcdef", "abcdef") and not variants.one_edit("abcdef", "abdcef") and not variants.one_edit("abcdefg", "abcdef")


def test_query_against_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    want = brute(brute_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert len(want) > 300
    assert result(variants.op11_spelling_variants(spark, SF_SMALL)) == want


def test_empty_table(no_docs):
    assert variants.group_variants(variants.word_counts(texts(no_docs))).count() == 0
