import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantpulse.llm import quality
from plantpulse.llm.common import held_out, table


def test_flat_trees_equal_recursive_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(float)
    m = quality.fit_trees(x[:1000], y[:1000], rounds=40)

    def walk(row, node):
        while not m.leaf[node]:
            node = m.left[node] + (row[m.feature[node]] > m.threshold[node])
        return m.value[node]
    slow = np.array([m.base + sum(walk(r, n) for n in m.roots) for r in x[:200]])
    assert np.allclose(slow, m.margin(x[:200]))
    assert ((m.score(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.85


def test_statistics_of_single_and_batched_texts_agree():
    odd = [None, "", " ", "a", "Ab cD\n!! é9", "x y x y x", "word " * 50, "\n\n"]
    together = quality.batch_features(pa.array(odd))
    alone = np.concatenate([quality.batch_features(pa.array([t], pa.string())) for t in odd])
    assert np.allclose(together, alone) and not together[:2].any()
    words = np.expm1(together[:, quality.FEATURES.index("log_words")])
    assert np.allclose(words, [len((t or "").split()) for t in odd])


def slow_statistics(text):
    """The statistics one by one, by their definitions."""
    t = (text or "").encode()
    n, lines = len(t), t.split(b"\n") if t else []
    if not t:
        return dict.fromkeys(quality.FEATURES, 0.0)
    words = re.findall(rb"[^\x20\x09-\x0D]+", t)
    some, counts = max(1, len(words)), Counter(words)

    def share(pattern):
        return len(re.findall(pattern, t)) / n
    return {
        "log_bytes": math.log1p(n), "log_words": math.log1p(len(words)), "log_lines": math.log1p(len(lines)),
        "word_bytes": sum(map(len, words)) / some, "upper": share(rb"[A-Z]"), "lower": share(rb"[a-z]"),
        "digit": share(rb"[0-9]"), "space": share(rb"[\x20\t\r\x0b\x0c]"), "newline": share(rb"\n"),
        "stop": share(rb"[.,;:?]"), "exclaim": share(rb"!"), "symbol": share(rb"[#$%&*+<=>@\[\]^_`{|}~\\/]"),
        "other_punct": share(rb"[\x00-\x08\x0e-\x1f\x7f\"'()-]"), "non_ascii": share(rb"[\x80-\xff]"),
        "distinct_words": len(counts) / some, "repeat_next": sum(a == b for a, b in zip(words, words[1:])) / some,
        "top_word": max(counts.values(), default=0) / some,
        "distinct_lines": len(set(lines)) / len(lines) if words else 0.0,
        "symbol_words": sum(bool(re.search(rb"[^A-Za-z0-9.,;:?\x80-\xff]\Z", w)) for w in words) / some,
        "upper_words": sum(len(w) > 1 and w.isupper() for w in words) / some,
        "line_bytes": n / len(lines)}


@given(st.lists(st.text(alphabet="aB1 é\n\t.!#-", max_size=40), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_statistics_against_definitions(docs):
    got = quality.batch_features(pa.array(docs, pa.string()))
    for row, text in zip(got, docs):
        want = slow_statistics(text)
        assert np.allclose(row, [want[name] for name in quality.FEATURES])


@pytest.mark.parametrize("seed", range(5))
def test_first_split_has_the_greatest_gain(seed):
    """One round of depth one against all (statistic, cut) pairs."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 8, size=(400, 4)).astype(float)
    y = ((x[:, seed % 4] >= 3 + seed % 3) ^ (rng.random(400) < 0.1)).astype(float)
    m = quality.fit_trees(x, y, rounds=1, depth=1)
    p = 1 / (1 + np.exp(-m.base))
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(goes, l2=2.0):
        return sum(g[part].sum() ** 2 / (h[part].sum() + l2) for part in (goes, ~goes))
    best = max(gain(x[:, j] <= v) for j in range(4) for v in range(7))
    root = m.roots[0]
    goes = x[:, m.feature[root]] <= m.threshold[root]
    assert gain(goes) == pytest.approx(best)
    for part, node in ((goes, m.left[root]), (~goes, m.left[root] + 1)):
        assert np.sign(m.value[node]) == -np.sign(g[part].sum())


def test_repeated_ids_are_learned_from_once(spark):
    from plantpulse.llm.common import prepare

    prepare(spark)
    docs = spark.createDataFrame([(i % 30, f"{'good words of prose ' * (i % 7 + 1)}{'!' * (i % 30 % 2 * 40)}{i // 30}")
                                  for i in range(240)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(0, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    stats = quality.document_statistics(docs)
    everyone = ~held_out("doc_id", 1, 1)
    assert quality.training_sample(labels, everyone).count() == 30
    a = quality.train(stats, labels, everyone)
    b = quality.train(stats.repartition(7), labels.repartition(3), everyone)
    assert (a.threshold == b.threshold).all() and (a.value == b.value).all() and a.base == b.base
    assert abs(a.base) < 0.2  # 30 ids, half of them 1


def test_degenerate_labels():
    x = np.ones((5, len(quality.FEATURES)))
    assert np.allclose(quality.fit_trees(x[:0], np.zeros(0)).score(x), 0.5)
    assert (quality.fit_trees(x, np.ones(5)).score(x) > 0.5).all()


def test_held_out_accuracy_and_folds(spark):
    from plantpulse.llm import QUERIES
    from tests.conftest import SF_MID

    got = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, SF_MID).collect()}
    labels = table(spark, SF_MID, "labels").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(held) > 30 and sum(p == q for p, q in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_odd_documents_and_filter(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (9, 0, 0), (10, 1, 0), (11, 1, 0), (11, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    everyone = ~held_out("doc_id", 1, 1)
    got = quality.quality_scores(odd_docs, labels, everyone).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(odd_docs, labels, everyone, threshold=0.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert quality.quality_scores(no_docs, labels.limit(0), everyone).count() == 0
