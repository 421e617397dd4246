import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantpulse.llm import ngram
from plantpulse.llm.common import held_out, prepare, texts
from plantpulse.llm.eliasfano import EliasFano

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@given(st.lists(st.integers(0, 2**64 - 1), max_size=80), st.sampled_from([2**64, 2**40, 1000, 100]))
@settings(max_examples=200, deadline=None)
def test_elias_fano(values, universe):
    v = np.array(sorted({x % universe for x in values}), np.uint64)
    e = EliasFano(EliasFano.encode(v, universe))
    assert (e.decode() == v).all() and (e.access(np.arange(len(v))) == v).all()
    asked = np.array(sorted({0, universe - 1, *v.tolist(), *[x % universe for x in values[:5]]}), np.uint64)
    a, b = e.access_pairs(np.arange(max(0, len(v) - 1)))
    assert universe > 2**62 or ((a == v[:-1].astype(np.int64)).all() and (b == v[1:].astype(np.int64)).all())
    place = {int(x): i for i, x in enumerate(v)}
    assert e.find(asked).tolist() == [place.get(int(x), -1) for x in asked]


def model(docs, order, d):
    """Interpolated absolute discounting by dictionaries; d: discount per level."""
    counts = [Counter() for _ in range(order)]
    for ws in docs:
        seq = ["<s>", *ws]
        for i in range(1, len(seq)):
            counts[0][(seq[i],)] += 1
            for k in range(2, order + 1):
                if i - k + 1 >= 0:
                    counts[k - 1][tuple(seq[i - k + 1:i + 1])] += 1
    total, vocab = sum(counts[0].values()), len(counts[0])
    fan, mass = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    for k in range(1, order):
        for g, c in counts[k].items():
            fan[k][g[:-1]] += 1
            mass[k][g[:-1]] += c

    def log_prob(ws):
        seq, out = ["<s>", *ws], 0.0
        for i in range(1, len(seq)):
            p = (counts[0][(seq[i],)] + 1) / (total + vocab + 1)
            for k in range(2, order + 1):
                if i - k + 1 < 0:
                    break
                g = tuple(seq[i - k + 1:i + 1])
                if mass[k - 1][g[:-1]]:
                    c = counts[k - 1][g]
                    p = (max(c - d[k], 0) if c else 0) / mass[k - 1][g[:-1]] + d[k] * fan[k - 1][g[:-1]] / mass[k - 1][g[:-1]] * p
            out += math.log10(p)
        return out
    return counts, total, vocab, log_prob


@pytest.mark.parametrize("most", [3, 2**32 - 1, 2**32, 5_000_000_000])
def test_counts_beyond_32_bits(most):
    keys, counts = np.array([5, 9, 70], np.uint64), np.array([1, most, 2], np.int64)
    level = ngram.Words(ngram.Words.build(keys, counts, 100))
    assert level.counts.tolist() == counts.tolist() and level.keys.decode().tolist() == keys.tolist()
    (block,) = ngram._blocks(np.array([0, 0, 1]), keys, counts, [0, 50], [50, 50])
    got = [ngram.stored_counts(c, EliasFano(k).n).tolist()
           for k, c in zip(block.column("keys").to_pylist(), block.column("counts").to_pylist())]
    assert got == [[1, most], [2]]
    assert ngram.stored_counts(ngram.count_bytes(counts[:0]), 0).tolist() == []


def test_keys_beyond_63_bits_are_refused(spark):
    trie = ngram.Trie(files=[[""], [""]], sizes=[np.array([10**9]), np.array([10**10])], ranges=1)
    with pytest.raises(OverflowError):
        ngram.add_level(trie, spark.createDataFrame([("a",)], "text string"), "unused")


def words(t):
    return [*WORD.findall((t or "").encode().lower()), None]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_dictionaries(spark, order, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(ngram, "shuffle_parts", lambda spark: 1)  # one range, one discount
    rng = np.random.default_rng(order)
    vocab = [f"w{i}" for i in range(40)] + ["É", "x,y"]
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(0, 30)), p=np.r_[np.full(20, 0.04), np.full(22, 0.2 / 22)])))
            for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trie = ngram.train(df.where("doc_id < 100"), order)
    train = [words(t) for i, t in rows if i < 100]
    d = {}
    for k in range(2, order + 1):
        n = Counter(model(train, order, {k: 0.5 for k in range(9)})[0][k - 1].values())
        d[k] = min(0.95, max(0.1, n[1] / max(1, n[1] + 2 * n[2])))
    counts, total, vocab_size, log_prob = model(train, order, d)
    for r in ngram.score(df, trie).collect():
        ws = words(rows[r.doc_id][1])
        assert r.n_tokens == len(ws) and r.n_known == sum(counts[0][(w,)] > 0 for w in ws) and r.train_tokens == total
        base = sum(math.log10((counts[0][(w,)] + 1) / (total + vocab_size + 1)) for w in ws)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base))
        assert abs(r.score - log_prob(ws)) < 1e-3 * len(ws)  # quantised


def test_ranges_change_only_discounts_and_mass_sums_to_one(spark):
    prepare(spark)
    rows = [(i, f"a b c d{i % 7} a c b{i % 3} a b") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trie = ngram.train(df, 2)
    number, count = ngram.word_numbers(trie, np.unique(np.concatenate([ngram.tokens(__import__("pyarrow").array([t]))[0] for _, t in rows])))
    assert sorted(number.tolist()) == list(range(trie.vocabulary)) and count.sum() == trie.total
    uni = (count[np.argsort(number)] + 1) / (trie.total + trie.vocabulary + 1)
    for parent in range(trie.vocabulary + 1):
        n = trie.vocabulary
        _, prob, back = ngram.children(trie, 2, np.full(n + 1, parent), np.r_[np.arange(n), -1])
        p = prob + back * np.r_[uni, 1 / (trie.total + trie.vocabulary + 1)]
        assert abs(p.sum() - 1) < 2e-3


def test_query_base_and_held_out_gain(spark):
    from plantpulse.llm import QUERIES
    from tests.conftest import SF_MID

    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    c = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total = sum(c.values())
    own = base = 0.0
    for r in QUERIES["op3_ngram_trie"](spark, SF_MID).collect():
        ws = docs[r.doc_id]
        want = sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws)
        assert abs(r.base_score - want) < 1e-6 * abs(want) and r.train_tokens == total
        assert r.n_tokens == len(ws) and r.n_known == sum(c[w] > 0 for w in ws)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        if r.held_out:
            own, base = own + r.score, base + r.base_score
    assert own > base


def test_odd_and_empty(spark, odd_docs, no_docs):
    docs = texts(odd_docs)
    got = {r.doc_id: r for r in ngram.score(docs, ngram.train(docs)).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 1 and got[9].n_tokens == 3001
    assert all(np.isfinite([r.score, r.base_score]).all() for r in got.values())
    nothing = ngram.train(texts(no_docs))
    assert {(r.n_known, r.train_tokens, r.score) for r in ngram.score(docs, nothing).collect()} == {(0, 0, 0.0)}
    assert ngram.score(texts(no_docs), nothing).count() == 0
    assert docs.where(held_out("doc_id", 7, 2)).count() >= 0
